"""Secret scans: fixed patterns, and a battery of randomness tests that finds random strings no pattern names.

Everything is DataFrame expressions. Where a pattern matches, a text is split at its matches; lengths of the pieces
between them become rows, and running sums per text turn them into places, so the text itself is never shuffled.

Added spans. A candidate is a long run of characters that encodings use. The smallest alphabet that holds it is its encoding.
Its tests under "characters are drawn evenly from that alphabet": chi-squared of the counts, runs above and below the
alphabet's middle, serial correlation of neighbours. A candidate stays if none of them speaks against it. Short words pass
such tests too, so it must also be unlike ordinary text: the number of equal pairs and of runs is compared with characters
drawn by the law that all texts have within the same alphabet, whose moments depend on the length. False discoveries are
controlled by the step-up rule within each class of lengths, so that many short strings don't decide about the long ones.
Normal scores are rounded down to sixteenths, which makes the rule a count per grid point: it merges like any other sum,
errs on the careful side, and needs no sorted list of all candidates.
"""

from __future__ import annotations

from math import erfc, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm import common

#: Base patterns in the order in which kinds are listed: kind, pattern, group that is measured, least length of it.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: Candidates of the test battery; trailing signs of equality are padding.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST_LENGTH = 20
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet up; the first that holds a candidate is its encoding.
ENCODINGS = tuple(
    (name, "".join(sorted(letters)))
    for name, letters in (
        ("hex", DIGITS + "abcdef"),
        ("HEX", DIGITS + "ABCDEF"),
        ("lower", LOWER),
        ("upper", UPPER),
        ("base32", "234567" + UPPER),
        ("base36", DIGITS + LOWER),
        ("base62", DIGITS + LOWER + UPPER),
        ("base64", "+/" + DIGITS + LOWER + UPPER),
        ("base64url", "-_" + DIGITS + LOWER + UPPER),
        ("any", "+/-_" + DIGITS + LOWER + UPPER),
    )
)
#: Chance that an evenly drawn string is given up, over the three tests; share of added spans that may be ordinary text.
LEVEL, FALSE_SHARE = 0.001, 0.01
ONE_SIDED, TWO_SIDED = NormalDist().inv_cdf(1 - LEVEL / 3), NormalDist().inv_cdf(1 - LEVEL / 6)
#: Grid of normal scores: steps a unit, and the last grid point, which stands for everything beyond.
STEPS, LAST_STEP = 16, 160
TAILS = [erfc(b / STEPS / sqrt(2)) / 2 for b in range(LAST_STEP + 1)]


def _matches(text: str, kind: str, pattern: str, group: int, least: int) -> Column:
    """What a pattern finds, in order: (kind, place, gap before it, size, whether it counts, its text if it is a candidate)."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("cores"))
    shape = "array<struct<kind: string, place: int, gap: int, size: int, counts: boolean, token: string>>"

    def row(x: Column, at: Column) -> Column:
        token = x["hits"][at] if kind == "random" else F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"),
            at.cast("int").alias("place"),
            F.length(x["gaps"][at]).alias("gap"),
            F.length(x["hits"][at]).alias("size"),
            (F.length(x["cores"][at]) >= least).alias("counts"),
            token.alias("token"),
        )

    # A list of one lets the three arrays be made once and read by place.
    rows = F.flatten(F.transform(F.array(parts), lambda x: F.transform(F.sequence(F.lit(0), F.size(x["hits"]) - 1), lambda at: row(x, at))))
    return F.when(F.col(text).rlike(pattern), rows.cast(shape)).otherwise(F.array().cast(shape))


def matches(docs: DataFrame) -> DataFrame:
    """_row (a number of its own for each row), doc_id and found: matches of all patterns. Null text has none."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = F.concat(*(_matches("text", *p) for p in (*BASE, ("random", CANDIDATE, 0, LEAST_LENGTH))))
    return rows.select(F.monotonically_increasing_id().alias("_row"), "doc_id", found.alias("found"))


def text_law(docs: DataFrame) -> DataFrame:
    """One row per encoding: chance that two, and three, characters of ordinary text within its alphabet are equal, and that one lies in its lower half.

    Ordinary is all text outside candidates. Alphabets of one case take letters of either case as their own.
    """
    ordinary = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), CANDIDATE, "")
    letters = docs.select(F.explode(F.split(ordinary, "")).alias("letter")).groupBy("letter").agg(F.count("*").cast("double").alias("n"))
    letters = letters.where(F.length("letter") == 1)
    of = F.array(*(F.struct(F.lit(name).alias("encoding"), F.lit(a).alias("alphabet")) for name, a in ENCODINGS))
    rows = letters.select("letter", "n", F.explode(of).alias("e")).select("letter", "n", "e.*")
    other = F.translate("letter", LOWER + UPPER, UPPER + LOWER)
    own, swapped = F.call_function("instr", "alphabet", "letter"), F.call_function("instr", F.col("alphabet"), other)
    rows = rows.withColumn("at", F.when(own > 0, own).otherwise(swapped)).where("at > 0")
    rows = rows.groupBy("encoding", "alphabet", "at").agg(F.sum("n").alias("n"))
    total = F.sum("n")
    return rows.groupBy("encoding").agg(
        (F.sum(F.col("n") * F.col("n")) / (total * total)).alias("two"),
        (F.sum(F.col("n") * F.col("n") * F.col("n")) / (total * total * total)).alias("three"),
        (F.sum(F.when(2 * F.col("at") <= F.length("alphabet"), F.col("n")).otherwise(0.0)) / total).alias("low"),
    )


def places(found: DataFrame) -> DataFrame:
    """One row per match that counts: _row, doc_id, kind, start, end (code points, end exclusive), token; candidates that overlap a base span go."""
    rows = found.select("_row", "doc_id", F.explode("found").alias("m")).select("_row", "doc_id", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.where("counts").withColumn("base", F.col("kind") != "random")
    by_start = Window.partitionBy("_row").orderBy("start", F.col("base").desc(), "kind")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"_before": before, "_after": after})
    free = (F.coalesce(F.col("_before"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_after"), F.col("end")) >= F.col("end"))
    return rows.where(F.col("base") | free).select("_row", "doc_id", "kind", "start", "end", "token")


def battery(spans: DataFrame, law: DataFrame) -> DataFrame:
    """Adds to candidates: length_class, even (no test speaks against even draws) and score (steps by which they are unlike text)."""
    rows = spans.withColumn("core", F.rtrim(F.col("token"), F.lit("="))).withColumn("n", F.length("core").cast("double"))
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, letters in reversed(ENCODINGS):
        fits = F.translate("core", letters, "") == ""
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(letters)).otherwise(alphabet)
    rows = rows.withColumns({"encoding": encoding, "alphabet": alphabet, "letters": F.split("core", "")})
    times = F.transform(F.array_distinct("letters"), lambda a: F.col("n") - F.length(F.replace(F.col("core"), a, F.lit(""))))
    # Twice the place less the middle: whole numbers, symmetric about zero.
    centred = F.transform("letters", lambda a: 2 * F.call_function("instr", F.col("alphabet"), a) - 1 - F.length("alphabet"))
    rows = rows.withColumns({"times": times, "u": centred, "k": F.length("alphabet").cast("double")})
    steps = F.size("u") - 1
    ahead, behind = F.slice("u", F.lit(2), steps), F.slice("u", F.lit(1), steps)
    turned = F.aggregate(F.zip_with(ahead, behind, lambda a, b: ((a > 0) != (b > 0)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    product = F.aggregate(F.zip_with(ahead, behind, lambda a, b: (a * b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    pairs = F.aggregate("times", F.lit(0.0), lambda s, x: s + x * (x - 1) / 2)
    rows = rows.withColumns({"pairs": pairs, "turned": turned.cast("double"), "product": product.cast("double")})
    rows = rows.join(F.broadcast(law), "encoding", "left")  # a row per encoding
    n, k, d = F.col("n"), F.col("k"), 2 * F.col("low") * (1 - F.col("low"))
    square = (k / n * (2 * F.col("pairs") + n) - n) / (k - 1)
    spread = 2 / (9 * (k - 1))
    uneven = (F.cbrt(square) - (1 - spread)) / F.sqrt(spread)
    runs = (2 * F.col("turned") - (n - 1)) / F.sqrt(n - 1)
    serial = 3 * F.col("product") / ((k * k - 1) * F.sqrt(n - 1))
    two, three = F.col("two"), F.col("three")
    pairs_spread = F.sqrt(F.greatest(n * (n - 1) / 2 * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two), F.lit(1.0)))
    turned_spread = F.sqrt(F.greatest((n - 1) * d * (1 - d) + 2 * (n - 2) * (d / 2 - d * d), F.lit(1.0)))
    unlike = ((n * (n - 1) / 2 * two - F.col("pairs")) / pairs_spread + (F.col("turned") - (n - 1) * d) / turned_spread) / sqrt(2)
    return rows.select(
        *spans.columns,
        F.floor(F.log2("n")).cast("int").alias("length_class"),
        ((uneven <= ONE_SIDED) & (F.abs(runs) <= TWO_SIDED) & (F.abs(serial) <= TWO_SIDED)).alias("even"),
        F.least(F.greatest(F.floor(STEPS * unlike), F.lit(0)), F.lit(LAST_STEP)).cast("int").alias("score"),
    )


def cutoffs(tested: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """The least score per class of lengths at which the step-up rule still holds; classes without one are absent."""
    counts = tested.where("kind = 'random'").groupBy("length_class", "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.col("score").desc())
    all_of = Window.partitionBy("length_class")
    counts = counts.withColumns({"above": F.sum("n").over(down), "tests": F.sum("n").over(all_of)})
    tail = F.element_at(F.array(*(F.lit(p) for p in TAILS)), F.col("score") + 1)
    return counts.where(F.col("tests") * tail <= false_share * F.col("above")).groupBy("length_class").agg(F.min("score").alias("cutoff"))


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row of docs (doc_id, text).

    A span is a whole match, as kind:start:end in code points with the end exclusive; `spans` lists base and added ones by
    start, then kind (assign, access, hex, random). Rows with null, empty or clean text have zeros and empty lists; repeated
    rows and null ids are judged row by row; other columns are left aside; an empty table gives no rows.
    """
    found = common.materialise(matches(docs))
    tested = common.materialise(battery(places(found), text_law(docs)))
    limits = cutoffs(tested, false_share)  # a row per class of lengths, at most 31
    rows = tested.join(F.broadcast(limits), "length_class", "left")
    kinds = [p[0] for p in BASE]
    order = F.array_position(F.array(*(F.lit(k) for k in [*kinds, "random"])), F.col("kind"))
    rows = rows.withColumn("base", F.col("kind") != "random").where(F.col("base") | (F.col("even") & (F.col("score") >= F.col("cutoff"))))
    span = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("said"))

    def listed(which: Column) -> Column:
        return F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(which, span))), lambda x: x["said"]))

    counts = {f"n_{k}": F.count(F.when(F.col("kind") == k, 1)) for k in [*kinds, "random"]}
    summed = rows.groupBy("_row").agg(*(c.alias(name) for name, c in counts.items()), listed(F.col("base")).alias("_base"), listed(F.lit(True)).alias("_all"))
    out = found.select("_row", "doc_id").join(summed, "_row", "left")
    zero = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds]
    return out.select(
        "doc_id",
        *zero,
        F.sha2(F.coalesce(F.col("_base"), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(F.col("_all"), F.lit("")).alias("spans"),
        F.coalesce(F.col("n_random"), F.lit(0)).cast("long").alias("n_random"),
    )
