"""Ordered recursions over one series held as an array: filters, smoothers and shortest paths.

A series has one entry per trading day, so its array is bounded by the calendar; the work is spread over
assets, penalties, state counts and restarts. Every recursion is a fold evaluated inside the JVM.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-300


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``; keeps loop invariants out of inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Gives long folds their own tasks.

    A series is small in bytes but long in work, so size-based coalescing would put many into one task; an
    explicit partition count keeps them apart.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def indices(k: Column) -> Column:
    return F.sequence(F.lit(0), k - 1)


def as_series(panel: DataFrame, col: str, by=("asset",)) -> DataFrame:
    """One row per key with the date-ordered arrays ``dates`` and ``x``."""
    packed = panel.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("date", F.col(col).alias("x")))).alias("_s"))
    return packed.select(*by, F.col("_s.date").alias("dates"), F.col("_s.x").alias("x"))


def explode_series(df: DataFrame, keep, **arrays: str) -> DataFrame:
    """Arrays of equal length back to one row per date."""
    zipped = F.arrays_zip(F.col("dates"), *[F.col(c).alias(n) for n, c in arrays.items()])
    names = ["dates", *arrays.values()]
    rows = df.select(*keep, F.explode(zipped).alias("_z"))
    fields = rows.schema["_z"].dataType.names
    return rows.select(*keep, F.col("_z").getField(fields[0]).alias("date"),
                       *[F.col("_z").getField(f).alias(n) for f, n in zip(fields[1:], arrays)])


def gaussian_losses(x: Column, means: Column, variances: Column) -> Column:
    """Negative log density of every observation under every state."""
    params = F.zip_with(means, variances, lambda m, v: F.struct(
        m.alias("m"), (F.lit(0.5) / v).alias("w"), (F.lit(0.5) * F.ln(F.lit(2 * pi) * v)).alias("c")))
    return let(params, lambda p: F.transform(x, lambda v: F.transform(p, lambda s: (v - s["m"]) * (v - s["m"]) * s["w"] + s["c"])))


def cholesky(matrix: Column) -> Column:
    """Lower factor of a positive definite matrix, as rows that end at the diagonal."""

    def row(done, i):
        def cell(own, j):
            other = F.when(j == i, own).otherwise(F.get(done, j))
            rest = F.element_at(F.element_at(matrix, i + 1), j + 1) - F.aggregate(
                F.zip_with(own, F.slice(other, 1, F.size(own)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            diagonal = F.sqrt(F.greatest(rest, F.lit(TINY)))
            return F.array_append(own, F.when(j == i, diagonal).otherwise(rest / F.element_at(F.get(done, j), -1)))

        return F.array_append(done, F.aggregate(F.sequence(F.lit(0), i), F.array().cast("array<double>"), cell))

    return F.aggregate(indices(F.size(matrix)), F.array().cast("array<array<double>>"), row)


def vector_losses(x: Column, means: Column, covariances: Column) -> Column:
    """Negative log density of every vector under every state with a full covariance.

    Each covariance is factored once; an observation costs one triangular solve per state.
    """
    def state(m, c):
        half_volume = lambda f: F.aggregate(f, F.lit(0.0), lambda s, r: s + F.ln(F.element_at(r, -1))) + F.size(m) * F.lit(0.5 * log(2 * pi))
        return let(cholesky(c), lambda f: F.struct(m.alias("m"), f.alias("f"), half_volume(f).alias("c")))

    def solve(v, s):
        def forward(z, r):
            done = F.aggregate(F.zip_with(z, F.slice(r, 1, F.size(z)), lambda a, b: a * b), F.lit(0.0), lambda t, u: t + u)
            at = F.size(z) + 1
            return F.array_append(z, (F.element_at(v, at) - F.element_at(s["m"], at) - done) / F.element_at(r, -1))

        return F.aggregate(s["f"], F.array().cast("array<double>"), forward)

    squares = lambda z: F.aggregate(z, F.lit(0.0), lambda t, u: t + u * u)
    return let(F.zip_with(means, covariances, state), lambda p: F.transform(x, lambda v: F.transform(p, lambda s: squares(solve(v, s)) / 2 + s["c"])))


#: Entries of a history that are appended to one by one; histories are arrays of such pieces until they end.
PIECE = 64


def scan(items: Column, first: Column, step) -> Column:
    """All intermediate states of a fold: ``step(previous state, item)`` for items after the first.

    An append copies what it appends to, so a history grows in pieces of bounded size, which are joined at the end.
    """
    rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1)))
    pieces = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(r) / PIECE).cast("int") - 1, F.lit(0))), lambda i: F.slice(r, i * PIECE + 1, F.lit(PIECE)))
    grow = lambda last, piece: F.slice(F.aggregate(piece, F.array(last), lambda acc, item: F.array_append(acc, step(F.element_at(acc, -1), item))), F.lit(2), F.greatest(F.size(piece), F.lit(1)))
    history = F.aggregate(
        F.filter(let(rest, pieces), lambda piece: F.size(piece) > 0), F.array(F.array(first)), lambda acc, piece: F.array_append(acc, grow(F.element_at(F.element_at(acc, -1), -1), piece)))
    return F.flatten(history)


def _first_min(v: Column) -> Column:
    return F.array_position(v, F.array_min(v)).cast("int") - 1


def _first_max(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def _walk_back(history: Column, last: Column) -> Column:
    """Follows the ``back`` pointers of a scan from its last state to its first."""
    pointers = F.reverse(F.transform(F.slice(history, 2, F.greatest(F.size(history) - 1, F.lit(1))), lambda s: s["back"]))
    return F.reverse(F.aggregate(
        pointers, F.array(last), lambda acc, b: F.array_append(acc, F.element_at(b, F.element_at(acc, -1) + 1))))


def jump_path(losses: Column, penalty: Column) -> Column:
    """Exact minimum of summed losses plus a penalty per switch: struct(path, objective, online).

    Staying is compared with the cheapest other state, so a step costs K and not K squared. ``online`` is
    the state that is best at each step given only the past.
    """

    def step(prev, loss):
        v = prev["v"]
        ranked = let(F.array_min(v), lambda m1: let(
            F.array_position(v, m1).cast("int") - 1,
            lambda j1: let(
                F.coalesce(F.array_min(F.filter(v, lambda _, i: i != j1)), m1),
                lambda m2: F.struct(m1.alias("m1"), j1.alias("j1"), m2.alias("m2"), F.coalesce(
                    F.get(F.filter(F.transform(v, lambda x, i: F.when((i != j1) & (x == m2), i)), lambda i: i.isNotNull()), 0), j1
                ).alias("j2")),
            ),
        ))

        def advance(r):
            jump = lambda i: penalty + F.when(i == r["j1"], r["m2"]).otherwise(r["m1"])
            back = F.transform(v, lambda x, i: F.when(x <= jump(i), i).when(i == r["j1"], r["j2"]).otherwise(r["j1"]))
            value = F.zip_with(F.transform(v, lambda x, i: F.least(x, jump(i))), loss, lambda a, b: a + b)
            return F.struct(value.alias("v"), back.alias("back"))

        return let(ranked, advance)

    first = F.struct(F.element_at(losses, 1).alias("v"), F.array().cast("array<int>").alias("back"))

    def trace(h):
        v = F.element_at(h, -1)["v"]
        return F.struct(
            _walk_back(h, _first_min(v)).alias("path"), F.array_min(v).alias("objective"),
            F.transform(h, lambda s: _first_min(s["v"])).alias("online"))

    return let(scan(losses, first, step), trace)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def transpose(matrix: Column, k: Column) -> Column:
    return F.transform(indices(k), lambda j: F.transform(matrix, lambda row: F.element_at(row, j + 1)))


def forward_filter(losses: Column, start: Column, columns: Column) -> Column:
    """Causal state probabilities: struct(p, loglik). ``columns`` is the transposed transition matrix."""

    def update(prior, loss):
        return let(F.array_min(loss), lambda m: let(
            F.zip_with(prior, loss, lambda p, q: p * F.exp(m - q)),
            lambda w: let(_total(w), lambda s: F.struct(F.transform(w, lambda v: v / s).alias("a"), (F.ln(s) - m).alias("ll")))))

    def step(prev, loss):
        return let(F.transform(columns, lambda c: _dot(prev["a"], c)), lambda prior: update(prior, loss))

    history = scan(losses, update(start, F.element_at(losses, 1)), step)
    return let(history, lambda h: F.struct(
        F.transform(h, lambda s: s["a"]).alias("p"), F.aggregate(h, F.lit(0.0), lambda acc, s: acc + s["ll"]).alias("loglik")))


def backward_weights(losses: Column, matrix: Column) -> Column:
    """Scaled backward variables, one array per observation in time order."""

    def step(acc, loss):
        scaled = let(F.array_min(loss), lambda m: F.zip_with(F.element_at(acc, -1), loss, lambda b, q: b * F.exp(m - q)))
        raw = let(scaled, lambda w: F.transform(matrix, lambda row: _dot(row, w)))
        return F.array_append(acc, let(raw, lambda v: let(_total(v), lambda s: F.transform(v, lambda x: x / s))))

    ones = F.transform(F.element_at(losses, 1), lambda _: F.lit(1.0))
    return F.reverse(F.aggregate(F.reverse(F.slice(losses, 2, F.greatest(F.size(losses) - 1, F.lit(1)))), F.array(ones), step))


def smoothed(filtered: Column, backward: Column) -> Column:
    """State probabilities given the whole series."""
    return F.zip_with(filtered, backward, lambda a, b: let(
        F.zip_with(a, b, lambda p, q: p * q), lambda w: let(_total(w), lambda s: F.transform(w, lambda v: v / s))))


def viterbi(losses: Column, start: Column, columns: Column) -> Column:
    """Most likely state path under a Markov chain; ``columns`` is the transposed transition matrix."""
    floor = lambda p: F.ln(F.greatest(p, F.lit(TINY)))

    def walk(lc):
        def step(prev, loss):
            scores = F.transform(lc, lambda c: F.zip_with(prev["v"], c, lambda a, b: a + b))
            return let(scores, lambda s: F.struct(
                F.zip_with(F.transform(s, lambda r: F.array_max(r)), loss, lambda a, b: a - b).alias("v"),
                F.transform(s, _first_max).alias("back")))

        v0 = F.zip_with(F.transform(start, floor), F.element_at(losses, 1), lambda a, b: a - b)
        return scan(losses, F.struct(v0.alias("v"), F.array().cast("array<int>").alias("back")), step)

    history = let(F.transform(columns, lambda c: F.transform(c, floor)), walk)
    return let(history, lambda h: _walk_back(h, _first_max(F.element_at(h, -1)["v"])))


def exponential_sums(x: Column, decay: Column) -> Column:
    """B_t = decay * B_(t-1) + x_(t-1), B_0 = 0, one value per observation."""
    return F.slice(F.aggregate(
        x, F.array(F.lit(0.0)), lambda acc, v: F.array_append(acc, decay * F.element_at(acc, -1) + v)), 1, F.size(x))
