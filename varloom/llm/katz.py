"""Katz backoff language model: Good-Turing discounted bigrams over unigrams, exactly normalised, scored in place.

Model, over the tokens of training documents (words, then one end per document; `begin` precedes the first):

    P(w)     = discounted(c(w)) / N, and for all unseen words together what is left
    P(w | h) = discounted(c(h, w)) / c(h)         if c(h, w) > 0
             = alpha(h) * P(w)                    else; alpha(h) = 1 if c(h) = 0
    alpha(h) = (1 - sum of P(w | h)) / (1 - sum of P(w)), both over the w seen after h

Counts up to CUTOFF are discounted by Good-Turing, higher ones by the constant LESS, so every history keeps
some mass for what it hasn't seen. Where Good-Turing gives no factor between 0 and 1, LESS applies as well.

A token needs c(h, w), c(w), c(h) and alpha(h). Bigrams with the tokens that are to be scored are dealt by w:
there c(h, w), c(w) and P(w) are known, and what each document gets of them is summed. A document's factors
1 / c(h) are those of its own words, since a word is the history of the token after it. Only unseen bigrams
(of held-out documents) need alpha(h): they meet the sums of their history, dealt by h. Frequent words and
histories are pre-aggregated where texts are read. The tables stay in the shared folder, split by kind.

A word of HOT_TIMES occurrences or more would fill a bucket: its count is told to all tasks, and its bigrams are
dealt by (h, w). Bigrams of two such words that are as frequent are counted first and told as well, so their
occurrences are summed per document where the texts are read and never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import common
from varloom.llm.langid import held_out

CUTOFF = 5
LESS = 0.5
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
FLUSH_BYTES = 32 << 20
#: Documents sent together: their numbers fit in 15 bits, the 16th says whether they train.
FLUSH_DOCS = 32_000
#: Entries of summed values that a task holds before it sends them on.
HELD_ENTRIES = 4_000_000
#: Occurrences, in all documents, from which a word or bigram is hot.
HOT_TIMES = 1_000_000


def factors(counts_of_counts: dict[int, int]) -> np.ndarray:
    """Discount factor of counts 0 to CUTOFF (place 0 is unused), from how many types have each count."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, CUTOFF + 2)]
    out = np.array([1.0] + [(r - LESS) / r for r in range(1, CUTOFF + 1)])
    common_part = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        if n[r] and common_part < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common_part) / (1 - common_part)
            if 0 < d < 1:
                out[r] = d
    return out


def discounted(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return np.where(counts > CUTOFF, counts - LESS, counts * factor[np.minimum(counts, CUTOFF)])


@dataclass
class Unigrams:
    tokens: int
    types: int
    factor: np.ndarray
    unseen: float  # probability of all unseen words together

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.factor) / max(1, self.tokens), self.unseen)


@dataclass
class Hot:
    """Hot words with their counts in training documents, by word; hot bigrams that training documents have, by key."""

    word: np.ndarray
    n: np.ndarray
    key: np.ndarray
    pair_word: np.ndarray
    pair_history: np.ndarray
    pair_n: np.ndarray

    def of_pair_words(self) -> np.ndarray:
        return self.n[np.searchsorted(self.word, self.pair_word)]


def _find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the known (sorted) ones, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def _pair_key(word: np.ndarray, history: np.ndarray) -> np.ndarray:
    return common.mix(word ^ common.mix(history))


def _terms(count: np.ndarray, of_word: np.ndarray, word: np.ndarray, uni: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(w), and what an occurrence of each bigram adds to base and score."""
    share = uni.probability(of_word)
    with np.errstate(divide="ignore"):
        seen_log = np.log10(np.where(count > CUTOFF, count - LESS, count))
        own = np.where((of_word > 0) & (word != END), np.log10(np.maximum(of_word, 1)), 0.0)
    return share, np.log10(of_word + 1.0), np.where(count > 0, seen_log, np.log10(share)) - own


def _row_sums(name: np.ndarray, kinds: np.ndarray, count: np.ndarray, of_word: np.ndarray, base: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row names, their sums of base and score, and their counts of known words and seen bigrams by count."""
    turn = np.argsort(name, kind="stable")
    name, kinds = name[turn], kinds[turn]
    at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    sums = np.stack([np.add.reduceat(base[kinds], at), np.add.reduceat(score[kinds], at)], axis=1)
    c = count[kinds]
    flags = [of_word[kinds] > 0, *(c == r for r in range(1, CUTOFF + 1))]
    return name[at], sums, np.stack([np.add.reduceat(f, at, dtype=np.uint32) for f in flags], axis=1)


def _tokens(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows with ends, their histories, and the tokens of each row."""
    word, per_row = common.words(*common.text_bytes(chunk.column("text")))
    size = per_row + 1
    token = np.full(len(word) + len(size), END, np.uint64)
    inner = np.ones(len(token), bool)
    ends = np.cumsum(size) - 1
    inner[ends] = False
    token[inner] = word
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[ends - per_row] = BEGIN
    return token, history, size


def _unigram_counts(rows: DataFrame, n_buckets: int, hot_times: int) -> DataFrame:
    """Blobs (word, count) by word bucket, pre-aggregated per task; then one blob per bucket.

    Hot words stand once more in buckets below 0. Counts are those of training documents, hot is whatever
    occurs often in all documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, train = (np.concatenate([x[i] for x in held]) for i in range(2))
            (word, n), (other, m) = (np.unique(token[x], return_counts=True) for x in (train, ~train))
            none = np.zeros
            columns = {"word": np.concatenate([word, other]), "n": np.concatenate([n, none(len(m))]), "m": np.concatenate([none(len(n)), m])}
            bucket = (common.mix(columns["word"]) % np.uint64(n_buckets)).astype(np.int32)
            return common.deal(bucket, {c: x if c == "word" else x.astype(np.uint32) for c, x in columns.items()})

        for chunk in common.text_chunks(batches):
            token, _, per_row = _tokens(chunk)
            held.append((token, np.repeat(~chunk.column("held_out").to_numpy(zero_copy_only=False), per_row)))
            size += len(token)
            if size >= HELD_ENTRIES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in common.buckets(batches, {"word": np.uint64, "n": np.uint32, "m": np.uint32}):
            word, at = np.unique(got["word"], return_inverse=True)
            n, m = (np.bincount(at, got[c]).astype(np.int64) for c in ("n", "m"))
            for number, these in ((bucket, n > 0), (-1 - bucket, n + m >= hot_times)):
                yield common.deal(np.full(int(these.sum()), number, np.int32), {"word": word[these], "n": n[these]})

    blobs = rows.select("text", "held_out").mapInArrow(count, common.blob_schema("word", "n", "m"))
    return common.by_bucket(blobs).mapInArrow(add, common.blob_schema("word", "n"))


def _hot(rows: DataFrame, table: DataFrame, n_buckets: int, hot_times: int) -> Hot:
    """Hot words of the table of words, and from the texts the hot ones among their bigrams.

    All tokens together are at least `hot_times` for each hot word or bigram, so there are few.
    """

    def joined(blobs: DataFrame, **dtypes: type) -> list[np.ndarray]:
        got = blobs.collect()
        return [np.frombuffer(b"".join(x[c] for x in got), t) for c, t in dtypes.items()]

    word, n = joined(table.where("bucket < 0").select("word", "n"), word=np.uint64, n=np.int64)
    order = np.argsort(word)
    word, n = word[order], n[order]
    none = np.zeros(0, np.uint64)
    if not len(word):
        return Hot(word, n, none, none, none, np.zeros(0, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, history, train = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((history, token))
            token, history, train = token[order], history[order], train[order]
            at = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (history[1:] != history[:-1])]))
            m, n = np.diff(np.concatenate([at, [len(token)]])), np.add.reduceat(train.astype(np.int64), at)
            token, history = token[at], history[at]
            bucket = (_pair_key(token, history) % np.uint64(n_buckets)).astype(np.int32)
            return common.deal(bucket, {"word": token, "history": history, "n": n.astype(np.uint32), "m": m.astype(np.uint32)})

        for chunk in common.text_chunks(batches):
            token, history, per_row = _tokens(chunk)
            train = np.repeat(~chunk.column("held_out").to_numpy(zero_copy_only=False), per_row)
            these = _find(word, token)[0]
            these[these] = _find(word, history[these])[0] | (history[these] == BEGIN)
            if these.any():
                held.append((token[these], history[these], train[these]))
                size += len(held[-1][0])
            if size >= HELD_ENTRIES // 4:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in common.buckets(batches, {"word": np.uint64, "history": np.uint64, "n": np.uint32, "m": np.uint32}):
            key, first, at = np.unique(_pair_key(got["word"], got["history"]), return_index=True, return_inverse=True)
            n, m = (np.bincount(at, got[c]).astype(np.int64) for c in ("n", "m"))
            these = (m >= hot_times) & (n > 0)
            columns = {"key": key[these], "word": got["word"][first][these], "history": got["history"][first][these], "n": n[these]}
            yield common.deal(np.full(int(these.sum()), bucket, np.int32), columns)

    blobs = rows.select("text", "held_out").mapInArrow(count, common.blob_schema("word", "history", "n", "m"))
    pairs = common.by_bucket(blobs).mapInArrow(add, common.blob_schema("key", "word", "history", "n")).drop("bucket")
    columns = joined(pairs, key=np.uint64, word=np.uint64, history=np.uint64, n=np.int64)
    order = np.argsort(columns[0])
    return Hot(word, n, *(c[order] for c in columns))


def _unigrams(table: DataFrame) -> Unigrams:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in common.buckets(batches, {"n": np.int64}):
            n = got["n"]
            few = np.bincount(np.minimum(n, CUTOFF + 1), minlength=CUTOFF + 2)
            exact = [int((n == CUTOFF + 1).sum()) if r == CUTOFF + 1 else int(few[r]) for r in range(1, CUTOFF + 2)]
            row = [int(n.sum()), len(n), int(n[n > CUTOFF].sum()), int((n > CUTOFF).sum()), *exact]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=names)

    names = ["tokens", "types", "big", "n_big", *(f"n{r}" for r in range(1, CUTOFF + 2))]
    rows = table.where("bucket >= 0").select("bucket", "n").mapInArrow(sums, ", ".join(f"{c} bigint" for c in names))
    got = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first()
    factor = factors({r: got[f"n{r}"] for r in range(1, CUTOFF + 2)})
    used = sum(r * factor[r] * got[f"n{r}"] for r in range(1, CUTOFF + 1)) + got["big"] - LESS * got["n_big"]
    unseen = 1 - used / got["tokens"] if got["tokens"] else 1.0
    return Unigrams(got["tokens"], got["types"], factor, unseen)


EVENTS = ("word", "types", "history", "times", "rows", "row_key", "n_tokens")


def _events(rows: DataFrame, uni: Unigrams, hot: Hot, n_buckets: int) -> DataFrame:
    """Blobs by word bucket: words, types of each, their histories, occurrences of each type, and the rows they are in.

    A row (document) is named by the flush it was sent in and its number there; blobs in buckets below 0 tell
    the key and length of each, and in the first four columns row numbers, bases, scores and counts of hot bigrams.
    """
    hot_of_word = hot.of_pair_words()
    _, hot_base, hot_score = _terms(hot.pair_n, hot_of_word, hot.pair_word, uni)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = docs = 0
        # No two flushes have one name, whatever rows are in them; a task that is run again gives the same names.
        names_left = (int(common.mix(np.array([TaskContext.get().partitionId() << 32 | i], np.uint64))[0].view(np.int64)) for i in count())

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([x[3] for x in held])
            name = next(names_left)
            sizes = np.concatenate([x[4] for x in held]).astype(np.int64)
            sums = [x[6] for x in held if x[6]]
            done = [np.concatenate(x).tobytes() for x in zip(*sums, strict=True)] if sums else [b""] * 4
            columns = [[x[i] for x in held] for i in (0, 1, 2, 5)]
            held.clear()
            token, history, row, bucket = (np.concatenate(columns.pop(0)) for _ in range(4))
            names = ["bucket", *EVENTS, "flush"]
            told_rows = [pa.array([x], pa.binary()) for x in (*done, b"", keys.tobytes(), sizes.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - abs(name) % n_buckets], pa.int32()), *told_rows, pa.array([name], pa.int64())], names=names)
            if not len(token):
                return
            order = np.lexsort((history, token, bucket))
            token, history, row, bucket = token[order], history[order], row[order], bucket[order]
            new_word = np.ones(len(token), bool)
            new_word[1:] = (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])
            new_type = new_word.copy()
            new_type[1:] |= history[1:] != history[:-1]
            type_at = np.flatnonzero(new_type)
            word_at = np.flatnonzero(new_word)
            times = np.diff(np.concatenate([type_at, [len(token)]]))
            types = np.add.reduceat(new_type.astype(np.int64), word_at)
            n_blobs = len(np.unique(bucket))
            parts = {
                "word": common.deal(bucket[word_at], {"word": token[word_at], "types": types.astype(np.uint32)}),
                "type": common.deal(bucket[type_at], {"history": history[type_at], "times": times.astype(np.uint32)}),
                "row": common.deal(bucket, {"rows": row}),
            }
            empty = pa.array([b""] * n_blobs, pa.binary())
            columns = [parts["word"].column(0), *parts["word"].columns[1:], *parts["type"].columns[1:], *parts["row"].columns[1:], empty, empty]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * n_blobs, pa.int64())], names=names)

        def sent(token: np.ndarray, history: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
            """Tokens without those of hot bigrams, their histories, rows and buckets; what the hot bigrams add to rows."""
            spread, done = _find(hot.word, token)[0], []
            if len(hot.key) and spread.any():
                told, kinds = np.zeros(len(token), bool), np.zeros(len(token), np.int64)
                told[spread], kinds[spread] = _find(hot.key, _pair_key(token[spread], history[spread]))
                told[told] = (hot.pair_word[kinds[told]] == token[told]) & (hot.pair_history[kinds[told]] == history[told])
                if told.any():
                    number, sums, counts = _row_sums(row[told] & np.uint16(0x7FFF), kinds[told], hot.pair_n, hot_of_word, hot_base, hot_score)
                    done = [number, sums[:, 0], sums[:, 1], counts.ravel()]
                    token, history, row, spread = token[~told], history[~told], row[~told], spread[~told]
            bucket = (common.mix(token) % np.uint64(n_buckets)).astype(np.int32)
            bucket[spread] = _pair_key(token[spread], history[spread]) % np.uint64(n_buckets)
            return token, history, row, bucket, done

        for chunk in common.text_chunks(batches):
            if docs + chunk.num_rows > FLUSH_DOCS and held:
                yield from flush()
                held, size, docs = [], 0, 0
            for part in (chunk.slice(i, FLUSH_DOCS) for i in range(0, chunk.num_rows, FLUSH_DOCS)):
                token, history, per_row = _tokens(part)
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                number = (docs + np.arange(len(per_row))).astype(np.uint16) | (train.astype(np.uint16) << np.uint16(15))
                token, history, row, bucket, done = sent(token, history, np.repeat(number, per_row))
                held.append((token, history, row, part.column("row_key").to_numpy(zero_copy_only=False), per_row, bucket, done))
                size += 6 * len(token)
                docs += len(per_row)
                if size >= FLUSH_BYTES or docs + FLUSH_DOCS // 8 > FLUSH_DOCS:
                    yield from flush()
                    held, size, docs = [], 0, 0
        if held:
            yield from flush()

    return rows.select("text", "held_out", "row_key").mapInArrow(run, common.blob_schema(*EVENTS) + ", flush bigint")


PARTS = ("a", "b", "c", "d", "e")
STATS = tuple(f"m{r}" for r in range(1, CUTOFF + 2))


def _by_word(events: DataFrame, uni: Unigrams, hot: Hot, n_buckets: int) -> DataFrame:
    """What word buckets know, by kind:

    doc: by flush, for each row number (a) the sums base (b), score (c), and counts: known words and seen bigrams by count (d).
    hist: by history (a), the bigrams by count 1 to CUTOFF and the higher ones (b), and the sum of P(w) (c); where
        c is not a number, b holds flush and row number of a bigram that wasn't seen.
    stat: bigram types by count (a). rows: by flush, keys (a) and lengths (b) of the rows.
    """
    def send(bucket: np.ndarray, kind: str, **columns: np.ndarray) -> pa.RecordBatch:
        flush = columns.pop("flush", None)
        dealt = common.deal(bucket, columns)
        n = dealt.num_rows
        filler = [pa.array([b""] * n, pa.binary())] * (len(PARTS) - len(columns))
        flushes = pa.array(np.full(n, 0 if flush is None else flush, np.int64))
        names = ["bucket", *PARTS, "flush", "kind"]
        return pa.RecordBatch.from_arrays([*dealt.columns, *filler, flushes, pa.array([kind] * n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_docs: list[tuple] = []
        held_hist: list[tuple] = []
        held_lost: list[tuple] = []
        stat = np.zeros(CUTOFF + 2, np.int64)

        def send_docs() -> Iterator[pa.RecordBatch]:
            flush, number, sums, counts = (np.concatenate([x[i] for x in held_docs]) for i in range(4))
            order = np.lexsort((number, flush))
            flush, number = flush[order], number[order]
            new = np.ones(len(flush), bool)
            new[1:] = (flush[1:] != flush[:-1]) | (number[1:] != number[:-1])
            at = np.flatnonzero(new)
            sums, counts = np.add.reduceat(sums[order], at, axis=0), np.add.reduceat(counts[order], at, axis=0, dtype=np.uint32)
            flush, number = flush[at], number[at]
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], flush[1:] != flush[:-1]])), [len(flush)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                bucket = np.full(b - a, abs(int(flush[a])) % n_buckets, np.int32)
                row = {"a": number[a:b], "b": sums[a:b, 0], "c": sums[a:b, 1], "d": np.ascontiguousarray(counts[a:b]).view(f"V{4 * (CUTOFF + 1)}").ravel()}
                yield send(bucket, "doc", flush=flush[a], **row)

        def send_hist() -> pa.RecordBatch:
            history, count, share = (np.concatenate([x[i] for x in held_hist]) for i in range(3))
            lost, flush, number = (np.concatenate([x[i] for x in held_lost]) if held_lost else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, np.uint16)))
            order = np.argsort(history, kind="stable")
            history, count, share = history[order], count[order], share[order]
            new = np.ones(len(history), bool)
            new[1:] = history[1:] != history[:-1]
            at = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            table = np.bincount(group * (CUTOFF + 1) + np.minimum(count, CUTOFF + 1) - 1, minlength=len(at) * (CUTOFF + 1)).astype(np.uint32).reshape(-1, CUTOFF + 1)
            told = np.zeros((len(lost), CUTOFF + 1), np.uint32)
            told[:, :2] = flush.view(np.uint32).reshape(-1, 2)
            told[:, 2] = number
            history = np.concatenate([history[at], lost])
            share = np.concatenate([np.add.reduceat(share, at) if len(at) else share, np.full(len(lost), np.nan)])
            bucket = (common.mix(history) % np.uint64(n_buckets)).astype(np.int32)
            return send(bucket, "hist", a=history, b=np.concatenate([table, told]).view(f"V{4 * (CUTOFF + 1)}").ravel(), c=share)

        def of_bucket(blobs: list[dict]) -> None:
            got = {c: np.concatenate([np.frombuffer(x[c], t) for x in blobs]) for c, t in DTYPES.items()}
            flush = np.array([x["flush"] for x in blobs], np.int64)
            blob = np.repeat(np.arange(len(blobs)), [len(x["rows"]) // 2 for x in blobs])
            word, history = np.repeat(got["word"], got["types"]), got["history"]
            order = np.lexsort((history, word))
            w, h = word[order], history[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
            kind = np.empty(len(w), np.int64)
            kind[order] = np.cumsum(new) - 1
            w, h = w[new], h[new]
            new_word = np.ones(len(w), bool)
            new_word[1:] = w[1:] != w[:-1]
            occurrence = np.repeat(kind, got["times"])
            trains, number = got["rows"] >> np.uint16(15), got["rows"] & np.uint16(0x7FFF)
            count = np.bincount(occurrence, trains, minlength=len(w)).astype(np.int64)
            of_word = np.add.reduceat(count, np.flatnonzero(new_word))[np.cumsum(new_word) - 1]
            is_hot, place = _find(hot.word, w)
            of_word[is_hot] = hot.n[place[is_hot]]
            share, base, score = _terms(count, of_word, w, uni)
            # Sums per row of this bucket's occurrences.
            name, sums, counts = _row_sums((blob.astype(np.int64) << 16) | number, occurrence, count, of_word, base, score)
            held_docs.append((flush[name >> 16], (name & 0xFFFF).astype(np.uint16), sums, counts))
            seen = count > 0
            held_hist.append((h[seen], count[seen], share[seen]))
            stat[:] += np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2]
            lost = np.flatnonzero(count[occurrence] == 0)
            if len(lost):
                lost_h = h[occurrence[lost]]
                held_lost.append((lost_h, flush[blob[lost]], number[lost]))

        def flush_held(limit: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in held_docs) > limit:
                yield from send_docs()
                held_docs.clear()
            if sum(len(x[0]) for x in (*held_hist, *held_lost)) > limit:
                yield send_hist()
                held_hist.clear()
                held_lost.clear()

        now, blobs = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    n_rows = len(row["row_key"]) // 8
                    told = {"a": np.frombuffer(row["row_key"], np.int64), "b": np.frombuffer(row["n_tokens"], np.int64)}
                    yield send(np.full(n_rows, -1 - row["bucket"], np.int32), "rows", flush=row["flush"], **told)
                    if row["word"]:
                        names = {"a": ("word", np.uint16), "b": ("types", np.float64), "c": ("history", np.float64), "d": ("times", f"V{4 * (CUTOFF + 1)}")}
                        done = {c: np.frombuffer(row[x], t) for c, (x, t) in names.items()}
                        yield send(np.full(len(done["a"]), -1 - row["bucket"], np.int32), "doc", flush=row["flush"], **done)
                    continue
                if row["bucket"] != now and blobs:
                    of_bucket(blobs)
                    yield from flush_held(HELD_ENTRIES)
                    blobs = []
                now = row["bucket"]
                blobs.append(row)
        if blobs:
            of_bucket(blobs)
        yield from flush_held(0)
        yield send(np.zeros(CUTOFF + 2, np.int32), "stat", a=stat)

    schema = common.blob_schema(*PARTS) + ", flush bigint, kind string"
    return common.by_bucket(events).mapInArrow(run, schema)


DTYPES = {"word": np.uint64, "types": np.uint32, "history": np.uint64, "times": np.uint32, "rows": np.uint16}


def _bigram_factors(table: DataFrame, hot: Hot) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("a").to_pylist():
                n = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in n[1:]], names=list(STATS))

    rows = table.where("kind = 'stat'").select("a").mapInArrow(sums, ", ".join(f"{c} bigint" for c in STATS))
    got = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS)).first()
    return factors({r: got[f"m{r}"] + int((hot.pair_n == r).sum()) for r in range(1, CUTOFF + 2)})


def _by_history(table: DataFrame, factor: np.ndarray, uni: Unigrams, hot: Hot, n_buckets: int) -> DataFrame:
    """Blobs by flush: row number (a) and what unseen bigrams add to its score (b), log10 of alpha(h) c(h)."""
    rows = table.where("kind = 'hist'").select("bucket", "a", "b", "c")
    counts = np.arange(1, CUTOFF + 1)
    left_of = np.concatenate([(1 - factor[1:]) * counts, [LESS]])

    hot_bucket = common.mix(hot.pair_history) % np.uint64(n_buckets)
    hot_types = (np.minimum(hot.pair_n, CUTOFF + 1)[:, None] == np.arange(1, CUTOFF + 2)).astype(np.uint32)
    hot_share = uni.probability(hot.of_pair_words())

    def of_bucket(bucket: int, got: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        told = np.isnan(got["c"])
        types = got["b"].reshape(-1, CUTOFF + 1)
        lost, flush = got["a"][told], np.ascontiguousarray(types[told, :2]).view(np.int64).ravel()
        number, value = types[told, 2].astype(np.uint16), np.zeros(len(lost))
        mine = hot_bucket == bucket
        parts = ((got["a"][~told], hot.pair_history[mine]), (types[~told], hot_types[mine]), (got["c"][~told], hot_share[mine]))
        history, types, share = (np.concatenate(x) for x in parts)
        if len(history):
            name, at = np.unique(history, return_inverse=True)
            left = np.bincount(at, types @ left_of)
            share = np.bincount(at, share)
            log = np.log10(left) - np.log10(np.maximum(1 - share, 1e-300))
            place = np.minimum(np.searchsorted(name, lost), len(name) - 1)
            value = np.where(name[place] == lost, log[place], 0.0)
        return flush, number, value

    def send(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not sum(len(x[0]) for x in found):
            return
        flush, number, value = (np.concatenate([x[i] for x in found]) for i in range(3))
        order = np.lexsort((number, flush))
        flush, number, value = flush[order], number[order], value[order]
        new = np.concatenate([[True], (flush[1:] != flush[:-1]) | (number[1:] != number[:-1])])
        at = np.flatnonzero(new)
        flush, number, value = flush[at], number[at], np.add.reduceat(value, at)
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], flush[1:] != flush[:-1]])), [len(flush)]])
        names, size = flush[edges[:-1]], np.diff(edges)
        arrays = [pa.array([abs(int(x)) % n_buckets for x in names], pa.int32())]
        for values in (number, value):
            offsets = pa.py_buffer((edges * values.itemsize).astype(np.int32))
            arrays.append(pa.Array.from_buffers(pa.binary(), len(size), [None, offsets, pa.py_buffer(values.tobytes())]))
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(names)], names=["bucket", "a", "b", "flush"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for bucket, got in common.buckets(batches, {"a": np.uint64, "b": np.uint32, "c": np.float64}):
            found.append(of_bucket(bucket, got))
            if sum(len(x[0]) for x in found) > HELD_ENTRIES:
                yield from send(found)
                found = []
        yield from send(found)

    return common.by_bucket(rows).mapInArrow(run, "bucket int, a binary, b binary, flush bigint")


def _per_row(table: DataFrame, backed_off: DataFrame, factor: np.ndarray) -> DataFrame:
    """row_key, n_tokens, n_known, base (without its constant), score of each row sent."""
    own = table.where("kind in ('doc', 'rows')").select("bucket", "flush", "kind", "a", "b", "c", "d")
    more = backed_off.select("bucket", "flush", F.lit("late").alias("kind"), "a", "b", F.lit(b"").alias("c"), F.lit(b"").alias("d"))
    dealt = common.by_bucket(own.unionByName(more), "flush")
    log_factor = np.log10(factor[1:])

    def of_flush(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        told = next((x for x in rows if x["kind"] == "rows"), None)
        if told is None:
            return
        keys, size = np.frombuffer(told["a"], np.int64), np.frombuffer(told["b"], np.int64)
        base, score, known = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
        for x in rows:
            if x["kind"] == "rows":
                continue
            at = np.frombuffer(x["a"], np.uint16).astype(np.int64)
            if x["kind"] == "late":
                score[at] += np.frombuffer(x["b"], np.float64)
                continue
            counts = np.frombuffer(x["d"], np.uint32).reshape(-1, CUTOFF + 1).astype(np.int64)
            base[at] += np.frombuffer(x["b"], np.float64)
            score[at] += np.frombuffer(x["c"], np.float64) + counts[:, 1:] @ log_factor
            known[at] += counts[:, 0]
        arrays = [pa.array(keys), pa.array(size), pa.array(known), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays(arrays, names=["row_key", "n_tokens", "n_known", "base", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["flush"] != now and rows:
                    yield from of_flush(rows)
                    rows = []
                now = row["flush"]
                rows.append(row)
        if rows:
            yield from of_flush(rows)

    return dealt.mapInArrow(run, "row_key bigint, n_tokens bigint, n_known bigint, base double, score double")


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, hot_times: int = HOT_TIMES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Null text is empty: one token, its end. Rows with a null doc_id are training rows. Repeated rows count as
    often as they occur. Without any training row every word is unseen and both scores are 0. Only doc_id and
    text are read.
    """
    n_buckets = common.BUCKETS_PER_PARTITION * common.shuffle_partitions(docs.sparkSession)
    rows = docs.select(
        "doc_id", "text", held_out(modulus, remainder).alias("held_out"), F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("row_key")
    )
    counts = common.materialise(_unigram_counts(rows, n_buckets, hot_times))
    uni, hot = _unigrams(counts), _hot(rows, counts, n_buckets, hot_times)
    table = common.materialise(_by_word(_events(rows, uni, hot, n_buckets), uni, hot, n_buckets), "kind")
    factor = _bigram_factors(table, hot)
    per_row = _per_row(table, _by_history(table, factor, uni, hot, n_buckets), factor)
    begins = rows.where("not held_out").count()
    # Rows that are the same in id and text have one key and equal sums.
    summed = per_row.groupBy("row_key").agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    named = rows.select("doc_id", "held_out", "row_key").join(summed, "row_key")
    constant = float(np.log10(uni.tokens + uni.types + 1.0))
    first = float(np.log10(begins)) if begins else 0.0
    return named.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(uni.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(constant)).alias("base_score"),
        (F.col("score") - F.lit(first)).alias("score"),
    )
