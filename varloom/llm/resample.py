"""Importance resampling towards a target distribution over hashed runs of words.

Every feature (a run of one or two words) falls into a bucket by its CRC-32, found with a position table: the
checksum is linear, so each byte contributes a value that depends on the byte and its distance from the end only;
contributions of a feature's bytes are combined by exclusive-or (`bitwise_xor.reduceat` over all features of a
chunk at once) and a constant for the length is added. Spans longer than the table are cut into blocks from the
end, which are folded pairwise by advancing the left one over the zeros of the right one.

Corpus and target are each read once into one count per bucket, which bounds everything that is brought together.
Scores are added to a Gumbel draw per document; the highest are found by one range shuffle of narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm import common

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 2
#: Documents with fewer words are scored but never drawn.
LEAST_WORDS = 20
SHARE = 25
SEED = "7"
#: Distances from the end that the position table holds.
BLOCK = 64
#: Feature bytes handled at once.
PIECE_BYTES = 1 << 20
#: Reversed polynomial of the checksum (fixed value).
POLYNOMIAL = 0xEDB88320
ALL_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & np.uint32(1), (value >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), value >> np.uint32(1))
    return value


BYTE_TABLE = _byte_table()


def _past_zero(state: np.ndarray) -> np.ndarray:
    return (state >> np.uint32(8)) ^ BYTE_TABLE[state & np.uint32(255)]


def _position_table() -> np.ndarray:
    rows = [BYTE_TABLE]
    for _ in range(BLOCK - 1):
        rows.append(_past_zero(rows[-1]))
    return np.stack(rows)


#: Contribution of a byte at a distance from the end, at [distance * 256 + byte].
POSITIONS = _position_table().reshape(-1)


def _image(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by its values on each of the four bytes."""
    out = tables[0][state & np.uint32(255)]
    for k in (1, 2, 3):
        out ^= tables[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _doublings() -> list[np.ndarray]:
    """Maps that advance a state over 1, 2, 4, ... zero bytes."""
    one = np.stack([_past_zero(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])
    maps = [one]
    for _ in range(47):
        maps.append(_image(maps[-1], maps[-1]))
    return maps


ADVANCES = _doublings()


def advance(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """States after so many zero bytes each."""
    for bit, tables in enumerate(ADVANCES):
        here = (zeros >> bit) & 1 == 1
        if here.any():
            state = np.where(here, _image(tables, state), state)
        if not (zeros >> (bit + 1)).any():
            break
    return state


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """What a span's length adds to the checksum, whatever its bytes."""
    distinct, place = np.unique(lengths, return_inverse=True)
    return (advance(np.full(len(distinct), ALL_ONES), distinct) ^ ALL_ONES)[place]


def _contributions(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exclusive-or of the contributions of each span's bytes; spans of one byte or more, all together of bounded size."""
    heads = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int32)
    at += np.repeat((starts - heads).astype(np.int32), lengths)
    behind = np.repeat((starts + lengths - 1).astype(np.int32), lengths) - at
    if lengths.max() <= BLOCK:
        behind <<= 8
        behind += data[at]
        return np.bitwise_xor.reduceat(POSITIONS[behind], heads)
    block = behind // BLOCK
    first = np.ones(len(at), bool)
    first[1:] = np.diff(block) != 0
    first[heads] = True
    edges = np.flatnonzero(first)
    values = np.bitwise_xor.reduceat(POSITIONS[(behind % BLOCK) * 256 + data[at]], edges)
    block, span = block[edges], np.searchsorted(heads, edges, side="right") - 1
    step = BLOCK.bit_length() - 1
    while block.max():
        values = np.where(block & 1, _image(ADVANCES[step], values), values)
        block, step = block >> 1, step + 1
        first = np.ones(len(block), bool)
        first[1:] = (np.diff(block) != 0) | (np.diff(span) != 0)
        edges = np.flatnonzero(first)
        values, block, span = np.bitwise_xor.reduceat(values, edges), block[edges], span[edges]
    return values


def span_crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start : start + length] of every span, some PIECE_BYTES at a time; empty spans give 0."""
    out = np.zeros(len(starts), np.uint32)
    filled = np.flatnonzero(lengths > 0)
    ends = np.cumsum(lengths[filled])
    at = 0
    while at < len(filled):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        some = filled[at:stop]
        if stop == at + 1 and lengths[some[0]] > PIECE_BYTES:
            start, left, state = int(starts[some[0]]), int(lengths[some[0]]), np.zeros(1, np.uint32)
            while left:
                size = min(left, PIECE_BYTES)
                state = advance(state, np.array([size])) ^ _contributions(data, np.array([start]), np.array([size]))
                start, left = start + size, left - size
            out[some] = state
        else:
            out[some] = _contributions(data, starts[some], lengths[some])
        at = stop
    return out ^ length_constants(lengths)


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def feature_buckets(data: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every feature, run length by run length."""
    lowered = common.LOWERED[data]
    inside = WORD_BYTE[lowered]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[starts[:-1][starts[:-1] < len(inside)]] = False
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return
    # A word's letters are counted by how many letters lie between its first and the next word's first.
    letters = np.cumsum(inside)
    lengths = np.diff(np.append(letters[first] - 1, letters[-1]))
    rows = np.searchsorted(starts, first, side="right") - 1
    places = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    joined[common.ragged(places, lengths)] = lowered[inside]
    for n in range(longest):
        whole = rows[n:] == rows[: len(rows) - n]
        begin, end = places[: len(rows) - n][whole], (places + lengths)[n:][whole]
        if len(begin):
            yield rows[n:][whole], (span_crc32(joined, begin, end - begin) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all texts in each bucket. Tasks add up what they read, so a row per task and bucket is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for chunk in common.text_chunks(batches, limit=PIECE_BYTES):
            for _, bucket in feature_buckets(*common.text_bytes(chunk.column("text")), buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket speaks for the target, in thousandths of a nat: one whole number per bucket, nothing else."""

    def counted(counts: DataFrame) -> np.ndarray:
        table = counts.toArrow()
        out = np.zeros(buckets, np.int64)
        out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        return out

    s, t = counted(corpus), counted(target)
    of_target = (t + 1).astype(float) * float(s.sum() + buckets)
    of_corpus = (s + 1).astype(float) * float(t.sum() + buckets)
    return np.floor(1000 * np.log(of_target / of_corpus)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a document's features (0 without any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches, limit=PIECE_BYTES):
            features = np.zeros((longest, chunk.num_rows), np.int64)
            total = np.zeros(chunk.num_rows, np.int64)
            for n, (row, bucket) in enumerate(feature_buckets(*common.text_bytes(chunk.column("text")), len(gain), longest)):
                features[n] = np.bincount(row, minlength=chunk.num_rows)
                np.add.at(total, row, gain[bucket])
            count = features.sum(axis=0)
            mean = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(features[0]), pa.array(count), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: str = SEED) -> Column:
    """Thousandths of a standard Gumbel draw that belongs to the key (null counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((place + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, eligible: Column, share: int = SHARE) -> DataFrame:
    """Adds rank to the highest `share` hundredths of the eligible rows by (score, smaller doc_id); null elsewhere.

    One range shuffle orders all rows; a row's place is its place in its partition plus the sizes of the partitions
    before it, one row each. The order is written, so that places don't change if a task is run again.
    """
    order = [F.col("_out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rows = rows.withColumn("_out", ~eligible)
    ordered = rows.repartitionByRange(common.shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ordered = common.materialise(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count(F.when(~F.col("_out"), 1)).alias("in")).orderBy("part").collect()
    ahead, offsets = 0, []
    for row in sizes:
        offsets.append((row["part"], ahead))
        ahead += row["n"]
    drawn = share * sum(row["in"] for row in sizes) // 100
    before = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in offsets for x in pair)), part.cast("long")) if offsets else F.lit(0)
    rank = inside + 1 + before
    return ordered.withColumn("rank", F.when(rank <= drawn, rank)).drop("_out", "_place")


def draw(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of docs.

    docs has doc_id and text, target has text; other columns are left aside. Null and empty texts, and texts without
    a word, have no features and weight 0. Repeated rows are scored alike and hold ranks of their own. Without a
    target every gain speaks for what the corpus lacks; empty docs give no rows. The driver holds one number per
    bucket and one per shuffle partition.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    rows = common.materialise(weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    return ranked(rows, F.col("n_words") >= least_words, share)
