"""Token ids as Parquet list columns: delta or dictionary encoded, small row groups and pages, selective reads.

Rows are range-partitioned and sorted by document id, encoded where they lie, and written by Spark's Parquet
writer. Every row carries its file part and the tokens before it inside that part, so the global offset needs
one sum per part and no window over all rows. The page index that the writer leaves lets a filter on the id
column skip row groups and pages; token and metadata columns are read independently of each other.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm import common

#: White space next to other white space, or at an end: there a text can't be cut into independent pieces.
UNSAFE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]{2}|^[\s\p{Z}\x0b\x1c-\x1f\x{85}]|[\s\p{Z}\x0b\x1c-\x1f\x{85}]$"
#: Text bytes that are cut into pieces at once; index arrays take some 15 times as much.
CHUNK_BYTES = 2 << 20
#: Characters that the tokenizer gets at once (one text at least); its results are objects, so they are turned into arrays in between.
SLICE = 1 << 18
#: Distinct pieces that the tokenizer gets as one text.
JOINED = 256
#: Bytes of pieces and their ids that a worker keeps from chunk to chunk.
KEPT_BYTES = 16 << 20
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Printable ASCII that is neither a letter, a digit, a blank nor the apostrophe, which may begin a contraction.
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[39] = False
_MARK &= ~_ALNUM
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
        common.release()
    return _ENCODERS[path]


class PieceEncoder:
    """Encodes each distinct piece once while it is kept.

    A byte-level tokenizer without normaliser never lets a token reach over a single blank or line feed between
    two other characters, nor from an ASCII letter or digit to a mark, so texts are cut there. Every other
    text, tokenizer or added token goes through the tokenizer whole.

    For the same reason distinct pieces can be put into one text again, in any order: those that begin with a
    blank follow each other, others get a line feed in between. A byte-level BPE token has as many characters
    as it has bytes, so the ids of such a text are dealt back by counting bytes; where a piece doesn't end at a
    token's end, its pieces are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, before = self.tokenizer.model, self.tokenizer.pre_tokenizer
        before = json.loads(before.__getstate__()) if before is not None else {}
        self.cuts = (
            self.tokenizer.normalizer is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and getattr(model, "dropout", None) is None
        )
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = type(model).__name__ == "BPE" and not any((model.unk_token, model.continuing_subword_prefix, model.end_of_word_suffix))
        self.joins = self.cuts and plain and not any(c.isspace() for t in self.added for c in t)
        if self.joins:
            vocabulary = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int32)
            self.token_bytes[np.fromiter(vocabulary.values(), np.int64)] = np.fromiter(map(len, vocabulary), np.int32)
        self._keep(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _keep(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known, self.known_ids, self.known_sizes = pieces, ids, sizes

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        ends, start = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))), 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts[start:stop], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
            start = stop
        return np.concatenate(ids), np.concatenate(sizes)

    def _joined(self, data: np.ndarray, edges: np.ndarray, per_piece: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the stretches of data between the edges, encoded many at once; nothing if a token reaches over an edge."""
        heads = np.append(edges[:-1][:: JOINED * per_piece], edges[-1])
        texts = pa.Array.from_buffers(pa.large_string(), len(heads) - 1, [None, pa.py_buffer(heads), pa.py_buffer(data)])
        ids, _ = self._ids(texts.to_pylist())
        ends = np.cumsum(self.token_bytes[ids], dtype=np.int64)
        if not len(ends) or ends[-1] != edges[-1]:
            return None
        last = np.searchsorted(ends, edges[1:])
        return (ids, np.diff(last, prepend=-1)) if (ends[last] == edges[1:]).all() else None

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces end to end, and how many each has."""
        if not self.joins or not len(pieces):
            return self._ids(pieces.to_pylist())
        data, starts = common.text_bytes(pieces)
        first = data[starts[:-1]]
        # A line feed is a piece of its own: next to another one it isn't single.
        kinds = [np.flatnonzero(first == 32), np.flatnonzero((first != 32) & (first != 10)), np.flatnonzero(first == 10)]
        parts = []
        for rows, end in zip(kinds, ("", "\n", None), strict=True):
            some, got = pieces.take(pa.array(rows)), None
            if len(rows) and end is not None:
                text, edges = common.text_bytes(pc.binary_join_element_wise(some, "", end))
                if end:
                    edges = np.sort(np.concatenate([edges, edges[1:] - len(end)]))
                got = self._joined(text, edges, 2 if end else 1)
            if got and end:
                ids, sizes = got
                got = ids[common.ragged((np.cumsum(sizes) - sizes)[::2], sizes[::2])], sizes[::2]
            parts.append(got or self._ids(some.to_pylist()))
        sizes = np.concatenate([p[1] for p in parts])
        order = np.argsort(np.concatenate(kinds), kind="stable")
        return np.concatenate([p[0] for p in parts])[common.ragged((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def _coded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: an array that holds their ids, where each piece's begin in it, and how many each has."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = pieces.take(pa.array(new))
            ids, sizes = self._distinct(fresh)
            at[new] = len(self.known) + np.arange(len(new))
            self._keep(pa.concat_arrays([self.known, fresh]), np.concatenate([self.known_ids, ids]), np.concatenate([self.known_sizes, sizes]))
        ids, sizes = self.known_ids, self.known_sizes
        starts = (np.cumsum(sizes) - sizes)[at]
        sizes = sizes[at]
        if self.known.nbytes + ids.nbytes + self.known_sizes.nbytes > KEPT_BYTES:
            kept = pieces if pieces.nbytes + 4 * sizes.sum() + sizes.nbytes <= KEPT_BYTES // 2 else pieces[:0]
            n = len(kept)
            self._keep(pa.concat_arrays([kept]), ids[common.ragged(starts[:n], sizes[:n])], sizes[:n])
        return ids, starts, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has; null counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, UNSAFE) if self.cuts else pa.array([True] * len(texts), pa.bool_())
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        whole = whole.to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._pieces(texts)
        cut_rows, whole_rows = np.flatnonzero(~whole), np.flatnonzero(whole)
        ids, sizes = self._pieces(texts.take(pa.array(cut_rows)))
        more_ids, more = self._ids(texts.take(pa.array(whole_rows)).to_pylist())
        ids, sizes = np.concatenate([ids, more_ids]), np.concatenate([sizes, more])
        order = np.argsort(np.concatenate([cut_rows, whole_rows]), kind="stable")
        starts = np.cumsum(sizes) - sizes
        return ids[common.ragged(starts[order], sizes[order])], sizes[order]

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts = common.text_bytes(texts)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        cut = data == 32
        feed = data == 10
        cut |= feed
        cut[1:] |= feed[:-1] | (_MARK[data[1:]] & _ALNUM[data[:-1]])
        cut[starts[:-1][starts[:-1] < len(data)]] = True
        edges = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.concatenate([edges, [len(data)]]).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.string(), len(edges), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        ids, begin, sizes = self._coded(pieces.dictionary)
        code = pieces.indices.to_numpy()
        each = sizes[code]
        total = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(edges, starts)]
        return ids[common.ragged(begin[code], each)], np.diff(total)


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids in ascending order of the id column (nulls first, ties by text hash): id, part, before, ids.

    ``before`` counts the ids of earlier rows of the same part. Null text gives the end id alone (or nothing).
    Columns besides id and text are not read. An empty table gives no rows.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("tie"))
    dealt = rows.repartitionByRange(common.shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for chunk in common.text_chunks(batches, limit=CHUNK_BYTES):
            ids, sizes = coder.encode(chunk.column("text"))
            if end_id is not None:
                ends = np.cumsum(sizes + 1) - 1
                with_end = np.full(len(ids) + len(sizes), end_id, np.int32)
                taken = np.ones(len(with_end), bool)
                taken[ends] = False
                with_end[taken] = ids
                ids, sizes = with_end, sizes + 1
            edges = np.concatenate([[0], np.cumsum(sizes)])
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + edges[:-1]), lists],
                names=["doc_id", "part", "before", "ids"],
            )
            before += int(edges[-1])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"doc_id {kind}, part int, before bigint, ids array<int>")


def write(
    encoded: DataFrame, path: str, encoding: str = "delta", row_group_rows: int = 4096, page_rows: int = 256, row_group_bytes: int = 32 << 20
) -> None:
    """Write in the given order. encoding: "delta" (DELTA_BINARY_PACKED) or "dictionary"."""
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"encoding is delta or dictionary, not {encoding!r}")
    (
        encoded.write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.block.row.count.limit", row_group_rows)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "zstd")
        .parquet(path)
    )


def parts_ahead(spark: SparkSession, path: str) -> DataFrame:
    """(part, ahead): ids in all earlier parts. One sum per part is all that crosses parts."""
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum(F.size("ids")).alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("ahead"))


def lookup(spark: SparkSession, path: str, low: int, high: int, columns: list[str]) -> DataFrame:
    """Named columns of rows with low <= doc_id <= high: the filter reaches row groups and pages."""
    return spark.read.parquet(path).where(F.col("doc_id").between(low, high)).select(*columns)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all earlier rows), n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            edges = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]].astype("<u4")).cast("B") if len(ids) else b""
            edges = edges.astype(np.int64) - edges[0]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            arrays = [batch.column("doc_id"), batch.column("part"), batch.column("before"), pa.array(np.diff(edges)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])
        common.release()

    rows = spark.read.parquet(path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = rows.mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids_crc32 bigint")
    placed = digests.join(parts_ahead(spark, path), "part")
    return placed.select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> DataFrame:
    """Encode, write and read back: doc_id, start, n_tokens, ids_crc32."""
    path = path or common.scratch_folder(docs.sparkSession)
    write(encode(docs, tokenizer, end_id), path)
    return read_digests(docs.sparkSession, path)
