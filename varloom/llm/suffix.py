"""Removal of repeated strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

1. Sharding by content. Every 50-byte window has a key: the least hash of its 20-byte substrings. Equal
   windows have equal keys, neighbouring windows mostly share one, so a text is a sequence of *runs* of
   windows with one key. A first exchange of (key, document) finds the keys that two documents have; only
   their runs go on, as segments (the run's bytes), to the bucket of their key. All occurrences of a window
   are then in one bucket, whatever documents they come from.
2. In a bucket, distinct segments are put in order of their keys; some keys at a time (a key never apart) they are
   concatenated and the transform is built. The first symbols of each suffix, packed in one number, tell all
   shorter common prefixes. From the intervals of that length on, intervals of the suffix order are extended
   backwards breadth-first; an interval of length l + 1 whose right border has no common-prefix value yet sets
   it to l and is extended further. Values so appear in increasing order, and the expansion stops at the
   minimum length: borders without a value then lie inside groups of suffixes that share at least that many
   bytes. The least document of each group decides. Where one key has very many bytes, windows whose hash no
   other window has are left out before the transform, and what is left goes in once for each content.
3. Runs of removed windows return to their documents, are merged and cut out.

Keys that very many documents have (a licence line) are spread: their windows are aggregated by content
before any exchange and joined back, so no bucket gathers all of them. Whole copies of an earlier document are
decided by their hash beforehand, which keeps groups of copies out of every exchange but the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import common

MIN_LENGTH = 50
GRAM = 20
#: Documents from which on a key's windows are aggregated by content and joined back (bounds a bucket's memory).
HOT_DOCS = 200_000
#: Windows of one segment at most; longer runs (repetitive text) are cut.
SEGMENT_WINDOWS = 64
FLUSH_BYTES = 32 << 20
#: Bytes of segments that a map task holds before it sends them on.
SENT_BYTES = 16 << 20
#: Bytes hashed at once: the arrays stay in the processor's cache.
BLOCK_BYTES = 32 << 10
#: Bytes of segments in one transform, whole keys each (one key at least).
PIECE_BYTES = 256 << 10
#: Bytes of one key's segments from which on windows without an equal are sieved out before its transform.
SIEVE_BYTES = 1 << 20
#: Rows without id count as later than all others.
LAST = np.iinfo(np.int64).max


def window_keys(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Least hash of the grams of each window of `length` bytes (windows over the end of a row included)."""
    windows = max(len(data) - length + 1, 0)
    keys = np.empty(windows, np.uint64)
    for at in range(0, windows, BLOCK_BYTES):
        part = data[at : min(at + BLOCK_BYTES, windows) + length - 1]
        keys[at : at + BLOCK_BYTES] = _block_keys(part, length, gram)
    return keys


def _block_keys(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    n, base = len(data), np.uint64(0x9E3779B97F4A7C15)
    powers, hashes, size = {1: base}, {1: common.BYTE_VALUES[data]}, 1
    with np.errstate(over="ignore"):
        while 2 * size <= gram:
            h = hashes[size]
            hashes[2 * size] = h[:-size] * powers[size] + h[size:]
            powers[2 * size] = powers[size] * powers[size]
            size *= 2
        h, done = hashes[size], size
        while done < gram:
            step = 1 << ((gram - done).bit_length() - 1)
            m = n - done - step + 1
            h = h[:m] * powers[step] + hashes[step][done : done + m]
            done += step
    h = common.mix(h)
    width, size = length - gram + 1, 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def window_runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key inside a row: key, row, first window (in data), number of windows."""
    keys = window_keys(data, length, gram)
    if not len(keys):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    new[starts[:-1][starts[:-1] < len(keys)]] = True
    # Windows over the end of a row are no windows: they begin a run of their own that is left out.
    tail = np.maximum(starts[1:] - length + 1, starts[:-1])
    new[tail[tail < len(keys)]] = True
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate([head, [len(keys)]]))
    row = np.searchsorted(starts, head, side="right") - 1
    valid = head + length <= starts[row + 1]
    return keys[head[valid]], row[valid], head[valid], count[valid]


# --- the transform -----------------------------------------------------------------------------------------


def packed(symbols: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The first `width` symbols of each suffix in one number; nothing but 0 from the end of its segment on."""
    key, size = symbols, 1
    while size < width:
        step = min(size, width - size)
        later = np.zeros_like(key)
        later[:-size] = key[size:] >> (bits * (size - step))
        later[(key & ((1 << bits) - 1)) == 0] = 0
        key = (key << (bits * step)) | later
        size += step
    return key


def suffix_order(symbols: np.ndarray, end: np.ndarray, least: int, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by `least` symbols of all suffixes of segments that each end in symbol 0, and their packed first ones.

    end: where each position's segment ends. Prefix doubling from `width` packed symbols; suffixes that are still
    equal then, or end before, keep their position's order, so one more symbol in front keeps it too.
    """
    n = len(symbols)
    key = packed(symbols.astype(np.int64), bits, width)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)  # first place of the suffix's group
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))

    def tied() -> np.ndarray:
        tie = ~new
        tie[:-1] |= tie[1:]
        return np.flatnonzero(tie)

    depth = width
    while depth < least:
        # Only suffixes that still tie and go on need sorting: their places stay inside their group.
        places = tied()
        mine = order[places]
        on = mine + depth <= end[mine]
        places, mine = places[on], mine[on]
        if not len(places):
            break
        pair = (rank[mine] << 32) | rank[mine + depth]
        turn = np.argsort(pair)
        mine, pair = mine[turn], pair[turn]
        order[places] = mine
        fresh = np.ones(len(places), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[places] |= fresh
        rank[mine] = np.maximum.accumulate(np.where(fresh, places, 0))
        depth *= 2
    places = tied()
    mine = order[places]
    order[places] = np.sort((rank[mine] << 32) | mine) & 0xFFFFFFFF
    return order, key


def repeat_groups(symbols: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place whether a group of suffixes with `least` common symbols begins there."""
    n = len(symbols)
    bits = max(int(symbols.max()).bit_length(), 1)
    width = min(63 // bits, least)
    order, key = suffix_order(symbols, end, least, bits, width)
    last = np.where(order > 0, symbols[order - 1], 0)  # the transform; symbol 0 where a segment begins
    back = np.empty(n, np.int64)  # place of the suffix that is one symbol longer
    back[np.argsort(last, kind="stable")] = np.arange(n)
    begins = symbols[order]
    # Borders with fewer than `width` common symbols are told by the packed ones; ends of segments share nothing.
    mask = (1 << bits) - 1
    known = np.ones(n + 1, bool)
    known[1:n] = (key[1:] != key[:-1]) | ((key[1:] & mask) == 0)
    # The first intervals: strings of `width` symbols (the last may be an end) whose right border has width - 1 in common.
    whole = ((key >> bits) & mask) > 0 if width > 1 else np.ones(n, bool)
    low, high = np.flatnonzero(known[:n] & whole), np.flatnonzero(known[1:] & whole)
    fresh = (high + 1 < n) & (key[high] >> bits == key[np.minimum(high + 1, n - 1)] >> bits)
    low, high = low[fresh], high[fresh]
    for _ in range(width, least):
        if not len(low):
            break
        size = high - low + 1
        place = common.ragged(low, size)
        owner = common.row_of(size)
        inner = last[place] > 0
        place, owner = back[place[inner]], owner[inner]
        turn = np.argsort(place)
        place, owner = place[turn], owner[turn]
        symbol = begins[place]
        new = np.ones(len(place), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(place)]]) - 1 if len(head) else head
        low, high = place[head], place[tail]
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
    return order, known[:n]


def least_documents(data: np.ndarray, sizes: np.ndarray, least_doc: np.ndarray, least: int) -> np.ndarray:
    """Segments end to end with the least document of each: for each byte that begins a window, the least document with that window."""
    segments = len(sizes)
    codes = np.zeros(256, np.int16)  # the bytes that occur, numbered from 1: fewer bits for each
    used = np.flatnonzero(np.bincount(data, minlength=256))
    codes[used] = np.arange(1, len(used) + 1)
    close = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(data) + segments, bool)
    inside[close] = False
    symbols = np.zeros(len(data) + segments, np.int16)
    symbols[inside] = codes[data]
    end = np.repeat(close, sizes + 1)
    order, head = repeat_groups(symbols, end, least)
    owner = common.row_of(sizes + 1)
    docs = np.where(order + least <= end[order], least_doc[owner[order]], LAST)
    first = np.flatnonzero(head)
    lowest = np.minimum.reduceat(docs, first)
    result = np.empty(len(symbols), np.int64)
    result[order] = np.repeat(lowest, np.diff(np.concatenate([first, [len(order)]])))
    return result[inside]


def distinct_segments(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of distinct content: one of each, which of them every segment is, and the least document of each."""
    content = np.array([hash(raw[b : b + s].tobytes()) for b, s in zip(begin, size, strict=True)], np.int64)
    order = np.lexsort((doc, size, content))
    c, s = content[order], size[order]
    new = np.ones(len(order), bool)
    new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    # Equal hashes are compared byte by byte; a difference begins another segment.
    same = np.flatnonzero(~new)
    if len(same):
        here, there = common.ragged(begin[order[same]], s[same]), common.ragged(begin[order[same - 1]], s[same])
        differs = np.add.reduceat(raw[here] != raw[there], np.cumsum(s[same]) - s[same]) > 0
        new[same[differs]] = True
    segment = np.empty(len(order), np.int64)
    segment[order] = np.cumsum(new) - 1
    return order[new], segment, np.minimum.reduceat(doc[order], np.flatnonzero(new))


def sieved_documents(data: np.ndarray, sizes: np.ndarray, least_doc: np.ndarray, least: int) -> np.ndarray:
    """As least_documents, where many segments share a key: only windows whose hash occurs twice go to the transform, equal runs of them once."""
    starts = np.cumsum(sizes) - sizes
    result = np.repeat(least_doc, sizes)
    windows = sizes - least + 1
    at = common.ragged(starts, windows)
    value = window_keys(data, least, least)[at]
    order = np.argsort(value)
    value = value[order]
    equal = np.concatenate([[False], value[1:] == value[:-1], [False]])
    twice = np.empty(len(at), bool)
    twice[order] = equal[1:] | equal[:-1]
    owner = common.row_of(windows)
    apart = owner[1:] != owner[:-1]
    head = np.flatnonzero(twice & np.concatenate([[True], ~twice[:-1] | apart]))
    if not len(head):
        return result
    tail = np.flatnonzero(twice & np.concatenate([~twice[1:] | apart, [True]]))
    count = tail - head + 1
    begin, size = at[head], count + least - 1
    one, segment, lowest = distinct_segments(data, begin, size, least_doc[owner[head]])
    found = least_documents(data[common.ragged(begin[one], size[one])], size[one], lowest, least)
    base = np.cumsum(size[one]) - size[one]
    result[common.ragged(begin, count)] = found[common.ragged(base[segment], count)]
    return result


def least_by_key(data: np.ndarray, sizes: np.ndarray, least_doc: np.ndarray, key: np.ndarray, least: int) -> np.ndarray:
    """least_documents of segments in order of their keys, some keys at a time: equal windows have equal keys."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    stops = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    found, at = [], 0
    while at < len(key):
        fits = np.searchsorted(edges[stops], edges[at] + PIECE_BYTES, side="right") - 1
        stop = int(stops[max(fits, np.searchsorted(stops, at, side="right"))])
        solve = sieved_documents if edges[stop] - edges[at] >= SIEVE_BYTES else least_documents
        found.append(solve(data[edges[at] : edges[stop]], sizes[at:stop], least_doc[at:stop], least))
        at = stop
    return np.concatenate(found)


# --- stages ------------------------------------------------------------------------------------------------


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(LAST)).to_numpy(zero_copy_only=False)


def _keys(docs: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    """Blobs of distinct (key, document), documents as gaps: sorted gaps take few bytes once compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (common.mix(key) % np.uint64(n_buckets)).astype(np.int32)
            order = np.lexsort((doc, bucket))
            key, doc, bucket = key[order], doc[order], bucket[order]
            gap = doc.copy()
            gap[1:] -= doc[:-1]
            head = np.ones(len(doc), bool)
            head[1:] = bucket[1:] != bucket[:-1]
            gap[head] = doc[head]
            return common.deal(bucket, {"key": key, "gap": gap, "head": head})

        for chunk in common.text_chunks(batches):
            data, starts = common.text_bytes(chunk.column("text"))
            key, row, _, _ = window_runs(data, starts, length, gram)
            held.append((key, _ids(chunk.column("doc_id"))[row]))
            size += len(data)
            if size >= FLUSH_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, common.blob_schema("key", "gap", "head"))


def _shared(keys: DataFrame, n_buckets: int, hot_docs: int) -> DataFrame:
    """Blobs (doc, key, hot) by document, of keys that two documents or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = common.Dealer()
        for _, got in common.buckets(batches, {"key": np.uint64, "gap": np.int64, "head": bool}):
            key, gap = got["key"], got["gap"]
            head = np.flatnonzero(got["head"])
            total = np.cumsum(gap)
            before = np.where(head > 0, total[head - 1], 0)
            doc = total - np.repeat(before, np.diff(np.concatenate([head, [len(gap)]])))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= doc[1:] != doc[:-1]
            key, doc, new_key = key[new], doc[new], new_key[new]
            first = np.flatnonzero(new_key)
            many = np.diff(np.concatenate([first, [len(key)]]))
            many = np.repeat(many, many)
            taken = many > 1
            key, doc, hot = key[taken], doc[taken], many[taken] >= hot_docs
            if len(key):
                bucket = (common.mix(doc.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
                yield from dealer.add(bucket, {"doc": doc, "key": key, "hot": hot})
        yield from dealer.rest()

    return common.by_bucket(keys).mapInArrow(run, common.blob_schema("doc", "key", "hot"))


def _per_document(shared: DataFrame) -> DataFrame:
    """doc (LAST where the id is null), its shared keys and its hot keys as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in common.buckets(batches, {"doc": np.int64, "key": np.uint64, "hot": bool}):
            order = np.argsort(got["doc"], kind="stable")
            doc, key, hot = got["doc"][order], got["key"][order], got["hot"][order]
            head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            edges = np.concatenate([head, [len(doc)]])
            cold = [key[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            warm = [key[a:b][hot[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(cold, pa.binary()), pa.array(warm, pa.binary())], names=["doc", "keys", "hot"])

    return common.by_bucket(shared).mapInArrow(run, "doc bigint, keys binary, hot binary")


def _hot_pairs(shared: DataFrame) -> DataFrame:
    """The blobs of _shared with nothing but hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = common.Dealer()
        for batch in batches:
            for bucket, doc, key, hot in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc", "key", "hot")), strict=True):
                hot = np.frombuffer(hot, bool)
                doc, key = np.frombuffer(doc, np.int64)[hot], np.frombuffer(key, np.uint64)[hot]
                yield from dealer.add(np.full(len(doc), bucket, np.int32), {"doc": doc, "key": key, "hot": np.ones(len(doc), bool)})
        yield from dealer.rest()

    return shared.where(F.locate("\x01", F.col("hot").cast("string")) > 0).mapInArrow(run, common.blob_schema("doc", "key", "hot"))


def _listed(column: pa.Array, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each (row, key) is in the row's list of keys."""
    lists = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    salt = np.uint64(0x9E3779B97F4A7C15)
    listed = np.concatenate([np.zeros(0, np.uint64), *lists]) ^ common.mix(owner.astype(np.uint64) * salt + np.uint64(1))
    return np.isin(key ^ common.mix(rows.astype(np.uint64) * salt + np.uint64(1)), listed)


def _segments(texts: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    """Blobs (key, doc, tie, start, size, bytes) by key bucket: the runs of shared keys that aren't hot."""
    names = ["key", "doc", "tie", "start", "size", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for chunk in common.text_chunks(batches):
            data, starts = common.text_bytes(chunk.column("text"))
            key, row, head, count = window_runs(data, starts, length, gram)
            taken = np.flatnonzero(_listed(chunk.column("keys"), row, key) & ~_listed(chunk.column("hot"), row, key))
            if not len(taken):
                continue
            pieces = -(-count[taken] // SEGMENT_WINDOWS)
            taken = np.repeat(taken, pieces)
            part = np.arange(len(taken)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            key, row, begin = key[taken], row[taken], head[taken] + part * SEGMENT_WINDOWS
            size = np.minimum(count[taken] - part * SEGMENT_WINDOWS, SEGMENT_WINDOWS) + length - 1
            bucket = (common.mix(key) % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, row, begin, size, bucket = key[order], row[order], begin[order], size[order], bucket[order]
            fixed = {
                "key": key,
                "doc": _ids(chunk.column("doc_id"))[row],
                "tie": chunk.column("tie").to_numpy(zero_copy_only=False)[row],
                "start": begin - starts[row],
                "size": size.astype(np.int32),
            }
            batch = common.deal(bucket, fixed)
            edges = np.concatenate([[0], np.cumsum(size)])
            cut = np.concatenate([np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0])), [len(bucket)]])
            raw = pa.py_buffer(data[common.ragged(begin, size)].tobytes())
            offsets = pa.py_buffer(edges[cut].astype(np.int32))
            blob = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, offsets, raw])
            held.append(pa.RecordBatch.from_arrays([*batch.columns, blob], names=["bucket", *names]))
            if sum(x.nbytes for x in held) >= SENT_BYTES:
                yield common.together(held)
                held = []
        if held:
            yield common.together(held)

    return texts.select("doc_id", "tie", "text", "keys", "hot").mapInArrow(run, common.blob_schema(*names))


def _removed_runs(segments: DataFrame, n_buckets: int, length: int) -> DataFrame:
    """Blobs (doc, tie, low, high) by document: bytes covered by windows that an earlier document has."""
    dtypes = {"key": np.uint64, "doc": np.int64, "tie": np.int64, "start": np.int64, "size": np.int32, "bytes": np.uint8}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = common.Dealer()
        for _, got in common.buckets(batches, dtypes):
            size, raw = got["size"].astype(np.int64), got["bytes"]
            begin = np.cumsum(size) - size
            one, segment, lowest = distinct_segments(raw, begin, size, got["doc"])
            turn = np.argsort(got["key"][one], kind="stable")
            back = np.empty(len(turn), np.int64)
            back[turn] = np.arange(len(turn))
            one, segment, lowest = one[turn], back[segment], lowest[turn]
            text = raw[common.ragged(begin[one], size[one])]
            least_doc = least_by_key(text, size[one], lowest, got["key"][one], length)
            # Back to all occurrences: windows whose least document is earlier.
            windows = size - length + 1
            base = np.cumsum(size[one]) - size[one]
            earlier = least_doc[common.ragged(base[segment], windows)] < np.repeat(got["doc"], windows)
            owner = common.row_of(windows)
            opens, closes = earlier.copy(), earlier.copy()
            opens[1:] &= ~(earlier[:-1] & (owner[1:] == owner[:-1]))
            closes[:-1] &= ~(earlier[1:] & (owner[1:] == owner[:-1]))
            low, high = np.flatnonzero(opens), np.flatnonzero(closes)
            if not len(low):
                continue
            at = owner[low]
            first = np.cumsum(windows) - windows
            doc, tie = got["doc"][at], got["tie"][at]
            low, high = got["start"][at] + low - first[at], got["start"][at] + high - first[at] + length
            bucket = (common.mix(doc.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)
            yield from dealer.add(bucket, {"doc": doc, "tie": tie, "low": low, "high": high})
        yield from dealer.rest()

    return common.by_bucket(segments).mapInArrow(run, common.blob_schema("doc", "tie", "low", "high"))


def _hot_runs(texts: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    """As _removed_runs, for hot keys: windows are aggregated by content before the exchange and joined back."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            data, starts = common.text_bytes(chunk.column("text"))
            key, row, head, count = window_runs(data, starts, length, gram)
            taken = np.flatnonzero(_listed(chunk.column("hot"), row, key))
            at, row = common.ragged(head[taken], count[taken]), np.repeat(row[taken], count[taken])
            window = [data[a : a + length].tobytes() for a in at]
            tie = chunk.column("tie").to_numpy(zero_copy_only=False)[row]
            arrays = [pa.array(window, pa.binary()), pa.array(_ids(chunk.column("doc_id"))[row]), pa.array(tie), pa.array(at - starts[row])]
            yield pa.RecordBatch.from_arrays(arrays, names=["window", "doc", "tie", "low"])

    schema = "window binary, doc bigint, tie bigint, low bigint"
    rows = texts.select("doc_id", "tie", "text", "hot").mapInArrow(explode, schema)
    least = rows.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("window", "least")
    found = rows.join(least, "window").where("least < doc").select("doc", "tie", "low", (F.col("low") + length).alias("high"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = common.Dealer()
        for batch in batches:
            arrays = {c: batch.column(c).to_numpy() for c in ("doc", "tie", "low", "high")}
            yield from dealer.add((common.mix(arrays["doc"].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), arrays)
        yield from dealer.rest()

    return found.mapInArrow(pack, common.blob_schema("doc", "tie", "low", "high"))


def _merged(runs: DataFrame) -> DataFrame:
    """Per document: doc, tie, lows and highs (binary) of its merged removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in common.buckets(batches, {c: np.int64 for c in ("doc", "tie", "low", "high")}):
            order = np.lexsort((got["low"], got["tie"], got["doc"]))
            doc, tie, low, high = (got[c][order] for c in ("doc", "tie", "low", "high"))
            head = np.ones(len(doc), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
            group = np.cumsum(head) - 1
            # Running maximum of the ends inside a document: ends are lifted by a step per document.
            step = int(high.max()) + 1
            reach = np.maximum.accumulate(high + group * step)
            new = head.copy()
            new[1:] |= low[1:] + group[1:] * step > reach[:-1]
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(doc)]]) - 1
            low, high, group = low[first], reach[last] - group[last] * step, group[first]
            edges = np.searchsorted(group, np.arange(group[-1] + 2))
            lows = [low[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            highs = [high[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            at = np.flatnonzero(head)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tie[at]), pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], names=["doc", "tie", "lows", "highs"])

    return common.by_bucket(runs).mapInArrow(run, "doc bigint, tie bigint, lows binary, highs binary")


def _cut(texts: DataFrame) -> DataFrame:
    """Per document with removed runs: doc, tie, n_removed, n_spans, kept_sha256, spans (pairs of byte offsets)."""
    names = ["doc", "tie", "n_removed", "n_spans", "kept_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in common.text_chunks(batches):
            columns: list[list] = [[] for _ in names]
            for doc, tie, text, lows, highs in zip(*(chunk.column(c).to_pylist() for c in ("doc", "tie", "text", "lows", "highs")), strict=True):
                raw, low, high = (text or "").encode(), np.frombuffer(lows, np.int64), np.frombuffer(highs, np.int64)
                kept, at = hashlib.sha256(), 0
                for a, b in zip(low, high, strict=True):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                spans = np.stack([low, high], axis=1).tolist()
                for column, value in zip(columns, (doc, tie, int((high - low).sum()), len(low), kept.hexdigest(), spans), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "doc bigint, tie bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<array<bigint>>")


def remove_repeats(docs: DataFrame, min_length: int = MIN_LENGTH, gram: int = GRAM, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Every byte covered by a string of min_length bytes that also starts in a document with a smaller doc_id is
    removed; strings are judged on the input and never cross documents. Null text counts as empty. Rows with
    a null doc_id come after all others and remove nothing from each other; rows with one doc_id likewise.
    """
    if not 1 <= gram <= min_length:
        raise ValueError("gram must lie between 1 and min_length")
    n_buckets = common.BUCKETS_PER_PARTITION * common.shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    order_id = F.coalesce(F.col("doc_id"), F.lit(int(LAST)))
    # doc_id and text name a row (tie: 64-bit hash of the text), so rows that share an id keep apart.
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    info = rows.select("doc_id", "tie", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    info = common.materialise(info)
    first = info.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    info = info.join(first, "sha").withColumn("copy", F.coalesce(F.col("first_id") < order_id, F.lit(False)) & (F.col("n_bytes") >= min_length))
    info = common.materialise(info.select("doc_id", "tie", "n_bytes", "sha", "copy", order_id.alias("doc")))

    copies = common.materialise(info.where("copy").select("doc_id", "tie").distinct())
    rows = common.keep_ids(rows, copies, "doc_id", "tie", how="left_anti")
    shared = common.materialise(_shared(_keys(rows, n_buckets, min_length, gram), n_buckets, hot_docs))
    rows = rows.withColumn("doc", order_id)
    texts = rows.join(_per_document(shared), "doc")
    runs = common.materialise(_removed_runs(_segments(texts, n_buckets, min_length, gram), n_buckets, min_length))
    hot = common.materialise(_hot_pairs(shared))
    if not hot.isEmpty():
        hot = common.materialise(_per_document(hot))
        texts = common.keep_ids(rows, hot.select("doc"), "doc").join(hot, "doc")
        runs = runs.union(common.materialise(_hot_runs(texts, n_buckets, min_length, gram)))
    merged = common.materialise(_merged(runs))
    touched, ids = rows, common.materialise(merged.select("doc").distinct())
    if ids.count() <= common.BROADCAST_IDS:  # else the join below would shuffle the same texts again
        touched = common.keep_ids(rows, ids, "doc")
    cut = _cut(touched.join(merged, ["doc", "tie"]).select("doc", "tie", "text", "lows", "highs").dropDuplicates(["doc", "tie"]))

    partly = info.join(cut, ["doc", "tie"], "left")
    everything = F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes")))
    return partly.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), everything).otherwise(F.coalesce("spans", F.array().cast("array<array<bigint>>"))).alias("spans"),
    )
