"""Benchmark decontamination by pigeonhole edit matching.

A test item that may differ by e edits is cut into e + 1 pieces: whatever the edits, one piece is intact. All
pieces of a block of items form one automaton; documents stream past it, and each exact piece hit names the
place where the item would lie. There, Myers' bit-parallel distance (semi-global: the item against any part
of the window) decides. Items are taken in blocks of bounded size, so the automaton fits in memory however
many items there are; every block reads all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm import common

#: Edits allowed per character of an item.
ERROR_RATE = 0.05
#: Normalised characters of items in one automaton.
BLOCK_CHARS = 8_000_000


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def pieces(item: str, rate: float = ERROR_RATE) -> tuple[int, list[tuple[int, str]]]:
    """Error budget, and the budget-plus-one pieces with their offsets."""
    budget = int(len(item) * rate)
    cut = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def myers(pattern_bits: dict[str, int], length: int, window: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the window, and where the first best part ends."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, best_end = length, 0
    for at, ch in enumerate(window, 1):
        match = pattern_bits.get(ch, 0)
        zero = ((((match & plus) + plus) ^ plus) | match | minus) & full
        h_plus = minus | (full & ~(zero | plus))
        h_minus = plus & zero
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(zero | h_plus))
        minus = h_plus & zero
        if score < best:
            best, best_end = score, at
    return best, best_end


class Matcher:
    """All items of a block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            budget, cut = pieces(text, rate)
            bits: dict[str, int] = {}
            for i, ch in enumerate(text):
                bits[ch] = bits.get(ch, 0) | 1 << i
            for offset, piece in cut:
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget, bits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, start) of the first place with the least distance, for every item within its budget."""
        if not self.items:
            return []
        text = normalise(text)
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, int] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                item_id, item, budget, bits = self.items[k]
                if best.get(k, (1, 0))[0] == 0:
                    continue
                start = end + 1 - size - offset
                if 0 <= start and text.startswith(item, start):
                    best[k] = (0, start)
                    continue
                # A window around the same diagonal has been tried if it lies within the slack of the last one.
                if tried.get(k) is not None and abs(start - tried[k]) <= budget // 2:
                    continue
                tried[k] = start
                slack = 2 * budget
                low = max(0, start - slack)
                distance, at = myers(bits, len(item), text[low : max(0, start + len(item) + slack)])
                if distance <= budget and distance < best.get(k, (budget + 1, 0))[0]:
                    best[k] = (distance, max(0, low + at - len(item)))
        return sorted((self.items[k][0], d, s) for k, (d, s) in best.items())


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start): every item within its error budget in every whole text.

    start counts characters of the normalised text. Null texts, empty items and items without id match nothing;
    an item shorter than 1 / rate characters must occur exactly. Each repeated row gives its own rows.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(block: int) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        shipped = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # at most about block_chars characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shipped.value, rate)
            for chunk in common.text_chunks(batches):
                ids, out = chunk.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, chunk.column("text").to_pylist(), strict=True):
                    out += [(doc_id, *found) for found in matcher.search(text)]
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                kinds = (chunk.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id bigint, distance int, start bigint")

    return reduce(DataFrame.unionByName, [one(b) for b in range(blocks)])


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Documents without any match; those with a null doc_id can't be named by a match and stay only if no such row matches."""
    hits = common.materialise(matches(docs, benchmark, rate).select("doc_id").distinct())
    small = hits.count() <= common.BROADCAST_IDS
    hit = hits.select(F.col("doc_id").alias("_hit"))
    hit = F.broadcast(hit) if small else hit
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit"]), "left_anti")
