"""Language identification as multilingual mixture inference.

Learning: byte trigrams of labelled texts are hashed into a fixed number of cells and counted per language by
map-side sums, which gives each language a smoothed trigram law. Prediction: a word's likelihood under a
language is the product over its trigrams (blanks at both ends included); expectation-maximisation over the
words estimates the document's language proportions. The language set is chosen by penalised likelihood:
languages enter in the order of their proportions, and a set grows for as long as the gain in log-likelihood
exceeds the penalty, up to all languages. The model is languages x cells, whatever the corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm import common

CELLS = 1 << 15
#: Languages that a model may hold; the model's size, which every task loads, is bounded by it.
MAX_LANGUAGES = 200
#: A document's rounds end when no proportion moves by more; the bound is reached only where languages can hardly be told apart.
EM_TOLERANCE, EM_LIMIT = 1e-3, 200
#: Penalty per further language: this many times half the logarithm of the number of words.
PENALTY = 3.0
UNKNOWN = "und"
#: Text bytes whose trigrams are held at once.
HELD_TEXT = 1 << 20


def _trigram_cells(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the trigrams of all words with a letter (blank, word, blank; A-Z lowered), where each word starts among them, words per row."""
    n = len(data)
    low = common.LOWERED[data]
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    space = common.IS_SPACE[data]
    inside = ~space
    before = np.empty(n, bool)
    before[:1], before[1:] = False, inside[:-1]
    before[starts[:-1][starts[:-1] < n]] = False
    first = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:], after[:-1] = False, inside[1:]
    after[starts[1:][np.diff(starts) > 0] - 1] = False
    last = np.flatnonzero(inside & ~after)
    left = np.empty(n, np.uint32)
    left[:1], left[1:] = 32, low[:-1]
    left[first] = 32
    right = np.empty(n, np.uint32)
    right[-1:], right[:-1] = 32, low[1:]
    right[last] = 32
    code = (left << np.uint32(16)) | (low.astype(np.uint32) << np.uint32(8)) | right
    cell = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    lettered = np.add.reduceat(letter, first) > 0 if len(first) else np.zeros(0, bool)
    taken = np.repeat(lettered, last - first + 1)
    cells = cell[inside][taken]
    sizes = (last - first + 1)[lettered]
    per_row = np.diff(np.searchsorted(first[lettered], starts))
    return cells, np.cumsum(sizes) - sizes, per_row


@dataclass
class Model:
    languages: list[str]
    log_law: np.ndarray  # cells x languages, natural logarithms


def learn(labelled: DataFrame) -> Model:
    """From (text, lang): every labelled text counts. Null texts and null langs teach nothing."""
    rows = labelled.select("text", "lang").where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for chunk in common.text_chunks(batches, limit=HELD_TEXT):
            coded = chunk.column("lang").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            data, starts = common.text_bytes(chunk.column("text"))
            cells, word_starts, per_row = _trigram_cells(data, starts)
            sizes = np.diff(np.concatenate([word_starts, [len(cells)]]))
            lang = np.repeat(code[common.row_of(per_row)], sizes).astype(np.int64)
            sums = np.bincount(lang * CELLS + cells, minlength=len(names) * CELLS).reshape(-1, CELLS)
            for name, row in zip(names, sums, strict=True):
                held[name] = held[name] + row if name in held else row
        for name, row in held.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "cell", "n"]
            )

    counts = rows.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = common.materialise(counts)
    languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: raise MAX_LANGUAGES if such a model fits in a task")
    table = counts.toArrow()  # at most languages x CELLS rows
    sums = np.full((CELLS, max(1, len(languages))), 0.5)
    place = {name: i for i, name in enumerate(languages)}
    if table.num_rows:
        at = np.array([place[x] for x in table["lang"].to_pylist()])
        sums[table["cell"].to_numpy(), at] += table["n"].to_numpy()
    return Model(languages, np.log(sums / sums.sum(axis=0)).astype(np.float32))


def _segment_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), values.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out


def infer(model: Model, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (rows x languages; zeros where no word has a letter), the size of the chosen set and its rounds."""
    return _inferred(model, data, starts)[:3]


def _inferred(model: Model, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What infer() gives, and whether the set's likelihood exceeds that of equally frequent trigrams by the penalty."""
    cells, word_starts, per_row = _trigram_cells(data, starts)
    docs, langs = len(per_row), len(model.languages)
    if not len(cells) or not langs:
        return np.zeros((docs, langs)), np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.zeros(docs, bool)
    word_log = np.empty((len(word_starts), langs), np.float32)
    for j in range(langs):
        word_log[:, j] = np.add.reduceat(model.log_law[:, j][cells], word_starts)
    row = common.row_of(per_row)
    first_word = np.cumsum(per_row) - per_row
    shift = word_log.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(word_log - shift, -60.0))
    base = _segment_sum(shift, per_row)[:, 0]
    single = _segment_sum(word_log, per_row)

    def fit(some: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions of these documents over their allowed languages, log-likelihoods and rounds; settled documents drop out."""
        share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
        rounds = np.zeros(len(some), np.int64)
        counts = per_row[some]
        words = like[common.ragged(first_word[some], counts)] if len(some) < docs else like
        going, held, of, size = np.arange(len(some)), words, common.row_of(counts), counts
        for _ in range(EM_LIMIT):
            part = held * share[going].astype(np.float32)[of]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            new = _segment_sum(part, size) / np.maximum(size, 1)[:, None]
            still = np.abs(new - share[going]).max(axis=1) > EM_TOLERANCE
            share[going] = new
            rounds[going] += 1
            if not still.any():
                break
            held, going, size = held[still[of]], going[still], size[still]
            of = common.row_of(size)
        total = np.log(np.maximum((words * share[common.row_of(counts)].astype(np.float32)).sum(axis=1, keepdims=True), 1e-30))
        return share, base[some] + _segment_sum(total, counts)[:, 0], rounds

    everyone = np.arange(docs)
    full, most, _ = fit(everyone, np.ones((docs, langs)))
    order = np.argsort(-full, axis=1, kind="stable")
    chosen = np.zeros((docs, langs))
    chosen[everyone, single.argmax(axis=1)] = 1.0
    gained = single.max(axis=1)
    size, rounds = np.ones(docs, np.int64), np.zeros(docs, np.int64)
    penalty = PENALTY * 0.5 * np.log(per_row + 1)
    # No set beats all languages together, so where even these gain less than the penalty none is tried.
    open_docs = everyone[(most + 1 - penalty > gained) & (per_row > 0)]
    for m in range(2, langs + 1):
        if not len(open_docs):
            break
        allowed = np.zeros((len(open_docs), langs))
        np.put_along_axis(allowed, order[open_docs, :m], 1.0, axis=1)
        share, total, taken = fit(open_docs, allowed)
        better = total - penalty[open_docs] > gained[open_docs]
        open_docs = open_docs[better]
        chosen[open_docs], gained[open_docs], size[open_docs], rounds[open_docs] = share[better], total[better], m, taken[better]
        open_docs = open_docs[most[open_docs] + 1 - penalty[open_docs] > gained[open_docs]]
    empty = per_row == 0
    chosen[empty], size[empty] = 0.0, 0
    sizes = np.diff(np.concatenate([word_starts, [len(cells)]]))
    background = -np.log(CELLS) * np.bincount(row, sizes, minlength=docs)
    return chosen, size, rounds, ~empty & (gained - penalty > background)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), n_languages, proportions of the chosen set, em_rounds they took.

    `und` with score 0 where text is null or has no letter, or nothing was learned. Ties go to the language
    that is first by name. Only the text decides.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast((model.languages, model.log_law))  # at most MAX_LANGUAGES x CELLS x 4 bytes
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shipped.value)
        for chunk in common.text_chunks(batches, limit=HELD_TEXT):
            texts = chunk.column("text")
            data, starts = common.text_bytes(texts)
            share, size, rounds = infer(known, data, starts)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            sure = letters & (size > 0)
            best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(size), np.int64)
            names = [known.languages[b] if ok else UNKNOWN for b, ok in zip(best, sure, strict=True)]
            score = np.where(sure, share[np.arange(len(best)), best] if share.shape[1] else 0.0, 0.0)
            mixed = [
                [(known.languages[j], float(share[i, j])) for j in np.flatnonzero(share[i] > 0)] if sure[i] else [] for i in range(len(best))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(np.clip(score, 0.0, 1.0)),
                    pa.array(np.where(sure, size, 0).astype(np.int32)),
                    pa.array(mixed, pa.map_(pa.string(), pa.float64())),
                    pa.array(rounds.astype(np.int32)),
                ],
                names=["doc_id", "lang_pred", "score", "n_languages", "proportions", "em_rounds"],
            )

    schema = f"doc_id {kind}, lang_pred string, score double, n_languages int, proportions map<string, double>, em_rounds int"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the document id as text leaves the remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def predict_split(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, predict all: doc_id, held_out, then identify()'s columns."""
    model = learn(docs.where(~held_out(4, 2)))
    return identify(docs, model).withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "lang_pred", "score", "n_languages", "proportions", "em_rounds")


def accepted(docs: DataFrame) -> DataFrame:
    """Documents in whose text a language is found, all columns kept; the others are rejected.

    Rejected are texts that are null or without a letter, and those that the chosen languages explain no better
    than a law of equally frequent trigrams, by the penalty. If nothing was learned, every text with a letter stays.
    The decision is made row by row beside the text, so no row is shuffled and repeated ids are no matter.
    """
    model = learn(docs.where(~held_out(4, 2)))
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_law))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shipped.value)
        for chunk in common.text_chunks(batches, limit=HELD_TEXT):
            texts = chunk.column("text")
            found = _inferred(known, *common.text_bytes(texts))[3] if known.languages else True
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            yield chunk.filter(pa.array(letters & found))

    return docs.mapInArrow(run, docs.schema)
