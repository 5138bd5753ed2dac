"""Language sets without a cap against a plain version, and quality fences that follow their group."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from varloom.llm import common, langid, quality

SYLLABLES = {
    "aa": ["tha", "wen", "ing", "oth", "sher"],
    "bb": ["ñol", "ción", "ade", "ero", "lla"],
    "cc": ["szcz", "owa", "nie", "prz", "ych"],
    "dd": ["koku", "mi", "ra", "tsu", "yama"],
    "ee": ["üng", "schä", "keit", "ver", "öt"],
}


def speech(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(2, 3))) for _ in range(n))


def model_of(spark):
    return langid.learn(spark.createDataFrame([(speech(x, 80, i), x) for x in SYLLABLES for i in range(20)], "text string, lang string"))


def plain_mixture(model, text):
    """Word by word, language by language: EM until nothing moves, sets that grow while the likelihood pays."""
    cells, at, _ = langid._trigram_cells(*common.text_bytes(pa.array([text])))
    words = [[sum(float(model.log_law[c, j]) for c in cells[a:b]) for j in range(len(model.languages))] for a, b in zip(at, [*at[1:], len(cells)], strict=True)]

    def fit(allowed):
        tops = [max(w[j] for j in allowed) for w in words]
        like = [[math.exp(w[j] - top) for j in allowed] for w, top in zip(words, tops, strict=True)]
        share = [1 / len(allowed)] * len(allowed)
        for _ in range(300):
            new = [0.0] * len(allowed)
            for w in like:
                part = [p * x for p, x in zip(share, w, strict=True)]
                size = sum(part) * len(words)
                new = [a + x / size for a, x in zip(new, part, strict=True)]
            moved, share = max(abs(a - b) for a, b in zip(new, share, strict=True)), new
            if moved < 1e-6:
                break
        total = sum(top + math.log(sum(p * x for p, x in zip(share, w, strict=True))) for w, top in zip(like, tops, strict=True))
        return dict(zip(allowed, share, strict=True)), total

    everything = range(len(model.languages))
    full, _ = fit(list(everything))
    order = sorted(everything, key=lambda j: -full[j])
    best = max(everything, key=lambda j: sum(w[j] for w in words))
    chosen, gained = {best: 1.0}, sum(w[best] for w in words)
    for m in range(2, len(order) + 1):
        share, total = fit(order[:m])
        if total - langid.PENALTY * 0.5 * math.log(len(words) + 1) <= gained:
            break
        chosen, gained = share, total
    return {model.languages[j]: p for j, p in chosen.items()}


def test_sets_grow_to_as_many_languages_as_a_text_has(spark):
    model = model_of(spark)
    texts = [" ".join(speech(x, 30, 100 + i) for x in list(SYLLABLES)[:n]) for i, n in enumerate((1, 2, 3, 4, 5, 5))]
    texts += [speech("aa", 90, 1) + " " + speech("dd", 10, 2), "x", "tha"]
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    for r in rows:
        want = plain_mixture(model, texts[r.doc_id])
        assert set(r.proportions) == set(want) and r.n_languages == len(want)
        assert all(abs(r.proportions[x] - p) < 0.02 for x, p in want.items())
        assert r.em_rounds < langid.EM_LIMIT
    assert [r.n_languages for r in sorted(rows, key=lambda r: r.doc_id)][:6] == [1, 2, 3, 4, 5, 5]
    assert all(abs(p - 0.2) < 0.05 for r in rows if r.doc_id == 4 for p in r.proportions.values())


def test_documents_settle_alone_as_they_do_together(spark):
    model = model_of(spark)
    texts = [speech("aa", 50, 7) + " " + speech("bb", 5, 8), speech("cc", 40, 9), None, "", speech("dd", 30, 1) + " " + speech("ee", 30, 1)]
    together = langid.infer(model, *common.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        alone = langid.infer(model, *common.text_bytes(pa.array([t], pa.string())))
        assert np.allclose(together[0][i], alone[0][0], atol=1e-6) and together[1][i] == alone[1][0]


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def planted(lang, source, first, sizes, symbols, r):
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in sizes for _ in range(200)]
    rows = []
    for i in range(150):
        text = "\n".join(sentence(r, words, 12) for _ in range(8))
        for _ in range(symbols * r.randint(8, 12) // 10):
            text = text.replace(" ", " |", 1)
        rows.append((first + i, text, lang, source))
    return rows, words


def test_each_measure_rejects_rows_that_pass_all_others(docs_of):
    r = random.Random(9)
    rows, words = planted("en", "plain", 0, (3, 4, 5, 6), 0, r)
    lines = [sentence(r, words, 12) for _ in range(8)]
    long_words = ["".join(r.choices("abcdefgh", k=14)) for _ in range(300)]
    again = sentence(r, words, 8)
    bad = {
        "word_len_pct": "\n".join(sentence(r, long_words, 12) for _ in range(8)),
        "symbol_pmil": "\n".join(lines).replace(" a", " |||a").replace(" b", " ***b").replace(" c", " $$$c").replace(" d", " ###d"),
        "dup_line_pmil": "\n".join(x for line in lines for x in (line, "ab")),
        "repeat_pmil": "\n".join([*(sentence(r, words, 16) for _ in range(8)), again, sentence(r, words, 10) + " " + again]),
    }
    rows += [(1000 + i, t, "en", "plain") for i, t in enumerate(bad.values())]
    docs = docs_of(rows)
    got = {x.doc_id: x for x in quality.judge(docs).collect()}
    assert all(got[i].kept for i in range(150))
    measured = common.materialise(quality.measures(quality.base_columns(docs)))
    limits = {(x.lang, x.source): x for x in quality.thresholds(quality.sketches(measured)).collect()}["en", "plain"]
    for i, name in enumerate(bad):
        row = got[1000 + i]
        assert not row.base_failed and not row.kept, name
        out = []
        for m, units, chance in quality.MEASURES:
            n = measured.where(F.col("doc_id") == 1000 + i).first()[units]
            noise = quality.WORD_LEN_NOISE / math.sqrt(row.n_words) if m == "word_len_pct" else 1000 * chance / n
            if not limits[f"low_{m}"] - int(noise) <= row[m] <= limits[f"high_{m}"] + int(noise):
                out.append(m)
        assert out == [name]


def test_fences_follow_their_group(docs_of):
    r = random.Random(4)
    plain, _ = planted("en", "plain", 0, (3, 4, 5, 6), 0, r)
    tables, _ = planted("en", "tables", 500, (3, 4, 5, 6), 60, r)
    long, _ = planted("de", "plain", 1000, (7, 9, 11, 13), 0, r)
    limits = {(x.lang, x.source): x for x in quality.thresholds(quality.sketches(common.materialise(quality.measures(quality.base_columns(docs_of(plain + tables + long)))))).collect()}
    assert limits["en", "tables"].high_symbol_pmil > 100 > limits["en", "plain"].high_symbol_pmil == 0
    assert limits["de", "plain"].low_word_len_pct > limits["en", "plain"].high_word_len_pct
    kept = {x.doc_id: x.kept for x in quality.judge(docs_of(plain + tables + long + [(2000, tables[0][1], "en", "plain")])).collect()}
    assert kept[500] and not kept[2000]
    only_failed = docs_of([(1, "too short", "fr", "x"), (2, None, None, None)])
    assert [x.kept for x in quality.judge(only_failed).collect()] == [False, False]
