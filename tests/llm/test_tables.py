"""Mixing, archives, tokens, similarity, repeats, the language model and the pipeline against brute force."""

from __future__ import annotations

import ctypes
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from varloom.llm import common, jaccard, katz, mixing, suffix, tokens, warc
from varloom.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) for _ in range(n))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing ------------------------------------------------------------------------------------------------


def filled(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_equal_repeated_redistribution(docs_of):
    r = random.Random(1)
    rows = [(i, prose(r.randrange(1, 60), i), None, f"s{min(int(r.expovariate(0.5)), 6)}") for i in range(400)]
    rows += [(500, None, None, "s0"), (501, "", None, None), (502, "one two three", None, None), (503, prose(3000, 1), None, "s1"), rows[0], rows[0], (None, "x y", None, "s2")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(split(t))
    expected = filled(sizes)
    taken = Counter()
    for g in got:
        assert g.size == len(split(g.text)) and g.source_size == sizes[g.source]
        assert math.isclose(g.target, expected[g.source])
        assert g.taken == g.reps * g.size <= 3 * g.size
        taken[g.source] += g.taken
    largest = defaultdict(int)
    for _, t, _, s in rows:
        largest[s] = max(largest[s], len(split(t)))
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(docs_of(rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    out = mixing.repeated(mixing.mix(docs_of(rows)), ["doc_id", "text"])
    assert out.count() == sum(g.reps for g in got)


def test_mixing_keeps_clashing_columns_and_empty_tables(docs_of):
    odd = docs_of([(1, "a b", None, "s"), (2, "c", None, "t")]).withColumn("extra", F.lit(7)).withColumn("size", F.lit("no"))
    got = mixing.mix(odd)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "size", "source_size", "target", "reps", "taken"]
    assert {r["size"] for r in got.collect()} == {2, 1}
    assert mixing.mix(docs_of([])).count() == 0
    assert {r.taken for r in mixing.mix(docs_of([(1, None, None, "s"), (2, "", None, None)])).collect()} == {0}


def test_mixture_keeps_columns_with_the_names_of_helpers(spark):
    names = ["rest", "whole", "earlier", "bucket", "_bucket", "_place", "place", "of", "id", "row", "plan_bucket", "in_bucket", "weight", "col"]
    rows = [(i, "a b c " * (i + 1), "st"[i % 2], *range(7, 7 + len(names))) for i in range(8)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mixing.mix(table)
    assert got.count() == 8 and {tuple(r[n] for n in names) for r in got.collect()} == {tuple(range(7, 7 + len(names)))}
    plain = {r.doc_id: (r.reps, r.taken) for r in mixing.mix(table.select("doc_id", "text", "source")).collect()}
    assert {r.doc_id: (r.reps, r.taken) for r in got.collect()} == plain
    assert mixing.repeated(got, table.columns).count() == sum(r for r, _ in plain.values())


# --- archives ----------------------------------------------------------------------------------------------


def pages(spark):
    r = random.Random(3)
    html = [None, "", "<p>é€🙂</p>", "x" * 70000, "WARC/1.1\r\nContent-Length: 5\r\n\r\nfake\r\n\r\n0\r\n\r\n", prose(30000, 1)] + [prose(r.randrange(1, 90), i) for i in range(20)]
    rows = [(i, f"http://a/{i} b\r\nWARC-Type: x", h) for i, h in enumerate(html + html[:7] + ["", None])]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


@pytest.mark.parametrize("segment", [300, 4096, 10**6])
def test_archives_come_back_whole(spark, tmp_path, segment):
    rows, table = pages(spark)
    path = str(tmp_path / "warc")
    warc.write(table, path, segment_bytes=segment, records_per_file=5)
    records = warc.records(spark, path)
    if segment == 300:
        assert records.where("kind = 'continuation'").count() > 100
        records = records.union(records.where("segment = 2")).orderBy(F.rand(1))
    got = {r.page_id: r for r in warc.page_summary(warc.reassemble(records)).collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        raw = (h or "").encode()
        g, origin = got[i], first[h or ""]
        assert (g.payload_bytes, g.payload_digest, g.whole) == (len(raw), warc.digest32(raw), True)
        assert (g.record_type, g.refers_to) == (("response", None) if origin == i else ("revisit", origin))


def test_broken_records_are_told(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "y" * 5000), (2, "u", "z" * 5000)], "page_id bigint, url string, html string")
    warc.write(table, str(tmp_path / "w"), segment_bytes=1000)
    records = warc.records(spark, str(tmp_path / "w"))
    lost = warc.reassemble(records.where("not (origin like '<urn:x-page:1:%' and segment = 3)")).collect()
    assert {r.origin.split(":")[2]: r.whole for r in lost} == {"1": False, "2": True}
    orphan = warc.reassemble(records.where("segment > 1")).collect()
    assert {r.kind for r in orphan} == {None} and not any(r.whole for r in orphan)


def test_small_payloads_are_all_responses(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", "longer text"), (4, "u", "longer text")], "page_id bigint, url string, html string")
    warc.write(table, str(tmp_path / "w"), min_bytes=5)
    got = {r.page_id: (r.record_type, r.refers_to, r.whole) for r in warc.page_summary(warc.reassemble(warc.records(spark, str(tmp_path / "w")))).collect()}
    assert got == {1: ("response", None, True), 2: ("response", None, True), 3: ("response", None, True), 4: ("revisit", 3, True)}
    assert warc.round_trip(table.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_every_row_of_pages_comes_back(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    long = "x" * 200_000
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (4, "u", "c"), (4, "u", "d"), (5, "u", "a"), (None, "u", "a"), (None, None, "e"), (None, None, "e"), (6, "u", long), (6, "u", long), (7, "u", long), (-8, "u", None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, sha string, segment int").repartition(3)
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(table).collect()), key=str)
    assert all(r.whole for r in warc.round_trip(table).collect())
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)

    def expected(i, h):
        raw, first = (h or "").encode(), least.get(h)
        kind = ("response", None) if i == first else ("revisit", first)
        return (i is None, i or 0, len(raw), warc.digest32(raw), *kind)

    assert got == sorted((expected(i, h) for i, _, h in rows), key=str)


def test_chunked_framing():
    for size in (1, 7, 5000):
        for payload in (b"", b"a", b"0\r\n\r\n" * 40):
            assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(b"5;x=y\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n") == b"hello"
    for broken in (b"", b"5\r\nhel", b"zz\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b"-1\r\n\r\n"):
        assert warc.unchunked(broken) is None


# --- tokens ------------------------------------------------------------------------------------------------


def whole(text):
    return tokens.encoder(BPE).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_whole_texts():
    import pyarrow as pa

    r = random.Random(2)
    parts = ["a", "é", "1", " ", " ", "\n", "'", "s", "'ve", "don't", ",", ".", "…", "!!", "\t", "漢", "🙂", "<|endoftext|>", "\xa0", " b"]
    texts = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)]
    ids, sizes = tokens.encoder(BPE).encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == whole(t)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library can't trim")
@pytest.mark.parametrize("read", ["text_chunks", "buckets"])
def test_a_task_gives_its_free_memory_back(read):
    import pyarrow as pa

    def held():
        return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Private_Dirty")) / 1024

    texts = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], names=["text"])
    blobs = pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([b"12345678"], pa.binary())], names=["bucket", "x"])
    rows = common.text_chunks([texts]) if read == "text_chunks" else common.buckets([blobs], {"x": np.int64})
    assert len([next(rows)]) == 1
    arrays = [np.ones(60_000, np.uint8) for _ in range(3000)]
    pinned = arrays[::50]
    before = held()
    del arrays
    list(rows)
    assert held() < before - 120 and len(pinned) == 60


def mixed_texts(seed, n):
    r = random.Random(seed)
    parts = ["a", "é", "1", " ", " ", " ", "\n", "'", "s", "'ve", "don't", ",", ".", "…", "!!", "\t", "漢", "🙂", "\xa0", "\u2028", "\x1c", " b", " ç\n", "<|endoftext|>"]
    return [None, "", "\n", " "] + ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(n)]


class Counted:
    """A tokenizer that counts the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, add_special_tokens):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)


def test_distinct_pieces_share_texts_and_are_kept():
    import pyarrow as pa

    coder = tokens.PieceEncoder(BPE)
    coder.tokenizer = counted = Counted(coder.tokenizer)
    words = [f"w{i}x{i * i}" for i in range(4000)]
    texts = pa.array([" ".join(words[i : i + 40]) + ", " + "\n".join(words[i : i + 3]) for i in range(0, 4000, 40)])
    ids, sizes = coder.encode(texts)
    assert ids.tolist() == [x for t in texts.to_pylist() for x in whole(t)]
    assert sizes.tolist() == [len(whole(t)) for t in texts.to_pylist()]
    assert 0 < counted.texts < 50
    counted.texts = 0
    again, _ = coder.encode(texts.take(pa.array(list(range(99, -1, -1)))))
    assert counted.texts == 0 and sorted(again.tolist()) == sorted(ids.tolist())


@pytest.mark.parametrize("kept", [0, 2_000, 1 << 24])
@pytest.mark.parametrize("joined", [1, 3, 256])
def test_joined_and_kept_pieces_equal_whole_texts(monkeypatch, kept, joined):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KEPT_BYTES", kept)
    monkeypatch.setattr(tokens, "JOINED", joined)
    monkeypatch.setattr(tokens, "SLICE", 50)
    coder = tokens.PieceEncoder(BPE)
    assert coder.joins
    for seed in range(4):
        texts = mixed_texts(seed, 300)
        ids, sizes = coder.encode(pa.array(texts))
        ends = np.cumsum(sizes)
        for t, a, b in zip(texts, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == whole(t)
        assert coder.known.nbytes + coder.known_ids.nbytes + coder.known_sizes.nbytes <= max(kept, 100)


@pytest.mark.parametrize("odd", ["missing byte", "missing line feed", "added with blank", "truncated", "prefix"])
def test_other_tokenizers_as_before(tmp_path, odd):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    made = json.loads(Path(BPE).read_text())
    if odd.startswith("missing"):
        gone = {"missing byte": "a", "missing line feed": "\u010a"}[odd]
        made["model"]["vocab"] = {t: i for t, i in made["model"]["vocab"].items() if gone not in t}
        made["model"]["merges"] = [m for m in made["model"]["merges"] if gone not in "".join(m)]
    elif odd == "added with blank":
        made["added_tokens"].append({**made["added_tokens"][0], "content": "b a", "id": 60000})
    elif odd == "truncated":
        made["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    else:
        made["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "odd.json")
    Path(path).write_text(json.dumps(made))
    coder, plain = tokens.PieceEncoder(path), Tokenizer.from_file(path)
    assert coder.joins == (odd in ("missing byte", "missing line feed", "truncated"))
    if odd == "truncated":
        pieces = pa.array([f" w{i}x{i}" for i in range(50)])
        assert coder._distinct(pieces)[0].tolist() == [x for p in pieces.to_pylist() for x in plain.encode(p, add_special_tokens=False).ids]
        return
    texts = [(t or "").replace("c", "") for t in mixed_texts(5, 300)] + ["x b a, y\nz", "banana b a\nband"]
    ids, sizes = coder.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_files(spark, docs_of, tmp_path, encoding):
    rows = [(i * 3 - 50, prose(i % 40, i)) for i in range(300)] + [(5000, None), (None, "null id"), (7, "twin"), (7, "twin"), (5001, prose(6000, 1))]
    path = str(tmp_path / encoding)
    tokens.write(tokens.encode(docs_of(rows), BPE, 2), path, encoding, row_group_rows=40, page_rows=10)
    expected, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*whole(t), 2]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(map(tuple, tokens.read_digests(spark, path).collect()), key=lambda x: x[1])
    assert got == expected
    files = sorted((tmp_path / encoding).glob("*.parquet"))
    meta = pq.ParquetFile(files[-1]).metadata.row_group(0)
    assert all(pq.ParquetFile(f).metadata.row_group(0).num_rows <= 40 for f in files)
    ids = next(meta.column(c) for c in range(meta.num_columns) if meta.column(c).path_in_schema.startswith("ids"))
    assert any(("DELTA_BINARY_PACKED" if encoding == "delta" else "DICTIONARY") in e for e in ids.encodings)
    assert ids.has_offset_index
    some = tokens.lookup(spark, path, 10, 40, ["doc_id", "ids"])
    assert {r.doc_id: r.ids for r in some.collect()} == {i: [*whole(t), 2] for i, t in rows if i is not None and 10 <= i <= 40}
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and "ReadSchema: struct<doc_id:bigint,ids:array<int>>" in plan
    assert tokens.token_files(docs_of([]), BPE, 2).count() == 0


# --- similarity --------------------------------------------------------------------------------------------


def shingle_set(text):
    w = split(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) if text else "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: (len(x), find(i)) for i, x in sets}


def near_rows():
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 6, 9, 30, 120, 400]))]
        for _ in range(r.choice([1, 2, 6, 40])):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25 + 1)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy).title() if r.random() < 0.3 else " ".join(copy))
        chain = list(base)
        for _ in range(6):
            for _ in range(max(1, len(base) // 60)):
                chain[r.randrange(len(chain))] = r.choice(vocabulary)
            rows.append(" ".join(chain))
    licence = " ".join(f"licence{i}" for i in range(30))
    rows += [licence + " " + " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    rows += [None, "", " \n ", "one", "one", "ONE", "two words", "four words are here", "four words are HERE"]
    r.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


def test_components_equal_brute_force(docs_of):
    rows = near_rows()
    expected = components_of(rows)
    got = jaccard.classes(docs_of(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected and len(got) == len(rows)
    assert max(Counter(c for _, c in expected.values()).values()) > 20
    kept = jaccard.first_of_each(docs_of(rows + rows[:5] + [(None, "no id")]).withColumn("sig", F.lit("x")))
    assert kept.columns[-1] == "sig"
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted(i for i, (_, c) in expected.items() if i == c)
    assert kept.where("doc_id is null").count() == 1


def test_classes_of_repeated_rows_and_empty_tables(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (3, None)]
    got = sorted(map(tuple, jaccard.classes(docs_of(rows)).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 0, 3)]
    assert jaccard.classes(docs_of([])).count() == 0


def test_long_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


# --- repeats -----------------------------------------------------------------------------------------------


def cut_repeats(rows, least):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < i:
                gone[k : k + least] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows():
    r = random.Random(4)
    common_part = [prose(12, 100 + k) for k in range(5)]
    rows = []
    for i in range(70):
        t = prose(r.randrange(1, 40), i)
        for _ in range(r.randrange(3)):
            t += r.choice(["", "é", " ", "\n"]) + r.choice(common_part)[r.randrange(20) :] + prose(r.randrange(6), i * 7)
        rows.append((i, t))
    rows += [(80, rows[3][1]), (81, rows[3][1]), (82, "a" * 300), (83, "b" + "a" * 500 + "c"), (84, None), (85, ""), (86, "x" * 49), (87, "x" * 49), (88, "y" * 50), (89, "y" * 50)]
    rows += [(5, rows[5][1]), (6, "another text with the id of an earlier one " + common_part[0]), (90, prose(9000, 5) + common_part[1])]
    return rows


@pytest.mark.parametrize("hot_docs", [suffix.HOT_DOCS, 3])
def test_repeats_equal_brute_force(docs_of, hot_docs):
    rows = repeat_rows()
    got = suffix.remove_repeats(docs_of(rows), hot_docs=hot_docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == cut_repeats(rows, 50)


def test_repeats_of_other_lengths_and_null_ids(docs_of):
    rows = repeat_rows()[:40]
    got = suffix.remove_repeats(docs_of(rows), min_length=24, gram=8).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == cut_repeats(rows, 24)
    text = prose(40, 1)
    named = {r.doc_id: r.n_removed for r in suffix.remove_repeats(docs_of([(4, text), (None, text + " tail"), (None, text + " other")])).collect()}
    assert named[4] == 0 and named[None] >= len(text)
    assert suffix.remove_repeats(docs_of([])).count() == 0


def test_interval_expansion_finds_all_groups():
    r = random.Random(0)
    for least in (1, 3, 6):
        for _ in range(30):
            segments = ["".join(r.choice("ab") for _ in range(r.randrange(1, 12))).encode() for _ in range(r.randrange(1, 9))]
            docs = np.array([r.randrange(5) for _ in segments])
            got = suffix.least_documents(np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments]), docs, least)
            at = 0
            for s in segments:
                for k in range(len(s)):
                    w = s[k : k + least]
                    if len(w) == least:
                        assert got[at] == min(d for x, d in zip(segments, docs, strict=True) if w in x)
                    at += 1


def least_by_brute_force(segments, docs, least):
    first = {}
    for s, d in zip(segments, docs, strict=True):
        for k in range(len(s) - least + 1):
            first[s[k : k + least]] = min(first.get(s[k : k + least], d), d)
    return [first[s[k : k + least]] if k + least <= len(s) else None for s in segments for k in range(len(s))]


def test_transform_of_long_repeats_in_pieces_and_sieved(monkeypatch):
    r = random.Random(3)
    for turn in range(300):
        least = r.choice([1, 2, 9, 20, 50])
        parts = [bytes(r.randrange(256 if turn % 2 else 3) for _ in range(r.choice([1, 3, 20, 40, 60]))) for _ in range(5)]
        segments = [b"".join(r.choice(parts) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 12))]
        segments = [s for s in segments if len(s) >= least] + ([bytes(range(256))] if turn % 3 else [b"z" * 60])
        docs = np.array([r.randrange(5) for _ in segments])
        data, sizes = np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments])
        want = least_by_brute_force(segments, docs, least)
        monkeypatch.setattr(suffix, "PIECE_BYTES", r.choice([1, 200, 1 << 20]))
        monkeypatch.setattr(suffix, "SIEVE_BYTES", r.choice([1, 200, 1 << 20]))
        for got in (
            suffix.least_documents(data, sizes, docs, least),
            suffix.sieved_documents(data, sizes, docs, least),
            suffix.least_by_key(data, sizes, docs, np.zeros(len(sizes), np.uint64), least),
        ):
            assert [int(g) for g, w in zip(got, want, strict=True) if w is not None] == [w for w in want if w is not None]


def test_transforms_hold_few_keys_and_no_windows_that_occur_once(monkeypatch):
    sizes_seen, solve = [], suffix.repeat_groups

    def seen(symbols, *rest):
        sizes_seen.append(len(symbols))
        return solve(symbols, *rest)

    monkeypatch.setattr(suffix, "repeat_groups", seen)
    monkeypatch.setattr(suffix, "PIECE_BYTES", 1000)
    monkeypatch.setattr(suffix, "SIEVE_BYTES", 4000)
    line, noise = prose(12, 1).encode()[:60], np.random.default_rng(2).integers(0, 256, (400, 30), np.uint8)
    many = [noise[2 * k].tobytes() + line + noise[2 * k + 1].tobytes() for k in range(200)]
    few = [prose(20, 5000 + k).encode()[:90] for k in range(100)]
    segments, key = many + few, np.array([1] * 200 + [2 + k // 4 for k in range(100)], np.uint64)
    docs = np.arange(len(segments))[::-1].copy()
    got = suffix.least_by_key(np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments]), docs, key, 50)
    want = least_by_brute_force(segments, docs, 50)
    assert [int(g) for g, w in zip(got, want, strict=True) if w is not None] == [w for w in want if w is not None]
    # Of 120 bytes around the common line about 60 are in windows that occur twice; the other keys stand apart.
    assert max(sizes_seen) < 200 * 70 and sum(n < 1100 for n in sizes_seen) > 5


def test_segments_are_sent_once_per_task_and_bucket(spark, docs_of):
    rows = [(i, prose(30, i) + prose(40, 7) + "\n" + prose(5, i)) for i in range(120)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        texts = docs_of(rows).select("doc_id", "text").coalesce(2)
        shared = suffix._shared(suffix._keys(texts, 8, 50, 20), 8, suffix.HOT_DOCS)
        listed = suffix._per_document(shared).toPandas().set_index("doc")
        given = spark.createDataFrame(
            [(i, i, t, bytes(listed["keys"][i]), b"") for i, t in rows], "doc_id bigint, tie bigint, text string, keys binary, hot binary"
        ).coalesce(2)
        blobs = suffix._segments(given, 8, 50, 20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert 1 < len(blobs) <= 2 * 8
    texts, found = dict(rows), set()
    for b in blobs:
        size, at = np.frombuffer(b.size, np.int32), 0
        for doc, start, n in zip(np.frombuffer(b.doc, np.int64), np.frombuffer(b.start, np.int64), size, strict=True):
            assert bytes(b.bytes[at : at + n]) == texts[doc].encode()[start : start + n]
            found.add(int(doc))
            at += n
        assert at == len(b.bytes)
    assert found == set(texts)


def test_hot_keys_read_no_other_texts(spark, docs_of):
    rows = [(i, prose(20, i) + (prose(30, 7) if i < 6 else "") + (prose(30, 8) if i in (7, 8) else "")) for i in range(30)]
    shared = suffix._shared(suffix._keys(docs_of(rows), 8, 50, 20), 8, 5)
    pairs = lambda t: {(d, k) for b in t.collect() for d, k, h in zip(np.frombuffer(b.doc, np.int64), np.frombuffer(b.key, np.uint64), np.frombuffer(b.hot, bool), strict=True) if h}
    assert pairs(suffix._hot_pairs(shared)) == pairs(shared)
    found = {r.doc for r in suffix._per_document(suffix._hot_pairs(shared)).collect()}
    assert found == {d for d, _ in pairs(shared)} and set(range(6)) <= found and len(found) < len(rows)


# --- language model ----------------------------------------------------------------------------------------


def katz_scores(rows):
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = [split((t or "").translate(up)) + [None] for _, t in rows]
    uni, two, of = Counter(), Counter(), Counter()
    for h, t in zip(held, texts, strict=True):
        if not h:
            uni.update(t)
            two.update(zip(["<"] + t[:-1], t, strict=True))
            of.update(["<"] + t[:-1])
    n, v = sum(uni.values()), len(uni)
    f1, f2 = (katz.factors(Counter(c.values())) for c in (uni, two))

    def disc(c, f):
        return c - katz.LESS if c > katz.CUTOFF else c * f[c]

    unseen = 1 - sum(disc(c, f1) for c in uni.values()) / n if n else 1.0

    def p1(w):
        return disc(uni[w], f1) / n if w in uni else unseen

    def alpha(h):
        after = [w for a, w in two if a == h]
        return (1 - sum(disc(two[h, w], f2) for w in after) / of[h]) / (1 - sum(map(p1, after))) if after else 1.0

    def p2(w, h):
        return disc(two[h, w], f2) / of[h] if (h, w) in two else alpha(h) * p1(w)

    for h in [*list(of)[:5], "never seen"]:
        total = sum(p2(w, h) for w in uni) + (alpha(h) * unseen)
        assert math.isclose(total, 1.0, rel_tol=1e-9)
    out = []
    for (i, _), h, t in zip(rows, held, texts, strict=True):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(p2(w, a)) for a, w in zip(["<"] + t[:-1], t, strict=True))
        out.append((i, h, len(t), sum(w in uni for w in t), n, base, score))
    return out


def test_katz_equals_brute_force(docs_of):
    r = random.Random(6)
    rows = [(i, prose(r.randrange(0, 60), i, WORDS[: 5 + i % 16]) + (f" rare{i}" if i % 3 else " Common")) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "alpha beta unheard"), rows[4], rows[4], (202, prose(20000, 3))]
    got = sorted(map(tuple, katz.score(docs_of(rows)).collect()), key=str)
    expected = sorted(katz_scores(rows), key=str)
    assert len(got) == len(expected)
    for g, e in zip(sorted(got, key=lambda x: (x[0] is None, x[0])), sorted(expected, key=lambda x: (x[0] is None, x[0])), strict=True):
        assert g[:5] == e[:5]
        assert math.isclose(g[5], e[5], abs_tol=1e-6) and math.isclose(g[6], e[6], abs_tol=1e-6)


def test_katz_without_training(docs_of):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = katz.score(docs_of([(held, "a b")])).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)
    assert katz.score(docs_of([])).count() == 0


def test_katz_of_a_table_twice(docs_of):
    rows = [(i, f"alpha beta {prose(9, i)}") for i in range(60)]
    docs = docs_of(rows)
    got = katz.score(docs.union(docs)).collect()
    expected = {x[0]: x for x in katz_scores(rows * 2)}
    assert len(got) == 120
    for g in got:
        assert tuple(g)[:5] == expected[g.doc_id][:5]
        assert math.isclose(g.base_score, expected[g.doc_id][5], abs_tol=1e-6) and math.isclose(g.score, expected[g.doc_id][6], abs_tol=1e-6)


@pytest.mark.parametrize("hot_times", [1, 6, 40, 400])
def test_katz_with_hot_words_and_bigrams(docs_of, hot_times):
    rows = [(i, prose(i % 30, i, WORDS[: 4 + i % 16]) + (" of the" * (i % 9)) + (f" rare{i}" if i % 3 else "")) for i in range(150)]
    got = {r.doc_id: r for r in katz.score(docs_of(rows), hot_times=hot_times).collect()}
    for e in katz_scores(rows):
        assert tuple(got[e[0]])[:5] == e[:5]
        assert math.isclose(got[e[0]].base_score, e[5], abs_tol=1e-6) and math.isclose(got[e[0]].score, e[6], abs_tol=1e-6)


def test_katz_spreads_a_hot_word(spark, docs_of):
    docs = docs_of([(i, " ".join(f"w{i}x{j} the of the" for j in range(40))) for i in range(100)])
    rows = docs.select("doc_id", "text", F.lit(False).alias("held_out"), F.col("doc_id").alias("row_key"))
    counts = katz._unigram_counts(rows, 16, 500)
    uni, hot = katz._unigrams(counts), katz._hot(rows, counts, 16, 500)
    assert len(hot.word) == 2 and sorted(hot.pair_n.tolist()) == [4000, 4000], "the and of; the of, of the"
    blobs = katz._events(rows, uni, hot, 16).where("bucket >= 0").select("bucket", "rows").collect()
    size = Counter()
    for b in blobs:
        size[b.bucket] += len(b.rows) // 2
    assert sum(size.values()) == 8100 and max(size.values()) < 2 * 8100 / 16


# --- pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from varloom.llm import decontam

    near = near_rows()
    rows = [(i, t, "en", f"s{i % 3}", None) for i, t in near]
    item = prose(40, 77)
    rows += [(10_000, "before " + item + " after", "en", "s0", None), (10_001, "12 345", "en", "s1", None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda x: x[1])

    left = [(i, t, s) for i, t, _, s, _ in rows if t and re.search(r"[^\W\d_]", t)]
    of = components_of([(i, t) for i, t, _ in left])
    left = [(i, t, s) for i, t, s in left if of[i][1] == i and decontam.normalise(item) not in decontam.normalise(t)]
    sizes = Counter()
    for _, t, s in left:
        sizes[s] += len(split(t))
    target = filled(sizes)
    order = sorted(left, key=lambda x: ((p := int(hashlib.md5(f"0:{x[0]}".encode()).hexdigest()[:12], 16)) % mixing.BUCKETS, p))
    ahead, expected, at = Counter(), [], 0
    reps = {}
    for i, t, s in order:
        full = math.floor(target[s] / sizes[s])
        rest, size = target[s] - full * sizes[s], len(split(t))
        reps[i] = full + (rest > 0 and 2 * ahead[s] + size <= 2 * rest)
        ahead[s] += size
    for i, t, _ in sorted(left):
        for _ in range(reps[i]):
            ids = [*whole(t), 2]
            expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    assert got == expected
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontaminate", "mixture", "token_output"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert common.scratch_folder(spark) != common.scratch_folder(spark)
