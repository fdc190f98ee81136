"""Hard negatives, importance resampling and language identification against brute force and held-out rows."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, hard_negatives, language, resample, vectors
from ledgerline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, score double, shard string, windows int, place long"


def vector_rows():
    """Nulls everywhere, odd components, other lengths, repeated ids, hundreds of copies, ties, huge and tiny components."""
    rnd = random.Random(5)
    v = lambda n=4: [rnd.uniform(-1, 1) for _ in range(n)]
    base = [abs(x) for x in v()]
    rows = [(i, v(), i % 3) for i in range(0, 600, 3)]
    rows += [(i, [x + 0.2 for x in v()], i % 3) for i in range(1, 600, 3)]
    rows += [(2000 + i, base, i % 2) for i in range(300)]
    rows += [(100, None, 1), (None, v(), 1), (101, v(), None), (103, [1.0, None, 2.0, 0.0], 1), (104, [float("nan")] * 4, 1), (106, [float("inf"), 0, 0, 0], 1), (107, [], 2), (9000, v(3), 1), (9001, v(3), 1), (9003, v(3), 2)]
    rows += [(3000, [0.0] * 4, 1), (3001, [0.0] * 4, 2), (3100, [1e14, 0.5, 0.1, 0.2], 1), (3101, [1e15, 0.1, 0.1, 0.2], 1), (3102, [7e14, 0.1, 0.1, 0.2], 2), (3200, [1e300, 0, 0, 1], 2), (3201, [1e300, 0, 0, 1], 2), (3202, [-1e300, 0, 0, 1], 2)]
    rows += [(200, base, 0), (200, base, 0), (300, [0.5] * 4, 2), (300, [0.25] * 4, 1)]
    return [(a, b and [x if x is None else float(x) for x in b], c, 1.0, "clash", 3, 4) for a, b, c in rows]


def usable_vectors():
    found = {}
    for i, v, label, *_ in vector_rows():
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v):
            found[i] = min(found.get(i, (v, label)), (v, label))
    return found


def product(a, b, scale):
    whole = lambda x: math.floor(x) * scale if abs(x) >= 2**53 else math.floor(scale * x)
    return max(-(2**63), min(2**63 - 1, sum(whole(x) * whole(y) for x, y in zip(a, b, strict=True))))


@pytest.mark.parametrize("digit", [3, 8])
def test_hard_negatives(spark, monkeypatch, digit):
    monkeypatch.setattr(vectors, "LEAST", 100)
    monkeypatch.setattr(vectors, "FAN_IN", 2)
    monkeypatch.setattr(vectors, "TILE", 7)
    table = spark.createDataFrame(vector_rows(), VECTORS).repartition(5)
    rows = usable_vectors()
    want = []
    for a, (v, label) in rows.items():
        if a % 100:
            continue
        all_ = sorted((-product(v, w, 256), i, own) for i, (w, own) in rows.items() if i != a and len(w) == len(v))
        for p, i, _ in [x for x in all_ if x[2] == label][:5]:
            fit = [(s, j) for s, j, own in all_ if own != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            want += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit)]
    got = hard_negatives.mine(table, vectors.every(100), digit=digit).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want
    assert got[0].__fields__ == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, vectors.every(100)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, 1.0, "", 1, 1), (5, [1.0], 2, 1.0, "", 1, 1)], VECTORS)
    assert hard_negatives.mine(alone, vectors.every(100)).count() == 0


def test_query_of_hard_negatives_relabels(spark):
    found = QUERIES["op11_hard_negatives"](spark, SF)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.filter("100 * negative_score not between 30 * positive_score and 90 * positive_score").count() == 0


def test_products_of_any_size():
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=(40, 6)), rnd.normal(size=(30, 6))
    a[3], a[7, 2], a[9, 1], b[4, 0], b[5] = a[3] * 1e9, 1e14, 1e300, -1e17, b[5] * 1e6
    got = vectors.inner(vectors.Scaled(a, 64), vectors.Scaled(b, 64))
    assert got.tolist() == [[product(x, y, 64) for y in b.tolist()] for x in a.tolist()]


def test_one_huge_component_does_not_slow_its_shard():
    """A vector beyond doubles costs its own products, not those of the 4,096 that share its shard."""
    rnd = np.random.default_rng(2)
    queries, shard = rnd.normal(size=(256, 64)), rnd.normal(size=(4096, 64))
    odd = shard.copy()
    odd[17, 5] = 1e14

    def seconds(m):
        s, best = vectors.Scaled(m, 64), []
        for _ in range(3):
            began = time.perf_counter()
            vectors.inner(vectors.Scaled(queries, 64), s)
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(odd) < 4 * seconds(shard) + 0.2


DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, copies int, weight double"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def text_rows():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdéß1") for _ in range(rnd.randrange(1, 8))) for _ in range(200)] + ["x" * 80, "é" * 70]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(n))
    shared = text(40)
    rows = [(1, None), (2, ""), (3, " .. "), (4, "One"), (5, "Two words"), (None, text(30)), (6, text(5000)), (7, text(25)), (7, text(25)), (8, shared), (8, shared)]
    rows += [(100 + i, shared) for i in range(120)] + [(300 + i, text(rnd.randrange(10, 60))) for i in range(200)] + [(600 + i, "ties " * 20) for i in range(5)]
    return [(i, t, "en", "s", 0, "clash", 3, 1.5) for i, t in rows]


def features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def expected_resample(rows, target, percent=5):
    s, t = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    for _, text in rows:
        np.add.at(s, features(text)[1], 1)
    for text in target:
        np.add.at(t, features(text)[1], 1)
    total_s, total_t = float(s.sum()), float(t.sum())
    gain = [math.floor(1000 * math.log((y + 1) * (total_s + 10_000) / ((x + 1) * (total_t + 10_000)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for i, text in rows:
        n, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], -1 if x[0] is None else x[0], x[1]))
    drawn = len(able) * percent // 100
    return sorted([(*x[:4], r + 1 if r < drawn else None) for r, x in enumerate(able)] + [(*x[:4], None) for x in out if x[4] < 20], key=str)


@pytest.mark.parametrize("percent", [5, 60])
def test_resample(spark, percent):
    rows = text_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    target = [None, "", "one two words", *[t for _, t, *_ in rows[40:60]]]
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, goal, percent=percent)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, got.collect()), key=str) == expected_resample([r[:2] for r in rows], target, percent)


def test_resample_of_nothing(spark):
    none, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, goal).count() == 0
    rows = text_rows()[:20]
    assert sorted(map(tuple, resample.resample(spark.createDataFrame(rows, DOCS), goal).collect()), key=str) == expected_resample([r[:2] for r in rows], [])


@pytest.mark.parametrize("limit", [7, 16, 50, 1000])
def test_features_of_long_texts_in_pieces(monkeypatch, limit):
    rows = [t or "" for _, t, *_ in text_rows()[:30]] + ["y" * 300 + " z", "a b", "?" * 99]
    monkeypatch.setattr(resample, "CHUNK_BYTES", limit)
    monkeypatch.setattr(resample, "row_chunks", lambda offsets: common.row_chunks(offsets, limit))
    found, words = [[] for _ in rows], np.zeros(len(rows), int)
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    for bucket, row, counts in resample.gram_buckets(data, np.cumsum([0, *[len(t.encode()) for t in rows]])):
        words += counts
        for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
            found[r].append(b)
    for text, got, n in zip(rows, found, words.tolist(), strict=True):
        count, want = features(text)
        assert (n, sorted(got)) == (count, sorted(want))


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.join(QUERIES["op13_language_id"](spark, "/root/testdata/sf0.01"), "doc_id")
    rows = got.select("doc_id", "lang", "lang_pred", "held_out", "score", "text").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean(held) >= 0.98
    plain = language.fit(docs.withColumn("source", F.lit("x")).repartition(7))
    again = plain.predict([r["text"] for r in rows[:50]])[0]
    assert again == [r["lang_pred"] for r in rows[:50]]


def kernel(a, b, within, n=language.GRAM):
    def grams(text):
        s = re.sub(r"(\W|\d|_)+", " ", f" {text.lower()} ")
        return {s[i : i + k] for k in range(1, n + 1) for i in range(len(s) - k + 1)} & within

    x, y = grams(a), grams(b)
    return len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y)))


def test_kernels_by_sets(monkeypatch):
    rnd = random.Random(4)
    text = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(n))
    rows = [(text("abcde", 30), "x") for _ in range(6)] + [(text("cdefgé", 30), "y") for _ in range(6)]
    model = language.train(rows)
    marks = [t for t, _ in rows]  # fewer rows than landmarks: all are
    within = set()
    for t in marks:
        s = f" {t.lower()} "
        within |= {s[i : i + k] for k in range(1, language.GRAM + 1) for i in range(len(s) - k + 1)}
    tests = [text("abcdefgé", 40), "abc, 123 DEF!!! é", "a" * 50, text("abcdefg", 3000)]
    want = [[kernel(t, m, within) for m in marks] for t in tests]
    assert np.allclose(model.kernels(tests)[0], want, atol=1e-5)
    monkeypatch.setattr(language, "SLICE", 64)  # long texts in slices
    assert np.allclose(model.kernels(tests)[0], want, atol=1e-5)


def test_languages_of_odd_rows(spark):
    english, german = "the cat and the dog were with them in the house", "der hund und die katze waren mit ihnen in dem haus"
    rows = [(i, f"{english} {i}", "en") for i in range(40)] + [(100 + i, f"{german} {i}", "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 ... $$$", None), (503, english, None), (503, english, None), (None, german, "xx"), (504, german * 30_000, None), (505, "漢字 かな", None), (506, "\u0301 é", None)]
    docs = spark.createDataFrame([(*r, "s", 9.0, "clash") for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").repartition(3)
    got = language.predictions(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [r["lang_pred"] for r in got if r["doc_id"] == 503] == ["en", "en"]
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (500, 501, 502))
    assert by[None]["lang_pred"] == by[504]["lang_pred"] == "de" and by[None]["held_out"] is False and "xx" not in {r["lang_pred"] for r in got}
    assert by[505]["lang_pred"] in ("de", "en") and by[506]["lang_pred"] in ("de", "en")
    empty = docs.limit(0)
    assert language.predictions(empty).count() == 0
    unknown = language.predictions(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unknown) == len(rows) and {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}
    one = language.predictions(docs.filter("lang = 'en' or lang is null")).collect()
    assert {r["lang_pred"] for r in one} == {"en", "und"} and {r["score"] for r in one} == {1.0, 0.0}
