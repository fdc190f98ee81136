"""The training-data operators against brute force, on small tables with all the odd cases."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import license_scan, mixing, near_dup, piece_bpe, quality, repeats, token_files, url_filter, vectors
from ledgerline.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, bucket int, component int"


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, exact and near copies, columns with clashing names."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, shared = text(60), text(25)
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "a b"), (5, "a b"), (6, base), (7, base), (7, base), (None, base), (8, text(20_000))]
    for i in range(40):  # near copies, each with a few words changed
        w = base.split()
        for _ in range(rnd.randrange(1, 3)):
            w[rnd.randrange(len(w))] = "edit"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, f"{text(30)} {shared} {text(30)}") for i in range(20)]
    rows += [(300 + i, text(rnd.randrange(1, 9))) for i in range(20)]
    rows += [(400, "x" * 300), (401, "x" * 70 + "y"), (402, "é" * 60), (403, "Licensed under the MIT LICENSE, cc by cc by")]
    return [(i, t, None, rnd.choice([None, "s1", "s2", "s1", "s1"]), 0, "clash", 7, 9) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_near_duplicates(docs, empty):
    rows = [r[:2] for r in odd_rows()]
    sets = {(i, t): shingles(t) for i, t in rows if i is not None}
    best = {i: i for i, _ in sets}
    for _ in range(len(best)):
        before = dict(best)
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    best[a[0]] = best[b[0]] = min(best[a[0]], best[b[0]])
        if before == best:
            break
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == best.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    counts = {(i, len(shingles(t))) for i, t in rows}
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == counts
    assert near_dup.near_duplicates(empty).count() == 0


def test_links_that_no_star_finds(spark):
    """A chain whose ends differ, and a hub that is like neither of two others: blocks find what is left."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[: 60 + 10 * (i % 4)] + [f"t{i // 4}x{j}" for j in range(4)])) for i in range(40)]
    sets = {i: shingles(t) for i, t in rows}
    best = {i: i for i in sets}
    for _ in range(len(best)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    best[a] = best[b] = min(best[a], best[b])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == best


def linked(sets):
    """Smallest node reachable of each, from sets by node, over an index of their shingles."""
    where, best = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for ids in where.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    while any(best[a] != best[b] for a, b in links):
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return best


@pytest.mark.parametrize("few", [1, 16])
def test_links_of_the_rest(spark, monkeypatch, few):
    """The exact join of what stars leave open, with pairs and with blocks alone, on sets around the threshold."""
    monkeypatch.setattr(near_dup, "FEW", few)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rnd = random.Random(12)
    rows = []
    for i in range(240):
        base = [f"b{i % 3}x{j}" for j in range(60)]
        at = rnd.randrange(50)
        rows.append((i, " ".join(base[:at] + [f"own{rnd.randrange(40)}" for _ in range(rnd.randrange(6))] + base[at:])))
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    live = spark.createDataFrame([(i, i) for i, _ in rows], "node long, component long")
    got = {(max(r), min(r)) for r in map(tuple, near_dup.rest_links(live, whole, 5, 75).collect())}
    assert got == {(a, b) for a in sets for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])} != set()


def test_unlike_texts_with_boilerplate(spark):
    """5,000 texts that share most of their words, but no two of them enough; and a few pairs that do."""
    rnd = random.Random(2)
    boiler = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([f"u{i}x{j}" for j in range(30)] + boiler + [f"v{i}x{j}" for j in range(15)])) for i in range(5_000)]
    rows += [(6_000 + i, rows[rnd.randrange(5_000)][1] + f" tail{i}") for i in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {t: i for i, t in reversed(rows)}
    assert got == {i: text[t.rsplit(" tail", 1)[0]] for i, t in rows}


def test_components():
    from ledgerline.llm import components

    rnd = np.random.default_rng(9)
    u, v = rnd.integers(0, 3_000, 2_500), rnd.integers(0, 3_000, 2_500)
    label = np.arange(3_000)
    for _ in range(3_000):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        if (before == label).all():
            break
    child, root = components.forest(u, v)
    want = {int(i): int(label[i]) for i in np.unique(np.concatenate([u, v])) if label[i] != i}
    assert dict(zip(child.tolist(), root.tolist(), strict=True)) == want


def test_components_over_tasks(spark, monkeypatch):
    """A long chain in random order, dealt over tasks that contract a few edges at a time."""
    from ledgerline.llm import components

    monkeypatch.setattr(components, "CHUNK_EDGES", 20)
    n = 400
    ids = random.Random(3).sample(range(10**6), n)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(7, 7), (None, 3), (5 + 10**6, 4 + 10**6), (5 + 10**6, 4 + 10**6)]
    random.Random(4).shuffle(edges)
    got = components.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
    assert {r["node"]: r["component"] for r in got} == {i: min(ids) for i in ids} | {5 + 10**6: 4 + 10**6, 4 + 10**6: 4 + 10**6}


def test_two_texts_under_one_doc_id(spark):
    """Each text of a doc_id has its own links, also where many pairs share that doc_id."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    whole = spark.createDataFrame([(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "quite other words than these are here")], "doc_id long, text string").coalesce(1)
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1)], "u long, v long")
    assert sorted(map(tuple, near_dup.confirm(pairs, whole, 5, 75).collect())) == [(2, 1), (3, 1)]


def test_common_counts():
    rnd = np.random.default_rng(1)
    a, b = ([np.unique(rnd.integers(0, 90, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 60, 1), (30, 80)))
    assert near_dup.common_counts(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def removed(rows, n=50):
    """Kept bytes and removed spans by brute force: {(doc_id, text): ...}."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for at in range(len(b) - n + 1):
            if i is not None:
                first[b[at : at + n]] = min(i, first.get(b[at : at + n], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for at in range(len(b) - n + 1):
            if i is not None and first[b[at : at + n]] < i:
                gone[at + 1 : at + 1 + n] = True
        out[i, t or ""] = (bytes(x for x, g in zip(b, gone[1:], strict=False) if not g), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()))
    return out


def test_repeats(docs, empty):
    rows = [r[:2] for r in odd_rows()]
    want = removed(rows)
    got = repeats.remove_repeats(docs, carry=("source",)).collect()
    assert len(got) == len(rows)
    for r in got:
        kept, n, spans = want[r["doc_id"], r["text"]]
        assert (bytes(r["kept"]), sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"])) == (kept, n, spans)
    assert any(r["spans"] for r in got)
    assert repeats.digests(repeats.remove_repeats(empty)).count() == 0


@pytest.mark.parametrize("length", [17, 33, 100])
def test_repeats_of_other_lengths(docs, length):
    want = removed([r[:2] for r in odd_rows()], length)
    for r in repeats.remove_repeats(docs, length).collect():
        assert (bytes(r["kept"]), len(r["spans"])) == want[r["doc_id"], r["text"]][::2]


def test_texts_under_one_doc_id_keep_their_own_spans(spark):
    """Many texts under one doc_id, some with equal low bits of their hash: only those with the passage lose it."""
    import xxhash

    passage, low = "a passage that an earlier document has, of over fifty bytes; " * 2, defaultdict(list)
    for i in range(3_000):
        t = f"text {i} " + (passage if i % 2 else "stands alone ") + f"{i * i}"
        low[xxhash.xxh64_intdigest(t.encode(), 42) % 1_024].append(t)
    mine = max(low.values(), key=len)
    assert any(passage in t for t in mine) and any(passage not in t for t in mine)
    rows = [(1, passage)] + [(5, t) for t in mine] + [(6, t) for t in mine[:2]]
    want = removed(rows)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r["kept"]) == want[r["doc_id"], r["text"]][0], r


def test_hot_anchors_are_split(spark, monkeypatch):
    """A passage and a ruler that most documents have, each in other surroundings, at every level."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("ab \n") for _ in range(n))
    rows = [(i, text(rnd.randrange(90)) + rnd.choice(["-" * rnd.randrange(16, 60), "this passage stands in most of the documents, as a notice does"]) + text(rnd.randrange(90))) for i in range(400)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), removed(rows)
    for hot, hotter in ((10**9, 8), (300, 8), (20, 8), (2, 2), (1, 1.01)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "HOTTER", hotter)
        monkeypatch.setattr(repeats, "FLUSH", 4_000)
        for r in repeats.remove_repeats(docs).collect():
            assert (bytes(r["kept"]), len(r["spans"])) == want[r["doc_id"], r["text"]][::2]


def test_common_prefixes():
    from ledgerline.llm import suffix_array

    rnd = np.random.default_rng(3)
    text = rnd.integers(97, 99, 500).astype(np.uint8)
    text[100:160] = 97
    sa = suffix_array.suffix_array(text, 504)
    b = text.tobytes()
    assert sa.tolist() == sorted(range(500), key=lambda i: b[i:])
    stop = np.repeat(np.arange(50, 501, 50), 50)
    got = suffix_array.common_prefixes(text, sa, suffix_array.keys8(text, 504), stop)
    for x, y, n in zip(sa[:-1].tolist(), sa[1:].tolist(), got.tolist(), strict=True):
        u, v = b[x : stop[x]], b[y : stop[y]]
        assert n == next((k for k, (p, q) in enumerate(zip(u, v)) if p != q), min(len(u), len(v)))


def test_hot_anchors_at_any_partitioning(spark, monkeypatch):
    """What the sample finds doesn't depend on how many documents a flush holds."""
    rng = random.Random(5)
    words = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = words(120)
    rows = spark.createDataFrame([(i, words(150) + (shared if i % 5 == 0 else "")) for i in range(40)], "id long, text string")
    monkeypatch.setattr(repeats, "HOT", 4)
    monkeypatch.setattr(repeats, "SAMPLE", 40)
    found = []
    for parts, flush in ((1, 1 << 20), (1, 1_000), (8, 1_000)):
        monkeypatch.setattr(repeats, "FLUSH", flush)
        h, level = repeats.hot_anchors(rows.repartition(parts, "id"), 50, 40)
        found.append((h.tolist(), level.tolist()))
    assert found[0][0] and found[0] == found[1] == found[2]


def test_repeats_in_pieces(monkeypatch):
    """Texts longer than a piece give the same segments."""
    data = np.frombuffer(bytes(random.Random(1).choice(b"ab ") for _ in range(5_000)), np.uint8)
    whole = repeats.segments(data, np.array([0, 2_000, 2_020, 5_000]), 50)
    monkeypatch.setattr(repeats, "PIECE", 700)
    pieces = repeats.segments(data, np.array([0, 2_000, 2_020, 5_000]), 50)
    windows = lambda s: {(r, w, p, h) for r, a, b, p, h in zip(*(x.tolist() for x in s), strict=True) for w in range(a, b + 1)}
    assert windows(whole) == windows(pieces)


def test_pieces_like_the_library(docs, empty):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for r in piece_bpe.decode(piece_bpe.encode(docs, model), model).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct(), "doc_id").collect():
        ids = library.encode(r["t"], add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    assert piece_bpe.digests(piece_bpe.encode(empty, model, decoded=True)).count() == 0
    rnd, bpe = random.Random(5), piece_bpe.model(model)
    cases = ["".join(rnd.choice("ab e▁ \nth=0é你'–-.\r…") for _ in range(rnd.randrange(80))) for _ in range(2_000)] + ["in" * 500, " " * 300, "ni" * 77 + "n"]
    assert [x.tolist() for x in bpe.encode(cases)] == [library.encode(c) for c in cases]


def test_words_without_spaces_like_the_library():
    """Very long words of letters, base64-like, of four letters, and of one; they are not remembered."""
    import time

    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library, bpe, rnd = sentencepiece.SentencePieceProcessor(model_file=model), piece_bpe.PieceBpe(model), random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for of, n in ((letters, 320_000), (letters + letters.upper() + "0123456789+/", 100_000), ("ACGT", 50_000), ("e", 50_000), ("thequickbrownfoxjumpsoverthelazydog", 20_000)):
        text = "".join(rnd.choice(of) for _ in range(n))
        began = time.time()
        (ids,) = bpe.encode([text])
        assert time.time() - began < 5 and ids.tolist() == library.encode(text)
    text = "thequickbrownfoxjumpsoverthelazydog" * 5_000
    assert bpe.encode([text])[0].tolist() == library.encode(text)
    assert not any(len(w) > piece_bpe.LONG for w in bpe.known) and bpe.held == sum(2 * len(w) + len(i) + piece_bpe.EACH for w, i in bpe.known.items())


def test_token_file_layout(spark, tmp_path):
    """Footers: encodings, row groups, page indexes; a read by doc_id skips row groups."""
    import pyarrow.parquet as pq

    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["word", "other", "text", "tokens"]) + str(rnd.randrange(500)) for _ in range(200))) for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, dictionary, encoding in (("a", True, "RLE_DICTIONARY"), ("b", False, "DELTA_BINARY_PACKED")):
        token_files.write(docs, f"{tmp_path}/{name}", path, dictionary=dictionary, row_group_bytes=200_000)
        groups, last = 0, -1
        for file in sorted((tmp_path / name).glob("*.parquet")):
            footer = pq.ParquetFile(file).metadata
            groups += footer.num_row_groups
            for g in range(footer.num_row_groups):
                columns = {footer.row_group(g).column(c).path_in_schema: footer.row_group(g).column(c) for c in range(footer.num_columns)}
                ids, doc = next(v for k, v in columns.items() if k.startswith("ids")), columns["doc_id"]
                assert any(encoding in e or (dictionary and "PLAIN_DICTIONARY" in e) for e in ids.encodings) and ids.compression == "ZSTD"
                assert ids.has_offset_index and doc.has_column_index and doc.has_offset_index
                assert last < doc.statistics.min <= doc.statistics.max
                last = doc.statistics.max
        assert groups > len(list((tmp_path / name).glob("*.parquet"))) > 1
        one = spark.read.parquet(f"{tmp_path}/{name}").filter("doc_id = 1234").select("n_tokens")
        assert one.count() == 1
        plan = one._jdf.queryExecution().toString()
        assert "EqualTo(doc_id,1234)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan


def test_token_files(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, start = Tokenizer.from_file(path), 0
    rows = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in odd_rows()))
    for n, dictionary in enumerate((True, False)):
        token_files.write(docs, f"{tmp_path}/{n}", path, dictionary=dictionary)
    got = sorted(token_files.read(spark, f"{tmp_path}/0").withColumn("crc", token_files.ids_crc32(F.col("ids"))).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows, strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i, start, len(ids), ids)
        assert r["crc"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    same = token_files.read(spark, f"{tmp_path}/1")
    assert sorted(r["ids"] for r in same.collect()) == sorted(r["ids"] for r in got)
    token_files.write(empty, f"{tmp_path}/e", path)
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/77?x", "https://example.com/en/8", "http://b.net/de/1", "http://x.example.net/de/8#", "http://notexample.net/de/8", "ftp://q.org/es/", "http://org/es/x", "nothing", None, "http://", "http://com", "http://u.com/EN/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, URL_RULES).collect()}
    for i, url in enumerate(urls):
        _, there, rest = (url or "").partition("://")
        host = re.split("[/?#]", rest)[0].lower() if there else ""
        path = re.split("[?#]", rest[len(host) :])[0] if there else ""
        fits = [(h.count("."), len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        assert got[i] == ((max(fits)[2], max(fits)[3]) if fits else (None, "allow")), url
    assert url_filter.filter_urls(pages.limit(0), URL_RULES).count() == 0
    twice = url_filter.filter_urls(pages.union(pages), URL_RULES).collect()
    assert len(twice) == 2 * len(urls) and {(r["page_id"], r["rule"], r["verdict"]) for r in twice} == {(i, *got[i]) for i in got}
    trie = url_filter.UrlTrie([("block", "a.com", "/x/"), ("allow", "a.com", "/x/y"), ("allow", "b.a.com", "")])
    assert trie.match("a.com", "/x/z") == ("block", "a.com/x/") and trie.match("c.a.com", "/x/yz") == ("allow", "a.com/x/y") and trie.match("b.a.com", "/x/z") == ("allow", "b.a.com")


def test_many_url_rules_are_joined(spark, monkeypatch):
    """Tries and joins against each other and against a scan of all rules."""
    rnd = random.Random(7)
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "x", "y", "é"]) for _ in range(rnd.randrange(6)))
    rules = [(rnd.choice(["allow", "block"]), host(), rnd.choice(["", "/"]) + path()) for _ in range(150)]
    pages = spark.createDataFrame([(i, f"http://{host()}/{path()}" if i % 3 else f"http://{host()}") for i in range(1_200)] + [(1_200, None)], "page_id int, url string")
    whole = {tuple(r) for r in url_filter.filter_urls(pages, rules).collect()}
    monkeypatch.setattr(url_filter, "RULES_MAX", 0)
    assert {tuple(r) for r in url_filter.filter_urls(pages, rules).collect()} == whole
    for _, h, p, rule, verdict in whole:
        fits = [(x.count("."), len(y), v == "allow", x + y, v) for v, x, y in rules if (h == x or h.endswith(f".{x}")) and p.startswith(y)]
        assert (rule, verdict) == (max(fits)[3:] if fits else (None, "allow"))


def test_licenses(docs, empty, spark):
    rows = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert (rows[403]["n_base"], rows[403]["base_labels"], rows[403]["first_word"], rows[403]["last_word"]) == (3, "cc-by,mit", 3, 7)
    assert (rows[1]["n_words"], rows[1]["score"], rows[1]["labels"]) == (0, 0.0, "")
    assert license_scan.scan(empty).count() == 0
    rnd = random.Random(2)
    vocabulary = sorted({w for t in license_scan.TEMPLATES for w in license_scan.words_of(t)})
    lines = [" ".join(rnd.sample(vocabulary, rnd.randrange(1, 30))) for _ in range(200)]
    for t in license_scan.TEMPLATES:
        w = t.split()
        lines += [" ".join(w[: len(w) * p // 10]) for p in (7, 8, 9, 10)]
    join = license_scan.TemplateJoin(license_scan.TEMPLATES, {w: rnd.randrange(9) for w in vocabulary}, 0.8)
    for line in lines:  # the filters lose no block
        block = set(license_scan.words_of(line))
        want = {i for i, t in enumerate(license_scan.TEMPLATES) if len(block & set(t.split())) >= 0.8 * len(set(t.split())) - 1e-9}
        assert set(join.meets(block)) == want
    join = license_scan.TemplateJoin({"a b c d e": "x", "f g h i j k l m n o": "y"}, {}, 0.8)
    ordered = lambda line: sorted(join.place[w] for w in line.split())
    assert list(join.candidates(ordered("a b c d h i j k l m"))) == [0]  # long enough for y and with its prefix word h, but that comes too late
    assert list(join.candidates(ordered("h i j k l m n o"))) == [1] and not list(join.candidates(ordered("i j k l m n o")))
    assert license_scan.phrase_places("cc by x cc by cc by mit license".split(), license_scan.PHRASES) == [(0, "cc-by"), (3, "cc-by"), (5, "cc-by"), (7, "mit")]


def test_wrapped_licenses(spark):
    """Every template wrapped at 72 columns, plain, in comments and with blank lines between; none where its words lie far apart."""
    templates, rows = list(license_scan.TEMPLATES), []
    for t in templates:
        lines = textwrap.wrap(t, 72)
        rows += ["\n".join(lines), "/*\n * " + "\n * ".join(lines) + "\n */", "one\ntwo\n\n" + "\r\n\r\n".join(lines) + "\n\nthree", "\n".join(f"rem {x}" for x in textwrap.wrap(t, 36))]
    rows += [("\n" + "filler " * 40).join(t.split()) for t in templates]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i in range(4 * len(templates)):
        label = license_scan.TEMPLATES[templates[i // 4]]
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= 0.8, rows[i]
    assert all(not got[i]["blocks"] for i in range(4 * len(templates), len(rows)))
    rnd = random.Random(6)
    join = license_scan.TemplateJoin({"a b c d e": "x", "b c a f g h": "y", "a a h i": "z"}, {}, 0.8)
    for _ in range(500):  # every window, one by one
        lines = [[rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(4))] for _ in range(rnd.randrange(1, 12))]
        words = [w for line in lines for w in line]
        found = join.blocks("\n".join(map(" ".join, lines)), words)
        for t, (template, label) in enumerate({"a b c d e": "x", "b c a f g h": "y", "a a h i": "z"}.items()):
            whole, span = set(template.split()), join.spans[t]
            held = [len(whole & set(block)) / len(whole) for block in [*lines, *(words[k : k + span] for k in range(len(words)))]]
            want = max((c for c in held if c >= 0.8 - 1e-9), default=0.0)
            assert max((b["containment"] for b in found if b["label"] == label), default=0.0) == want


def test_mixing_stays_within_a_block(docs, empty, spark):
    for shares in ({"a": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 500, "b": 333, "c": 166, "d": 1}):
        slots = mixing.period_slots(spark.createDataFrame(list(shares.items()), "source string, p long")).collect()
        total = sum(shares.values())
        assert sorted(r["at"] for r in slots) == list(range(total))
        done = defaultdict(int)
        for r in sorted(slots, key=lambda r: r["at"]):
            done[r["source"]] += 1
            for s, p in shares.items():
                assert abs(done[s] - p * (r["at"] + 1) / total) < 1
    got = mixing.mix(docs, block=4).collect()
    assert len(got) == len(odd_rows()) and len({r["position"] for r in got}) == len(got)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["position"]):
        by[r["source"]].append(-1 if r["doc_id"] is None else r["doc_id"])
    assert all(ids == sorted(ids) for ids in by.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_order(docs).columns == docs.columns


def due_first(p):
    """(source, block) to slot for the weights p, dealt out one slot at a time."""
    import heapq

    w, ready, got = sum(p.values()), [], {}
    starts = defaultdict(list)
    for s, x in p.items():
        for j in range(x):
            starts[j * w // x].append((-(-(j + 1) * w // x), s is not None, s or "", j))
    for t in range(w):
        for block in starts[t]:
            heapq.heappush(ready, block)
        _, named, s, j = heapq.heappop(ready)
        got[s if named else None, j] = t
    return got


def test_period_against_slots_dealt_one_by_one(spark):
    rnd = random.Random(8)
    cases = [{"a": 1}, {None: 3, "": 3, "b": 2}, {f"s{i}": rnd.choice([1, 1, 2, 9, 70]) for i in range(60)}, {f"s{i}": 1 + i % 2 for i in range(3_000)}]
    for p in cases:
        weights, want = spark.createDataFrame(list(p.items()), "source string, p long"), due_first(p)
        assert {(r["source"], r["j"]): r["at"] for r in mixing.period_slots(weights).collect()} == want
        w = sum(p.values())
        until = rnd.randrange(1, w + 1)
        part = mixing.slots_until(weights, len(p), w, until).collect()
        assert {(r["source"], r["j"]): r["at"] for r in part} == {b: t for b, t in want.items() if t < until}


def test_mixing_by_weights_of_any_size(spark, monkeypatch):
    """Weights with a common divisor, of billions, repeated, null and negative; the joins by shuffle give the same rows; clashing columns of the mixture are replaced."""
    rows = [(i, f"t{i}", "abc"[i % 7 % 3], "clash", 1.5, True) for i in range(300)] + [(5, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block string, slot double, position boolean")
    schema = "source string, p long"

    def got(*weights):
        rows = mixing.mix(docs, spark.createDataFrame(list(weights), schema), block=4)
        assert sorted(rows.columns) == sorted(docs.columns)
        return sorted((r["slot"], r["position"], r["doc_id"], r["block"]) for r in rows.collect())

    plain = got(("a", 3), ("b", 2), ("c", 1), (None, 1))
    p = {"a": 3, "b": 2, "c": 1, None: 1}
    at, own, want = due_first(p), defaultdict(list), []
    for r in rows:
        own[r[2]].append(r[0])
    for s, ids in own.items():
        for n, i in enumerate(sorted(ids)):
            slot = n // 4 // p[s] * 7 + at[s, n // 4 % p[s]]
            want.append((slot, slot * 4 + n % 4, i, n // 4))
    assert plain == sorted(want)
    assert got(("a", 1), ("a", 2), ("b", 2), ("c", None), (None, -5)) == plain
    assert got(("a", 3 * 10**9), ("b", 2 * 10**9), ("c", 10**9), (None, 10**9)) == plain
    huge = got(("a", 1_000_003), ("b", 2_000_003), ("c", 999_983))
    assert len(huge) == 301 == len({r[1] for r in huge})
    monkeypatch.setattr(mixing, "SMALL", 0)
    monkeypatch.setattr(mixing, "CHUNK", 1)
    assert got(("a", 3), ("b", 2), ("c", 1)) == plain


def test_mixing_of_scattered_ids(spark):
    """64-bit doc_ids, nulls and repeated rows in one source of most rows; columns with the mixture's names stay in mixed_order."""
    rnd = random.Random(5)
    rows = [(rnd.randrange(-(2**63), 2**63) if i % 40 else None, f"t{i % 700}", rnd.choices(["s1", "s2", None], [8, 1, 1])[0], i, "clash") for i in range(2_000)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, block int, position string").repartition(3)
    got = sorted(mixing.mix(docs, block=8).collect(), key=lambda r: r["position"])
    assert len(got) == 2_005 == len({r["position"] for r in got})
    for s in ("s1", "s2", None):
        ids = [r["doc_id"] for r in got if r["source"] == s]
        assert ids == sorted((r[0] for r in rows + rows[:5] if r[2] == s), key=lambda i: (i is not None, i or 0))
    again = mixing.mixed_order(docs, block=8).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, rows + rows[:5]))
    plan = mixing.mix(docs, block=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in "".join(line for line in plan.splitlines() if "Window [" in line)


def test_sources_without_weights_are_placed(docs, spark):
    for listed in ([("s1", 3)], [("s1", 3), (None, 2)], [("s2", 1), ("absent", 4)]):
        got = mixing.mix(docs, spark.createDataFrame(listed, "source string, p int"), block=4).collect()
        assert len(got) == len(odd_rows()) and len({r["position"] for r in got}) == len(got)
        p = {s: 1 for s in ("s1", "s2", None)} | dict(listed)
        assert all(r["slot"] // sum(p.values()) == r["block"] // p[r["source"]] for r in got)


def vector_rows():
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(300, 8)).astype(float)
    v[50:120] = v[7]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    return [*rows, rows[10], (300, None), (301, []), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (400, [0.0] * 8), (320, [1.0, 2.0])], v


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame(vector_rows()[0], "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))


def test_exact_top(embeddings, spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST", 40)
    monkeypatch.setattr(vectors, "FAN_IN", 2)
    monkeypatch.setattr(vectors, "BLOCK", 6)
    monkeypatch.setattr(vectors, "TILE", 4)
    monkeypatch.setattr(vectors, "partitions", lambda _: 5)  # 5 shards: lists are merged on three levels
    plan = vectors.exact_top(embeddings, vectors.every(20), k=20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 3
    z = np.floor(64 * np.vstack([vector_rows()[1], np.zeros(8)])).astype(int)
    ids = [*range(300), 400]
    got = defaultdict(list)
    for r in sorted(vectors.exact_top(embeddings, vectors.every(20), k=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q, i in zip(z, ids, strict=True):
        if i % 20 == 0:
            assert got.pop(i) == [(s, j) for s, j in sorted(((int(q @ x), j) for x, j in zip(z, ids, strict=True) if j != i), key=lambda t: (-t[0], t[1]))[:20]]
    assert not got
    assert vectors.exact_top(embeddings.limit(0), vectors.every(20)).count() == 0


def test_huge_and_tied_products(spark):
    """Products beyond 64 bits are the nearest long and tie; so do equal vectors."""
    rows = [(0, [1e10, 2.0]), (1, [1e10, 1.0]), (2, [-1e300, 0.0]), (3, [1e300, 5.0]), (4, [0.5, 0.0]), (20, [1.0, 1.0]), (40, [1.0, 1.0])]
    z = {i: [int(x) * 64 for x in v] if i != 4 else [32, 0] for i, v in rows}
    got = defaultdict(list)
    for r in sorted(vectors.exact_top(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), vectors.every(20), k=4).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in (0, 20, 40):
        all_ = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(z[q], z[j], strict=True)))), j) for j in z if j != q]
        assert got[q] == sorted(all_, key=lambda t: (-t[0], t[1]))[:4]


def test_vantage_points_at_equal_distances(spark):
    """One-hot vectors, whose distances are all equal, equal vectors, and no vectors."""
    n = 1_400
    hot = spark.createDataFrame([(i, [float(j == i) for j in range(1_536)]) for i in range(n)], "vec_id long, embedding array<float>")
    got = vectors.near_vectors(hot, lambda rows: rows.filter("vec_id in (0, 700)"), factor=1.0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(q, k, k if q == 0 else k - 1, 0.0) for q in (0, 700) for k in range(1, 6)]
    same = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(n)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(same, lambda rows: rows.filter("vec_id in (0, 700)")).collect()
    assert len(got) == 10 and all(abs(r["score"] - 1) < 1e-12 for r in got)
    assert vectors.near_vectors(same.limit(0), vectors.every(50)).count() == 0
    far = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [0.0, -1e308])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], round(r["score"], 9)) for r in sorted(vectors.near_vectors(far, vectors.every(50)).collect(), key=lambda r: r["rank"])] == [(1, 0.707106781), (2, -0.707106781)]


@pytest.mark.parametrize("least", [4_096, 20])
def test_vectors_on_one_line(spark, monkeypatch, least):
    """Cosines that differ in their last digit only, many more than k: brute force by unrounded cosines."""
    monkeypatch.setattr(vectors, "LEAST", least)
    monkeypatch.setattr(vectors.VantageTree, "LEAF", 8)
    rnd = np.random.default_rng(12)
    one = rnd.normal(size=24)
    m = np.array([one * s for s in rnd.uniform(0.1, 9, 200)] + [rnd.normal(size=24) for _ in range(20)])
    got = vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>"), vectors.every(50), factor=1.0).collect()
    for i in range(0, 220, 50):
        c = vectors.cosines(m, np.broadcast_to(m[i], m.shape))
        c[i] = -9
        want = [(int(j), float(c[j])) for j in np.lexsort((np.arange(220), -c))[:5]]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


@pytest.mark.parametrize("least", [4_096, 300])
def test_recall_on_embeddings(spark, monkeypatch, least):
    """Of the table itself: at least 0.9 of each query's nearest by brute force, and all of them with factor 1."""
    monkeypatch.setattr(vectors, "LEAST", least)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["v"])) for r in vectors.usable(table).filter("exists(v, x -> x != 0)").collect()]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    best = {}
    for i, v in zip(ids.tolist(), m, strict=True):
        if i % 50 == 0:
            c = vectors.cosines(m, np.broadcast_to(v, m.shape))
            c[ids == i] = -9
            best[i] = {(int(ids[j]), round(float(c[j]), 12)) for j in np.lexsort((ids, -c))[:5]}
    for factor, share in ((0.8, 0.9), (1.0, 1.0)):
        got = defaultdict(set)
        for r in vectors.near_vectors(table, vectors.every(50), factor=factor).collect():
            got[r["query_id"]].add((r["vec_id"], round(r["score"], 12)))
        hits = sum(len(got[i] & best[i]) for i in best)
        assert hits >= share * sum(map(len, best.values())), (factor, hits)


def test_vantage_points(embeddings, spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST", 60)
    monkeypatch.setattr(vectors.VantageTree, "LEAF", 4)
    v = vector_rows()[1]
    for factor, least in ((1.0, 1.0), (0.8, 0.9)):
        got = defaultdict(list)
        for r in sorted(vectors.near_vectors(embeddings, vectors.every(50), factor=factor).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        hits = 0
        for i in range(0, 300, 50):
            cosine = (v * v[i]).sum(axis=1) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]))
            best = [j for j in sorted(range(300), key=lambda j: (-round(cosine[j], 12), j)) if j != i][:5]
            hits += len({j for j, _ in got[i]} & set(best))
            assert all(abs(s - cosine[j]) < 1e-12 for j, s in got[i])
        assert hits >= least * 30


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    wins = np.mean([(good.score > s).mean() + (good.score == s).mean() / 2 for s in bad.score])
    assert wins > 0.97 and good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.2
    assert rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).all()


def test_quality_scores_by_hand(docs, spark):
    """Scores from two compressors and the weights, row by row; a long labelled text trains by a part of it."""
    import math

    import zstandard

    labels = spark.createDataFrame([(6, 1), (8, 1), (200, 1), (201, 1), (202, 1), (203, 1), (4, 0), (5, 0), (400, 0), (401, 0), (402, 0), (300, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert len(model.good) < 3 * quality.SAMPLE_CHARS + 5_000
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), quality.scorer(spark, model)(F.col("text")).alias("score")).collect():
        data, sizes = r["text"].encode(), []
        for words in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_checksum=False, write_content_size=False).compress(data)))
        x, share, length = (sizes[0] - sizes[1]) / (sizes[0] + sizes[1]), sizes[0] / (len(data) + 1), math.log(1 + len(data))
        z = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], (x, x * length, share, share**2, length, share * length), strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-50, min(50, z))))) < 1e-9


def test_quality_odd_rows(docs, empty, spark):
    labels = spark.createDataFrame([(6, 1), (200, 1), (201, 1), (202, 1), (4, 0), (5, 0), (400, 0), (401, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline(spark):
    import corpus_pipeline
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf)
        assert now.columns == docs.columns, name
        if name == "quality classifier":
            keep = {r["doc_id"] for r in quality.classify(before, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
        elif name == "MinHash near-dedup":
            keep = {r["doc_id"] for r in near_dup.near_duplicates(before).filter("kept").collect()}
        if name == "suffix-array dedup":
            want = removed([(r["doc_id"], r["text"]) for r in before.collect()])
            texts = {i: kept.decode("utf-8", "ignore") for (i, _), (kept, _, _) in want.items()}
            assert {r["doc_id"]: r["text"] for r in now.collect()} == texts
        assert {r["doc_id"] for r in now.collect()} == keep, name
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in corpus_pipeline.run(spark, sf).collect():
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_pipeline_of_odd_rows(docs, empty, spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; and an empty table."""
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    kept = near_dup.near_duplicates(docs).filter("kept").collect()
    key = lambda ids: sorted(-1 if i is None else i for i in ids)
    assert key(r["doc_id"] for r in rows) == key(r["doc_id"] for r in kept) and len({r["position"] for r in rows}) == len(rows)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_the_mixture_reaches_the_rows(spark):
    """Positions of the pipeline's rows against Pfair slots that are dealt out one by one."""
    import corpus_pipeline

    rnd = random.Random(4)
    rows = [(i if i % 50 else None, f"text {rnd.randrange(10**9)}", rnd.choices(["s1", "s2", None], [8, 3, 1])[0]) for i in rnd.sample(range(5_000), 1_500)]
    rows += [(7, "same", "s1"), (7, "same", "s1"), (7, "other", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.STAGES[-1][1](spark, corpus_pipeline.cut(mixing.mixed_order(docs)), "").collect()
    by = defaultdict(list)
    for i, text, s in rows:
        by[s].append(((-1 if i is None else i), text))
    roots = {s: round(len(v) ** 0.5) for s, v in by.items()}
    p = {s: max(1, r * mixing.PERIOD // sum(roots.values())) for s, r in roots.items()}
    w, done, slot, want = sum(p.values()), dict.fromkeys(p, 0), 0, {}
    while any(done[s] * mixing.BLOCK < len(by[s]) for s in by):
        ready = [s for s in p if done[s] * w // p[s] <= slot]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * w // p[s]), s is not None, s or ""))
        for k, n in enumerate(range(done[s] * mixing.BLOCK, min(len(by[s]), (done[s] + 1) * mixing.BLOCK))):
            want[slot * mixing.BLOCK + k] = sorted(i for i, _ in by[s])[n]
        done[s], slot = done[s] + 1, slot + 1
    assert {r["position"]: -1 if r["doc_id"] is None else r["doc_id"] for r in got} == want
    digest = {r["doc_id"]: r["ids_sha256"] for r in got if r["doc_id"] not in (None, 7)}
    plain = piece_bpe.digests(piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)).collect()
    assert len(got) == len(rows) and digest == {r["doc_id"]: r["ids_sha256"] for r in plain if r["doc_id"] not in (None, 7)}
