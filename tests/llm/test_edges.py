"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import block_neighbours, decontamination, html_extract, language_id, license_scan, mixing, quality, simhash_dedup, substring_dedup, warc
from tidelog.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, rest string, count int"


def documents(spark, texts):
    """Rows of (id, text), with nulls elsewhere and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, 7, "x", "y", 1) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(3))
    shared = " ".join(word() for _ in range(30))
    body = [(i, " ".join(word() for _ in range(r.randint(5, 60)))) for i in range(20)]
    body += [(20, "aa " * 40), (21, "aa\t" * 60), (22, "x " + shared + " y"), (23, shared), (24, "q " * 3 + shared), (23, "z " + shared)]
    body += [(25, ""), (26, None), (None, shared), (27, "one two"), (28, " \n\t "), (29, " ".join(word() for _ in range(60_000))), (30, body[0][1]), (30, body[0][1])]
    return body


def windows_removed(rows, window=13):
    """Brute force of the removal rule."""
    least = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for a in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[a : a + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and least[tuple(w[a : a + window])] < i:
                gone |= set(range(a, a + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, texts):
    found = substring_dedup.remove_repeats(documents(spark, texts)).select("rest.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == windows_removed(texts)
    assert substring_dedup.stage(spark, documents(spark, texts), "").columns == documents(spark, texts).columns
    assert substring_dedup.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_recompression_keys_depend_on_the_window_alone(seed):
    r = np.random.default_rng(seed)
    words = r.integers(0, [3, 6, 40][seed], 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = substring_dedup.window_keys(words)
    seen = {}
    for i, k in enumerate(keys.tolist()):
        assert seen.setdefault(words[i : i + 13].tobytes(), k) == k
    assert all(substring_dedup.window_hashes(words, 13, substring_dedup.Powers())[i] == substring_dedup.window_hashes(words[i : i + 13], 13, substring_dedup.Powers())[0] for i in (0, 77, 2000))


def test_blob_round_trip():
    r = np.random.default_rng(0)
    start = np.concatenate([np.arange(5), np.arange(100, 400)])
    rows = (np.repeat(r.integers(0, 9, 61), 5).astype(np.uint64), r.integers(0, 1 << 40, 305).astype(np.uint64), np.full(305, -4), np.full(305, 9, np.uint16), start)
    back = substring_dedup.unpack(substring_dedup.pack(*rows))
    assert sorted(zip(*(x.tolist() for x in rows))) == sorted(zip(*(x.tolist() for x in back)))


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts):
    texts = [t for t in texts if t[0] != 29]
    found = simhash_dedup.near_duplicates(documents(spark, texts)).collect()
    known = [(i, simhash(t)) for i, t in texts]
    parent = {i: i for i, _ in known if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in known:
        for j, b in known:
            if i is not None and j is not None and bin(a ^ b).count("1") <= 4:
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    want = sorted((str(i), f, None if i is None else root(i)) for i, f in known)
    assert sorted((str(r["id"]), r["fp"] % (1 << 64), r["component_id"]) for r in found) == want
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash_dedup.stage(spark, documents(spark, texts), "")
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 1 and len(ids) == len(set(ids)) == len({w[2] for w in want if w[2] is not None}) + 1


def test_anchor_cover_and_blocks(spark):
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 62, 500)
    y = x.copy()
    for i in range(500):
        for b in r.choice(62, r.integers(0, 5), replace=False):
            y[i] ^= np.int64(1) << np.int64(b)
    shared = np.zeros(500, bool)
    for half in (0, 1):
        sets = []
        for v in (x, y):
            row, anchor = simhash_dedup.anchors_within_two((v >> (32 * half)) & 0xFFFFFFFF)
            sets.append(set(zip(row.tolist(), anchor.tolist())))
        shared[[i for i, _ in sets[0] & sets[1]]] = True
    assert shared.all()
    # A hot group cut into small blocks links the same components as one block.
    near = sorted({int(x[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)})
    distinct = spark.createDataFrame([(v,) for v in near], "fp long")
    for block in (16, 4096):
        assert components(simhash_dedup.links(distinct, block)).select("root").distinct().count() == 1


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 15] + [(3, 3), (2, 1)], "u long, v long")
    for hub_rows in (0, 1_000_000):  # salted, and not
        assert {(r[0], r[1]) for r in components(edges, hub_rows).collect()} == {(i, 0 if i <= 15 else 16) for i in range(31)}


def test_decontamination(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (2, "Tiny ITEM here"), (3, None), (4, ""), (1, passage), (None, "odd one out")]
    docs = [(0, "a b " + passage.upper() + " c"), (1, " ".join(passage.split()[5:18])), (2, " ".join(passage.split()[5:17])), (3, "so tiny-item here"), (4, None), (5, "..."), (6, "the odd one, out")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for bound in (1 << 20, 120):  # the second needs several parts
        found = decontamination.find_contamination(documents(spark, docs), benchmark, index_bytes=bound).collect()
        got = {r["rest"]["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found}
        assert got == {0: (33, 30, 1, True), 1: (13, 13, 1, True), 2: (12, 0, 0, False), 3: (4, 3, 1, True), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (4, 3, 1, True)}
    assert decontamination.find_contamination(documents(spark, []), benchmark.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), None, "abc"[i % 3] if i % 4 else None, None, 1, "x", "y", 1) for i in range(400)] + [(500, None, None, "a", None, 1, "x", "y", 1), (501, "w", None, "zero", None, 1, "x", "y", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs).select("rest.doc_id", "rest.source", "size", "source_size", "target", "taken").collect()
    by = {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert len(found) == len(rows)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 1 and group[0]["target"] <= 2 * group[0]["source_size"]
    total = sum(r["size"] for r in found)
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-6 * total
    assert sorted(map(str, mixing.mix(docs, buckets=8).collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_language_id(spark):
    words = {"en": "the of and with over under house tree water".split(), "de": "der und mit haus baum wasser über nicht auch".split()}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(60)), lang) for i in range(200) for lang in [["en", "de"][i % 2]]] + [(900, None, None), (901, "123 !!", "en"), (None, "the house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs.withColumn("held_out", language_id.held_out()), language_id.fit(docs)).collect()
    held = [x for x in found if x["rest"]["held_out"] and x["rest"]["lang"]]
    assert held and all(x["lang_pred"] == x["rest"]["lang"] for x in held)
    assert {x["rest"]["doc_id"]: x["lang_pred"] for x in found if x["rest"]["doc_id"] in (900, 901)} == {900: "und", 901: "und"}
    assert all(0 <= x["score"] <= 1 for x in found)
    nothing = docs.limit(0)
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(nothing)).collect()} == {"und"}


def test_quality(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["fine", "good", "text", "word", "here"]) for _ in range(30)) + (" vile" if i % 5 == 0 else "")) for i in range(300)] + [(400, None)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = {x["rest"]["doc_id"]: x for x in quality.rate(docs, *quality.model_of(docs, labels)).collect()}
    assert all(found[i]["keep"] == (i % 5 != 0) for i in range(200, 300))
    assert all(x["keep"] for x in quality.rate(docs, *quality.model_of(docs, labels.limit(0))).collect())


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>one<p>two", "one\ntwo"),
    ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>Body&nbsp;text\n here <b>now</b><!-- no --></p><div class='comments'>hi</div></article><footer>f</footer>", "T\nBody text here now"),
    ("<div><div class='sidebar'>links</div><div id=content><p>A long paragraph of text, with words.</p><p>Another paragraph, also with words.</p></div></div>", "A long paragraph of text, with words.\nAnother paragraph, also with words."),
    ("<article><p>a < b & c</p><script>var x='<p>no</p>';</script><form>f</form></article", "a < b & c"),
])
def test_html(page, want):
    assert html_extract.main_text(page) == want


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (1, "u", "<p>x</p>" * 3)], "page_id long, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()) == [("", 0), ("x\nx\nx", 5)]


def test_neighbours(spark):
    r = np.random.default_rng(4)
    vectors = [(i, r.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0] * 3), (None, [1.0] * 16), (100, vectors[100][1]), (200, vectors[7][1]), (305, vectors[7][1]), (306, [None] + [1.0] * 15)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    good = [(i, np.array(v, np.float64)) for i, v in vectors if i is not None and i < 306 and i not in (300, 301, 302, 303)]
    found = block_neighbours.nearest(rows, rows.where("vec_id IN (0, 100, 7)"), query_block=2).collect()
    for q in (0, 100, 7):
        mine = next(v for i, v in good if i == q)
        best = {}
        for i, v in good:
            if i != q:
                best[i] = min(best.get(i, 1e9), float(np.sqrt(np.cumsum((mine - v) ** 2)[-1])))
        want = sorted((s, i) for i, s in best.items())[:10]
        assert [(x["score"], x["vec_id"]) for x in sorted(found, key=lambda x: x["rank"]) if x["query_id"] == q] == want
    assert block_neighbours.nearest(rows.limit(0), rows.limit(0)).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(8)
    a, b = r.normal(size=(40, 32)), r.normal(size=(60, 32)) * 5
    low, high = block_neighbours.bounds(block_neighbours.Coded(a), block_neighbours.Coded(b))
    true = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    payloads = [b"", b"a\nb\n", b"http://x 0.0.0.0 20200101000000 text/html 3\nabc"]
    archive = warc.arc_start(version) + b"".join(warc.arc_record({"url": "http://a", "address": "1.2.3.4", "date": "20200101000000", "type": "text/html"}, p, version) for p in payloads)
    assert [p for _, p in warc.read_arc(archive)] == payloads
    with pytest.raises(ValueError):
        list(warc.read_arc(archive[:-5]))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 100
    rows = [(1, "u", big), (2, None, big), (3, "a b", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (None, "u", big), (2, None, big), (6, "u", "long " * 100_000)]
    warc.convert(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 1 else "response", 2 if i == 1 else None) for i, _, h in rows)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == want


def test_licenses(spark):
    rows = [(0, "Released under the MIT License. Under the MIT license!"), (1, "Licenced under the Apache-License, Version 2.0"), (2, None), (3, "underthe mit license"), (4, "Licensed under CC BY-NC 4.0"), (5, "This work is licensd under the GNU Genral Public License, version 3")]
    found = {r["rest"]["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    assert (found[0]["n_base"], found[0]["first_word"], found[0]["last_word"], found[0]["base_labels"]) == (2, 1, 5, "mit")
    assert found[1]["base_labels"] == "apache-2" and found[2]["labels"] == "" and found[2]["n_words"] == 0
    assert found[3]["base_labels"] == "" and found[4]["base_labels"] == "cc-by-nc" and found[5]["labels"] == "gpl-3" and 0 < found[5]["score"] < 1
    span = found[5]["spans"][0]
    assert "this work is licensd under the gnu genral public license version 3"[span["start"] : span["end"]].startswith("this work")
