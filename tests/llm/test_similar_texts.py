"""Near copies of five-word Jaccard similarity 0.8 or more: against all pairs, and what op2's bits don't reach."""

import random

import numpy as np

import corpus_pipeline
from tidelog.llm import similar_texts
from tidelog.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """Component of each id, from all pairs."""
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for i, a in sets:
        for j, b in sets:
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i in parent}


def test_near_copies_beyond_four_bits(spark):
    r = random.Random(11)
    rows = []
    for k in range(60):  # a text and a copy with some words changed, at similarities about 0.8
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((2 * k, " ".join(words)))
        for _ in range(r.randint(1, 8)):
            words[r.randrange(200)] = f"x{r.randrange(5000)}"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    assert 90 > len(set(want.values())) > 60  # near copies, and some that aren't near enough
    found = {x["id"]: x["component_id"] for x in similar_texts.similar(docs).collect()}
    assert found == want
    kept = {x["doc_id"] for x in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert kept == set(want.values())


def test_edges_and_hot_group(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (None, "one two"), (7, "one two"), (7, "a b c d e f")]
    found = {(x["id"], x["component_id"]) for x in similar_texts.similar(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, None), (7, 4)}
    assert similar_texts.similar(spark.createDataFrame([], SCHEMA)).count() == 0
    # A chain, of which far ends aren't similar, in small blocks and in one.
    words = [f"w{i}" for i in range(260)]
    chain = [(i, " ".join(words[i * 5 : i * 5 + 100])) for i in range(30)]
    docs = spark.createDataFrame(chain, SCHEMA)
    marked = docs.withColumnRenamed("doc_id", "id").select("id", "text").mapInArrow(similar_texts.mark, "id long, cls long, size long, bands binary")
    classes = marked.withColumnRenamed("id", "least")
    for block in (300, 1 << 20):
        assert components(similar_texts.links(docs, classes, block=block)).select("root").distinct().count() == 1


def test_spanning_links():
    sets = [np.arange(i, i + 20, dtype=np.uint64) for i in range(8)] + [np.arange(100, 103, dtype=np.uint64)]
    u, v = similar_texts.spanning_links(np.arange(9), sets)
    assert len(u) == 7 and 8 not in set(u) | set(v)
