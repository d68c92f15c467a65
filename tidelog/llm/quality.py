"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades from `labels`: 0 toxic, 1 of low quality, 2 of good quality. A document is the set of its folded words
and of their stems, hashed to `FEATURES` weights that all thresholds share: P(grade <= g) = logistic(threshold_g - score). From it
come the expected grade and the tail probability P(grade >= 1), by which documents are kept.

Features are weighted only if their share of low grades differs from that of all rows by `MIN_Z` standard deviations at
some threshold: incidental words of the few low grades would else be learned by heart in place of what marks them.

The fit takes at most `SAMPLE` labelled documents by a hash of their ids (a bounded sample); scoring takes whole texts.

Defined cases: a null or wordless text has the score 0 (the thresholds alone decide); labels without a grade or a
document are left out, of repeated labels the lowest grade counts; without labels every document has grade 2 and tail 1;
rows that repeat a document are each scored by their text; equal scores are equal results, nothing is ranked; whole
texts are read, however long; an empty table gives an empty table; other columns pass through in `rest`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelog.llm.common import FOLD_WORDS, WordHashes, per_text, table, unpacked

FEATURES = 1 << 20
STEM = 5
SCALE = 1.0
LEAST_DOCS = 8
MIN_Z = 6.0
SAMPLE = 8000
PASSES = 8
LEAST_STEPS = 20_000
RATE = 0.5
DECAY = 1e-5
MIN_TAIL = 0.9


def features(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct feature numbers of a text's words and of the first `STEM` bytes of the longer ones."""
    words = set(text.translate(FOLD_WORDS).split()) if text else set()
    words |= {b"^" + w[:STEM] for w in words if len(w) > STEM}
    return np.unique(hashes.of(list(words)) & np.uint64(FEATURES - 1)).astype(np.int32)


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(feature numbers, grade) of at most `sample` labelled documents."""
    rated = graded(labels)
    n = rated.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rated.withColumn("draw", draw).where(F.col("draw") < min(1.0, 1.5 * sample / max(1, n))).orderBy("draw").limit(sample).drop("draw")
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # `sample` rows at most

    def work():
        hashes = WordHashes()
        return lambda texts: [pa.array([features(x, hashes).tobytes() for x in texts], pa.binary())]

    return unpacked(per_text(texts, "text", ["grade"], work, "found binary"), ["grade"], "found")


def fit(rows: list[tuple[bytes, int]], grades: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by AdaGrad on the log-likelihood of the grades."""
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
    cuts = np.array([-4.0, -1.0][: grades - 1]) if grades == 3 else np.arange(grades - 1) - (grades - 2) / 2
    cut_squares = np.full(len(cuts), 1e-6)
    data = sorted(((np.frombuffer(x, np.int32), g) for x, g in rows), key=lambda r: (r[0].tobytes(), r[1]))
    if len(data) >= 50 * LEAST_DOCS:  # features of few documents only add noise
        telling = telling_features(data, grades)
        data = [(x[telling[x]], g) for x, g in data]
    order = np.random.default_rng(seed)
    for _ in range(max(PASSES, -(-LEAST_STEPS // max(1, len(data))))):
        for i in order.permutation(len(data)):
            at, grade = data[i]
            score = weights[at].sum() * SCALE
            upper = sigmoid(cuts[grade] - score) if grade < len(cuts) else 1.0
            lower = sigmoid(cuts[grade - 1] - score) if grade else 0.0
            p = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            step = (du - dl) * SCALE  # d(-log p)/d(weight)
            grad = step + DECAY * weights[at]
            squares[at] += grad * grad
            weights[at] -= RATE * 0.2 * grad / np.sqrt(squares[at])
            for cut, slope in ((grade, -du), (grade - 1, dl)):
                if 0 <= cut < len(cuts):
                    cut_squares[cut] += slope * slope
                    cuts[cut] -= RATE * 0.2 * slope / np.sqrt(cut_squares[cut])
            cuts = np.maximum.accumulate(cuts)
    return weights, cuts


def telling_features(data: list[tuple[np.ndarray, int]], grades: int) -> np.ndarray:
    """True for features of enough documents whose share at or under some grade is off by `MIN_Z` standard deviations."""
    of_all = np.bincount(np.concatenate([x for x, _ in data]), minlength=FEATURES)
    telling = np.zeros(FEATURES, dtype=bool)
    for cut in range(grades - 1):
        low = [x for x, g in data if g <= cut]
        share = len(low) / len(data)
        if 0 < share < 1:
            off = np.bincount(np.concatenate(low), minlength=FEATURES) - of_all * share
            telling |= np.abs(off) >= MIN_Z * np.sqrt(of_all * share * (1 - share))
    return telling & (of_all >= LEAST_DOCS)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def rate(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray, text_col: str = "text", carry=None, min_tail: float = MIN_TAIL) -> DataFrame:
    """Every row of `docs` as struct `rest`, with expected_grade, tail (P(grade >= 1)) and keep."""
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cuts))  # FEATURES numbers

    def work():
        (w, c), hashes = model.value, WordHashes()

        def each(texts):
            scores = np.empty(len(texts))
            for i, x in enumerate(texts):
                at = features(x, hashes)
                scores[i] = w[at].sum(dtype=np.float64) * SCALE
            above = 1 - sigmoid(c[None, :] - scores[:, None])
            return [pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= min_tail)]

        return each

    return per_text(docs, text_col, carry, work, "expected_grade double; tail double; keep boolean")


def model_of(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = [(r["found"], r["grade"]) for r in sampled(docs, labels).collect()]
    return fit(rows) if rows else (np.zeros(FEATURES), np.array([-35.0, -35.0]))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rate(docs.select("doc_id", "text"), *model_of(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return unpacked(found, ["doc_id"], "expected_grade", "tail", "keep")
