"""Language ID by compression classification.

Each language's dictionary is up to `DICT_BYTES` of folded training text (lower case, letters and their marks only, one
space between words), given to zstandard as raw content. A text is folded likewise, cut into blocks of `BLOCK` bytes,
all of which are encoded with each dictionary; the language with the smallest sum wins, of equal ones the one with
more training rows. A margin under `MIN_MARGIN` of the second smallest sum is a rejection.

Training takes at most `SAMPLE` documents a language, by a hash of their ids, from documents with a lang and text
whose crc32(id) mod 4 is not 2. All of these are counted and may be drawn, however long; of each drawn document the
first `SAMPLE_CHARS` characters are taken. Each language costs a dictionary and an encoding of every text; more than
`LANGUAGES` of them raise an error.

Defined cases: null and empty texts and texts without a letter are `und`, with score 0, and rejected; without training rows
(as of an empty table) every text is; a null id is held out; rows that repeat an id are judged each by its text; of tied
languages the one with more training rows wins, with margin 0; whole texts are judged, however long, a part at a time; an
empty table gives an empty table; other columns pass through in `rest` under their own names, whatever these are.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.llm.common import parts, per_text, table, unpacked

SAMPLE = 120
SAMPLE_CHARS = 4000
DICT_BYTES = 32 << 10
BLOCK = 1024
LEVEL = 6
MIN_MARGIN = 0.002
LANGUAGES = 1000
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def fold(text: str) -> bytes:
    """Letters and their marks between spaces; two spaces for a text without a letter."""
    return b" " + NOT_LETTERS.sub(" ", text.lower()).strip().encode() + b" " if LETTER.search(text) else b"  "


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", sample: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, dictionary) in order of falling training rows."""
    spark = docs.sparkSession
    rows = docs.where(~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("text"), F.col(id_col).alias("id")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = sorted(((r["n"], r["lang"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()), reverse=True)
    if len(counts) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for n, lang in counts for x in (lang, min(1.0, 4.0 * sample / n))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")])
    best = Window.partitionBy("lang").orderBy(F.char_length("text") < 200, "draw", "id", "text")
    picked = drawn.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= sample).select("lang", "rank", "text").collect()
    texts: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: r["rank"]):
        texts.setdefault(r["lang"], []).append(fold(r["text"]))
    whole = {lang: b"".join(found)[:DICT_BYTES].decode(errors="ignore").encode() for lang, found in texts.items()}  # no half character at the end
    return [(lang, whole[lang]) for _, lang in counts if whole.get(lang, b"").strip()]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        self.coders = []
        for lang, content in dictionaries:
            parameters = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=DICT_BYTES, source_size=BLOCK, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=parameters)
            self.coders.append((lang, zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)))

    def __call__(self, text: bytes | None) -> tuple[str, float, float]:
        """(language, score, margin as a share of the second smallest sum)."""
        sizes, letters = [0] * len(self.coders), False
        for part in parts(text or b""):
            folded = fold(part.decode())
            if folded != b"  ":
                letters = True
                blocks = [folded[i : i + BLOCK] for i in range(0, len(folded), BLOCK)]
                for i, (_, coder) in enumerate(self.coders):
                    sizes[i] += sum(len(coder.compress(b)) for b in blocks)
        if not letters or not self.coders:
            return "und", 0.0, 0.0
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.coders[0][0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        score = 1.0 / sum(2.0 ** max(-1000, sizes[best] - s) for s in sizes)
        return self.coders[best][0], score, (second - sizes[best]) / second


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text_col: str = "text", carry=None, min_margin: float = MIN_MARGIN, with_text: bool = False) -> DataFrame:
    """Every row of `docs` as struct `rest`, with lang_pred, score, margin and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # DICT_BYTES for each language

    def work():
        judge = Classifier(shared.value)

        def each(texts):
            found = [judge(x) for x in texts]
            reject = [lang == "und" or margin < min_margin for lang, _, margin in found]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()), pa.array(reject, pa.bool_())]

        return each

    return per_text(docs, text_col, carry, work, "lang_pred string; score double; margin double; rejected boolean", with_text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    found = identify(rows, fit(docs), carry=["doc_id", "held_out"])
    return unpacked(found, ["doc_id", "held_out"], "lang_pred", "score", "margin", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those rejected go. lang stays as given where it is, else it is the one found."""
    found = identify(docs, fit(docs), carry=[c for c in docs.columns if c != "text"], with_text=True).where("NOT rejected")
    made = {"text": F.col("text"), "lang": F.coalesce("rest.lang", "lang_pred")}
    return found.select(*[made.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])
