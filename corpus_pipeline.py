"""The corpus pipeline: documents in, a cleaned and mixed corpus out. Each stage applies one operator of tidelog.llm."""

from __future__ import annotations

from tidelog.llm import decontamination, language_id, mixing, similar_texts, substring_dedup
from tidelog.llm.common import shared_folder

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", similar_texts.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontamination", decontamination.stage),
    ("mixing", mixing.stage),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            folder = shared_folder(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
