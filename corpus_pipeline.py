"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, folder) and returns what the next one reads. All but the last return
the columns of `documents`: language identification drops documents without recognisable language,
near-dedup keeps one document of each group, decontamination drops documents that hold a benchmark
item, the secret scan replaces secrets in the text, and packing gives the pieces of the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import decontam, langid, packing, secret_scan, simhash
from quarrylight.llm.common import crc_of_id, land
from quarrylight.sources.tables import read_table


def recognise_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    model = langid.fit(docs.filter((crc_of_id() % 3) != 1).select("text", "lang"))
    return langid.recognised(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.keep_first(docs, size=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, folder, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"
    )


STAGES = [
    ("language_id", recognise_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", hide_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the model of the first stage, nor the last; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, folder), name)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
