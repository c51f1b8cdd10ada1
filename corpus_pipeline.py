"""Corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing. Part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, langid, packing, secrets, simhash
from veilframe.llm.common import fresh, small, store, table

#: A prediction below this share of the likelihood is no language we know.
LEAST_LANGUAGE_SCORE = 0.4

#: Bytes of a batch that goes to a Python worker; several exist at once, in the JVM and in the worker.
BATCH_BYTES, _BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def _modest(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for the stages that run Python, unless the session sets its own. Rows do not depend on it."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; a missing lang is filled in.

    Null and empty texts, and texts without a letter, have no language and go; repeated rows and null ids are judged like any
    other; no documents give none. Further columns stay, whatever their names.
    """
    _modest(spark)
    language, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = langid.predict(docs, langid.fit(docs), (language, score))
    kept = found.where((F.col(language) != langid.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", language)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component one row, of its smallest id; rows without an id stay.

    Components are told apart by their roots, since ids may repeat: rows that share an id and lie in several components
    are judged each in its own. Of texts with one id in one component the one with the smallest hash stays, of equal
    texts with one id the row that is smallest as JSON. Null texts are empty, and empty ones are near each other. Further
    columns stay, of whatever type.
    """
    _modest(spark)
    text, check = fresh("text_hash", docs.columns), fresh("text_check", docs.columns)
    key = ["doc_id", text, check]  # an id and 96 bits of its text
    keyed = docs.withColumns({text: F.xxhash64("text"), check: F.hash("text")})
    found = store(simhash.grouped(keyed, key[1:]).where("doc_id is not null").groupBy("root", *key).agg(F.count("*").alias("n")), "duplicates")
    # Equal keys have equal roots, so a key alone tells whether its rows stand for their component.
    standing = store(found.groupBy("root").agg(F.min(F.struct(*key)).alias("least")).select("least.*"), "standing")
    gone = store(found.join(standing, key, "left_anti").select(key), "gone")
    repeated = store(found.where("n > 1").join(standing, key, "left_semi").select(key), "repeated")
    # Texts are only shuffled if the keys to drop are too many to broadcast.
    kept = keyed.join(small(gone, 32), key, "left_anti")
    repeated = small(repeated, 32)
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = kept.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by(rest, F.to_json(rest)).alias("row")).select("row.*")
    return kept.join(repeated, key, "left_anti").select(docs.columns).unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, as do repeated rows without one; a null id is one like any other. Further columns stay.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = store(found.where("contaminated").select(*decontaminate.row_key(F.col("doc_id"), F.col("doc_key"))).distinct(), "contaminated")
    names = [fresh("id", docs.columns), fresh("key", docs.columns)]
    rows = docs.withColumns(dict(zip(names, decontaminate.row_key(F.col("doc_id"), F.xxhash64("text")))))
    hit = small(hit, 32)
    return rows.join(hit, (F.col(names[0]) == hit["row_id"]) & (F.col(names[1]) == hit["row_key"]), "left_anti").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets replaced, and n_chars as long as the texts; null texts stay null. No row goes."""
    _modest(spark)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(secrets.redact)

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    _modest(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("packing", pack)]

#: Language scores, fingerprints and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
