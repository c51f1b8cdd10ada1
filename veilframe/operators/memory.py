"""Retrieval: hashed bag-of-words vectors and scoped top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import summary

DIM, TOP = 128, 5
WORD = r"[\p{L}\p{M}\p{N}_-]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def slot(term: Column, dim: int = DIM) -> Column:
    """SHA-1 of the term as a number, modulo dim: for dim up to 256 and a divisor of it, the last byte decides."""
    return (F.conv(F.right(F.sha1(term), F.lit(2)), 16, 10).cast("int") % dim).cast("int")


def histogram(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, slot, n), partial counts before the shuffle."""
    return texts.select(key, F.explode(terms(F.col(text))).alias("term")).select(key, slot(F.col("term")).alias("slot")).groupBy(key, "slot").agg(F.count("*").alias("n"))


def vector(text: Column, dim: int = DIM) -> Column:
    """The normalised vector of one text, within its row; a text without words keeps zeros."""
    slots = F.transform(terms(text), lambda t: slot(t, dim))
    counts = F.aggregate(slots, F.array_repeat(F.lit(0.0), dim), lambda v, s: F.transform(v, lambda x, i: F.when(i == s, x + 1).otherwise(x)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(F.array(counts), lambda v: F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))[0])[0]


def index(documents: DataFrame) -> DataFrame:
    """documents(subject, path, title, text, ord) -> index records; the sparse vector is a map of slots."""
    base = documents.select("subject", "path", "title", "ord", summary(F.coalesce("text", F.lit(""))).alias("summary"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"), F.concat_ws("\n", "path", "text").alias("_body"))
    counts = histogram(base, "path", "_body").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("counts"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return base.drop("_body").join(counts, "path", "left")


def stale(index_table: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose content the index does not hold: an incremental sync indexes only these."""
    now = documents.withColumn("source_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return now.join(index_table.select("path", "source_sha256"), ["path", "source_sha256"], "left_anti").drop("source_sha256")


def synced(index_table: DataFrame, documents: DataFrame) -> DataFrame:
    """The index without erased or changed documents, and with new ones: what a full rebuild gives."""
    now = documents.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"))
    kept = index_table.join(now, ["path", "source_sha256"], "left_semi")
    return kept.unionByName(index(stale(index_table, documents)).select(kept.columns))


def scores(histograms: DataFrame, key: str, query: str) -> DataFrame:
    """(key, score) of the query against (key, slot, n): the cosine of the count vectors."""
    spark = histograms.sparkSession
    asked = spark.createDataFrame([(0, query)], "q int, text string")
    wanted = histogram(asked, "q").select("slot", F.col("n").alias("m"))  # at most DIM rows
    length = F.sqrt(F.sum(F.col("n") * F.col("n")))
    query_norm = wanted.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("query_norm"))
    joined = histograms.join(F.broadcast(wanted), "slot", "left").groupBy(key).agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("dot"), length.alias("norm"))
    return joined.join(F.broadcast(query_norm)).select(key, F.coalesce(F.col("dot") / (F.col("norm") * F.col("query_norm")), F.lit(0.0)).alias("score"))


def search(index_table: DataFrame, query: str, subject: str, k: int = TOP) -> DataFrame:
    """The subject's k best records: the scope is a filter before anything is scored."""
    spark = index_table.sparkSession
    wanted = histogram(spark.createDataFrame([(0, query)], "q int, text string"), "q").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("wanted"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("query_norm"))
    mine = index_table.where(F.col("subject") == F.lit(subject)).join(F.broadcast(wanted))
    slots = F.map_keys(F.coalesce("counts", F.create_map().cast("map<int,bigint>")))
    dot = F.aggregate(slots, F.lit(0).cast("long"), lambda a, s: a + F.element_at("counts", s) * F.coalesce(F.try_element_at("wanted", s), F.lit(0)))
    score = F.coalesce(F.try_divide(dot, F.col("norm") * F.col("query_norm")), F.lit(0.0))
    return mine.withColumn("score", F.round(score, 12)).orderBy(F.desc("score"), "ord").limit(k).select("path", "subject", "title", "summary", "source_sha256", "score")


def search_many(index_table: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """queries(subject, query), one a subject -> (subject, rank, path, score): the k best records of each query's own subject."""
    asked = histogram(queries.select("subject", "query"), "subject", "query").groupBy(F.col("subject").alias("asker")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("wanted"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("query_norm"))
    mine = index_table.join(asked, F.col("subject") == F.col("asker"))
    slots = F.map_keys(F.coalesce("counts", F.create_map().cast("map<int,bigint>")))
    dot = F.aggregate(slots, F.lit(0).cast("long"), lambda a, s: a + F.element_at("counts", s) * F.coalesce(F.try_element_at("wanted", s), F.lit(0)))
    scored = mine.select("subject", "path", "ord", F.round(F.coalesce(F.try_divide(dot, F.col("norm") * F.col("query_norm")), F.lit(0.0)), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("subject", "rank", "path", "score")


def texts_of(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits(subject, path, …) with the text of each record, of its own subject."""
    return hits.join(documents.select("subject", "path", "text"), ["subject", "path"])


def records(documents: DataFrame) -> DataFrame:
    """documents(subject, path, …) with ord, their place in a scan by depth and then by path."""
    place = Window.partitionBy("subject").orderBy(F.size(F.split("path", "/")), "path")
    return documents.withColumn("ord", F.row_number().over(place).cast("long"))


def subjects(documents: DataFrame) -> DataFrame:
    """(subject) of all documents, by name."""
    return documents.select("subject").distinct().orderBy("subject")


def opened(spark, path: str, documents: DataFrame) -> DataFrame:
    """The stored index, brought up to date in memory; built and written where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return synced(spark.read.parquet(path), documents)
    index(documents).write.parquet(path)
    return spark.read.parquet(path)


def top_per_scope(scored: DataFrame, scope: str, key: str, k: int = TOP) -> DataFrame:
    """(scope, key, score, rank): the k best of every scope, ties to the smaller key; row_number's bound prunes before the shuffle."""
    place = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def confined(documents: DataFrame, path: str) -> DataFrame:
    """The one document of a path under patients/; any other path, or one with .., is an error."""
    if not path.startswith("patients/") or ".." in path.split("/"):
        raise ValueError("path is outside the patients' records")
    return documents.where(F.col("path") == F.lit(path))
