"""Helpers the training-data operators share: scratch tables, table reading, word rules."""

from __future__ import annotations

import re
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: Largest table, in rows and in bytes of its rows, that an operator here marks for broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Tasks that learn from a sample.
SAMPLE_PARTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here where that is unset and all run in one process (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = context._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
            made = context._jsc.sc().getCheckpointDir()
        folder = made.get()
    return folder.rstrip("/")


def _path(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts the lineage, and a lost executor costs no recomputation.

    The files go when the JVM ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/veilframe/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    files, path = _path(spark, where)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._stored_at = where
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``store`` that nothing reads any more."""
    files, path = _path(df.sparkSession, df._stored_at)
    files.delete(path, True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its measured size is within bounds; else unmarked, so that the join shuffles."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df


def sampled(rows: DataFrame, group: str, most: int, most_groups: int = 200) -> DataFrame:
    """The ``most`` ids of each group with the smallest hashes: (doc_id, group), each once however many rows repeat it.

    Of more groups than ``most_groups``, as a noisy label column may hold, those with the most ids count, ties by name. The
    ids are counted first, by a sketch, so that a hash bound leaves about four times as many as wanted: what the
    ranking gets is bounded by groups and ``most``, not by the input, its tasks or the rows of one id.
    """
    counts = rows.groupBy(group).agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), group).limit(most_groups).collect()
    if not counts:
        return rows.select("doc_id", group)
    bound = lambda n: -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * most // max(n, 1))
    bounds = rows.sparkSession.createDataFrame([(r[group], bound(r.n)) for r in counts], rows.select(group).withColumn("bound", F.lit(0).cast("long")).schema)
    few = rows.join(F.broadcast(bounds), group).where(F.xxhash64("doc_id") <= F.col("bound")).select("doc_id", group).distinct()
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64("doc_id"), "doc_id"))
    return few.withColumn("place", place).where(F.col("place") <= most).select("doc_id", group)


def one_text_rows(rows: DataFrame, picked: DataFrame, group: str) -> DataFrame:
    """The smallest text of each picked (doc_id, group), stored: as many rows as were picked, whatever one id holds."""
    found = rows.join(F.broadcast(picked), [c for c in picked.columns if c in rows.columns]).groupBy("doc_id", group).agg(F.min("text").alias("text"))
    return store(found.repartition(SAMPLE_PARTS, "doc_id"), "sample")  # else so few bytes would be one task


def fresh(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as make it unlike any taken one, in whatever case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else untouched.

    A text of ASCII alone, as many bytes as characters, takes ``lower``, which goes by bytes; ``translate`` goes by characters.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by
