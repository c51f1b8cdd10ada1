"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

``postings`` stores (document, position, term) for the terms that any test item uses; a term that no
test asks for has a list that is never read, so it is not written. One more row per document, with no
term, carries its number of words. For each test window the two rarest terms, by stored frequency, are
looked up first: a document position minus the term's offset in the item is the place where the
item would begin (a diagonal), and a diagonal that two anchors agree on is a candidate. Only there are the
other lists intersected; runs of matching offsets of a whole window are exact phrase matches.

Defined results: null text has no words; rows with equal doc_id and text each get the same result, rows
with equal doc_id and another text their own; item rows with a null id or without words are left out, and
several texts under one id are one item. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, small, store

WINDOW = 10
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW = ["doc_id", "doc_key"]


def words(text: Column) -> Column:
    """Lower-cased runs of 0-9, a-z and every character beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def row_key(doc_id: Column, doc_key: Column) -> tuple[Column, Column]:
    """A row's id and the 64-bit hash of its text, without nulls: a null id is 0 with an odd key, where all others are even, so that plain equi-joins hold for it too."""
    return F.coalesce(doc_id, F.lit(0)).cast("long").alias("row_id"), doc_key.bitwiseAND(F.lit(-2)).bitwiseOR(doc_id.isNull().cast("long")).alias("row_key")


class Index:
    """Items and stored postings of one corpus against one test set."""

    def __init__(self, documents: DataFrame, items: DataFrame):
        texts = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0").distinct()
        texts = store(texts.select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")
        used = texts.select("item", "item_id", F.size("words").alias("length"), F.posexplode("words").alias("off", "term"))
        terms = store(used.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")), "terms")
        self.terms = terms.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0))).first()
        average = max(1, self.terms[1] // max(1, self.terms[0]))
        self.items = store(used.join(terms, "term").select("item", "item_id", "length", "off", "tid"), "item_words")
        self.item_rows = self.items.count()
        # The empty string ends every document: its position is the number of words.
        row_id, key = row_key(F.col("doc_id"), F.xxhash64("text"))
        # Keys and words come before the explode, or the text would be carried and hashed again for each of its words; the
        # outer form, on arrays that are never empty, spares a filter that would split every text a second time.
        rows = documents.select(row_id.alias("doc_id"), key.alias("doc_key"), F.array_append(words(F.col("text")), F.lit("")).alias("words"))
        spread = rows.select(*_ROW, F.posexplode_outer("words").alias("pos", "term"))
        wanted = terms.union(documents.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("tid")))
        self.postings = store(spread.join(small(wanted, average, self.terms[0]), "term").select("doc_id", "doc_key", "pos", F.col("tid").cast("long").alias("tid")), "postings")

    def documents(self) -> DataFrame:
        """One row per input row, with its number of words."""
        return self.postings.where("tid = -1").select("doc_id", "doc_key", F.col("pos").cast("long").alias("n_words"))

    def frequencies(self) -> DataFrame:
        return self.postings.where("tid >= 0").groupBy("tid").agg(F.count("*").alias("freq"))

    def candidates(self, window: int = WINDOW) -> DataFrame:
        """(doc_id, doc_key, item, diagonal) where two of a window's rarest terms agree (or its one term)."""
        known = self.items.join(self.frequencies(), "tid", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
        known = store(known, "item_frequencies")
        # Every window of an item, as its first offset; an item shorter than a window is one.
        first, last = F.greatest(F.col("off") - window + 1, F.lit(0)), F.least(F.col("off"), F.greatest(F.col("length") - window, F.lit(0)))
        spread = known.select("item", "length", "off", "tid", "freq", F.explode(F.sequence(first, last)).alias("start"))
        placed = Window.partitionBy("item", "start").orderBy("freq", "off")
        anchors = (
            spread.withColumn("place", F.row_number().over(placed)).withColumn("least", F.min("freq").over(Window.partitionBy("item", "start")))
            .where("place <= 2 and least > 0").select("item", "off", "tid", F.least("length", F.lit(2)).alias("needed")).distinct()
        )
        anchors = store(anchors, "anchors")
        met = self.postings.join(small(anchors, 64), "tid").select(*_ROW, "item", (F.col("pos") - F.col("off")).alias("diagonal"), "needed")
        return met.groupBy(*_ROW, "item", "diagonal").agg(F.count("*").alias("n"), F.min("needed").alias("needed")).where("n >= needed").select(*_ROW, "item", "diagonal")

    def phrases(self, window: int = WINDOW) -> DataFrame:
        """(doc_id, doc_key, item_id, first, last): maximal runs of item words in a document that hold a whole window."""
        starts = store(self.candidates(window), "candidates")
        lists = self.postings.join(small(starts, 64), _ROW).where("pos >= diagonal").withColumn("off", (F.col("pos") - F.col("diagonal")).cast("int"))
        met = lists.join(small(self.items, 64, self.item_rows), ["item", "off", "tid"]).groupBy(*_ROW, "item", "item_id", "diagonal", "length", "off").agg(F.lit(1).alias("one"))
        runs = met.withColumn("run", F.col("off") - F.row_number().over(Window.partitionBy(*_ROW, "item", "diagonal").orderBy("off")))
        runs = runs.groupBy(*_ROW, "item", "item_id", "diagonal", "length", "run").agg(F.min("off").alias("a"), F.max("off").alias("b"))
        whole = runs.where(F.col("b") - F.col("a") + 1 >= F.least(F.col("length"), F.lit(window)))
        return whole.select(*_ROW, "item_id", (F.col("diagonal") + F.col("a")).alias("first"), (F.col("diagonal") + F.col("b")).alias("last"))

    def proximity(self, slop: int) -> DataFrame:
        """(doc_id, doc_key, item_id, pos): places of an item's rarest term with all its terms within ``slop`` words on either side."""
        distinct = self.items.groupBy("item", "item_id", "tid").agg(F.count("*").alias("uses"))
        ranked = distinct.join(self.frequencies(), "tid", "left").withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("freq", F.lit(0)), "tid")))
        needed = distinct.groupBy("item").agg(F.count("*").alias("needed"))
        around = F.explode(F.array(*(F.floor(F.col("pos") / (slop + 1)) + k for k in (-1, 0, 1)))).alias("block")
        rare = self.postings.join(ranked.where("place = 1").join(needed, "item").select("item", "item_id", "tid", "needed"), "tid").select(*_ROW, "item", "item_id", "needed", F.col("pos").alias("at"), around)
        rest = self.postings.join(distinct.select("item", F.col("tid")), "tid").select(*_ROW, "item", "tid", "pos", F.floor(F.col("pos") / (slop + 1)).alias("block"))
        near = rare.join(rest, [*_ROW, "item", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
        met = near.groupBy(*_ROW, "item_id", "at", "item", "needed", "tid").agg(F.lit(1).alias("one")).groupBy(*_ROW, "item_id", "at", "item", "needed").agg(F.count("*").alias("n"))
        return met.where("n = needed").select(*_ROW, "item_id", F.col("at").alias("pos")).distinct()


def decontaminate(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_key, n_words, n_hit, n_items, item_ids, contaminated), one row per row of documents."""
    index = Index(documents, items)
    found = store(index.phrases(window), "phrases")
    hit = found.select(*_ROW, F.explode(F.sequence("first", "last")).alias("pos")).groupBy(*_ROW, "pos").agg(F.lit(1).alias("one")).groupBy(*_ROW).agg(F.count("*").alias("n_hit"))
    which = found.groupBy(*_ROW).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = index.documents().join(hit.join(which, _ROW), _ROW, "left")
    return out.select(
        F.when(F.col("doc_key") % 2 == 0, F.col("doc_id")).alias("doc_id"), "doc_key", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
