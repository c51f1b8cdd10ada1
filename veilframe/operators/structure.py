"""From text to records: prepass, merge with a model's reply, metadata, names, rendering, longitudinal lists."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions.text import after_label, body_date, computed, filename_date, has, iso_date, let, lines, strip
from . import residue

LISTS = ("timeline", "problems", "meds", "labs")
FIELDS = ("document_date", "document_topic", "document_sender", "doc_type", "specialty", "examination_date", "institution", "examiner", "summary")
SECTIONS = tuple(key for key, _ in fixed.SECTIONS)
SCHEMA = ", ".join([*(f"{x} array<string>" for x in LISTS), *(f"{x} string" for x in FIELDS), "sections struct<" + ", ".join(f"{x}:string" for x in SECTIONS) + ">"])


def prepass(text: Column) -> Column:
    """The deterministic record: dated lines, problems by their label, lines of medication and laboratory values."""
    empty = F.lit(None).cast("struct<" + ",".join(f"{x}:string" for x in SECTIONS) + ">")

    def of_lines(found: Column) -> Column:
        picked = lambda p: F.filter(found, lambda x: has(x, p))
        return F.struct(
            picked(fixed.DATE_LINE).alias("timeline"), F.transform(F.filter(found, lambda x: F.lower(x).startswith("problem:")), after_label).alias("problems"),
            picked(fixed.MED_LINE).alias("meds"), picked(fixed.LAB_LINE).alias("labs"),
            *((F.coalesce(body_date(text), F.lit("")) if x == "document_date" else F.lit("")).alias(x) for x in FIELDS), empty.alias("sections"),
        )

    trimmed = F.filter(F.transform(lines(F.coalesce(text, F.lit(""))), strip), lambda x: x != "")
    return let(trimmed, of_lines)


def coerce(reply: Column) -> Column:
    """A model's JSON reply as a record: trimmed, empty entries gone; null if it is no JSON object or a list field is no list."""
    lists = F.from_json(reply, "struct<" + ",".join(f"{x}:array<string>" for x in LISTS) + ">")
    raw = F.from_json(reply, "map<string,string>")
    parsed = F.from_json(reply, SCHEMA)
    broken = F.lit(False)
    for x in LISTS:
        broken = broken | (F.element_at(raw, x).isNotNull() & lists[x].isNull())
    clean = lambda c: strip(F.coalesce(c, F.lit("")))
    record = F.struct(
        *(F.filter(F.transform(F.coalesce(parsed[x], F.array().cast("array<string>")), clean), lambda v: v != "").alias(x) for x in LISTS),
        *(clean(parsed[x]).alias(x) for x in FIELDS),
        F.when(parsed["sections"].isNotNull(), F.struct(*(clean(parsed["sections"][x]).alias(x) for x in SECTIONS))).alias("sections"),
    )
    return F.when(raw.isNotNull() & ~broken, record)


def merge(first: Column, second: Column) -> Column:
    """Lists joined without repeats, first seen first; of scalars the second, unless it is empty."""
    second_or = lambda x: F.coalesce(F.nullif(second[x], F.lit("")), F.nullif(first[x], F.lit("")), F.lit(""))
    return F.struct(
        *(F.array_distinct(F.concat(first[x], F.coalesce(second[x], F.array().cast("array<string>")))).alias(x) for x in LISTS),
        *(second_or(x).alias(x) for x in FIELDS), F.coalesce(second["sections"], first["sections"]).alias("sections"),
    )


def structured(documents: DataFrame, reply: str | None = None) -> DataFrame:
    """documents with record: the prepass, merged with the model's reply in column ``reply`` where that is usable."""
    base = computed(documents, "record", prepass(F.col("text")))
    if reply is None:
        return base
    return computed(base, "_model", coerce(F.col(reply))).withColumn("record", F.when(F.col("_model").isNull(), F.col("record")).otherwise(merge(F.col("record"), F.col("_model")))).drop("_model")


#: What a structuring model is told; its answer is read by ``coerce``.
PROMPT = (
    "From a de-identified medical text, give one JSON object: lists of strings timeline, problems, meds, labs; strings document_date, document_topic, document_sender, doc_type, specialty, examination_date, institution, examiner, summary; "
    "and an object sections with the strings kontext, untersuchung, befund, beurteilung, empfehlung. Dates are YYYY-MM-DD. Keep every token in brackets as it is, add nothing, restore nothing, and name no person as topic or sender."
)


def asked(documents: DataFrame, ask, attempts: int = 2) -> DataFrame:
    """documents(text, …) with reply: a structuring model's answer, or null after so many failed or unusable ones. ask(prompt, JSON) -> text."""
    import json

    from ..functions.text import python

    fence = python(fixed.FENCE)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            for _ in range(attempts):
                try:
                    reply = ask(PROMPT, json.dumps({"text": text or ""}, ensure_ascii=False))
                    fenced = fence.search(reply)
                    found = json.loads(fenced[1] if fenced else reply)
                    if isinstance(found, dict) and all(isinstance(found.get(x) or [], list) for x in LISTS):
                        return json.dumps(found, ensure_ascii=False)
                except Exception:  # the deterministic record stays
                    continue
            return None

        return texts.map(one)

    return computed(documents, "reply", run.asNondeterministic()("text"))


@F.pandas_udf(StringType())
def _ascii(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii"))


def slug(value: Column, fallback: str) -> Column:
    """A name part; empty values, tokens, titles and residue give the fallback."""
    clean = strip(F.coalesce(value, F.lit("")))
    unsafe = (clean == "") | has(clean, fixed.METADATA_TOKEN) | has(clean, fixed.PERSON_TITLE) | (F.size(residue.hits(clean)) > 0)
    spelled = clean
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    made = F.regexp_replace(F.regexp_replace(_ascii(spelled), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(unsafe | (made == ""), fallback).otherwise(made)


def with_metadata(documents: DataFrame, ingest_day: str, stem: str | None = None) -> DataFrame:
    """documents(text, record) with date, date_source, topic, sender. stem: a column of file names of reviewed previews."""
    found = F.coalesce(iso_date(F.col("record.document_date")), body_date(F.col("text")))
    named = filename_date(F.col(stem)) if stem else F.lit(None).cast("string")
    documents = computed(documents, "topic", slug(F.col("record.document_topic"), "document"))
    documents = computed(documents, "sender", slug(F.col("record.document_sender"), "unknown-sender"))
    return documents.withColumns({
        "date": F.coalesce(found, named, F.lit(ingest_day)), "date_source": F.when(found.isNotNull(), "document").when(named.isNotNull(), "filename").otherwise("ingest"),
    })


def named(documents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """documents(subject, seq, doc_id, date, topic, sender) with stem, unique within the subject: -2, -3, … in order of seq.

    existing: (subject, stem) already in use.
    """
    base = documents.withColumn("_base", F.concat_ws("_", "date", "topic", "sender"))
    number = F.row_number().over(Window.partitionBy("subject", "_base").orderBy("seq", "doc_id"))
    if existing is None:
        return base.withColumn("stem", F.when(number == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", number.cast("string")))).drop("_base")
    used = existing.select("subject", "stem", F.regexp_replace("stem", r"-\d+$", "").alias("cut"), F.regexp_extract("stem", r"-(\d+)$", 1).try_cast("int").alias("k"))
    taken = used.select("subject", F.col("stem").alias("_base"), F.lit(1).alias("k")).union(used.where("k is not null").select("subject", F.col("cut").alias("_base"), "k"))
    taken = taken.groupBy("subject", "_base").agg(F.array_sort(F.collect_set("k")).alias("_taken"))
    joined = base.join(taken, ["subject", "_base"], "left").withColumn("_n", number)
    held = F.coalesce("_taken", F.array().cast("array<int>"))
    # The n-th free number: among 1 .. n + taken, those not in use.
    free = F.element_at(F.array_except(F.sequence(F.lit(1), F.col("_n") + F.size(held)), held), F.col("_n"))
    return joined.withColumn("_k", free).withColumn("stem", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_k").cast("string")))).drop("_base", "_taken", "_n", "_k")


def quoted(value: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def rendered(accepted: str | None = None) -> Column:
    """A stored document as Markdown, of columns text, record, date, date_source, topic, sender."""
    of = lambda x: F.coalesce(F.col(f"record.{x}"), F.lit(""))
    examined = F.coalesce(iso_date(F.col("record.examination_date")), F.col("date"))
    kind = F.when(of("doc_type") == "", "sonstiges").otherwise(of("doc_type"))
    front = [("document_date", F.col("date")), ("examination_date", examined), ("date_source", F.col("date_source")), ("doc_type", kind), ("specialty", of("specialty")),
             ("institution", of("institution")), ("examiner", of("examiner")), ("topic", F.col("topic")), ("sender", F.col("sender")), ("summary", of("summary"))]
    head = [F.concat(F.lit(f"{name}: "), quoted(value), F.lit("\n")) for name, value in front]
    if accepted:
        names = F.array_sort(F.array_distinct(F.coalesce(F.col(accepted), F.array().cast("array<string>"))))
        head.append(F.when(F.size(names) > 0, F.concat(F.lit("accepted_residue: ["), F.array_join(F.transform(names, quoted), ", "), F.lit("]\n"))).otherwise(""))
    title = F.concat(F.lit("---\n\n# "), kind, F.lit(" — "), examined, F.when(of("institution") == "", "").otherwise(F.concat(F.lit(" — "), of("institution"))))
    parts = []
    for key, name in fixed.SECTIONS:
        content = strip(F.coalesce(F.col(f"record.sections.{key}"), F.lit("")))
        parts.append(F.when(content == "", "").otherwise(F.concat(F.lit(f"\n\n## {name}\n\n"), content)))
    return F.concat(F.lit("---\n"), *head, title, *parts, F.lit("\n\n## Originaltext (bereinigt)\n\n"), strip(F.coalesce("text", F.lit(""))), F.lit("\n"))


def items(documents: DataFrame) -> DataFrame:
    """(subject, list, item, seq, doc_id, place) of every record; timeline entries name their document."""
    parts = [
        documents.select("subject", F.lit(x).alias("list"), "seq", "doc_id", F.posexplode(f"record.{x}").alias("place", "item"))
        for x in LISTS if x != "timeline"
    ]
    dated = documents.select("subject", F.lit("timeline").alias("list"), "seq", "doc_id", "stem", F.posexplode("record.timeline").alias("place", "item"))
    parts.append(dated.withColumn("item", F.concat("item", F.lit(" [doc:"), "stem", F.lit("]"))).drop("stem"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("subject", "list", "item", "seq", "doc_id", "place")


def merge_lists(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(subject, list, ord, item): existing entries in their order, then new ones by first coming, without repeats."""
    rows = new.select("subject", "list", "item", F.struct(F.lit(1).alias("age"), F.lit(0).cast("long").alias("ord"), F.col("seq").cast("long").alias("seq"), F.col("doc_id").cast("long").alias("doc_id"), F.col("place").cast("int").alias("place")).alias("at"))
    if existing is not None:
        rows = rows.unionByName(existing.select("subject", "list", "item", F.struct(F.lit(0).alias("age"), F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("place")).alias("at")))
    first = rows.groupBy("subject", "list", "item").agg(F.min("at").alias("at"))
    return first.select("subject", "list", F.row_number().over(Window.partitionBy("subject", "list").orderBy("at", "item")).cast("long").alias("ord"), "item")


def list_text(merged: DataFrame) -> DataFrame:
    """(subject, list, body): the bullets of each list."""
    bullets = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: F.concat(F.lit("- "), x.item)), "\n")
    return merged.groupBy("subject", "list").agg(bullets.alias("body"))


def list_items(text: Column) -> Column:
    """The entries of a stored list."""
    kept = F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: x.startswith("- ") & (x != fixed.NO_ENTRIES))
    return F.transform(kept, lambda x: F.substr(x, F.lit(3)))
