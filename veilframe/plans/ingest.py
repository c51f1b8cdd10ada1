"""The ingest plan: rewrite, declutter, gate, structure, name, render, gate again."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed, subject_id, subject_scope
from ..operators import declutter, deid, detectors, residue, structure, vault
from ..sources.scratch import store


@dataclass(frozen=True)
class Options:
    today: datetime.date
    detector: deid.Detector | None = None
    policy: dict[str, str] = field(default_factory=dict)
    strict: bool = False
    synthetic: bool = False
    reviewed: bool = False  # reviewed previews of real documents may be stored
    reply: str | None = None  # a column with the structuring model's reply
    accepted: str | None = None  # a column with the rules accepted for a document


@dataclass(frozen=True)
class Result:
    documents: DataFrame  # stored documents with stem and markdown
    quarantined: DataFrame  # documents with blocking hits, and those hits
    vault: DataFrame  # rows to append
    lists: DataFrame  # longitudinal lists


def ready(options: Options) -> None:
    """Fail closed before any job: real documents need a detector that answers."""
    if options.synthetic:
        return
    if options.detector is None:
        raise RuntimeError("real documents need a detector")
    detectors.probe(options.detector)


def ingest(documents: DataFrame, options: Options, *, vault_rows: DataFrame | None = None, stored: DataFrame | None = None, lists: DataFrame | None = None) -> Result:
    """documents(subject, seq, doc_id, text, …) through the whole plan. stored: (subject, stem); lists: (subject, list, ord, item)."""
    ready(options)
    clean = documents.withColumn("subject", subject_id(F.col("subject")))
    rewritten = deid.deidentify(clean, today=options.today, detector=options.detector, vault=vault_rows, sweep_known=vault_rows is not None, strict=options.strict)
    extra = [c for c in (options.reply, options.accepted) if c]
    if extra:
        rewritten = rewritten.join(clean.select("subject", "seq", "doc_id", *extra), ["subject", "seq", "doc_id"], "left")
    # The rewrite is the costly part, and four results hang on it; written, a lost executor does not cost it again.
    rewritten = store(rewritten, "rewritten")
    return _stored(rewritten, vault.entries(rewritten), options, stored, lists)


def _stored(rewritten: DataFrame, new_tokens: DataFrame, options: Options, stored: DataFrame | None, lists: DataFrame | None, preview_stem: str | None = None) -> Result:
    """Gate, structure, name, render and gate again: rewritten(subject, seq, doc_id, text, retained, …)."""
    passed, stopped = residue.gate(declutter.declutter(rewritten), options.policy, "retained", options.accepted)
    records = structure.structured(passed, options.reply)
    dated = structure.with_metadata(records, options.today.isoformat(), preview_stem)
    stems = structure.named(dated, stored)
    written = computed(stems, "markdown", structure.rendered(options.accepted))
    second = residue.hits(F.col("markdown"), options.policy, F.col("retained"), F.col(options.accepted) if options.accepted else None)
    written = computed(written, "_again", F.filter(second, lambda h: h.action == "block"))
    final, late = written.where(F.size("_again") == 0).drop("_again"), written.where(F.size("_again") > 0)
    quarantined = stopped.select("subject", "seq", "doc_id", "blocking").unionByName(late.select("subject", "seq", "doc_id", F.col("_again").alias("blocking")))
    merged = structure.merge_lists(structure.items(final), lists)
    return Result(final, quarantined, new_tokens, merged)


def from_preview(previews: DataFrame, preview_vault: DataFrame, vault_rows: DataFrame, options: Options, *, stored: DataFrame | None = None, lists: DataFrame | None = None) -> Result:
    """Reviewed previews(subject, seq, doc_id, stem, text, accepted array<string>, …) as documents, without another rewrite.

    Their tokens are moved onto the subjects' vaults, scoped by the subject's number; a conflict is an error and nothing is
    stored. Rules that a reviewer accepted only report, in that document alone. Real documents need no detector here, but the option ``reviewed``.
    """
    if not (options.reviewed or options.synthetic):
        raise RuntimeError("reviewed previews are not allowed by the options")
    clean = previews.withColumnRenamed("stem", "stem_of_preview").withColumns({"subject": subject_id(F.col("subject")), "accepted": F.transform(F.coalesce("accepted", F.array().cast("array<string>")), F.upper)})
    empty = clean.where(F.trim(F.coalesce("text", F.lit(""))) == "").limit(1).count()
    if empty:
        raise ValueError("a reviewed preview is empty")
    owned = preview_vault.withColumn("subject", subject_id(F.col("subject")))
    rows, mapped = vault.merged(vault_rows, owned, clean, subject_scope(F.col("subject")))
    mailboxes = deid.mailboxes(mapped)
    return _stored(store(mailboxes, "previewed"), rows, replace(options, accepted="accepted"), stored, lists, "stem_of_preview")


def preview(documents: DataFrame, options: Options, vault_rows: DataFrame | None = None) -> DataFrame:
    """What would be stored, its residue and its tokens, without storing: numbered from scratch and unscoped."""
    rewritten = deid.deidentify(documents, today=options.today, detector=options.detector, vault=vault_rows, sweep_known=vault_rows is not None, strict=options.strict)
    return rewritten.withColumn("residue", residue.hits(F.col("text"), options.policy, F.col("retained")))


def preview_reports(previews: DataFrame) -> DataFrame:
    """(subject, doc_id, report): a preview's report as JSON, of rule names, lines and counts, without any of its content."""
    dropped = F.transform(F.array(*map(F.lit, declutter.REASONS)), lambda r: F.struct(r.alias("reason"), F.size(F.filter("judged", lambda x: x.reason == r)).alias("n")))
    body = F.struct(
        F.col("residue").alias("hits"), F.col("rejected").alias("rejected_entities"), F.exists("residue", lambda h: h.action == "block").alias("blocked"),
        F.map_from_entries(dropped).alias("declutter"),
    )
    return declutter.judged(previews).select("subject", "doc_id", F.to_json(body).alias("report"))
