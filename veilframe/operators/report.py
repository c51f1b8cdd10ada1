"""Case reports, letters and the monitor: assembled as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import vault as vaults

# What each role looks at, and default texts of a report.
ROLE_FOCUS = {
    "internist": "overall differential and primary-care coordination",
    "endocrinologist": "metabolic risk, diabetes and hormone-related patterns",
    "neurologist": "neurologic symptoms and escalation questions",
}
OTHER_FOCUS = "the assigned clinical perspective"
ROLE_QUESTION = "What should the treating physician clarify next?"
CASE_QUESTION = "Which next clinical question should the physician resolve?"
NEXT_STEP = "Review this report with a licensed physician."
DEFAULT_PROBLEM = "clinical guideline"
AGGREGATES = ("timeline/events.md", "problems.md", "meds.md", "labs/labs.md")


def _focus(role: Column) -> Column:
    out = F.lit(OTHER_FOCUS)
    for name, focus in ROLE_FOCUS.items():
        out = F.when(role == name, focus).otherwise(out)
    return out


def deterministic(cases: DataFrame, created_at: str) -> DataFrame:
    """cases(subject, roles array<string>, question, memory_refs, external_refs arrays of (source, url)) -> report columns.

    Repeated roles count once, as keys do.
    """
    claim = lambda r: F.concat(r, F.lit(": review "), F.col("subject"), F.lit(" for "), _focus(r), F.lit("."))
    view = lambda r: F.struct(r, F.struct(F.array(claim(r)).alias("claims"), F.array(F.lit(ROLE_QUESTION)).alias("open_questions")))
    distinct = F.array_distinct("roles")
    names = F.when(F.size("roles") > 0, F.array_join(distinct, ", ")).otherwise("no roles")
    return cases.select(
        F.lit("consilium_report").alias("artifact_type"), F.col("subject").alias("patient_id"), F.lit(created_at).alias("created_at"), "roles",
        F.map_from_entries(F.transform(distinct, view)).alias("perspectives"), F.concat(F.lit("Chair synthesis required across: "), names, F.lit(".")).alias("chair_summary"),
        F.transform(distinct, claim).alias("claims"), F.concat("memory_refs", "external_refs").alias("evidence_refs"),
        F.array(F.coalesce(F.nullif("question", F.lit("")), F.lit(CASE_QUESTION))).alias("open_questions"), F.array().cast("array<string>").alias("disagreements"),
        F.lit(NEXT_STEP).alias("recommended_next_step"), F.lit("not_used").alias("model_status"),
    )


def with_profiles(reports: DataFrame, profiles: DataFrame) -> DataFrame:
    """reports with role_profiles, map of role to (title, content, path); a role without a file has its name and empty content."""
    roles = reports.select("patient_id", F.posexplode("roles").alias("ord", "role")).join(F.broadcast(profiles), "role", "left")
    entry = F.struct("role", F.struct(F.coalesce("title", "role").alias("title"), F.coalesce("content", F.lit("")).alias("content"), "path"))
    maps = roles.dropDuplicates(["patient_id", "role"]).groupBy("patient_id").agg(F.map_from_entries(F.collect_list(entry)).alias("role_profiles"))
    return reports.join(maps, "patient_id", "left")


def grounded(disagreements: DataFrame, claims: DataFrame) -> DataFrame:
    """disagreements(case_id, ord, text) that name at least two of the case's roles with claims(case_id, role, n_claims)."""
    voices = claims.where("n_claims > 0").select("case_id", "role").distinct()
    literal = F.concat(F.lit(r"(?Uiu)\b\Q"), F.replace("role", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
    named = disagreements.join(voices, "case_id").where(F.rlike("text", literal)).groupBy("case_id", "ord", "text").agg(F.countDistinct("role").alias("n"))
    return named.where("n >= 2").select("case_id", "ord", "text")


def with_model(cases: DataFrame, ask: Callable[[str], str], prompt: str) -> DataFrame:
    """cases with a model's reply and model_status used or fallback; ask is called per row and must not be on a hot path."""
    import pandas as pd

    @F.pandas_udf("reply string, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return ask(text), None
            except Exception as error:  # a failing model leaves the deterministic report
                return None, type(error).__name__

        return pd.DataFrame([one(p) for p in prompts], columns=["reply", "error"])

    asked = cases.withColumn("_answer", run(prompt))
    return asked.withColumns({"reply": F.col("_answer.reply"), "model_error": F.col("_answer.error"), "model_status": F.when(F.col("_answer.reply").isNotNull(), "used").otherwise("fallback")}).drop("_answer")


def evidence(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """(subject, refs): documents(subject, path) by path, then the lists(subject, path) that exist, in their fixed order."""
    rank = F.array_position(F.array(*map(F.lit, AGGREGATES)), F.col("path"))
    rows = documents.select("subject", F.lit(0).cast("long").alias("part"), "path").unionByName(lists.where(rank > 0).select("subject", rank.cast("long").alias("part"), "path"))
    ref = lambda r: F.struct(F.concat(F.lit("patient_memory:"), r.path).alias("source"), r.path.alias("url"))
    return rows.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "path"))), ref).alias("refs"))


def first_problem(subjects: DataFrame, merged: DataFrame) -> DataFrame:
    """(subject, problem): the first listed problem or the default."""
    firsts = merged.where("list = 'problems'").groupBy("subject").agg(F.min_by("item", "ord").alias("problem"))
    return subjects.select("subject").distinct().join(firsts, "subject", "left").select("subject", F.coalesce("problem", F.lit(DEFAULT_PROBLEM)).alias("problem"))


def letters(requests: DataFrame, vault: DataFrame, problems: DataFrame, today: str) -> DataFrame:
    """requests(subject, channel, sender, recipient, place, subject_line, body) -> with draft; tokens only, never values.

    problems: (subject, body). today: dd.mm.yyyy. An unknown channel is an error.
    """
    joined = requests.join(vaults.lowest_token(vault, "PATIENT"), "subject", "left").join(problems.select("subject", F.col("body").alias("problems")), "subject", "left")
    patient = F.coalesce("token", F.lit("[PATIENT_1]"))

    def fill(template: str, values: dict[str, Column]) -> Column:
        out = F.lit(template)
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    given = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), default)
    subject_line = given("subject_line", fill(fixed.LETTER_SUBJECT, {"patient": patient}))
    body = F.trim(given("body", fill(fixed.LETTER_BODY, {"patient": patient, "problems": F.trim(F.coalesce("problems", F.lit("")))})))
    values = {"sender": given("sender", F.lit("[ABSENDER]")), "recipient": given("recipient", F.lit("[EMPFÄNGER]")), "place": given("place", F.lit("[ORT]")), "date": F.lit(today), "subject": subject_line, "body": body}
    draft = F.raise_error(F.concat(F.lit("unknown letter channel: "), F.col("channel"))).cast("string")
    for channel, template in fixed.LETTERS.items():
        draft = F.when(F.col("channel") == channel, fill(template, values)).otherwise(draft)
    return joined.withColumn("draft", draft).drop("token", "problems")


def monitor(requested: DataFrame, timelines: DataFrame) -> DataFrame:
    """requested(subject) -> (patient_id, latest_timeline, strategy_path), a row for each, an empty timeline where there is none."""
    joined = requested.join(timelines.select("subject", F.col("body").alias("latest_timeline")), "subject", "left")
    return joined.select(F.col("subject").alias("patient_id"), F.coalesce("latest_timeline", F.lit("")).alias("latest_timeline"), F.concat(F.lit("patients/"), "subject", F.lit("/strategy.md")).alias("strategy_path"))


def schedule(requested: DataFrame) -> DataFrame:
    """(job, cadence, patient_ids): one row, what a scheduler has to know. The ids are those that were asked for."""
    return requested.agg(F.array_sort(F.collect_set("subject")).alias("patient_ids")).select(F.lit("monitor").alias("job"), F.lit("manual_or_scheduled").alias("cadence"), "patient_ids")
