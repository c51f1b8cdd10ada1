"""Case review: retrieve, gate again, ask each role and the chair, ground disagreements; else the deterministic report.

Cases are rows; a case's payload is bounded by its k retrieved records, and a model is asked within its row. What leaves for a
model passes the residue gate once more, with what each document's front matter accepts; a case whose records do not pass is never sent.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import python
from ..operators import deid, memory, report, residue
from ..sources.scratch import store

Ask = Callable[[str, str], str]  # (system prompt, JSON of the case) -> the reply's text
ROLE_PROMPT = "You speak as {role}. Answer with one JSON object: claims and open_questions, both lists of strings. Give no diagnosis and no prescription."
CHAIR_PROMPT = "You chair the round. Answer with one JSON object: chair_summary, claims, open_questions, disagreements, recommended_next_step. Each disagreement names the roles that differ; without any, an empty list."
_FENCE = python(fixed.FENCE)
ANSWER = "perspectives map<string,struct<claims:array<string>,open_questions:array<string>>>, chair_summary string, claims array<string>, open_questions array<string>, disagreements array<string>, recommended_next_step string, error string"


def _object(reply: str) -> dict:
    fenced = _FENCE.search(reply)
    found = json.loads(fenced[1] if fenced else reply)
    if not isinstance(found, dict):
        raise ValueError("the reply is no object")
    return found


def _listed(found: dict, name: str) -> list[str]:
    values = found.get(name) or []
    if not isinstance(values, list):
        raise ValueError(f"{name} is no list")
    return [str(x) for x in values]


def consult(ask: Ask, case: dict) -> dict:
    """One call a role and one for the chair. A reply that is no object, or whose lists are none, is an error."""
    views = {}
    for role in case["roles"]:
        own = {"patient_id": case["subject"], "role": role, "role_profile": (case.get("role_profiles") or {}).get(role, {})}
        asked = own | {x: case.get(x) for x in ("question", "patient_memory", "external_evidence")}
        found = _object(ask(ROLE_PROMPT.format(role=role), json.dumps(asked, ensure_ascii=False)))
        views[role] = {x: _listed(found, x) for x in ("claims", "open_questions")}
    asked = {"patient_id": case["subject"], "roles": case["roles"], "perspectives": views, "question": case.get("question"), "external_evidence": case.get("external_evidence")}
    chair = _object(ask(CHAIR_PROMPT, json.dumps(asked, ensure_ascii=False)))
    lists = {x: _listed(chair, x) for x in ("claims", "open_questions", "disagreements")}
    lists["claims"] = lists["claims"] or [claim for view in views.values() for claim in view["claims"]]
    return {"perspectives": views, **lists, "chair_summary": str(chair.get("chair_summary") or ""), "recommended_next_step": str(chair.get("recommended_next_step") or ""), "error": None}


def retrieved(cases: DataFrame, documents: DataFrame, k: int = memory.TOP) -> DataFrame:
    """cases(subject, query) and documents(subject, path, text, …) -> (subject, rank, path, score, text): each subject's k best records, never another's."""
    hits = memory.search_many(memory.index(documents), cases, k)
    return memory.texts_of(hits, documents)


def regated(records: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """records(subject, path, text, …) with blocking, the hits that keep a record from being sent."""
    allowed = deid.mailboxes(records)
    found = residue.hits(F.col("text"), policy, F.col("retained"), residue.accepted(F.col("text")))
    return allowed.withColumn("blocking", F.filter(found, lambda h: h.action == "block")).drop("retained")


def reviewed(cases: DataFrame, documents: DataFrame, lists: DataFrame, created_at: str, *, ask: Ask | None = None, external: DataFrame | None = None, profiles: DataFrame | None = None, policy: dict[str, str] | None = None, k: int = memory.TOP) -> DataFrame:
    """A report per case of cases(subject, roles, question).

    documents(subject, path, title, text, ord); lists(subject, list, ord, item); external(subject, title, source, url); profiles(role, title, content,
    path). Without ask the reports are deterministic (not_used); with it, a failing model, an unusable reply or blocked
    records leave the deterministic report (fallback) with the error's name.
    """
    roles = F.when(F.size(F.coalesce("roles", F.array().cast("array<string>"))) > 0, F.col("roles")).otherwise(F.array(F.lit("internist")))
    problems = report.first_problem(cases, lists)
    known = cases.withColumn("roles", roles).join(problems, "subject", "left")
    aggregates = F.create_map(*(F.lit(x) for pair in zip(("timeline", "problems", "meds", "labs"), report.AGGREGATES) for x in pair))
    held = report.evidence(documents.select("subject", "path"), lists.select("subject", F.element_at(aggregates, F.col("list")).alias("path")).distinct())
    refs = F.array().cast("array<struct<source:string,url:string>>")
    found = known.join(held.withColumnRenamed("refs", "memory_refs"), "subject", "left")
    if external is not None:
        found = found.join(external.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("source", "url"))).alias("external_refs")), "subject", "left")
    else:
        found = found.withColumn("external_refs", refs)
    found = found.withColumns({x: F.coalesce(x, refs) for x in ("memory_refs", "external_refs")})
    plain = report.deterministic(found, created_at)
    plain = report.with_profiles(plain, profiles) if profiles is not None else plain
    if ask is None:
        return plain
    records = regated(retrieved(found.select("subject", F.coalesce(F.nullif("question", F.lit("")), "problem").alias("query")), documents, k), policy)
    bodies = records.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("patient_memory"), F.max(F.size("blocking")).alias("blocked"))
    asked = found.join(bodies, "subject", "left").select(
        "subject", (F.coalesce("blocked", F.lit(0)) > 0).alias("blocked"),
        F.to_json(F.struct("subject", "roles", "question", "patient_memory", F.col("external_refs").alias("external_evidence"))).alias("case"),
    )

    @F.pandas_udf(ANSWER)
    def run(blocked: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        def one(stopped: bool, payload: str) -> dict:
            try:
                if stopped:
                    raise residue.ResidueError
                return consult(ask, json.loads(payload))
            except Exception as error:  # whatever fails, the deterministic report stays
                return {x.split()[0]: None for x in ANSWER.split(", ")[:1]} | {"error": type(error).__name__}

        names = ["perspectives", "chair_summary", "claims", "open_questions", "disagreements", "recommended_next_step", "error"]
        return pd.DataFrame([{name: made.get(name) for name in names} for made in map(one, blocked, payloads)], columns=names)

    answers = asked.select(F.col("subject").alias("patient_id"), run.asNondeterministic()("blocked", "case").alias("a"))
    answers = store(answers, "answers")  # a model is asked once, however many results read its answers
    voices = answers.select(F.col("patient_id").alias("case_id"), F.explode("a.perspectives").alias("role", "view")).select("case_id", "role", F.size("view.claims").alias("n_claims"))
    said = answers.select(F.col("patient_id").alias("case_id"), F.posexplode("a.disagreements").alias("ord", "text"))
    kept = report.grounded(said, voices).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x.text).alias("kept"))
    joined = plain.join(answers, "patient_id", "left").join(kept.withColumnRenamed("case_id", "patient_id"), "patient_id", "left")
    used = F.col("a.error").isNull()
    or_plain = lambda name: F.when(used, F.coalesce(F.nullif(F.col(f"a.{name}"), F.lit("")), F.col(name))).otherwise(F.col(name))
    of_model = lambda name: F.when(used, F.col(f"a.{name}")).otherwise(F.col(name))
    return joined.withColumns({
        "chair_summary": or_plain("chair_summary"), "recommended_next_step": or_plain("recommended_next_step"), "perspectives": of_model("perspectives"), "claims": of_model("claims"), "open_questions": of_model("open_questions"),
        "disagreements": F.when(used, F.coalesce("kept", F.array().cast("array<string>"))).otherwise(F.col("disagreements")), "model_status": F.when(used, "used").otherwise("fallback"), "model_error": F.col("a.error"),
    }).drop("a", "kept")


def as_json(reports: DataFrame) -> DataFrame:
    """(patient_id, report): each report as a JSON text, as a sink takes it."""
    return reports.select("patient_id", F.to_json(F.struct(*reports.columns)).alias("report"))
