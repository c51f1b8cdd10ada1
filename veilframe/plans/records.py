"""Queries over the parts of ingest, retrieval, review and letters, with their SQL.

Documents stand for records, their source for the subject. Vaults, previews, letters and disagreements are made of the customers, whose
nation is the subject; conversations stand for streamed replies, and pages for scanned ones.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import body_date, fenced_json, filename_date, iso_date, subject_id, subject_scope, visible
from ..operators import declutter, dialogue, memory, report, residue, structure, vault
from ..sources import documents as sources
from ..sources import knowledge
from . import review

DAY, CREATED = "2026-07-10", "2026-07-10T00:00:00+00:00"
ROLES = ["internist", "neurologist"]
QUESTION = "the clinical guideline with report and les patients von der"
VAULT = "subject string, token string, kind string, idx int, value string, ord long"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir):
    path = F.concat(F.lit("patients/"), "source", F.lit("/documents/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("subject"), F.col("doc_id").alias("seq"), "doc_id", path.alias("path"), F.col("lang").alias("title"), "text")


def structure_prepass(spark, sf_dir):
    made = structure.structured(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda name: F.sha2(F.array_join(f"record.{name}", "\n"), 256).alias(f"{name}_sha256")
    return made.select("doc_id", *(F.size(f"record.{x}").cast("long").alias(f"n_{x}") for x in structure.LISTS), *map(listed, structure.LISTS))


def document_dates(spark, sf_dir):
    """Orders stand for letters: the date stands in the text, in the file's name, or nowhere."""
    day = F.date_format("o_orderdate", "d.M.yyyy")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Bericht vom "), day, F.lit(" und vom 31.02.2020"))).when(F.col("o_orderkey") % 3 == 1, "Befund vom 31.2.2020").otherwise("ohne Datum")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("scan-"), F.date_format("o_orderdate", "yyyy.MM-dd"))).otherwise("scan").alias("stem"), F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("2020-13-01").alias("given"))
    body, file, given = body_date(F.col("text")), filename_date(F.col("stem")), iso_date(F.col("given"))
    return rows.select("id", F.coalesce(given, body, file, F.lit(DAY)).alias("date"), F.when(given.isNotNull(), "model").when(body.isNotNull(), "document").when(file.isNotNull(), "filename").otherwise("ingest").alias("date_source"))


def _named(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumns({"date": F.lit(DAY), "topic": F.coalesce("title", F.lit("document")), "sender": F.lit("unknown-sender")})
    taken = rows.select("subject").distinct().withColumn("stem", F.lit(f"{DAY}_en_unknown-sender-2"))
    return structure.named(rows, taken)


def stored_names(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", "subject", "stem")


def stored_markdown(spark, sf_dir):
    made = structure.structured(_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("document")).alias("topic")))
    made = made.withColumns({"date": F.lit(DAY), "date_source": F.lit("ingest"), "sender": F.lit('a "sender"'), "accepted": F.array(F.lit("DOB"), F.lit("DOB"), F.lit("ADDR"))})
    return made.select("doc_id", F.sha2(structure.rendered("accepted"), 256).alias("markdown_sha256"))


def subject_ids(spark, sf_dir):
    raw = F.concat(F.lit(" -"), F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.lit("- "))
    return _table(spark, sf_dir, "customer").select("c_custkey", subject_id(raw).alias("subject"), subject_scope(subject_id(raw)).alias("scope"))


def name_slugs(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lit("[PATIENT_1] Ärztin")).when(F.col("p_partkey") % 7 == 1, "Frau Schmidt").when(F.col("p_partkey") % 7 == 2, "Größe & Übergabe").otherwise(F.col("p_type")).alias("raw"))
    return rows.select("p_partkey", structure.slug(F.col("raw"), "document").alias("slug"))


def list_parse(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.lit("meds").alias("list"), F.col("o_orderpriority").alias("item"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("place"))
    bodies = structure.list_text(structure.merge_lists(orders)).withColumn("body", F.concat(F.lit("# Medications\n\n"), "body", F.lit("\n- No structured entries yet.\n")))
    return bodies.select("subject", F.array_join(structure.list_items(F.col("body")), "|").alias("items"))


def _vault(spark, sf_dir):
    """Of each nation, the customers with an even key: every third one's name is another kind of value."""
    kind = F.when(F.col("c_custkey") % 3 == 0, "ADDR").otherwise("PATIENT")
    rows = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("subject"), kind.alias("kind"), F.col("c_custkey").cast("int").alias("idx"), F.col("c_name").alias("value"), F.col("c_custkey").alias("ord"))
    token = F.concat(F.lit("["), subject_scope(F.col("subject")), F.lit("_"), "kind", F.lit("_"), F.col("idx").cast("string"), F.lit("]"))
    return rows.select("subject", token.alias("token"), "kind", "idx", "value", "ord")


def vault_ledger(spark, sf_dir):
    return vault.ledger(_vault(spark, sf_dir)).select("subject", "n_tokens", F.sha2("ledger", 256).alias("ledger_sha256"))


def lowest_tokens(spark, sf_dir):
    return vault.lowest_token(_vault(spark, sf_dir), "PATIENT")


def _preview(spark, sf_dir):
    """A preview of all customers up to the 400th, numbered from scratch within a nation, unscoped."""
    rows = _table(spark, sf_dir, "customer").where("c_custkey <= 400").select(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("subject"), F.col("c_name").alias("value"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 3 == 0, "ADDR").otherwise("PATIENT").alias("kind"))
    return rows.select("subject", F.concat(F.lit("["), "kind", F.lit("_"), F.col("ord").cast("string"), F.lit("]")).alias("token"), "value", "ord")


def vault_reconcile(spark, sf_dir):
    made = vault.reconcile(_vault(spark, sf_dir), _preview(spark, sf_dir), subject_scope(F.col("subject")))
    return made.select("subject", "token", "new_token", "value")


def preview_documents(spark, sf_dir):
    """A preview text of each nation names all of its preview's tokens; moved onto the vault it names the vault's."""
    preview = _preview(spark, sf_dir)
    texts = preview.groupBy("subject").agg(F.concat(F.lit("Preview: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x.token), ", "), F.lit(" [7_PATIENT_1]")).alias("text"))
    rows, mapped = vault.merged(_vault(spark, sf_dir), preview, texts, subject_scope(F.col("subject")))
    added = rows.groupBy("subject").agg(F.count("*").alias("n_new"), F.max("ord").alias("last"))
    return mapped.join(added, "subject", "left").select("subject", F.sha2("text", 256).alias("text_sha256"), F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"), "last")


def vault_conflicts(spark, sf_dir):
    other = _vault(spark, sf_dir).withColumn("value", F.when(F.col("idx") % 5 == 0, F.lower("value")).otherwise(F.col("value")))
    return vault.conflicts(_vault(spark, sf_dir), other)


def _letters(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("subject"), F.when(F.col("n_nationkey") % 2 == 0, "paper").otherwise("email").alias("channel"), F.col("n_name").alias("sender"), *(F.lit("").alias(x) for x in ("recipient", "place", "subject_line", "body")))
    problems = nations.where("sender < 'M'").select("subject", F.concat(F.lit("- problem of "), "sender").alias("body"))
    return report.letters(nations, _vault(spark, sf_dir), problems, "10.07.2026")


def letter_drafts(spark, sf_dir):
    return _letters(spark, sf_dir).select("subject", F.sha2("draft", 256).alias("draft_sha256"))


def letters_rendered(spark, sf_dir):
    return vault.render(_letters(spark, sf_dir), _vault(spark, sf_dir)).select("subject", F.sha2("rendered", 256).alias("rendered_sha256"))


def grounded_disagreements(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer")
    said = customers.select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("ord"), F.concat(F.lower("c_mktsegment"), F.lit(" vs "), F.when(F.col("c_custkey") % 2 == 0, "BUILDING").otherwise("NOBODY"), F.lit(": differ")).alias("text"))
    voices = customers.groupBy(F.col("c_nationkey").alias("case_id"), F.col("c_mktsegment").alias("role")).agg(F.sum((F.col("c_acctbal") > 5000).cast("int")).alias("n_claims"))
    return report.grounded(said, voices)


def visible_replies(spark, sf_dir):
    text = F.concat(F.lit("<think>"), "text", F.lit("</think>\n```json\n{\"role\": \""), "role", F.lit("\"}\n```"), F.when(F.col("turn") % 3 == 0, "<reasoning>never closed").otherwise(""))
    shown = visible(text)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(shown, 256).alias("visible_sha256"), fenced_json(shown).alias("body"))


def index_stale(spark, sf_dir):
    documents = _records(spark, sf_dir).withColumn("ord", F.col("doc_id"))
    held = memory.index(documents.where("doc_id % 3 <> 0")).withColumn("source_sha256", F.when(F.col("ord") % 5 == 0, "changed").otherwise(F.col("source_sha256")))
    return memory.stale(held, documents).select("path")


def record_order(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("path", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("patients/"), "subject", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.col("path")))
    return memory.records(rows).select("subject", "path", "ord")


def subject_listing(spark, sf_dir):
    return memory.subjects(_records(spark, sf_dir))


def retrieved_texts(spark, sf_dir):
    documents = _records(spark, sf_dir).withColumn("ord", F.col("doc_id"))
    asked = documents.select("subject").distinct().withColumn("query", F.concat(F.lit(QUESTION + " "), "subject"))
    return review.retrieved(asked, documents).select("subject", F.col("rank").cast("long").alias("rank"), "path", "score", F.sha2("text", 256).alias("text_sha256"))


def _cases(spark, sf_dir):
    documents = _records(spark, sf_dir).withColumn("ord", F.col("doc_id"))
    cases = documents.groupBy("subject").agg(F.min("doc_id").alias("least")).select("subject", F.array(*map(F.lit, ROLES)).alias("roles"), F.when(F.col("least") % 2 == 0, "What next?").alias("question"))
    lists = documents.groupBy("subject").agg(F.min("doc_id").alias("least")).where("least % 2 = 1").select("subject", F.lit("problems").alias("list"), F.lit(1).cast("long").alias("ord"), F.concat(F.lit("problem "), F.col("least").cast("string")).alias("item"))
    return cases, documents, lists


def _shown(reports):
    return reports.select("patient_id", "chair_summary", F.array_join("claims", "|").alias("claims"), F.array_join("open_questions", "|").alias("open_questions"), F.array_join("disagreements", "|").alias("disagreements"), F.size("evidence_refs").cast("long").alias("n_refs"), F.element_at("evidence_refs", -1)["url"].alias("last_ref"), "recommended_next_step", "model_status")


def review_reports(spark, sf_dir):
    cases, documents, lists = _cases(spark, sf_dir)
    return _shown(review.reviewed(cases, documents, lists, CREATED))


def _model(system: str, case: str) -> str:
    """Stands for a model: it answers from the case alone, and fails for one subject in four."""
    known = json.loads(case)
    number = sum(map(ord, known["patient_id"]))
    if "chair" in system:
        if number % 4 == 1:
            return "no JSON"
        return "```json\n" + json.dumps({"chair_summary": f"{len(known['perspectives'])} views", "open_questions": [], "disagreements": ["internist vs neurologist: dose", "internist vs nobody: x"]}) + "\n```"
    return json.dumps({"claims": [f"{known['role']} read {len(known['patient_memory'])}"], "open_questions": []})


def review_by_model(spark, sf_dir):
    """The model's path with every residue rule but the report of digits left on: a subject whose best records hold residue falls back."""
    cases, documents, lists = _cases(spark, sf_dir)
    return _shown(review.reviewed(cases, documents, lists, CREATED, ask=_model, policy={name: "report" for name in fixed.POLICY if name != "EMAIL"}))


def guideline_links(spark, sf_dir):
    link = knowledge.guideline_link(F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", link["title"].alias("title"), link["url"].alias("url"))


def streamed_tool_calls(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    deltas = rows.select(F.col("conv_id").alias("reply_id"), F.col("turn").alias("ord"), (F.col("turn") % 2).alias("idx"), F.when(F.col("turn") < 3, F.concat(F.lit("call"), F.col("turn").cast("string"))).otherwise("").alias("id"), F.when(F.col("turn") < 3, F.col("role")).alias("name"), F.substring("text", 1, 20).alias("arguments"))
    return dialogue.tool_calls(deltas)


def streamed_text(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "response.output_text.delta").when(F.col("turn") > 5, "response.completed").otherwise("response.other")
    events = rows.select(F.col("conv_id").alias("reply_id"), F.col("turn").alias("ord"), kind.alias("type"), F.substring("text", 1, 30).alias("delta"), F.when(F.col("turn") == 4, F.concat(F.lit("error "), "role")).alias("error"))
    return dialogue.joined_deltas(events).select("reply_id", F.sha2("content", 256).alias("content_sha256"), "completed", "error")


def responses_requests(spark, sf_dir):
    made = dialogue.responses_input(_table(spark, sf_dir, "conversations"))
    return made.select("conv_id", F.sha2("instructions", 256).alias("instructions_sha256"), F.size("input").cast("long").alias("n_input"), F.sha2(F.array_join(F.transform("input", lambda t: F.concat(t.role, F.lit("\t"), t.content)), "\n"), 256).alias("input_sha256"))


def scanned_pages(spark, sf_dir):
    """Every third page has a weak text layer that recognition replaces, every sixth stays weak."""
    pages = _table(spark, sf_dir, "pages").where("trim(html) <> ''").select((F.col("page_id") % 20).cast("string").alias("path"), F.col("page_id").alias("page"), F.when(F.col("page_id") % 3 == 0, " a b ").otherwise(F.col("html")).alias("text"), "html")
    ocr = pages.where("page % 3 = 0").select("path", "page", F.when(F.col("page") % 6 == 0, "short").otherwise(F.col("html")).alias("text"))
    made = sources.assembled(sources.with_ocr(pages.drop("html"), ocr))
    return made.select("path", F.sha2("text", 256).alias("text_sha256"), *(F.array_join(f"stats.{x}", ",").alias(x) for x in ("text_layer_pages", "ocr_pages", "suspicious_pages")))


def dropped_lines(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", F.lit("Seite 1 von 3"), F.concat(F.lit("IBAN "), F.col("doc_id").cast("string")), F.lit("www.example.org")).alias("text"))
    return declutter.statistics(rows)


def residue_report(spark, sf_dir):
    """The gate itself, with all its rules, exemptions and neighbouring lines."""
    return residue.report(_table(spark, sf_dir, "documents").select("doc_id", "text"), {"DIGIT_RUN": "report"})


QUERIES = {
    f.__name__: f
    for f in (
        structure_prepass, document_dates, stored_names, stored_markdown, subject_ids, name_slugs, list_parse, vault_ledger, lowest_tokens, vault_reconcile, preview_documents, vault_conflicts, letter_drafts, letters_rendered,
        grounded_disagreements, visible_replies, index_stale, record_order, subject_listing, retrieved_texts, review_reports, review_by_model, guideline_links, streamed_tool_calls, streamed_text, responses_requests,
        scanned_pages, dropped_lines, residue_report,
    )
}

_STRIP = r"regexp_replace({}, '^[\s\x0b\x{{85}}\x{{a0}}]+|[\s\x0b\x{{85}}\x{{a0}}]+$', '', 'g')"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"(select doc_id, case when s[-1] = '' then s[:-2] else s end as lines from (select doc_id, string_split_regex(coalesce(text, ''), '{_LINE_END}') as s from documents))"
_DATES = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b"
_FOUND = {"timeline": f"regexp_matches(x, '{_DATES}')", "problems": "starts_with(lower(x), 'problem:')", "meds": f"regexp_matches(x, '(?i){fixed.MED_LINE[0]}')", "labs": f"regexp_matches(x, '(?i){fixed.LAB_LINE[0]}')"}
_PREPASS = ", ".join(f"list_filter(l, lambda x: {test}) as {name}" for name, test in _FOUND.items())
_RECORDS = "(select source as subject, doc_id, 'patients/' || source || '/documents/' || doc_id || '.md' as path, coalesce(lang, 'document') as topic, text from documents)"
_VAULT = "(select 'p' || c_nationkey as subject, if(c_custkey % 3 = 0, 'ADDR', 'PATIENT') as kind, c_custkey as idx, c_name as value, '[' || c_nationkey || '_' || if(c_custkey % 3 = 0, 'ADDR', 'PATIENT') || '_' || c_custkey || ']' as token from customer where c_custkey % 2 = 0)"
_MAPPED = f"""
    preview as (select 'p' || c_nationkey as subject, if(c_custkey % 3 = 0, 'ADDR', 'PATIENT') as kind, c_custkey as ord, c_name as value, '[' || if(c_custkey % 3 = 0, 'ADDR', 'PATIENT') || '_' || c_custkey || ']' as token from customer where c_custkey <= 400),
    lasts as (select subject, kind, max(idx) as last from {_VAULT} group by all),
    mapped as (
        select p.subject, p.token, p.value, p.ord, v.token is not null as known,
               coalesce(v.token, '[' || substr(p.subject, 2) || '_' || p.kind || '_' || (coalesce(last, 0) + row_number() over (partition by p.subject, p.kind, v.token is null order by p.ord)) || ']') as new_token
        from preview p left join {_VAULT} v on v.subject = p.subject and v.kind = p.kind and v.value = p.value left join lasts l on l.subject = p.subject and l.kind = p.kind)"""


def _filled(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_PATIENT = "coalesce((select arg_min(token, idx) from V v where v.subject = n.subject and kind = 'PATIENT'), '[PATIENT_1]')".replace("V", _VAULT, 1)
_BODY = "trim(" + _filled(fixed.LETTER_BODY, patient="patient", problems="if(n_name < 'M', '- problem of ' || n_name, '')") + ")"
_LETTER = {k: _filled(t, sender="n_name", recipient="'[EMPFÄNGER]'", place="'[ORT]'", date="'10.07.2026'", subject=_filled(fixed.LETTER_SUBJECT, patient="patient"), body=_BODY) for k, t in fixed.LETTERS.items()}
_DRAFTS = f"(select subject, if(n_nationkey % 2 = 0, {_LETTER['paper']}, {_LETTER['email']}) as draft from (select n.*, {_PATIENT} as patient from (select 'p' || n_nationkey as subject, * from nation) n))"
_SLOT = "cast(('0x' || right(sha1({}), 2))::integer % 128 as integer)"
_TERMS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}_-]+')"
_FOCUS = {"internist": report.ROLE_FOCUS["internist"], "neurologist": report.ROLE_FOCUS["neurologist"]}
_CLAIMS = " || '|' || ".join(f"'{role}: review ' || subject || ' for {focus}.'" for role, focus in _FOCUS.items())
_RETRIEVED = f"""
    hist as (select subject, path, doc_id, {_SLOT.format('term')} as slot, count(*) as n from (select subject, path, doc_id, unnest({_TERMS.format('path || chr(10) || text')}) as term from {_RECORDS}) group by all),
    wanted as (select subject, {_SLOT.format('term')} as slot, count(*) as m from (select subject, unnest({_TERMS.format('q')}) as term from asked) group by all),
    norms as (select subject, sqrt(sum(m * m)) as norm from wanted group by 1),
    scored as (select h.subject, path, doc_id, round(coalesce(sum(n * coalesce(m, 0)) / (sqrt(sum(n * n)) * any_value(norm)), 0), 9) as score from hist h left join wanted w on h.subject = w.subject and h.slot = w.slot join norms on norms.subject = h.subject group by all),
    best as (select *, row_number() over (partition by subject order by score desc, doc_id) as rank from scored qualify rank <= 5)"""
_CASES = "cases as (select source as subject, min(doc_id) as least, count(*) as n, min(doc_id) % 2 = 1 as listed, max('patients/' || source || '/documents/' || doc_id || '.md') as last_path from documents group by 1)"

# The residue rules without lookaround. A word after a title is taken out and judged by itself; TOWN's and the street's optional parts do not matter for whether there is a match.
_TITLE = r"(?:\b(?:Dr|Prof|DR|PROF)\.?|\b(?:Chefarzt|Chefärztin|Oberarzt|Oberärztin|Assistenzarzt|Assistenzärztin|Frau|FRAU|Herrn?|HERRN?)|\b(?i:geehrte[rs]?)|(?:\bFr|\bHr|\bgez)\.)(?:[ \t]+(?i:med)\.?)?[ \t]+"
_TITLED = rf"len(list_filter(regexp_extract_all(x, '{_TITLE}([A-ZÄÖÜ][a-zäöüß]{{2,}}[\p{{L}}\p{{N}}_]*|[A-ZÄÖÜ]{{3,}}[\p{{L}}\p{{N}}_]*)', 1), lambda w: not regexp_matches(w, '(?i)^(?:Dr|Prof|Professor(?:in)?|med|Frau|Herrn?|Kollegin(?:nen)?|Kollegen?|Doktor|Damen|Herren)$|(?:logie|iatrie|medizin|heilkunde|chirurgie|therapie)$'))) > 0"
_PLAIN = {name: f"regexp_matches(x, '{('(?i)' if 'i' in flags else '') + pattern}')" for name, (pattern, flags) in fixed.RESIDUE.items() if name not in ("PLZ_CITY", "EMAIL", "DIGIT_RUN", "NAME_CUE")}
_AROUND = "array_to_string(lines[greatest(n - 4, 1):n + 4], chr(10))"
_INSTITUTIONAL = rf"(not exists_recipient and (regexp_matches(x, '{fixed.LETTERHEAD[0]}') or (not regexp_matches({_AROUND}, '(?i){fixed.PRIVATE[0]}') and regexp_matches({_AROUND}, '(?i){fixed.INSTITUTION[0]}'))))"
_RULES = _PLAIN | {
    "PLZ_CITY": rf"regexp_matches(x, '\b\d{{2}}[ \t]?\d{{3}}[ \t]+[A-ZÄÖÜ][A-Za-zÄÖÜäöüß.-]')", "EMAIL": r"regexp_matches(x, '[\p{L}\p{M}\p{N}_]@[\p{L}\p{M}\p{N}_]')",
    "DIGIT_RUN": rf"regexp_matches(x, '(?:^|[^0-9])[0-9]{{6,}}(?:[^0-9]|$)') and not (regexp_matches(x, '(?i){fixed.CONTACT_OR_NUMBER[0]}') and {_INSTITUTIONAL})", "NAME_CUE": _TITLED,
    "DOB_MARKER": rf"regexp_matches(x, '(?i){fixed.BIRTH_MARKER[0]}') and not regexp_matches(regexp_extract(x, '(?i)(?:{fixed.BIRTH_MARKER[0]})(.{{0,24}})', 1), '(?i)\bage\s+\d+\b')",
}
_RULES |= {name: f"{_RULES[name]} and not {_INSTITUTIONAL}" for name in fixed.EXEMPT_BY_PLACE}
RESIDUE_SQL = f"""
    split as {_LINES},
    numbered as (select doc_id, lines, unnest(lines) as x, generate_subscripts(lines, 1) as n from split),
    placed as (select *, len(list_filter(lines[greatest(n - 3, 1):n - 1], lambda y: regexp_matches(y, '(?i){fixed.RECIPIENT[0]}'))) > 0 as exists_recipient from numbered),
    hit as (select doc_id, n, unnest(list_filter([{', '.join(f"if({test}, '{name}', null)" for name, test in _RULES.items())}], lambda p: p is not null)) as pattern from placed
            union all select doc_id, 1, 'CORRUPTED_TOKEN' from documents where len(coalesce(text, '')) - len(replace(coalesce(text, ''), '[', '')) <> len(coalesce(text, '')) - len(replace(coalesce(text, ''), ']', '')))"""

ORACLES = {
    "structure_prepass": f"""
        with trimmed as (select doc_id, list_filter(list_transform(lines, lambda x: {_STRIP.format('x')}), lambda x: x <> '') as l from {_LINES}),
        made as (select doc_id, {_PREPASS} from trimmed)
        select doc_id, {', '.join(f'cast(len({x}) as bigint) as n_{x}' for x in structure.LISTS)},
               {', '.join(f"sha256(array_to_string({'list_transform(problems, lambda x: trim(substr(x, 9)))' if x == 'problems' else x}, chr(10))) as {x}_sha256" for x in structure.LISTS)} from made""",
    "document_dates": f"""
        with rows as (
            select o_orderkey as id, o_orderkey % 3 = 0 as body, o_orderkey % 2 = 0 as file, o_orderkey % 5 = 0 as given, strftime(o_orderdate, '%Y-%m-%d') as day from orders)
        select id, if(given or body or file, day, '{DAY}') as date, case when given then 'model' when body then 'document' when file then 'filename' else 'ingest' end as date_source from rows""",
    "stored_names": f"""
        with rows as (select doc_id, subject, topic, '{DAY}_' || topic || '_unknown-sender' as base, row_number() over (partition by subject, topic order by doc_id) as k from {_RECORDS}),
        moved as (select *, if(topic = 'en' and k >= 2, k + 1, k) as j from rows)
        select doc_id, subject, if(j = 1, base, base || '-' || j) as stem from moved""",
    "stored_markdown": f"""
        with found as (select doc_id, coalesce(text, '') as text, coalesce(lang, 'document') as topic from documents)
        select doc_id, sha256('---' || chr(10) || 'document_date: "{DAY}"' || chr(10) || 'examination_date: "{DAY}"' || chr(10) || 'date_source: "ingest"' || chr(10) || 'doc_type: "sonstiges"' || chr(10) || 'specialty: ""' || chr(10) || 'institution: ""' || chr(10)
               || 'examiner: ""' || chr(10) || 'topic: "' || topic || '"' || chr(10) || 'sender: "a \\"sender\\""' || chr(10) || 'summary: ""' || chr(10) || 'accepted_residue: ["ADDR", "DOB"]' || chr(10) || '---' || chr(10) || chr(10) || '# sonstiges — {DAY}'
               || chr(10) || chr(10) || '## Originaltext (bereinigt)' || chr(10) || chr(10) || {_STRIP.format('text')} || chr(10)) as markdown_sha256 from found""",
    "subject_ids": r"select c_custkey, s as subject, nullif(regexp_extract(s, '\d+'), '') as scope from (select c_custkey, regexp_replace(regexp_replace(trim(' -' || c_name || ' / ' || c_mktsegment || '- '), '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') as s from customer)",
    "name_slugs": "select p_partkey, case when p_partkey % 7 < 2 then 'document' when p_partkey % 7 = 2 then 'Groesse-Uebergabe' else regexp_replace(p_type, '[^A-Za-z0-9]+', '-', 'g') end as slug from part",
    "list_parse": "select cast(o_custkey as varchar) as subject, string_agg(o_orderpriority, '|' order by k) as items from (select o_custkey, o_orderpriority, min(o_orderkey) as k from orders group by all) group by 1",
    "vault_ledger": f"""
        with parts as (
            select subject, kind, count(*) as n, string_agg('| `' || token || '` | ' || replace(value, '|', '\\|') || ' |', chr(10) order by idx) as body from {_VAULT} group by all),
        sections as (select subject, kind, n, chr(10) || '## ' || kind || chr(10) || chr(10) || '| Token | Klartext |' || chr(10) || '| --- | --- |' || chr(10) || body as body from parts),
        whole as (select subject, cast(sum(n) as bigint) as n_tokens, string_agg(body, chr(10) order by kind desc) as body from sections group by subject)
        select subject, n_tokens, sha256('# Token-Register — ' || subject || chr(10) || chr(10) || 'Token → Klartext für alle Dokumente dieses Patienten (' || n_tokens || ' Tokens).' || chr(10)
               || 'Nur lokal, außerhalb der indizierten Akte. Nach jedem Ingest aktualisiert.' || chr(10) || body || chr(10)) as ledger_sha256 from whole""",
    "lowest_tokens": f"select subject, arg_min(token, idx) as token from {_VAULT} where kind = 'PATIENT' group by subject",
    "vault_reconcile": f"with {_MAPPED} select subject, token, new_token, value from mapped",
    "preview_documents": f"""
        with {_MAPPED}, vaults as (select subject, max(idx) as last from {_VAULT} group by 1)
        select subject, sha256('Preview: ' || string_agg(new_token, ', ' order by ord) || ' [7_PATIENT_1]') as text_sha256, count(*) filter (where not known) as n_new,
               if(n_new > 0, coalesce(any_value(last), 0) + n_new, null) as last
        from mapped left join vaults using (subject) group by subject""",
    "vault_conflicts": f"select subject, token from {_VAULT} where idx % 5 = 0 and value <> lower(value)",
    "letter_drafts": f"select subject, sha256(draft) as draft_sha256 from {_DRAFTS}",
    "letters_rendered": f"""
        with named as (select subject, arg_min(token, idx) as token, arg_min(value, idx) as value from {_VAULT} where kind = 'PATIENT' group by 1)
        select subject, sha256(if(token is null, draft, replace(draft, token, value))) as rendered_sha256 from {_DRAFTS} left join named using (subject)""",
    "grounded_disagreements": """
        with voices as (select c_nationkey as case_id, c_mktsegment as role from customer group by all having count(*) filter (where c_acctbal > 5000) > 0),
        said as (select c_nationkey as case_id, c_custkey as ord, c_mktsegment as a, if(c_custkey % 2 = 0, 'BUILDING', 'NOBODY') as b, lower(c_mktsegment) || ' vs ' || b || ': differ' as text from customer)
        select case_id, ord, text from said where a <> b and exists (from voices v where v.case_id = said.case_id and role = a) and exists (from voices v where v.case_id = said.case_id and role = b)""",
    "visible_replies": """
        select conv_id, turn, sha256('```json' || chr(10) || body || chr(10) || '```') as visible_sha256, body from (select conv_id, turn, '{"role": "' || role || '"}' as body from conversations where text is not null and role is not null)
        union all select conv_id, turn, sha256(''), '' from conversations where text is null or role is null""",
    "index_stale": f"select path from {_RECORDS} where doc_id % 3 = 0 or doc_id % 5 = 0",
    "record_order": """
        with rows as (select source as subject, if(doc_id % 4 = 0, 'patients/' || source || '/n' || doc_id || '.md', 'patients/' || source || '/documents/' || doc_id || '.md') as path from documents)
        select subject, path, row_number() over (partition by subject order by len(string_split(path, '/')), path) as ord from rows""",
    "subject_listing": "select distinct source as subject from documents",
    "retrieved_texts": f"with asked as (select distinct source as subject, '{QUESTION} ' || source as q from documents), {_RETRIEVED} select subject, rank, path, score, sha256(text) as text_sha256 from best join {_RECORDS} using (subject, path)",
    "review_reports": f"""
        with {_CASES}
        select subject as patient_id, 'Chair synthesis required across: internist, neurologist.' as chair_summary, {_CLAIMS} as claims, if(least % 2 = 0, 'What next?', '{report.CASE_QUESTION}') as open_questions, '' as disagreements,
               cast(n + if(listed, 1, 0) as bigint) as n_refs, if(listed, 'problems.md', last_path) as last_ref, '{report.NEXT_STEP}' as recommended_next_step, 'not_used' as model_status from cases""",
    "review_by_model": f"""
        with {_CASES}, asked as (select subject, if(least % 2 = 0, 'What next?', 'problem ' || least) as q from cases), {_RETRIEVED},
        read as (select subject, count(*) as n_read, bool_or(regexp_matches(text, '{r"[\p{L}\p{M}\p{N}_]@[\p{L}\p{M}\p{N}_]"}')) as blocked from best join {_RECORDS} using (subject, path) group by 1),
        judged as (select cases.*, n_read, coalesce(blocked, false) or list_sum(list_transform(string_split(subject, ''), lambda c: ascii(c))) % 4 = 1 as failed from cases left join read using (subject))
        select subject as patient_id, if(failed, 'Chair synthesis required across: internist, neurologist.', '2 views') as chair_summary, if(failed, {_CLAIMS}, 'internist read ' || n_read || '|neurologist read ' || n_read) as claims,
               if(failed, if(least % 2 = 0, 'What next?', '{report.CASE_QUESTION}'), '') as open_questions, if(failed, '', 'internist vs neurologist: dose') as disagreements,
               cast(n + if(listed, 1, 0) as bigint) as n_refs, if(listed, 'problems.md', last_path) as last_ref, '{report.NEXT_STEP}' as recommended_next_step, if(failed, 'fallback', 'used') as model_status from judged""",
    "guideline_links": f"select p_partkey, 'AWMF guideline search: ' || p_name as title, '{knowledge.AWMF}' || replace(url_encode(p_name), '%20', '+') as url from part",
    "streamed_tool_calls": """
        select conv_id as reply_id, turn % 2 as idx, arg_max('call' || turn, turn) filter (where turn < 3) as id, coalesce(string_agg(role, '' order by turn) filter (where turn < 3), '') as name, coalesce(string_agg(substr(text, 1, 20), '' order by turn), '') as arguments
        from conversations group by all""",
    "streamed_text": """
        select conv_id as reply_id, sha256(coalesce(string_agg(substr(text, 1, 30), '' order by turn) filter (where role = 'user'), '')) as content_sha256, bool_or(coalesce(role, '') <> 'user' and turn > 5) as completed,
               arg_min('error ' || role, turn) filter (where turn = 4) as error from conversations group by 1""",
    "responses_requests": """
        select conv_id, sha256(coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) filter (where role = 'system'), '')) as instructions_sha256, count(*) filter (where coalesce(role, 'user') <> 'system') as n_input,
               sha256(coalesce(string_agg(coalesce(role, 'user') || chr(9) || coalesce(text, ''), chr(10) order by turn) filter (where coalesce(role, 'user') <> 'system'), '')) as input_sha256 from conversations group by 1""",
    "scanned_pages": f"""
        with read as (select cast(page_id % 20 as varchar) as path, page_id as page, case when page_id % 6 = 0 then 'short' else html end as text, if(page_id % 3 = 0 or len(regexp_replace(html, '{r"[\s\x0b\x{85}\x{a0}]+"}', '', 'g')) < 12, 'ocr', 'text_layer') as method from pages where trim(html) <> ''),
        judged as (select *, len(regexp_replace(text, '{r"[\s\x0b\x{85}\x{a0}]+"}', '', 'g')) < 12 as weak from read)
        select path, sha256(string_agg({_STRIP.format('text')}, chr(10) || chr(10) order by page)) as text_sha256, coalesce(string_agg(page, ',' order by page) filter (where method = 'text_layer'), '') as text_layer_pages,
               coalesce(string_agg(page, ',' order by page) filter (where method = 'ocr'), '') as ocr_pages, coalesce(string_agg(page, ',' order by page) filter (where weak), '') as suspicious_pages from judged group by path""",
    "residue_policy_summary": f"""
        with {RESIDUE_SQL},
        policy as (select unnest([{', '.join(f"'{name}'" for name in fixed.POLICY)}]) as pattern)
        select pattern, if(pattern = 'DIGIT_RUN', 'report', 'block') as action, count(n) as n_hits, count(distinct doc_id) as n_docs from policy left join hit using (pattern) group by pattern""",
    "residue_report": f"with {RESIDUE_SQL} select doc_id, cast(n as integer) as line, pattern, if(pattern = 'DIGIT_RUN', 'report', 'block') as action from hit",
}
