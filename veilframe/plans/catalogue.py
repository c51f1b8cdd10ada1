"""Queries by name over the test tables, and the SQL that DuckDB runs for the same result.

Documents stand for records, their source for the subject and doc_id for the order. Some queries are analogues on
relational tables (timeline_merge, monitor, inbox_pending, vector_topk_scoped); they exercise the same operators.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import chunks, has, lines, summary
from ..operators import declutter, deid, dialogue, egress, memory, report, residue, structure, vault
from ..sources.documents import pending
from ..sources.scratch import store
from . import records

TODAY = datetime.date(2026, 7, 10)
MOST_PASSAGES, MOST_PASSAGE_BYTES = 5000, 32 << 20
QUESTION = "the clinical guideline with report and les patients von der"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("source").alias("subject"), F.col("doc_id").alias("seq"), "doc_id", "text")


def declutter_line_profile(spark, sf_dir):
    return declutter.line_profile(_table(spark, sf_dir, "documents"))


def declutter_text_hash(spark, sf_dir):
    return declutter.declutter(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def _lines_hit(spark, sf_dir, pattern):
    found = F.filter(lines(F.coalesce("text", F.lit(""))), lambda x: has(x, pattern))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n_lines")).where("n_lines > 0")


def residue_digit_run(spark, sf_dir):
    return _lines_hit(spark, sf_dir, fixed.RESIDUE["DIGIT_RUN"])


def residue_email(spark, sf_dir):
    return _lines_hit(spark, sf_dir, fixed.RESIDUE["EMAIL"])


def residue_phone_shape(spark, sf_dir):
    return _lines_hit(spark, sf_dir, (fixed.FIELDS[-1][1], ""))


def residue_policy_summary(spark, sf_dir):
    return residue.policy_summary(_table(spark, sf_dir, "documents"), {"DIGIT_RUN": "report"})


def doc_index(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", summary(text).alias("summary"), F.sha2(text, 256).alias("source_sha256"))


def token_hist(spark, sf_dir):
    return memory.histogram(_table(spark, sf_dir, "documents"), "doc_id")


def memory_search(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    scored = memory.scores(memory.histogram(documents, "doc_id"), "doc_id", QUESTION).withColumn("score", F.round("score", 9))
    best = memory.top_per_scope(documents.select("doc_id", "source").join(scored, "doc_id"), "source", "doc_id")
    return best.select("source", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def vector_topk_scoped(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))  # one query per scope
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = vectors.join(F.broadcast(asked), "label").select("label", "vec_id", F.round(dot, 9).alias("score"))
    return memory.top_per_scope(scored, "label", "vec_id").select("label", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


def chunk_windows(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk", "piece"))
    return rows.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("piece").cast("long").alias("n_chars"), F.sha2("piece", 256).alias("piece_sha256"))


def egress_guard(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", egress.verdict(F.coalesce("text", F.lit("")), strict=False).alias("verdict"))


def known_passage_sweep(spark, sf_dir):
    """Documents that hold a test passage of 24 characters or more verbatim."""
    passages = _table(spark, sf_dir, "benchmark").where("length(text) >= 24").select("item_id", F.col("text").alias("passage"))
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    passages = passages.groupBy("item_id", "passage").agg(F.count("*").alias("n"))
    size = passages.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("bytes")).first()
    # Blocks of bounded lists: each document tests a block within a row, so no pair is a row unless it matches.
    blocks = max(1, -(-size["rows"] // MOST_PASSAGES), -(-size["bytes"] // MOST_PASSAGE_BYTES))
    listed = passages.groupBy(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "passage", "n")).alias("passages")).drop("block")
    # One block is small enough to broadcast; more of them meet the documents in a plain cross join.
    found = documents.crossJoin(F.broadcast(listed) if blocks == 1 else listed).select("doc_id", F.explode(F.filter("passages", lambda p: F.col("text").contains(p.passage))).alias("p"))
    return found.select("doc_id", F.col("p.item_id").alias("item_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.n")))).drop("col")


def prompt_fold(spark, sf_dir):
    folded = dialogue.prompt_fold(_table(spark, sf_dir, "conversations"))
    return folded.select("conv_id", F.sha2("system", 256).alias("system_sha256"), F.sha2("prompt", 256).alias("prompt_sha256"))


def request_metrics(spark, sf_dir):
    return dialogue.request_metrics(_table(spark, sf_dir, "conversations"))


def inbox_pending(spark, sf_dir):
    names = _table(spark, sf_dir, "documents").select(F.concat(F.lit("letter "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".docx").otherwise(".TXT")).alias("name"))
    previews = _table(spark, sf_dir, "labels").select(F.concat(F.lit("letter-"), F.col("doc_id").cast("string")).alias("stem"))
    return pending(names, previews)


def _orders(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders")
    return rows.select(F.col("o_custkey").cast("string").alias("subject"), F.lit("timeline").alias("list"), F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority").alias("item"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("place"))


def timeline_merge(spark, sf_dir):
    return structure.merge_lists(_orders(spark, sf_dir)).select("subject", "ord", "item")


def monitor(spark, sf_dir):
    body = structure.list_text(structure.merge_lists(_orders(spark, sf_dir)))
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject"))
    return report.monitor(asked, body).withColumn("latest_timeline", F.sha2("latest_timeline", 256))


def _rewritten(spark, sf_dir):
    return deid.deidentify(_records(spark, sf_dir), today=TODAY)


def deid_tokens(spark, sf_dir):
    """Parity reading of the residence label: it begins at any word in wh, so many lines of English prose become one token."""
    made = _rewritten(spark, sf_dir)
    return made.select("doc_id", F.size("new_tokens").cast("long").alias("n_new_tokens"), F.size("rejected").cast("long").alias("n_rejected"), F.sha2("text", 256).alias("text_sha256"))


def deid_vault(spark, sf_dir):
    return vault.entries(_rewritten(spark, sf_dir)).select("subject", "token", "kind", "idx", F.sha2("value", 256).alias("value_sha256"), "ord")


def deid_ledger(spark, sf_dir):
    made = vault.ledger(vault.entries(_rewritten(spark, sf_dir)))
    return made.select("subject", "n_tokens", F.sha2("ledger", 256).alias("ledger_sha256"))


def deid_leak_check(spark, sf_dir):
    made = store(_rewritten(spark, sf_dir).select("subject", "seq", "doc_id", "text", "new_tokens"), "rewritten")
    return vault.leak_counts(vault.entries(made), made).agg(F.sum("n_leaks").alias("n_leaks"), F.sum((F.col("n_leaks") > 0).cast("long")).alias("n_documents"))


QUERIES = {
    f.__name__: f
    for f in (
        declutter_line_profile, declutter_text_hash, residue_digit_run, residue_email, residue_phone_shape, residue_policy_summary, doc_index, token_hist, memory_search, vector_topk_scoped, chunk_windows,
        egress_guard, known_passage_sweep, prompt_fold, request_metrics, inbox_pending, timeline_merge, monitor, deid_tokens, deid_vault, deid_ledger, deid_leak_check,
    )
} | records.QUERIES

_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"(select doc_id, case when s[-1] = '' then s[:-2] else s end as lines from (select doc_id, string_split_regex(coalesce(text, ''), '{_LINE_END}') as s from documents))"
_CONTACT = r"(?i)www\.|https?://|\bTel(?:efon)?\.?\s*:?\s*\+?\d|\bFax\.?\s*:?\s*\+?[\d\[]|@"
_REGISTRY = fixed.REGISTRY[0]
_JUDGED = rf"""
    with split as {_LINES},
    numbered as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as n from split),
    clean as (select *, regexp_replace(line, '^[\s\x0b\x{{85}}\x{{a0}}]+|[\s\x0b\x{{85}}\x{{a0}}]+$', '', 'g') as c from numbered),
    marked as (select *, len(c) > 12 and count(*) over (partition by doc_id, c) >= 3 as again, regexp_matches(c, '{_CONTACT}') as contact from clean),
    judged as (
        select *, case
            when c = '' then null
            when regexp_matches(c, '(?i)^\s*Seite\s+\d+\s*(?:von|/)\s*\d+\b') then 'page'
            when regexp_matches(c, '(?i){_REGISTRY}') then 'reqs'
            when contact and len(regexp_extract_all(regexp_replace(c, 'www\.\S+|https?://\S+|\S+@\S+', '', 'g'), '[A-Za-zÄÖÜäöüß]{{4,}}')) < 3 then 'contact'
            when again and (contact or regexp_matches(c, '(?i)\b\d{{5}}\s+[A-ZÄÖÜ]|\bPostfach\b|stra[sß]e\s+\d+')) then 'repeat' end as reason
        from marked)
"""
_ENDED = "documents as (select doc_id, concat_ws(chr(10), text, 'Seite 1 von 3', 'IBAN ' || doc_id, 'www.example.org') as text from documents), "
_COUNT = "cast(count(*) filter (where {}) as bigint)"
_DIGITS, _MAIL_SIGN = r"(?:^|[^0-9])[0-9]{6,}(?:[^0-9]|$)", r"[\p{L}\p{M}\p{N}_]@[\p{L}\p{M}\p{N}_]"


def _hit_lines(pattern: str) -> str:
    return f"select doc_id, cast(len(list_filter(lines, lambda x: regexp_matches(x, '{pattern}'))) as bigint) as n_lines from {_LINES} where len(list_filter(lines, lambda x: regexp_matches(x, '{pattern}'))) > 0"


_TERMS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}_-]+')"
_SLOT = "cast(('0x' || right(sha1({}), 2))::integer % 128 as integer)"
_HIST = f"(select doc_id, {_SLOT.format('term')} as slot, count(*) as n from (select doc_id, unnest({_TERMS.format('text')}) as term from documents) group by all)"

ORACLES = records.ORACLES | {
    "dropped_lines": f"with {_ENDED}{_JUDGED.strip().removeprefix('with ')} select doc_id, reason, count(*) as n from judged where reason is not null group by all",
    "declutter_line_profile": f"""{_JUDGED}
        select documents.doc_id, {_COUNT.format('n is not null')} as n_lines, {_COUNT.format('again')} as n_repeated, {_COUNT.format('contact')} as n_contact_like, {_COUNT.format('n is not null and reason is null')} as n_kept,
               {', '.join(_COUNT.format(f"reason = '{r}'") + f' as n_{r}' for r in declutter.REASONS)}
        from documents left join judged using (doc_id) group by documents.doc_id""",
    "declutter_text_hash": rf"""{_JUDGED},
        kept as (select doc_id, string_agg(line, chr(10) order by n) filter (where reason is null) as t from judged group by doc_id)
        select documents.doc_id, sha256(regexp_replace(regexp_replace(coalesce(t, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x0b\x{{85}}\x{{a0}}]+|[\s\x0b\x{{85}}\x{{a0}}]+$', '', 'g') || chr(10)) as text_sha256
        from documents left join kept using (doc_id)""",
    "residue_digit_run": _hit_lines(_DIGITS),
    "residue_email": _hit_lines(_MAIL_SIGN),
    "doc_index": r"select doc_id, substr(trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x{85}\x{a0}]+', ' ', 'g')), 1, 240) as summary, sha256(coalesce(text, '')) as source_sha256 from documents",
    "token_hist": f"select doc_id, slot, n from {_HIST}",
    "memory_search": f"""
        with wanted as (select {_SLOT.format('term')} as slot, count(*) as m from (select unnest({_TERMS.format(f"'{QUESTION}'")}) as term) group by 1),
        scored as (select doc_id, round(coalesce(sum(n * coalesce(m, 0)) / (sqrt(sum(n * n)) * (select sqrt(sum(m * m)) from wanted)), 0), 9) as score from {_HIST} h left join wanted using (slot) group by doc_id)
        select source, rank, doc_id, score from (select source, doc_id, score, row_number() over (partition by source order by score desc, doc_id) as rank from scored join documents using (doc_id)) where rank <= 5""",
    "vector_topk_scoped": """
        with asked as (select label, arg_min(embedding, vec_id) as q from embeddings group by label),
        scored as (select label, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: cast(p[1] as double) * cast(p[2] as double))), 9) as score from embeddings join asked using (label))
        select label, rank, vec_id, score from (select *, row_number() over (partition by label order by score desc, vec_id) as rank from scored) where rank <= 5""",
    "chunk_windows": """
        with starts as (select doc_id, text, unnest(range(0, greatest(cast(ceil((len(text) - 900) / 750.0) as bigint), 0) + 1)) as chunk from documents where len(text) > 0)
        select doc_id, chunk, cast(len(substr(text, chunk * 750 + 1, 900)) as bigint) as n_chars, sha256(substr(text, chunk * 750 + 1, 900)) as piece_sha256 from starts""",
    "known_passage_sweep": "select doc_id, item_id from documents, benchmark where len(benchmark.text) >= 24 and contains(documents.text, benchmark.text)",
    "prompt_fold": """
        select conv_id, sha256(coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) filter (where role = 'system'), '')) as system_sha256,
               sha256(coalesce(string_agg(upper(coalesce(role, 'user')) || ':' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn) filter (where coalesce(role, 'user') <> 'system'), '')) as prompt_sha256
        from conversations group by conv_id""",
    "request_metrics": """
        select conv_id, count(*) as message_count, cast(sum(len(coalesce(text, ''))) as bigint) as message_chars, cast(sum(if(role = 'system', len(coalesce(text, '')), 0)) as bigint) as system_chars,
               cast(sum(len(coalesce(text, ''))) // 4 as bigint) as approx_input_units from conversations group by conv_id""",
    "inbox_pending": "select 'letter ' || doc_id || '.TXT' as name, 'letter-' || doc_id as stem from documents where doc_id % 7 <> 0 and doc_id not in (select doc_id from labels)",
    "timeline_merge": """
        with items as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority as item, min(o_orderkey) as place from orders group by all)
        select cast(o_custkey as varchar) as subject, row_number() over (partition by o_custkey order by place) as ord, item from items""",
    "monitor": """
        with items as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || o_orderpriority as item, min(o_orderkey) as place from orders group by all),
        bodies as (select o_custkey, string_agg('- ' || item, chr(10) order by place) as body from items group by o_custkey)
        select cast(c_custkey as varchar) as patient_id, sha256(coalesce(body, '')) as latest_timeline, 'patients/' || c_custkey || '/strategy.md' as strategy_path from customer left join bodies on o_custkey = c_custkey""",
}
