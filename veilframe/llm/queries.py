"""The operators over the test tables: one query each, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, langid, licenses, packing, secrets, sharding, simhash, toxicity
from .common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = langid.predict(documents.select("doc_id", "text"), langid.fit(documents))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for spans in map(secrets.scan, texts):
            base = [s for s in spans if s[0] != "lexed"]
            joined = lambda part: ",".join(f"{k}:{a}:{b}" for k, a, b in part)
            rows.append([*(sum(s[0] == k for s in base) for k in secrets.KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return table(spark, sf_dir, "documents").select("doc_id", digest("text").alias("found")).select("doc_id", "found.*")


#: A conversation whose texts are made of other templates' control strings.
HOSTILE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    made = chat.format_conversations(rows.unionByName(spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for conv, ids, mask in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                text = chat.written(ids)
                turns, learned = chat.read_back(text), chat.masked_text(ids, mask)
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.string() if "sha" in n else pa.int64()) for k, n in enumerate(names)})

    return made.select("conv_id", "input_ids", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.score(documents.select("doc_id", "text"), toxicity.fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return placed.select("doc_id", sharding.size_of("text").alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("loss_tokens")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_nearest_neighbours, op2_decontamination, op3_language_id, op4_near_duplicates, op5_secrets, op6_chat, op7_licenses, op8_toxicity, op9_sharding, op10_packing)
} | {"pipeline": _pipeline}

_WORDS = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')".format(r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

ORACLES = {
    # Valid vectors of the most frequent length; products are added in the order of the dimensions.
    "op1_nearest_neighbours": """
        with sound as (
            select vec_id, embedding::double[] as v from embeddings
            where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        fit as (select distinct vec_id, v from sound where len(v) = (select len(v) from sound group by 1 order by count(*) desc, 1 limit 1)),
        scored as (
            select q.vec_id as query_id, c.vec_id, max(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b)) as score
            from fit q join fit c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id group by all
        )
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
    """,
    "op2_decontamination": f"""
        with docs as (select doc_id, {_WORDS} as words from documents),
        items as (select item_id, {_WORDS} as words from benchmark),
        starts as (select item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) as s from items where len(words) > 0),
        windows as (select distinct item_id, words[s:s + least(len(words), 10) - 1] as w from starts),
        lengths as (select distinct len(w) as n from windows),
        spots as (select doc_id, n, unnest(range(1, len(words) - n + 2)) as p from docs, lengths where len(words) >= n),
        grams as (select spots.doc_id, p, n, array_to_string(words[p:p + n - 1], ' ') as g from spots join docs using (doc_id)),
        hits as (select doc_id, p, n, item_id from grams join (select item_id, array_to_string(w, ' ') as g, len(w) as n from windows) using (g, n)),
        marked as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by doc_id),
        named as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
        select docs.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from docs left join marked using (doc_id) left join named using (doc_id)
    """,
    "op7_licenses": licenses.sql(),
    "op6_chat": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ),
        sized as (
            select *, role || chr(10) || text || chr(10) as plain, if(role = 'assistant', text, '') as learned,
                   len(text) + len(role) + len('<|turn|><|sep|><|end|>')
                   + len(regexp_extract_all(role || chr(10) || text, '␛|<\|turn\|>|<\|sep\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|system\|>|<\|user\|>|<\|assistant\|>|<s>|</s>|\[INST\]|\[/INST\]')) as chars
            from turns
        )
        select conv_id, count(*) as n_turns, sha256(string_agg(plain, '' order by turn, role, text)) as turns_sha256,
               cast(sum(len(learned)) as bigint) as loss_chars, sha256(string_agg(learned, '' order by turn, role, text)) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
        from sized group by conv_id
    """,
}
