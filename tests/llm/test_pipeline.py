"""Every stage against a plain reading of its operator, on the smallest tables."""

import zlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as p
    from veilframe.llm.common import store, table

    docs, out = table(spark, SF, "documents"), []
    for name, stage in p.STAGES:
        made = store(stage(spark, docs, SF), name)
        out.append((name, docs.toPandas(), made.toPandas()))
        docs = made
    return out


def test_stages(spark, stages):
    from veilframe.llm import secrets, simhash
    from veilframe.llm.tokens import encoder

    names = [name for name, _, _ in stages]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    for _, before, after in stages[:-1]:
        assert list(after.columns) == list(before.columns)
    _, before, after = stages[0]
    assert len(after) >= 0.98 * len(before)
    _, before, after = stages[1]
    prints = dict(zip(before.doc_id, map(simhash.fingerprint, before.text)))
    near = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 4
    kept = sorted(after.doc_id)
    assert not any(near(a, b) for a in kept for b in kept if a < b)
    assert all(any(near(g, d) for d in before.doc_id if d != g) for g in set(before.doc_id) - set(kept))
    _, before, after = stages[3]
    assert list(before.sort_values("doc_id").text.map(secrets.redact)) == list(after.sort_values("doc_id").text)
    _, before, after = stages[4]
    assert after.length.sum() == sum(len(encoder(added=True)(t)) + 1 for t in before.text)


def test_decontamination_stage(spark, stages):
    import duckdb

    from veilframe.llm.queries import ORACLES

    _, before, after = stages[2]
    con = duckdb.connect()
    con.register("documents", before)
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    clean = con.execute(f"select doc_id from ({ORACLES['op2_decontamination']}) where not contaminated").fetchall()
    assert sorted(x for (x,) in clean) == sorted(after.doc_id)


def test_odd_rows_pass_through_every_stage(spark):
    import corpus_pipeline as p
    from veilframe.llm.common import store

    a, b = [k for k in range(10, 60) if zlib.crc32(str(k).encode()) % 3 != 1][:2]  # ids that language ID may learn from
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "the house and the garden are here", "en", "s", 1), (a, "the same words in a row", "en", "s", 1), (a, "the same words in a row", "en", "s", 1), (b, "word " * 5000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs_ in (docs, docs.limit(0)):
        for name, stage in p.STAGES:
            docs_ = store(stage(spark, docs_, SF), name)
    kept = docs
    for name, stage in p.STAGES[:2]:
        kept = store(stage(spark, kept, SF), name)
    assert sorted(str(r.doc_id) for r in kept.collect()) == [str(a), str(b), "None"]


def test_near_dedup_keeps_a_row_of_every_component_where_ids_repeat(spark):
    import corpus_pipeline as p

    text = lambda name: " ".join(f"{name}{k}" for k in range(60))
    texts = [(5, text("a")), (5, text("b")), (9, text("b")), (9, text("a")), (9, text("own")), (5, text("a")), (None, text("a")), (7, text("far"))]
    texts += [(3, text(f"hot{k}")) for k in range(40)]
    docs = spark.createDataFrame([(k, t, "en", "s", n) for n, (k, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r.doc_id), r.text, r.n_chars) for r in p.near_dedup(spark, docs, SF).collect())
    assert kept == sorted((str(texts[n][0]), texts[n][1], n) for n in [0, 1, 4, 6, 7, *range(8, 48)])


def test_columns_named_like_the_stages_own_and_maps_survive(spark):
    import corpus_pipeline as p
    from pyspark.sql import functions as F

    from veilframe.llm.common import table

    docs = table(spark, SF, "documents").limit(60).withColumns({"score": F.lit(7.0), "lang_pred": F.lit("x"), "id": F.lit("i"), "key": F.lit("k"), "language": F.lit("y"), "text_hash": F.lit(1), "m": F.create_map(F.lit("a"), F.col("doc_id"))})
    docs = docs.union(docs.limit(5))
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-7:] == ["score", "lang_pred", "id", "key", "language", "text_hash", "m"]
    rows = docs.collect()
    assert rows and {(r.score, r.lang_pred, r.id, r.key, r.language, r.text_hash) for r in rows} == {(7.0, "x", "i", "k", "y", 1)} and all(r.m == {"a": r.doc_id} for r in rows)


def test_the_language_stage_predicts_once(spark):
    import corpus_pipeline as p
    from veilframe.llm.common import table

    plan = p.language_id(spark, table(spark, SF, "documents"), SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    import corpus_pipeline as p

    key = p._BATCH_KEY
    spark.conf.unset(key)
    p._modest(spark)
    assert spark.conf.get(key) == str(p.BATCH_BYTES)
    spark.conf.set(key, "3m")
    p._modest(spark)
    assert spark.conf.get(key) == "3m"
    spark.conf.unset(key)
