"""Registered queries of the engine against DuckDB on the smallest tables, as far as SQL expresses them."""

import duckdb
import pytest

from veilframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    made = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in made.description]
    want = sorted(tuple(map(plain, r)) for r in made.fetchall())
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_passages_beyond_a_block(spark, tmp_path, monkeypatch):
    text = lambda k: f"passage number {k} is long enough to be tested."
    items = [(k, text(k)) for k in range(60)] + [(7, text(7)), (8, text(7)), (99, "short"), (None, text(3)), (98, None)]
    docs = [(k, f"before {text(k)} {text(k + 1)} after") for k in range(0, 80, 3)] + [(0, text(7)), (None, text(7)), (500, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(d), str(i)) for d, t in docs for i, p in items if t and p and len(p) >= 24 and p in t)
    for most in (5000, 7):
        monkeypatch.setattr(catalogue, "MOST_PASSAGES", most)
        assert sorted((str(r.doc_id), str(r.item_id)) for r in catalogue.QUERIES["known_passage_sweep"](spark, str(tmp_path)).collect()) == want
