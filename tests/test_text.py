from pyspark.sql import functions as F

from veilframe.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_lines_follow_every_line_end(spark):
    assert one(spark, "a\r\nb\x0bc d\n", T.lines) == ["a", "b", "c", "d"]
    assert one(spark, "", T.lines) == []
    assert one(spark, "a\n\n", T.lines) == ["a", ""]


def test_chunks_stop_at_the_first_window_that_reaches_the_end(spark):
    assert [len(x) for x in one(spark, "x" * 1700, T.chunks)] == [900, 900, 200]
    assert one(spark, "x" * 900, lambda c: F.size(T.chunks(c))) == 1
    assert one(spark, "", T.chunks) == []
    assert one(spark, "", lambda c: T.chunks(c, empty_is_chunk=True)) == [""]


def test_dates(spark):
    assert one(spark, "Bericht vom 3.2.2024", T.body_date) == "2024-02-03"
    assert one(spark, "vom 31.2.2024, den 1.1.2020", T.body_date) is None
    assert one(spark, "2025-02", T.iso_date) is None
    assert one(spark, "scan 2024.05.06 b", T.filename_date) == "2024-05-06"


def test_visible_drops_thinking(spark):
    assert one(spark, "<think>a</think>b<reasoning>c", T.visible) == "b"
    assert one(spark, "x</thought>y", T.visible) == "xy"


def test_fenced_json_and_quoting(spark):
    assert one(spark, 'so:\n```json\n{"a":1}\n```', T.fenced_json) == '{"a":1}'
    assert one(spark, "a~b*c d", T.url_quote) == "a~b%2Ac+d"


def test_weak_page(spark):
    assert one(spark, " a b   c ", T.is_weak) is True
    assert one(spark, "abcdefghijkl", T.is_weak) is False
