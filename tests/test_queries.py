"""Registered queries on tables of other shapes than the test tables have."""

import os

import pytest
from pyspark.sql import functions as F

from sparkveil.functions.align import align_stages
from sparkveil.operators import raw, redaction
from sparkveil.plans.config import only
from sparkveil.queries import QUERIES


def table(spark, folder, name, rows, schema, files=3):
    """A table as a folder of several files."""
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{folder}/{name}.parquet")


def test_injection_flags_reads_its_own_hostile_texts(spark, tmp_path):
    table(spark, tmp_path, "customer", [(i, f"Customer#{i}") for i in range(10)], "c_custkey bigint, c_name string")
    rows = {r["c_custkey"]: r for r in QUERIES["injection_flags"](spark, str(tmp_path)).collect()}
    assert [rows[i]["categories"] for i in range(5)] == ["sql_injection", "command_injection", "script_injection", "path_traversal", ""]
    assert [rows[i]["is_safe"] for i in range(10)] == [False, False, False, False, True] * 2


@pytest.mark.parametrize("whole", [False, True])
def test_streams_read_a_table_of_one_file_and_of_many(spark, tmp_path, whole):
    turns = [(i, i % 3, f"turn {i}") for i in range(20)]
    table(spark, tmp_path, "documents", [(i, f"mail u{i}@x.example.com ok") for i in range(20)], "doc_id bigint, text string")
    table(spark, tmp_path, "conversations", turns, "conv_id bigint, turn int, text string")
    folder = tmp_path
    if whole:
        folder = tmp_path / "whole"
        folder.mkdir()
        for name in ("documents", "conversations"):
            spark.read.parquet(f"{tmp_path}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/one-{name}")
            part = next(f for f in os.listdir(tmp_path / f"one-{name}") if f.endswith(".parquet"))
            os.link(tmp_path / f"one-{name}" / part, folder / f"{name}.parquet")
    found = QUERIES["stream_findings"](spark, str(folder))
    assert {(r["doc_id"], r["text_cleaned"]) for r in found.collect()} == {(i, "mail [EMAIL] ok") for i in range(20)}
    masked = QUERIES["stream_log_mask"](spark, str(folder))
    assert masked.count() == 20 and masked.where(F.col("masked").contains("[EMAIL]")).count() == 20


def test_many_short_rows_of_one_file_are_work_for_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("id AS c_custkey", "'c' AS c_name").coalesce(1)
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["windows_users"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    assert found.select("key").distinct().count() == found.count() == 60_000


def test_traced_texts_keep_only_what_cleaning_changes(spark):
    texts = ["some plain words\nand a second line 12 345", "two  blanks\tand &amp; more \n x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    traced = redaction.run_stages(df, {"o": "t"}, align_stages(traced=True)).orderBy("i")
    got = traced.select("o.t", F.size("o.ed").alias("edits"), F.aggregate("o.ed", F.lit(0), lambda a, d: a + F.size(d.a)).alias("parts")).collect()
    assert [r["t"] for r in got] == [texts[0], "two blanks and & more\nx"]
    # without the line break and the blank between digits nothing is an edit; each edit has a part per match
    assert got[0]["edits"] <= 1 and got[0]["parts"] <= 2
    assert 3 <= got[1]["edits"] and got[1]["parts"] <= 9


def test_findings_have_the_same_raw_places_traced_as_by_character(spark):
    text = "​ …  &amp;amp;\t&#x41;­ mail1@raw.example.com &lt;“\r\n\r\n\r\n áb  ﬁn x@y.example.org​ "
    df = spark.createDataFrame([(1, text)], "i int, t string")
    place = raw.aligned(df, "t").first()["aligned"]
    found = raw.findings(df, "t", ["i"], only("DET7")).orderBy("start").collect()
    assert [r["raw_original"] for r in found] == ["mail1@raw.example.com", "x@y.example.org"]
    assert [(r["raw_start"], r["raw_end"]) for r in found] == [(place["starts"][r["start"]], place["ends"][r["end"] - 1]) for r in found]
