"""Values that come back whole: quoted CSV, JSON nulls, escaped HTML, our own marks, late attacks."""

from pyspark.sql import functions as F

from sparkveil.functions import clean, sanitize
from sparkveil.operators import nested, redaction
from sparkveil.sources import files


def test_csv_keeps_breaks_and_quotes(spark, tmp_path):
    rows = [("1", 'hello\nmail a.b@x.example'), ("2", 'he said "no"'), ("3", "back\\slash, comma")]
    path = str(tmp_path / "t.csv")
    files.write(spark.createDataFrame(rows, "id string, note string"), path, "csv")
    assert sorted(map(tuple, files.read_any(spark, path).collect())) == rows


def test_json_keeps_null_keys(spark, tmp_path):
    path = str(tmp_path / "t.jsonl")
    files.write(spark.createDataFrame([(None, 2)], "a string, n long"), path, "jsonl")
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":null,"n":2}']


def test_html_text_stays_text(spark):
    page = "<p>1 &lt;script&gt;alert(1)&lt;/script&gt; a.b@x.example</p>﷑<b>c.d@y.example</b>"
    done = nested.redact_html(spark.createDataFrame([(page,)], "html string"), "html").first()[0]
    assert "<script" not in done and "&lt;script&gt;" in done
    assert "a.b@x" not in done and "c.d@y" not in done


def test_marks_do_not_come_back_through_entities(spark):
    rows = [("a &#64977; SECRET &#64977; b &#x41; &#x0000000041;",), ("&#xFDD0; a.b@x.example",)]
    df = spark.createDataFrame(rows, "t string")
    texts = [r[0] for r in df.select(clean.clean("t")).collect()]
    assert "SECRET" in texts[0] and texts[0].endswith("b A A")
    assert "a.b@x" not in redaction.redact_columns(df, ["t"]).collect()[1].t_cleaned


def test_session_token_with_underscore_before_the_dot(spark):
    df = spark.createDataFrame([("x eyJhbGc_.eyJzdWI_.sigabc y",)], "t string")
    assert "eyJhbGc_" not in redaction.redact_columns(df, ["t"]).first().t_cleaned


def test_attack_after_the_first_kilobytes(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("x "), 20_000), F.lit("<iframe src=a>")).alias("t"))
    assert df.select(sanitize.suspicious("t")).first()[0]
