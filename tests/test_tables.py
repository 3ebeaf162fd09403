"""Sources, nested data, audit, sanitizers and streams."""

import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkveil.functions import mask, sanitize
from sparkveil.operators import audit, nested, redaction, relational
from sparkveil.plans.config import RedactionConfig, only
from sparkveil.plans.words import NameLists
from sparkveil.sources import files
from sparkveil.streaming import pipelines

MAIL = only("DET7")


def test_nested_walk(spark):
    data = '{"a": "x@y.com", "n": 1, "b": {"c": ["p@q.org", null, "plain"], "m": {"k": "z@z.net"}}, "e": []}'
    df = spark.createDataFrame([(1, data), (2, None)], "i int, j string")
    schema = "a string, n int, b struct<c:array<string>,m:map<string,string>>, e array<string>"
    rows = {r["i"]: r["j"] for r in nested.redact_json(df, "j", schema, MAIL).collect()}
    assert json.loads(rows[1]) == {
        "a": "[EMAIL]", "n": 1, "b": {"c": ["[EMAIL]", None, "plain"], "m": {"k": "[EMAIL]"}}, "e": []
    }
    assert rows[2] is None


def test_json_deeper_than_allowed_fails(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": {"c": "x"}}}')], "i int, j string")
    assert nested.json_leaves(df, "j", ["i"], depth=3).count() == 1
    with pytest.raises(Exception, match="deeper"):
        nested.json_leaves(df, "j", ["i"], depth=1).collect()


def test_html_keeps_markup(spark):
    page = '<p title="a@b.com">a@b.com</p><script>var x="a@b.com"</script><!-- a@b.com --><b>ok</b>'
    df = spark.createDataFrame([(page,)], "h string")
    assert nested.redact_html(df, "h", MAIL).first()["h"] == page.replace(">a@b.com<", ">[EMAIL]<").replace("- a@b.com -", "- [EMAIL] -")
    assert [r["text"] for r in nested.html_texts(df, "h", []).collect()] == ["a@b.com", " a@b.com ", "ok"]


def test_other_columns_pass_through(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    out = redaction.redact_columns(df.withColumn("t", F.lit("a@b.com")), ["t", "missing"], MAIL)
    assert out.columns == [*df.columns, "t", "t_cleaned"]
    with pytest.raises(ValueError):
        redaction.redact_columns(df, ["missing"])


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,note\n1,mail a@b.com\n2,none\n")
    files.process(spark, str(tmp_path / "in.csv"), str(tmp_path / "out.csv"), ["note"], MAIL)
    got = {r["id"]: r["note_cleaned"] for r in files.read_any(spark, str(tmp_path / "out.csv")).collect()}
    assert got == {"1": "mail [EMAIL]", "2": "none"}
    (tmp_path / "in.json").write_text('[{"a": "a@b.com", "n": 3}]')
    done = files.process(spark, str(tmp_path / "in.json"), str(tmp_path / "o.json"), None, MAIL)
    assert done.first().asDict() == {"a": "[EMAIL]", "n": 3}
    (tmp_path / "in.log").write_text("one a@b.com\ntwo\n")
    lines = files.process(spark, str(tmp_path / "in.log"), str(tmp_path / "o.log"), None, MAIL)
    assert sorted(r["value"] for r in lines.collect()) == ["one [EMAIL]", "two"]
    (tmp_path / "p.html").write_text("<p>a@b.com</p>\n<i>x</i>")
    assert files.process(spark, str(tmp_path / "p.html"), str(tmp_path / "o.html"), None, MAIL).first()["html"].startswith("<p>[EMAIL]</p>")


def test_name_sources(spark, tmp_path):
    (tmp_path / "n.txt").write_text("# list\nZubin\n\n zaara \n")
    (tmp_path / "n.csv").write_text("first_name,last_name\nQadir,Qasim\n")
    (tmp_path / "n.json").write_text('{"first_names": ["Xena"], "names": ["Xylo"]}')
    kinds = {
        (r["name"], r["kind"]) for f in ("n.txt", "n.csv", "n.json") for r in files.read_names(spark, str(tmp_path / f)).collect()
    }
    assert kinds == {("zubin", "extra"), ("zaara", "extra"), ("qadir", "first"), ("qasim", "last"), ("xena", "first"), ("xylo", "extra")}
    lists = files.name_lists(files.read_names(spark, str(tmp_path / "n.txt")))
    df = spark.createDataFrame([("met Zubin Abcd at noon",)], "t string")
    assert redaction.redact_columns(df, ["t"], only("NAM5"), lists).first()["t_cleaned"] == "met [NAME] at noon"


def test_dictionary_join_equals_plan_words(spark):
    rows = [(i, t) for i, t in enumerate(["Dear Rahul Xyz", "Abc Emma Park", "Hello Contact Rahul Emma", "Abc Xyz", "Emma Rao Rahul", "RAHUL KUMAR called", "dear Rahul, hello", "hi Emma Park and EMMA STONE", None, ""])]
    df = spark.createDataFrame(rows, "k int, t string")
    lists = NameLists(frozenset({"rahul", "emma"}), frozenset())
    names = spark.createDataFrame([("Rahul",), ("emma",), ("EMMA",)], "name string")
    joined = {(r["k"], r["start"], r["end"]) for r in relational.dictionary_findings(df, "t", "k", names).collect()}
    plan = {(r["k"], r["start"], r["end"]) for r in redaction.findings(df, "t", ["k"], only("NAM5"), lists).collect()}
    assert joined == plan


def test_redact_with_findings_of_a_table(spark):
    rows = [(1, "ask RAHUL KUMAR or a.b@mail.example.com"), (2, "dear Emma, hello"), (3, None), (4, "  "), (None, "c.d@mail.example.com")]
    df = spark.createDataFrame(rows, "k int, t string")
    extra = relational.dictionary_findings(df, "t", "k", spark.createDataFrame([("rahul",), ("emma",)], "name string"))
    got = {(r["k"], r["t_cleaned"]) for r in relational.redact_with(df, "t", "k", extra, only("DET7")).collect()}
    assert got == {(1, "ask [NAME] or [EMAIL]"), (2, "dear [NAME], hello"), (3, None), (4, "  "), (None, "[EMAIL]")}


def test_audit_report_and_errors(spark):
    df = spark.createDataFrame([("a@b.com c@d.com",), ("10.0.0.1",), (None,), ("",)], "t string")
    row = audit.report(df, "t", only("DET7", "DET14"), seconds=2.0).first()
    assert row["redactions"] == {"EMAIL": 2, "IP_V4": 1}
    assert (row["total_rows"], row["total_redactions"], row["redaction_types"], row["most_common"]) == (4, 3, 2, "EMAIL")
    assert row["rows_per_second"] == 2.0
    failed = df.withColumn("e", sanitize.row_error("t"))
    assert audit.row_totals(failed, "e").first()["error_count"] == 2
    with pytest.raises(Exception, match="threshold"):
        audit.row_totals(failed, "e", max_errors=1).collect()


def test_token_counts_with_and_without_digits(spark):
    df = spark.createDataFrame([("[EMAIL] [IP_V4] [EMAIL]",)], "t string")
    assert {r["token"]: r["n"] for r in audit.token_counts(df, "t").collect()} == {"EMAIL": 2, "IP_V4": 1}
    assert {r["token"]: r["n"] for r in audit.token_counts(df, "t", strict=True).collect()} == {"EMAIL": 2}


def test_sanitizers(spark):
    df = spark.createDataFrame([(0, "a\x00b\x07c"), (1, "' OR '1'='1"), (2, None), (3, "x" * 30)], "i int, t string")
    config = sanitize.SanitizerConfig(max_length=20, escape_html=True)
    rows = {r["i"]: r["s"] for r in df.select("i", sanitize.sanitize("t", config, detect=True).alias("s")).collect()}
    assert rows[0].text == "abc" and rows[0].removed_chars == 2 and rows[0].was_modified
    assert rows[1].warnings[0].startswith("Warning: SQL injection") and "&#x27;" in rows[1].text
    assert rows[3].warnings == ["Text truncated from 30 to 20 chars"]
    safe = {r["i"]: r["s"] for r in df.select("i", sanitize.inspect("t").alias("s")).collect()}
    assert not safe[1].is_safe and safe[1].categories == ["sql_injection"] and safe[2].is_safe
    good, bad = sanitize.quarantine(df, "t")
    assert (good.count(), bad.count()) == (2, 2)


def test_unicode_forms(spark):
    df = spark.createDataFrame([("ﬁ é é",)], "t string")
    row = df.select(
        sanitize.unicode_form("t").alias("a"), sanitize.unicode_form("t", exact=True).alias("b"), sanitize.unicode_form("t", "NFD").alias("c")
    ).first()
    assert row["a"] == row["b"] == "fi é é" and row["c"] == "ﬁ é é"


def test_masks(spark):
    df = spark.createDataFrame([("call 555-123-4567 at 10.0.0.1 or a@b.com",)], "t string")
    assert df.select(mask.mask_log("t")).first()[0] == "call [PHONE] at [IP] or [EMAIL]"
    assert df.select(mask.safe_preview("t", 10)).first()[0] == "[40 chars] call 555-1..."


def test_file_triage(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a,b\n")
    (tmp_path / "bad.pdf").write_bytes(b"nope")
    (tmp_path / "js.pdf").write_bytes(b"%PDF-1 /JavaScript")
    (tmp_path / "x.html").write_text("<script>1</script>")
    got = {r["path"].split("/")[-1]: r["error"] for r in files.triage_files(spark, str(tmp_path)).collect()}
    assert got["ok.csv"] is None and "match" in got["bad.pdf"] and "PDF" in got["js.pdf"] and "malicious" in got["x.html"]


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "documents.parquet").parquet(SF)
    done = pipelines.redact_stream(stream, ["text"], MAIL)
    pipelines.append(done, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = redaction.redact_columns(docs, ["text"], MAIL)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(batch).count() == 0

    src = tmp_path / "src"
    make = lambda rows: spark.createDataFrame(rows, "s string, k string, v double").selectExpr("timestamp(s) AS ts", "k", "v")
    one = make([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0)])
    one.write.parquet(str(src), mode="append")
    events = spark.readStream.schema(one.schema).parquet(str(src))
    out = pipelines.windowed_metrics(events, "ts", ["k"], "v", F.col("v") > 1)
    run = lambda: pipelines.append(out, str(tmp_path / "w"), str(tmp_path / "wc")).awaitTermination()
    run()
    make([("2024-01-01 00:20:00", "a", 9.0), ("2024-01-01 09:00:00", "a", 1.0)]).write.parquet(str(src), mode="append")
    run()
    got = {str(r["window_start"]): r["requests"] for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 1}


def test_detection_is_narrow_and_native(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = redaction.findings(df, "text", ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("FileScan") == 1 and "lang" not in plan.split("ReadSchema")[1][:60]


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["pi_type", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
