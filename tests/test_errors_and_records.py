"""Row errors, CSV in splits, JSON of any depth, markup: against plain Python."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import audit, errors, nested, staging
from sparkveil.plans.config import RedactionConfig, only
from sparkveil.sources import files, records
from sparkveil.streaming import pipelines

MAIL = only("DET7")


# -- row errors ------------------------------------------------------------------


@pytest.fixture
def rows(spark):
    df = spark.createDataFrame([(1, "mail a@b.com", "x"), (2, "bad a@b.com", "c@d.com"), (3, None, ""), (4, "fine", "y")], "k int, t string, row string")
    return df.withColumn("t", F.expr("IF(k = 2, CAST(concat(CAST(t AS BINARY), X'FF') AS STRING), t)"))


def test_hostile_values_go_to_the_error_table(rows):
    checked = errors.redact_checked(rows, ["t", "row"], MAIL)
    assert checked.columns == ["k", "t", "row", "t_cleaned", "row_cleaned", "row_errors"]
    got = {r.k: (r.t_cleaned, r.row_cleaned) for r in checked.collect()}
    assert got == {1: ("mail [EMAIL]", "x"), 2: (None, "[EMAIL]"), 3: (None, ""), 4: ("fine", "y")}
    table = errors.error_table(checked, ["k"]).collect()
    assert [(r.k, r.column, r.reason, r.original) for r in table] == [(2, "t", "text is not valid UTF-8", None)] and table[0].at is not None
    assert checked.where("k = 2").select(F.length(F.col("t").cast("binary"))).first()[0] == 12  # the input stays as it is
    assert [tuple(r) for r in errors.error_counts(checked).collect()] == [("t", "text is not valid UTF-8", 1)]
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_checks_of_ones_own(rows):
    config = MAIL.with_(include_original_in_log=True)
    checked = errors.redact_checked(rows, ["t", "row"], config, checks=(errors.undecodable, errors.longer_than(11)), column_checks={"row": lambda c: F.when(c == "y", "no y")})
    found = sorted((r.k, r.column, r.reason, r.original) for r in errors.error_table(checked.where("k <> 2"), ["k"]).collect())
    assert found == [(1, "t", "text has more than 11 bytes", "mail a@b.com"), (4, "row", "no y", "y")]


def test_error_settings(spark, rows, tmp_path):
    log, out = f"{tmp_path}/errors", f"{tmp_path}/out"
    publish = lambda df: df.write.mode("overwrite").parquet(out)
    with pytest.raises(Exception, match="column t: text is not valid"):
        errors.run(rows, publish, ["t"], MAIL.with_(continue_on_error=False))
    with pytest.raises(errors.RowErrors, match="threshold"):
        errors.run(rows, publish, ["t"], MAIL.with_(max_errors=1, error_log_file=log), key=["k"])
    assert not list((tmp_path / "out").glob("part-*")) and spark.read.parquet(log).select("k").first()[0] == 2  # the table tells why
    assert errors.run(rows, publish, ["t"], MAIL.with_(max_errors=2)) == errors.Outcome(4, 1)
    assert errors.run(rows, publish, ["t"], MAIL) == errors.Outcome(4, 1) and spark.read.parquet(out).count() == 4
    config = RedactionConfig.from_dict({"error_handling": {"continue_on_error": False, "max_errors": 3, "error_log_file": "e", "include_original_in_log": True}})
    assert (config.continue_on_error, config.max_errors, config.error_log_file, config.include_original_in_log) == (False, 3, "e", True)


def test_report_over_columns_counts_errors(rows):
    checked = errors.with_errors(rows, ["t", "row"], MAIL)
    row = audit.report(checked, ["t", "row"], MAIL).first()
    assert (row.total_rows, row.redactions, row.total_redactions, row.error_count, row.columns_processed) == (4, {"EMAIL": 2}, 2, 1, ["t", "row"])
    assert audit.report(rows.limit(0), "t", MAIL).first().error_count == 0


def test_staging_folders_go(spark, tmp_path):
    folder = staging.shared_folder(spark, "test")
    staging.stored(spark.range(3), folder)
    staging.drop_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)
    with pytest.raises(ValueError):
        staging.drop_folder(spark, str(tmp_path))


# -- CSV in splits ---------------------------------------------------------------

CELLS = ["a", "", "x y", 'q"uo"te', "line\nbreak\n\nmore", "com,ma", '"', '""', "\n", '\n"', "é😀", "tab\t", '5" pipe', " lead", "a\r\nb", '",\n"', "mail a@b.com"]


@pytest.mark.parametrize(("split", "end"), [(29, "\n"), (150, "\r\n"), (1 << 27, "\n")])
def test_csv_in_splits_of_any_size(spark, tmp_path, split, end):
    rng = random.Random(split)
    data = [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(40)]
    for part in range(2):
        text = io.StringIO()
        writer = csv.writer(text, lineterminator=end)
        writer.writerow(["id", "a", "b"])
        writer.writerows(data[part::2])
        (tmp_path / f"{part}.csv").write_text(text.getvalue(), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        found = records.read_csv(spark, f"{tmp_path}/*.csv")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found.header == ["id", "a", "b"]
    got = sorted([r.id, r.a or "", r.b or ""] for r in found.rows.collect() if not r.row_errors)
    assert got == sorted(data)


def test_bad_records_have_a_reason(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,a,b\n1,x,y\n2,x,y,z\n3,x\n\n4,5" pipe,"q"\n5,"open\nnever, closed\n6,a,b\n')
    found = records.read_csv(spark, f"{tmp_path}/x.csv", include_original=True)
    rows = found.rows.collect()
    assert sorted((r.id, r.a, r.b) for r in rows if not r.row_errors) == [("1", "x", "y"), ("3", "x", None), ("4", '5" pipe', "q")]
    bad = sorted((e.reason, e.original) for r in rows for e in r.row_errors)
    assert bad == [
        (records.UNFINISHED, '5,"open'), (records.UNFINISHED, "6,a,b"), (records.UNFINISHED, "never, closed"), (records.MANY_FIELDS, "2,x,y,z"),
    ]
    assert records.read_csv(spark, f"{tmp_path}/x.csv", header=["p", "q", "r"]).rows.where("p = 'id'").count() == 1
    (tmp_path / "tab.csv").write_text("a\tA\t\n1,2\t3\t4\n")
    tab = records.read_csv(spark, f"{tmp_path}/tab.csv", delimiter="\t")
    assert tab.header == ["a", "A_1", "_c2"] and tuple(tab.rows.first())[:3] == ("1,2", "3", "4")


def test_csv_is_processed_with_an_error_table(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,note\n1,"mail a@b.com\nand c@d.com"\n2,x,too many\n3,ok\n')
    config = MAIL.with_(error_log_file=f"{tmp_path}/errors", include_original_in_log=True)
    done = files.process(spark, f"{tmp_path}/in.csv", f"{tmp_path}/out.csv", ["note"], config)
    assert sorted((r.id, r.note_cleaned) for r in done.collect()) == [("1", "mail [EMAIL]\nand [EMAIL]"), ("3", "ok")]
    assert [(r.column, r.reason, r.original) for r in spark.read.parquet(f"{tmp_path}/errors").collect()] == [(None, records.MANY_FIELDS, "2,x,too many")]
    with pytest.raises(errors.RowErrors):
        files.process(spark, f"{tmp_path}/in.csv", f"{tmp_path}/no.csv", ["note"], MAIL.with_(max_errors=1))


# -- JSON ------------------------------------------------------------------------


def leaves(value, path="$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for key, inner in value.items():
            yield from leaves(inner, f"{path}.{key}")
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from leaves(inner, f"{path}[{i}]")


def deep(levels):
    text = '"x@y.com"'
    for i in range(levels):
        text = f'{{"k{i}": [1.50, {text}]}}' if i % 2 else f'[{text} , {{"a b": 1e3}}]'
    return text


def json_texts():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind > 4:
            return {rng.choice("abc") + str(i): value(depth - 1) for i in range(rng.randrange(4))} if kind > 5 else [value(depth - 1) for _ in range(rng.randrange(4))]
        return [1.5, None, True, rng.choice(["x@y.com", 'q"uote\\', "é\n", "{[,]}:", "plain"]), -12345678901234567890][kind]

    return [json.dumps(value(5), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for _ in range(150)]


def test_json_leaves_at_any_depth(spark):
    texts = [*json_texts(), deep(60), '"top x"', "[]", "no json x@y.com", '{"a":1} x@y.com', "", "[" + ",".join(f'"u{i}"' for i in range(1300)) + "]"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, j string")
    found = {}
    for r in nested.json_leaves(df, "j", ["i"]).collect():
        found.setdefault(r.i, []).append((r.path, r.text))
    for i, text in enumerate(texts):
        try:
            want = list(leaves(json.loads(text)))
        except ValueError:
            want = []
        assert found.get(i, []) == want, text


def test_json_text_round_trip(spark):
    texts = [*json_texts(), deep(60), '{"x@key.com": "a", "a": "a@b.com", "a": 1.10}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    for r in nested.redact_json_text(df, "j", MAIL).collect():
        assert r.j == texts[r.i].replace('"x@y.com"', '"[EMAIL]"').replace('"a@b.com"', '"[EMAIL]"')
    bad = spark.createDataFrame([("no json",), ('{"a":1} a@b.com',), (None,)], "j string")
    assert [r.j for r in nested.redact_json_text(bad, "j", MAIL).collect()] == [None] * 3


def test_json_file_as_written(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"n": 1.10, "a": "a@b.com"},\n {"big": 12345678901234567890}]')
    files.process(spark, f"{tmp_path}/in.json", f"{tmp_path}/out", None, MAIL, as_written=True)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.rstrip("\n") == '[{"n": 1.10, "a": "[EMAIL]"},\n {"big": 12345678901234567890}]'


# -- markup ----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<a title="1>2 e@x.com">t</a>  mail  c@d.org  <i>z &amp; &#233;</i>', '<a title="1>2 e@x.com">t</a>  mail [EMAIL]  <i>z &amp; &#233;</i>'),
        ("<p><![CDATA[mail a.b@x.example]]></p><!-- c.d@y.example -->", "<p><![CDATA[mail [EMAIL]]]></p><!-- [EMAIL] -->"),
        ("<style>p{}</style><SCRIPT src='>'>a<b a@b.com</script >x<!-- open a@b.com", "<style>p{}</style><SCRIPT src='>'>a<b a@b.com</script >x<!-- open [EMAIL]"),
        ("a < b, c@d.com", "a &lt; b, [EMAIL]"),
        ("untouched &nbsp; < b  &copy;", "untouched &nbsp; < b  &copy;"),
        ("<a b='\">' c>q@r.com</a><br/><a title=\"open>x@y.com", "<a b='\">' c>[EMAIL]</a><br/><a title=\"open>[EMAIL]"),
        ("<!DOCTYPE html><?xml v?><scripty>a@b.com</scripty>", "<!DOCTYPE html><?xml v?><scripty>[EMAIL]</scripty>"),
        ("", ""),
    ],
)
def test_markup(spark, page, want):
    assert nested.redact_html(spark.createDataFrame([(page,)], "h string"), "h", MAIL).first()["h"] == want


def test_pages_come_back_byte_for_byte(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    done = nested.redact_html(pages, "html", MAIL, out="new")
    assert done.where("new <> html AND NOT contains(new, '[EMAIL]')").count() == 0
    long = spark.createDataFrame([("<b>" + "<i a='b'>x</i>" * 20_000 + "<!-- " + "-" * 50_000 + "'" * 9_999,)], "h string")
    row = nested.redact_html(long, "h", MAIL, out="n").first()
    assert row["h"] == row["n"]


# -- streams, names, exclusions ----------------------------------------------------


def test_a_stream_has_each_row_and_error_once(spark, rows, tmp_path):
    source, out, log, state = (f"{tmp_path}/{n}" for n in ("in", "out", "errors", "state"))
    rows.write.parquet(source)
    run = lambda config=MAIL: pipelines.append_checked(spark.readStream.schema(rows.schema).parquet(source), ["t"], out, log, state, config, key=["k"]).awaitTermination()
    with pytest.raises(Exception, match="threshold"):
        run(MAIL.with_(max_errors=1))
    run()  # the batch that failed is run again, under its own number
    run()
    rows.withColumn("k", F.col("k") + 10).write.mode("append").parquet(source)
    run()
    assert sorted(r.k for r in pipelines.read_batches(spark, out).collect()) == [1, 2, 3, 4, 11, 12, 13, 14]
    assert sorted((r.k, r.column) for r in pipelines.read_batches(spark, log).collect()) == [(2, "t"), (12, "t")]


def test_name_list_in_a_default_place(spark, tmp_path):
    (tmp_path / "names.txt").write_text("zubin\n")
    (tmp_path / "in.log").write_text("met Zubin Abcd at noon\n")
    assert files.find_names_file(spark, (f"{tmp_path}/no.txt", f"{tmp_path}/names.txt")) == f"{tmp_path}/names.txt"
    done = files.process(spark, f"{tmp_path}/in.log", f"{tmp_path}/out.log", None, only("NAM5"), names_file=f"{tmp_path}/names.txt")
    assert done.first()["value"] == "met [NAME] at noon"


def test_exclusions_with_a_hot_domain(spark):
    from sparkveil.operators import relational

    found = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "a@Hot.com").otherwise(F.concat("id", F.lit("@b.com"))).alias("original"))
    excluded = spark.createDataFrame([("HOT.com",), ("hot.com",), ("never.org",), (None,)], "d string")
    left = relational.without_excluded(found, excluded, "d", by_domain=True)
    assert left.columns == found.columns and left.count() == 1000 and left.where("id % 3 > 0").count() == 0


# -- cookies -----------------------------------------------------------------------


def test_cookie_pattern_is_the_plain_one_and_fast(spark):
    """Fixed value: the plain form of the pattern, compared on generated texts."""
    import re
    import time

    from sparkveil.operators import redaction

    plain = re.compile(r"(?:cookie|set-cookie)[\s:]*[^;]*(?:session|auth|token|user)[^;]*=[^;\s]+", re.IGNORECASE)
    rng = random.Random(6)
    bits = ["cookie", "set-cookie", ": ", "session", "auth", "token", "user", "=", "x1", ";", " ", "= ", "\n", "Cookie:", "a=b"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 16))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in redaction.findings(df, "t", ["i"], only("DET4", enable_data_cleaning=False)).where("pi_type = 'SESSION_COOKIE'").collect():
        got.setdefault(r.i, []).append((r.start, r.end))
    want = {i: [m.span() for m in plain.finditer(t)] for i, t in enumerate(texts)}
    others = {r.i for r in redaction.findings(df, "t", ["i"], only("DET4", enable_data_cleaning=False)).where("pi_type <> 'SESSION_COOKIE'").collect()}
    assert all(got.get(i, []) == w for i, w in want.items() if i not in others) and sum(map(bool, want.values())) > 30
    slow = spark.createDataFrame([("= " + "cookie token " * 1000,)], "t string")
    start = time.time()
    assert redaction.findings(slow, "t", [], only("DET4")).count() == 0 and time.time() - start < 20
