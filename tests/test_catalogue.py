from conftest import SF

from sparkveil.operators import redaction
from sparkveil.operators.catalogue import broken_patterns, register_functions, supported_types
from sparkveil.plans import catalog
from sparkveil.plans.config import CustomPattern, RedactionConfig, only
from sparkveil.functions.spans import split_group
from sparkveil.functions.sql import spelled


def test_listing_and_self_check(spark):
    assert supported_types(spark).count() == len(catalog.rows(RedactionConfig()))
    config = only("EXT1", custom_patterns=(CustomPattern("bad", "(", "[X]"), CustomPattern("good", "a+", "[Y]")))
    assert broken_patterns(spark, config) == ["CUSTOM_bad"]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT sv_clean('a  &amp; b'), sv_mask_log('a@b.com'), sv_luhn('4111111111111111'), sv_verhoeff('12x')").first()
    assert tuple(row) == ("a & b", "[EMAIL]", True, False)


def test_pattern_helpers():
    assert split_group(r"(?:a[(]b)\((c\d)d") == (r"(?:a[(]b)\(", r"c\d", "d")
    assert spelled(r"[A-C\d-]x-y[^0-2_]") == r"[ABC\d-]x-y[^012_]"


def test_each_regex_is_in_the_plan_once_to_look_and_once_to_mark(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = redaction.findings(df, "text", ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    ssn = spelled(r"\d{3}[-]\d{2}[-]\d{4}")
    assert plan.count(ssn) == 2
