"""Queries over whole documents, pages, conversations and events: text, audit, joins, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.functions import checks, clean, mask, sanitize
from sparkveil.functions import spans as S
from sparkveil.functions.sql import apply
from sparkveil.operators import audit, errors, nested, raw, redaction, relational, staging
from sparkveil.plans import words as W
from sparkveil.plans.config import RedactionConfig, only
from sparkveil.plans.words import NameLists
from sparkveil.queries.detectors import Query, short_rows, table
from sparkveil.sources import files
from sparkveil.sources.records import read_csv
from sparkveil.streaming import pipelines

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


# Patterns for the check engine, which knows no look-around and only ASCII word edges.
_EDGE, _TAIL = r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])"
_OCT = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,61}[A-Za-z0-9])?\.[A-Za-z]{2,20}\b"
_IP = rf"(?:{_OCT}\.){{3}}{_OCT}(?::\d{{2,5}})?\b"
_CARD = r"(?:\d{4}[\s-]?){3}\d{4}\b"
PLAIN = only("DET7", "DET14", "DET23", enable_data_cleaning=False)


def _found(columns: str, source: str = "documents", text: str = "text") -> str:
    parts = " UNION ALL ".join(
        f"SELECT {columns}, '{kind}' AS pi_type, unnest(regexp_extract_all({text}, '{_EDGE}({p})', 2)) AS m FROM {source}"
        for kind, p in (("EMAIL", _EMAIL), ("IP_V4", _IP), ("CARD", _CARD))
    )
    return f"({parts})"


@query("findings_by_type", f"SELECT pi_type, count(*) AS n FROM {_found('doc_id')} GROUP BY pi_type")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text", config=PLAIN)
    return audit.count_by(found, "pi_type")


@query("findings_by_type_all_detectors")
def findings_by_type_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text")
    return audit.count_by(found, "pi_type")


@query(
    "findings_rollup",
    f"SELECT source, pi_type, count(*) AS n FROM {_found('doc_id, source')} GROUP BY ROLLUP (source, pi_type)",
)
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text", ["source"], PLAIN)
    return audit.rollup(found, "source", "pi_type")


@query("findings_detail", f"SELECT doc_id, pi_type, m AS original FROM {_found('doc_id')}")
def findings_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text", ["doc_id"], PLAIN)
    return found.select("doc_id", "pi_type", "original")


@query(
    "span_offsets",
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '(\d+)') AS m, string_split_regex(text, '\d+') AS g FROM documents),
    i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM p)
    SELECT doc_id, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS start,
    m[k] AS original FROM i""",
)
def span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkveil.plans.catalog import Detector

    digits = Detector("D", r"[0-9]+", "D", icase=False)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.inline_outer(apply("text", "t", S.find("t", digits)))
    )
    return rows.filter("s IS NOT NULL").select("doc_id", F.col("s").cast("bigint").alias("start"), F.col("v").alias("original"))


@query(
    "overlap_resolution",
    """WITH RECURSIVE s AS (SELECT l_orderkey AS k, CAST(l_partkey % 60 AS BIGINT) AS st, CAST(l_partkey % 60 + l_quantity AS BIGINT) AS en, l_linenumber AS o FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY st, st - en, o) AS i FROM s),
    w AS (SELECT k, i, st, en, o, en AS last, TRUE AS kept FROM r WHERE i = 1
      UNION ALL SELECT r.k, r.i, r.st, r.en, r.o, CASE WHEN r.st >= w.last THEN r.en ELSE w.last END, r.st >= w.last
      FROM r JOIN w ON r.k = w.k AND r.i = w.i + 1)
    SELECT k AS l_orderkey, st AS start, en AS "end", CAST(o AS BIGINT) AS layer FROM w WHERE kept""",
)
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, size = F.expr("int(l_partkey % 60)"), F.expr("int(l_quantity)")
    span = F.struct(
        start.alias("s"), (-size).alias("n"), F.col("l_linenumber").cast("int").alias("o"), (start + size).alias("e")
    )
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(span)).alias("z"))
    kept = groups.select("l_orderkey", F.inline(apply("z", "z", f"transform({S.resolve('z')}, i -> z[i])")))
    return kept.select(
        "l_orderkey", F.col("s").cast("bigint").alias("start"), F.col("e").cast("bigint").alias("end"),
        F.col("o").cast("bigint").alias("layer"),
    )


def _replace(text: str, *pairs: tuple[str, str]) -> str:
    for pattern, tok in pairs:
        text = f"regexp_replace({text}, '{_EDGE}{pattern}', '\\1{tok}', 'g')"
    return text


_SQUEEZE = r"regexp_replace({0}, '\s{{2,}}', ' ', 'g')"


@query(
    "redacted_documents",
    "SELECT doc_id, trim("
    + _SQUEEZE.format(_replace("text", (_EMAIL, "[EMAIL]"), (_IP, "[IP_V4]"), (_CARD, "[CARD]")))
    + ", chr(32) || chr(10)) AS text_cleaned FROM documents",
)
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redaction.redact_columns(rows, ["text"], PLAIN).select("doc_id", "text_cleaned")


@query(
    "untyped_tokens",
    "SELECT conv_id, turn, trim(" + _SQUEEZE.format(_replace("(text || ' a@b.example.com')", (_EMAIL, "[REDACTED]"))) + ", chr(32) || chr(10)) AS text_cleaned FROM conversations",
)
def untyped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text || ' a@b.example.com' AS text")
    config = only("DET7", enable_data_cleaning=False, use_typed_tokens=False)
    return redaction.redact_columns(rows, ["text"], config).select("conv_id", "turn", "text_cleaned")


@query(
    "details_batch",
    f"SELECT doc_id, CAST(length(text) AS BIGINT) AS original_length, CAST(len(regexp_extract_all(text, '{_EDGE}{_EMAIL}')) AS BIGINT) AS redacted_count FROM documents",
)
def details_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = only("DET7", enable_data_cleaning=False)
    rows = redaction.with_details(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", config)
    return rows.select(
        "doc_id",
        F.col("details.original_length").cast("bigint").alias("original_length"),
        F.col("details.redacted_count").cast("bigint").alias("redacted_count"),
    )


@query("redacted_documents_all_detectors")
def redacted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redaction.redact_columns(rows, ["text"]).select("doc_id", "text_cleaned")


@query("details_all_detectors")
def details_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.with_details(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.inline_outer("details.redactions"))


_CLOSING = (
    r"(?i)\b(?:thanks?(?:\s{0,5}(?:and|&)\s{0,5}regards?)?|thank\s{0,5}you|regards?|best(?:\s{0,5}regards?)?"
    r"|warm(?:\s{0,5}regards?)?|sincerely|cheers)\b"
)


@query(
    "signature_cut",
    rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'ok ' || turn || chr(10) || 'Best regards, ' || text ELSE text END AS t FROM conversations),
    p AS (SELECT *, string_split_regex(t, '{_CLOSING}') AS p FROM t)
    SELECT conv_id, turn, trim(regexp_replace(CASE WHEN len(p) > 1 THEN p[1] || ' [SIGNATURE]' ELSE t END, '\s{{2,}}', ' ', 'g'), chr(32) || chr(10)) AS text_cleaned FROM p""",
)
def signature_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "IF(turn % 2 = 0, 'ok ' || turn || chr(10) || 'Best regards, ' || text, text) AS text")
    config = only("SPN9", enable_data_cleaning=False)
    return redaction.redact_columns(rows, ["text"], config).select("conv_id", "turn", "text_cleaned")


# -- cleaning ----------------------------------------------------------------

_QUAD = rf"\b({_OCT})\.({_OCT})\.({_OCT})\.({_OCT})\b"
_CLEAN = "text"
for _old, _new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
    _CLEAN = f"replace({_CLEAN}, '{_old}', '{_new}')"
_CLEAN = rf"regexp_replace({_CLEAN}, '{_QUAD}', '\1¤\2¤\3¤\4', 'g')"
_CLEAN = rf"replace(regexp_replace({_CLEAN}, '(\+?\d{{1,4}})[\s.]+(\d)', '\1 \2', 'g'), '¤', '.')"
_LINES = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), chr(32) || chr(10) || chr(9))"


@query("cleaned_documents", f"SELECT doc_id, {_LINES.format(_CLEAN)} AS text_clean FROM documents")
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redaction.cleaned(rows, "text", "text_clean").select("doc_id", "text_clean")


def _step_query(name: str, step: str, source: str, key: str, text: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).selectExpr(f"{key} AS key", f"{text} AS t")
        return rows.select("key", clean.step("t", step).alias("cleaned"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT key, {oracle} AS cleaned FROM (SELECT {key} AS key, {text} AS t FROM {source})"


_NAMED = "t"
for _old, _new in clean.ENTITIES:
    _NAMED = f"replace({_NAMED}, '{_old}', '{_new.replace(chr(39), chr(39) * 2)}')"
_step_query("clean_entities", "entities", "pages", "page_id", "html", _NAMED)
_step_query("clean_numeric_entities", "entities", "customer", "c_custkey", "'a&#' || CAST(65 + c_custkey % 26 AS STRING) || ';b&#x' || CASE WHEN c_custkey % 2 = 0 THEN '1F600' ELSE 'e9' END || ';'", "'a' || chr(CAST(65 + key % 26 AS INT)) || 'b' || CASE WHEN key % 2 = 0 THEN chr(128512) ELSE chr(233) END")
_step_query("clean_punctuation", "punctuation", "customer", "c_custkey", "chr(34) || c_name || '’s “ok” – yes… '", "chr(34) || substr(t, 2, 18) || chr(39) || 's ' || chr(34) || 'ok' || chr(34) || ' - yes... '")
_step_query("clean_homoglyphs", "homoglyphs", "customer", "c_custkey", "translate(c_name, 'oae', 'оае')", "translate(t, 'оае', 'oae')")
_step_query("clean_invisible", "invisible", "customer", "c_custkey", "replace(c_name, '0', '0​­')", "replace(replace(t, '​', ''), '­', '')")
_step_query("clean_mojibake", "mojibake", "customer", "c_custkey", "'Ã© â€œ' || c_name", "'é \"' || substr(t, 7)")
_step_query("clean_compatibility_forms", "nfkc", "customer", "c_custkey", "translate(CAST(c_custkey AS STRING), '0123456789', '０１２３４５６７８９') || ' ﬁn é'", "CAST(key AS STRING) || ' fin é'")
_step_query("clean_control", "control", "orders", "o_orderkey", "o_orderpriority || chr(7) || 'x' || chr(127) || 'y'", "replace(replace(t, chr(7), ''), chr(127), '')")
_step_query("clean_digit_groups", "digit_groups", "orders", "o_orderkey", "'call ' || CAST(o_orderkey AS STRING) || '.  98765 at 10.0.0.1:80 v3.14'", r"replace(replace(regexp_replace(t, '(\d+)\.  98765', '\1 98765'), '.  ', ' '), '3.14', '3 14')")
_step_query("clean_whitespace", "whitespace", "conversations", "conv_id * 1000 + turn", "'  ' || text || chr(10) || ' ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || 'x  y '", _LINES.format("t"))


# -- checks, masks, sanitizers -------------------------------------------------

_VD, _VP = checks._D, checks._P


@query(
    "verhoeff_valid",
    f"""WITH d AS (SELECT c_custkey, '2' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '3') AS t FROM customer),
    e AS (SELECT c_custkey, list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: CAST(substr('{_VP}', 10 * (i % 8) + 1 + CAST(substr(reverse(t), i + 1, 1) AS INT), 1) AS INT))),
      lambda a, p: CAST(substr('{_VD}', 10 * a + p + 1, 1) AS INT)) AS c FROM d)
    SELECT c_custkey, c = 0 AS valid FROM e""",
)
def verhoeff_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr("c_custkey", "'2' || lpad(string(c_custkey * 7919), 11, '3') AS t")
    return rows.select("c_custkey", checks.verhoeff("t").alias("valid"))


@query(
    "luhn_valid",
    """WITH d AS (SELECT l_orderkey, l_linenumber, '4' || lpad(CAST(l_orderkey * 7919 + l_partkey AS VARCHAR), 15, '1') AS t FROM lineitem),
    e AS (SELECT *, list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse(t), i + 1, 1) AS INT)
      WHEN CAST(substr(reverse(t), i + 1, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse(t), i + 1, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse(t), i + 1, 1) AS INT) END)) AS c FROM d)
    SELECT l_orderkey, l_linenumber, c % 10 = 0 AS valid FROM e""",
)
def luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "'4' || lpad(string(l_orderkey * 7919 + l_partkey), 15, '1') AS t"
    )
    return rows.select("l_orderkey", "l_linenumber", checks.luhn("t").alias("valid"))


@query(
    "aadhaar_ids",
    f"""WITH d AS (SELECT c_custkey AS key, '2' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '3') AS n FROM customer),
    e AS (SELECT key, n, list_reduce(list_prepend(0, list_transform(range(0, 12), lambda i: CAST(substr('{_VP}', 10 * (i % 8) + 1 + CAST(substr(reverse(n), i + 1, 1) AS INT), 1) AS INT))),
      lambda a, p: CAST(substr('{_VD}', 10 * a + p + 1, 1) AS INT)) AS c FROM d)
    SELECT key, n AS original FROM e WHERE c = 0""",
)
def aadhaar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key", "'number ' || '2' || lpad(string(c_custkey * 7919), 11, '3') || ' there' AS text"
    )
    found = redaction.findings(rows, "text", ["key"], only("DET8", enable_data_cleaning=False))
    return found.select("key", "original")


_MASK = "text || ' call 555-123-4567 or mail jo.doe@x.example.com, 123-45-6789'"
_MASKED = "t"
for _p, _tok in mask.LOG_MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '{_tok}', 'g')"


@query("log_mask", f"SELECT conv_id, turn, {_MASKED} AS masked FROM (SELECT conv_id, turn, {_MASK} AS t FROM conversations)")
def log_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", mask.mask_log(F.expr(_MASK)).alias("masked"))


_SHOWN = "replace(left(text, 100), chr(10), ' ')"
for _p, _tok in mask.PREVIEW_MASKS:
    _SHOWN = f"regexp_replace({_SHOWN}, '{_p.replace(chr(92) + 'b', '').replace(chr(92) + 'w', chr(92) + 'pL' + chr(92) + 'pN_') if '@' in _p else _p}', '{_tok}', 'g')"
_SHOWN = _SHOWN.replace(r"\.\pL\pN_+", r"\.[\pL\pN_]+")


@query(
    "safe_preview",
    f"SELECT doc_id, '[' || length(text) || ' chars] ' || {_SHOWN} || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview FROM documents",
)
def safe_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", mask.safe_preview("text").alias("preview"))


@query(
    "safe_details",
    "SELECT event_id, CAST(length(props) AS VARCHAR) AS text_length, event_type AS kind FROM events",
)
def safe_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "event_id", mask.safe_details(F.create_map(F.lit("text"), "props", F.lit("kind"), "event_type")).alias("d")
    )
    return rows.select("event_id", F.col("d")["text_length"].alias("text_length"), F.col("d")["kind"].alias("kind"))


_HOSTILE = (
    "CASE c_custkey % 5 WHEN 0 THEN c_name || '; DROP TABLE x' WHEN 1 THEN c_name || ' | bash' "
    "WHEN 2 THEN '<script>' || c_name WHEN 3 THEN '../' || c_name ELSE c_name END"
)


@query(
    "injection_flags",
    """SELECT c_custkey, c_custkey % 5 > 3 AS is_safe, CASE c_custkey % 5 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'command_injection'
    WHEN 2 THEN 'script_injection' WHEN 3 THEN 'path_traversal' ELSE '' END AS categories,
    CAST(CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS n_issues FROM customer""",
)
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_HOSTILE} AS t")
    seen = rows.select("c_custkey", sanitize.inspect("t").alias("i"))
    return seen.select(
        "c_custkey", "i.is_safe", F.array_join("i.categories", ",").alias("categories"),
        F.size("i.issues").cast("bigint").alias("n_issues"),
    )


@query(
    "sanitized",
    "SELECT o_orderkey, o_orderpriority || 'xy' AS text, TRUE AS was_modified, CAST(2 AS BIGINT) AS removed_chars, 'Removed 2 control character(s)' AS warnings FROM orders",
)
def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority || chr(7) || 'x' || chr(127) || 'y' AS t")
    done = rows.select("o_orderkey", sanitize.sanitize("t", detect=True).alias("s"))
    return done.select(
        "o_orderkey", "s.text", "s.was_modified", F.col("s.removed_chars").cast("bigint").alias("removed_chars"),
        F.array_join("s.warnings", "; ").alias("warnings"),
    )


@query(
    "escaped_html",
    "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS escaped FROM pages",
)
def escaped_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sanitize.escape_html("html").alias("escaped"))


@query(
    "text_stats",
    r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS length, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines,
    regexp_matches(text, '[^\x00-\x7f]') AS has_unicode, regexp_matches(text, '[\x00-\x1f\x7f]') AS has_control_chars, FALSE AS has_null_bytes FROM documents""",
)
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", sanitize.text_stats("text").alias("s")).select("doc_id", "s.*")
    return rows.withColumns({"length": F.col("length").cast("bigint"), "lines": F.col("lines").cast("bigint")})


@query(
    "row_quarantine",
    "SELECT CASE WHEN length(text) > 5000 THEN 'Text exceeds maximum length of 5000 characters' ELSE 'valid' END AS reason, count(*) AS n FROM documents GROUP BY 1",
)
def row_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(sanitize.row_error("text", 5000).alias("e"))
    return rows.groupBy(F.coalesce("e", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "row_totals",
    "SELECT count(*) AS total_rows, count(*) FILTER (length(text) > 5000) AS error_count FROM documents",
)
def row_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(sanitize.row_error("text", 5000).alias("error"))
    return audit.row_totals(rows, "error")


@query(
    "request_ids_and_filenames",
    """SELECT c_custkey, c_custkey % 2 = 0 AS id_ok, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Invalid filename: path traversal detected'
    ELSE 'File type not allowed' END AS name_error FROM customer""",
)
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "IF(c_custkey % 2 = 0, 'req-' || c_custkey || '_a', 'req ' || c_custkey) AS r",
        "CASE c_custkey % 3 WHEN 0 THEN 'f' || c_custkey || '.csv' WHEN 1 THEN '../f.csv' ELSE 'f' || c_custkey || '.exe' END AS f",
    )
    return rows.select("c_custkey", sanitize.valid_request_id("r").alias("id_ok"), sanitize.filename_error("f").alias("name_error"))


@query(
    "suspicious_pages",
    r"SELECT page_id, regexp_matches(html, '(?i)<script|javascript:|=cmd\||=HYPERLINK\s*\(|@SUM\(|=DDE\s*\(|on\w+\s*=\s*[\x22\x27]|<\s*iframe|<\s*object|<\s*embed|data:\s*text/html') AS suspicious FROM pages",
)
def suspicious_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sanitize.suspicious("html").alias("suspicious"))


# -- audit ---------------------------------------------------------------------


@query(
    "token_counts",
    f"SELECT source, '[' || pi_type || ']' AS token, count(*) AS n FROM {_found('source')} GROUP BY ALL",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "text")
    done = redaction.redact_columns(rows, ["text"], PLAIN)
    counts = audit.token_counts(done, "text_cleaned", ["source"])
    return counts.select("source", F.concat(F.lit("["), "token", F.lit("]")).alias("token"), "n")


@query(
    "most_common_type",
    f"SELECT source, arg_min(pi_type, (-n, pi_type)) AS most_common FROM (SELECT source, pi_type, count(*) AS n FROM {_found('source')} GROUP BY ALL) GROUP BY source",
)
def most_common_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text", ["source"], PLAIN)
    return audit.most_common(audit.count_by(found, "source", "pi_type"), ["source"])


@query(
    "audit_report",
    f"WITH c AS (SELECT pi_type, count(*) AS n FROM {_found('doc_id')} GROUP BY ALL) "
    "SELECT (SELECT count(*) FROM documents) AS total_rows, CAST(sum(n) AS BIGINT) AS total_redactions, count(*) AS redaction_types, "
    "arg_min(pi_type, (-n, pi_type)) AS most_common, string_agg(pi_type || '=' || n, ',' ORDER BY pi_type) AS redactions FROM c",
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = audit.report(table(spark, sf_dir, "documents"), "text", PLAIN)
    shown = F.array_join(F.transform(F.map_entries("redactions"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return row.select("total_rows", "total_redactions", "redaction_types", "most_common", shown.alias("redactions"))


@query(
    "top_sources",
    f"SELECT source, count(*) AS n FROM {_found('source')} GROUP BY source ORDER BY n DESC, source LIMIT 5",
)
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text", ["source"], PLAIN)
    return audit.top_groups(audit.count_by(found, "source"), 5, tie="source")


_LABELLED = _found("d.doc_id, l.quality", "documents d JOIN labels l ON d.doc_id = l.doc_id")


@query("findings_by_label", f"SELECT quality, pi_type, count(*) AS n FROM {_LABELLED} GROUP BY ALL")
def findings_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text", ["doc_id"], PLAIN)
    per_doc = found.groupBy("doc_id", "pi_type").agg(F.count("*").alias("n"))
    joined = per_doc.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "pi_type").agg(F.sum("n").alias("n"))


@query(
    "conversation_findings_per_role",
    f"SELECT role, count(*) AS n FROM {_found('role', '(SELECT role, text || chr(32) || conv_id || chr(64) || chr(97) || chr(46) || chr(101) || chr(117) AS text FROM conversations)')} GROUP BY role",
)
def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("role", "text || ' ' || conv_id || '@a.eu' AS text")
    return audit.count_by(redaction.findings(rows, "text", ["role"], PLAIN), "role")


@query("batch_totals", "SELECT conv_id, count(*) AS batch_size, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.batch_totals(table(spark, sf_dir, "conversations"), "text", ["conv_id"])


@query(
    "request_metrics",
    "SELECT event_type, count(*) AS requests, round(sum(value), 4) AS total_ms, round(avg(value), 4) AS mean_ms, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY event_type",
)
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.request_metrics(table(spark, sf_dir, "events"), ["event_type"], "value", F.col("event_type") == "error")
    return out.withColumns({"total_ms": F.round("total_ms", 4), "mean_ms": F.round("mean_ms", 4)})


@query(
    "latency_histogram",
    "SELECT event_type, b AS le, count(*) FILTER (value <= b) AS n FROM events, (SELECT unnest([0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0])::DOUBLE AS b) GROUP BY event_type, b "
    "UNION ALL SELECT event_type, NULL, count(value) FROM events GROUP BY event_type",
)
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(table(spark, sf_dir, "events"), "value", audit.LATENCY_BOUNDS, ["event_type"])


@query("labelled_sum", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def labelled_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.labelled_sum(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.withColumn("total", F.round("total", 2))


# -- joins -----------------------------------------------------------------------


@query(
    "dictionary_name_hits",
    r"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\pL]+')) AS word FROM documents), "
    "b AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\pL]+')) AS name FROM benchmark) "
    "SELECT doc_id, word, count(*) AS n FROM w WHERE word <> '' AND word IN (SELECT name FROM b WHERE name <> '') GROUP BY ALL",
)
def dictionary_name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = relational.words_of(table(spark, sf_dir, "benchmark"), "text", ["item_id"]).select(F.col("word").alias("name"))
    words = relational.words_of(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return relational.dictionary_hits(words, names)


@query(
    "excluded_findings",
    f"SELECT doc_id, m AS original FROM {_found('doc_id')} WHERE pi_type = 'EMAIL' AND split_part(lower(m), '@', 2) NOT IN (SELECT 'mail' || n_nationkey || '.example.com' FROM nation WHERE n_regionkey < 2)",
)
def excluded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redaction.findings(table(spark, sf_dir, "documents"), "text", ["doc_id"], only("DET7", enable_data_cleaning=False))
    blocked = table(spark, sf_dir, "nation").filter("n_regionkey < 2").selectExpr("'mail' || n_nationkey || '.example.com' AS domain")
    return relational.without_excluded(found, blocked, "domain", by_domain=True).select("doc_id", "original")


@query(
    "email_near_number",
    rf"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '(\d+)') AS m, string_split_regex(text, '\d+') AS g FROM documents),
    i AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM n),
    d AS (SELECT doc_id, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS s, length(m[k]) AS z FROM i),
    e AS (SELECT doc_id, m, strpos(text, m) - 1 AS s FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_EDGE}({_EMAIL})', 2)) AS m FROM documents))
    SELECT e.doc_id, CAST(e.s AS BIGINT) AS start, CAST(d.s AS BIGINT) AS r_start FROM e JOIN d ON e.doc_id = d.doc_id AND d.s >= e.s - 100 AND d.s + d.z <= e.s""",
)
def email_near_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mails = redaction.findings(docs, "text", ["doc_id"], only("DET7", enable_data_cleaning=False)).select("doc_id", "start", "end")
    numbers = span_offsets(spark, sf_dir).select(
        "doc_id", F.col("start").alias("r_start"), (F.col("start") + F.length("original")).alias("r_end")
    )
    pairs = relational.near_pairs(mails, numbers, "doc_id")
    return pairs.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("r_start").cast("bigint").alias("r_start"))


_ENTITIES = (
    "doc_id", "0 AS start", "4 AS end",
    "CASE doc_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' WHEN 2 THEN 'GPE' ELSE 'PERSON' END AS label",
    "CASE doc_id % 4 WHEN 0 THEN 'Joao' WHEN 1 THEN 'Tata' WHEN 2 THEN 'Oslo' ELSE 'Duo' END AS text",
)


@query(
    "entity_findings",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'NAME' WHEN 1 THEN 'ORG' ELSE 'LOCATION' END AS pi_type FROM documents WHERE doc_id % 4 < 3",
)
def entity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "documents").selectExpr(*_ENTITIES)
    return relational.entity_findings(entities).select("doc_id", "pi_type")


@query(
    "entities_merged_with_rules",
    f"SELECT doc_id, pi_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, pi_type FROM {_found('doc_id')} WHERE pi_type = 'EMAIL' UNION ALL "
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'NAME' WHEN 1 THEN 'ORG' ELSE 'LOCATION' END FROM documents WHERE doc_id % 4 < 3) GROUP BY ALL",
)
def entities_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    extra = relational.entity_findings(docs.selectExpr(*_ENTITIES))
    config = only("DET7", enable_data_cleaning=False)
    merged = relational.merge_candidates(docs, "text", "doc_id", extra, config)
    return audit.count_by(merged, "doc_id", "pi_type")


@query(
    "dictionary_findings",
    "SELECT c_custkey, CAST(5 AS BIGINT) AS start, original FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Rahul Xyz' WHEN 1 THEN 'Abc Emma' END AS original FROM customer) WHERE original IS NOT NULL",
)
def dictionary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "'Dear ' || CASE c_custkey % 3 WHEN 0 THEN 'Rahul Xyz' WHEN 1 THEN 'Abc Emma' ELSE 'Abc Xyz' END || ' and ' || c_custkey AS text",
    )
    names = table(spark, sf_dir, "nation").selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN 'Rahul' ELSE 'EMMA' END AS name")
    found = relational.dictionary_findings(rows, "text", "c_custkey", names, config=RedactionConfig(enable_data_cleaning=False))
    return found.select("c_custkey", F.col("start").cast("bigint").alias("start"), "original")


@query(
    "redacted_with_names",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'Dear [NAME] and [EMAIL]' ELSE 'Dear Abc Xyz and [EMAIL]' END AS text_cleaned FROM customer",
)
def redacted_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "'Dear ' || CASE c_custkey % 3 WHEN 0 THEN 'Rahul Xyz' WHEN 1 THEN 'EMMA PARK' ELSE 'Abc Xyz' END || ' and u' || c_custkey || '@mail.example.com' AS text",
    )
    names = table(spark, sf_dir, "nation").selectExpr("CASE WHEN n_nationkey % 2 = 0 THEN 'Rahul' ELSE 'EMMA' END AS name")
    config = only("DET7", enable_data_cleaning=False)
    extra = relational.dictionary_findings(rows, "text", "c_custkey", names, config=config)
    return relational.redact_with(rows, "text", "c_custkey", extra, config).select("c_custkey", "text_cleaned")


# -- nested ----------------------------------------------------------------------

_JSON = "'{\"who\":{\"mail\":\"u' || c_custkey || '@mail.example.com\",\"n\":' || c_custkey || '},\"tags\":[\"x\",\"10.0.0.1\"]}'"


@query(
    "redacted_json",
    "SELECT c_custkey, '{\"who\":{\"mail\":\"[EMAIL]\",\"n\":' || c_custkey || '},\"tags\":[\"x\",\"[IP_V4]\"]}' AS doc FROM customer",
)
def redacted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_JSON} AS doc")
    return nested.redact_json(rows, "doc", "who struct<mail:string,n:bigint>, tags array<string>", PLAIN)


@query(
    "json_leaves",
    "SELECT c_custkey, '$.who.mail' AS path, 'u' || c_custkey || '@mail.example.com' AS text FROM customer UNION ALL "
    "SELECT c_custkey, '$.tags[0]', 'x' FROM customer UNION ALL SELECT c_custkey, '$.tags[1]', '10.0.0.1' FROM customer",
)
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_rows(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_JSON} AS doc")
    return nested.json_leaves(rows, "doc", ["c_custkey"])


@query(
    "html_text_chars",
    r"SELECT page_id, CAST(length(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>', '', 'g')) AS BIGINT) AS chars FROM pages",
)
def html_text_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = nested.html_parts("html")
    text = F.aggregate(parts, F.lit(0), lambda a, p: a + F.when(p.kind == "text", F.length(p.part)).otherwise(0))
    return table(spark, sf_dir, "pages").select("page_id", text.cast("bigint").alias("chars"))


_STRIPPED = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>', chr(10), 'g')"


@query(
    "redacted_pages",
    f"SELECT page_id, CAST(1 + len(regexp_extract_all({_STRIPPED}, '{_EDGE}{_EMAIL}')) AS BIGINT) AS mails FROM pages",
)
def redacted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "'<p title=\"a@b.example.com\">a@b.example.com</p>' || html AS html")
    done = nested.redact_html(rows, "html", only("DET7", enable_data_cleaning=False))
    return done.select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"\[EMAIL\]"), F.lit(0))).cast("bigint").alias("mails"))


@query(
    "redacted_json_text",
    "SELECT c_custkey, '{\"who\": {\"mail\":\"[EMAIL]\", \"n\":1.50, \"mail\\u0040\":' || c_custkey || 'e0}, \"d\":' || repeat('[{\"k\": ', 40) || '\"[IP_V4]\"' || repeat('}]', 40) || '}' AS doc FROM customer",
)
def redacted_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON 80 levels deep, with numbers, blanks and escaped keys that come back as written."""
    doc = (
        "'{\"who\": {\"mail\":\"u' || c_custkey || '@mail.example.com\", \"n\":1.50, \"mail' || chr(92) || 'u0040\":' || c_custkey || 'e0}, \"d\":' "
        "|| repeat('[{\"k\": ', 40) || '\"10.0.0.1\"' || repeat('}]', 40) || '}'"
    )
    rows = short_rows(spark, sf_dir, "customer").selectExpr("c_custkey", f"{doc} AS doc")
    return nested.redact_json_text(rows, "doc", PLAIN)


_PAGE = "'<p title=\"1>2 {0}\">{1} &amp; more</p><!-- by {1} --><![CDATA[ {1} ]]>' || {2}"


@query(
    "redacted_pages_whole",
    "SELECT page_id, " + _PAGE.format("a@b.example.com", "[EMAIL]", _replace("html", (_EMAIL, "[EMAIL]"))) + " AS html FROM pages",
)
def redacted_pages_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages: addresses in text, comments and CDATA go, attributes and all other bytes stay."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", _PAGE.format("a@b.example.com", "a@b.example.com", "html") + " AS html")
    return nested.redact_html(rows, "html", only("DET7", enable_data_cleaning=False))


# -- places in the raw text --------------------------------------------------------

# A lead that cleaning shortens: invisible, typographic and blank characters, entities, line breaks.
_RAW = "'\u200b \u2026  &amp;amp;\t&#x41;\u00ad mail' || {0} || '@raw.example.com &lt;\u201c\r\n\r\n\r\n ' || {1}"


@query(
    "findings_in_raw_text",
    rf"""WITH r AS (SELECT page_id, {_RAW.format("page_id", "html")} AS html FROM pages),
    p AS (SELECT page_id, regexp_extract_all(html, '{_EMAIL}') AS m, string_split_regex(html, '{_EMAIL}') AS g FROM r),
    i AS (SELECT page_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM p),
    j AS (SELECT page_id, m[k] AS raw_original, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS raw_start FROM i)
    SELECT page_id, raw_start, CAST(raw_start + length(raw_original) AS BIGINT) AS raw_end, raw_original FROM j""",
)
def findings_in_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses found in cleaned pages, at their places in the pages as given."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", _RAW.format("page_id", "html") + " AS html")
    found = raw.findings(rows, "html", ["page_id"], only("DET7"))
    return found.select("page_id", F.col("raw_start").cast("bigint").alias("raw_start"), F.col("raw_end").cast("bigint").alias("raw_end"), "raw_original")


@query(
    "redacted_raw_pages",
    f"WITH r AS (SELECT page_id, {_RAW.format('page_id', 'html')} AS html FROM pages) SELECT page_id, {_replace('html', (_EMAIL, '[EMAIL]'))} AS html FROM r",
)
def redacted_raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in which addresses are replaced and every other byte stays, though they were found in cleaned text."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", _RAW.format("page_id", "html") + " AS html")
    return raw.redacted(rows, "html", only("DET7"), out="html")


# -- errors and records ----------------------------------------------------------

_BROKEN = "IF(doc_id % 7 = 0, CAST(concat(CAST(text AS BINARY), X'C3') AS STRING), text) AS text"


@query(
    "row_errors",
    "SELECT doc_id, 'text' AS \"column\", 'text is not valid UTF-8' AS reason FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL",
)
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, some with bytes that are no UTF-8: these land in the error table."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", _BROKEN)
    return errors.error_table(errors.redact_checked(rows, ["text"], PLAIN), ["doc_id"]).select("doc_id", "column", "reason")


@query(
    "rows_beside_errors",
    f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text_cleaned END AS text_cleaned FROM ({ORACLES['redacted_documents']})",
)
def rows_beside_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents: bad values are never passed on, all other rows come out redacted."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", _BROKEN)
    return errors.good_rows(errors.redact_checked(rows, ["text"], PLAIN)).select("doc_id", "text_cleaned")


@query(
    "csv_records",
    "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars, source FROM (SELECT doc_id, nullif(text, '') AS text, source FROM documents)",
)
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as CSV with quoted line breaks, and read back in splits."""
    folder = staging.shared_folder(spark, "csv-query")
    files.write(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), folder, "csv")
    rows = read_csv(spark, folder).rows
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(F.encode("text", "utf-8")).alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), "source")


# -- streams ---------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    fallback = None
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        fallback = tempfile.mkdtemp(prefix="sparkveil-")
    return pipelines.checkpoint_dir(spark, f"{name}-{uuid.uuid4().hex}", fallback)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; it may be one file or a folder of many."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, as a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query("stream_findings", ORACLES["redacted_documents"])
def stream_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stream-redaction")
    stream = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    done = pipelines.redact_stream(stream, ["text"], PLAIN).select("doc_id", "text_cleaned")
    pipelines.append(done, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_log_mask", ORACLES["log_mask"])
def stream_log_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stream-mask")
    stream = _stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_MASK).alias("masked"))
    pipelines.append(pipelines.mask_stream(stream, "masked"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_WINDOWED = (
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS requests, "
    "count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value <= 10.0) AS le_9 FROM events GROUP BY ALL"
)


@query("windowed_metrics", _WINDOWED)
def windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.windowed_metrics(
        table(spark, sf_dir, "events"), "ts", ["event_type"], "value", F.col("event_type") == "error"
    )
    return out.select("window_start", "event_type", "requests", "errors", "le_9")


@query(
    "stream_windowed_metrics",
    f"SELECT * FROM ({_WINDOWED}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def stream_windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "stream-windows")
    out = pipelines.windowed_metrics(
        _stream(spark, sf_dir, "events"), "ts", ["event_type"], "value", F.col("event_type") == "error"
    )
    pipelines.append(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("window_start", "event_type", "requests", "errors", "le_9")
