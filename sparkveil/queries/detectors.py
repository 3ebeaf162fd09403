"""One query per detector: findings over text derived from the tables, and over documents.

Text is derived with the same expression in Spark and in the check SQL, so every row of the
table is used and the key tells what must be found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkveil.operators.redaction import findings
from sparkveil.plans.config import RedactionConfig, only
from sparkveil.sources.files import dealt, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out where the session asks for it."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def short_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of many short rows, each of which is worked on for long."""
    return dealt(table(spark, sf_dir, name))


def shown(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("key").cast("bigint").alias("key"),
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
        "original",
        "replacement",
    )


def derived(
    name: str, source: str, key: str, text: str, config: RedactionConfig, *expected: tuple[str, int, str], where: str = "TRUE"
) -> None:
    """Register findings over ``text``. ``expected``: RE2 pattern, group, token (or SQL in braces)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = short_rows(spark, sf_dir, source).selectExpr(f"{key} AS key", f"{text} AS text")
        return shown(findings(rows, "text", ["key"], config.with_(enable_data_cleaning=False)))

    items = ", ".join(
        f"{{'v': regexp_extract(t, '{p}', {g}), 'r': {tok[1:-1] if tok.startswith('{') else repr(tok)}}}"
        for p, g, tok in expected
    )
    QUERIES[name] = run
    ORACLES[name] = (
        f"WITH d AS (SELECT {key} AS key, {text} AS t FROM {source}), "
        f"x AS (SELECT key, t, unnest([{items}]) AS m FROM d) "
        "SELECT CAST(key AS BIGINT) AS key, CAST(strpos(t, m.v) - 1 AS BIGINT) AS start, "
        "CAST(strpos(t, m.v) - 1 + length(m.v) AS BIGINT) AS \"end\", m.v AS original, m.r AS replacement "
        f"FROM x WHERE m.v <> '' AND {where}"
    )


_C = "CAST(c_custkey AS STRING)"
_O = "CAST(o_orderkey AS STRING)"
_L = "CAST(l_orderkey AS STRING)"
_O8 = f"lpad({_O}, 8, '0')"
_C7 = "CAST(1000000 + c_custkey AS STRING)"
_HEX = f"lpad({_O}, 40, 'a1b2c3d4')"
_GUID = f"(lpad({_C}, 8, '0') || '-12ab-34cd-56ef-' || lpad({_C}, 12, '0'))"
_CUST = ("customer", "c_custkey")
_ORD = ("orders", "o_orderkey")

derived("credentials", *_ORD, f"CASE WHEN o_orderkey % 3 = 0 THEN 'password: reset now' ELSE 'password: Pw' || {_O} || 'x now' END", only("DET1"), (r"password: Pw\d+x", 0, "[CREDENTIAL]"))
derived("vpn_and_api_keys", *_ORD, f"'vpn password: s' || {_O} || ' and api_key=' || lpad({_O}, 24, 'k')", only("DET1"), (r"vpn password: s\d+", 0, "[CREDENTIAL_VPN]"), (r"api_key=[a-z0-9]+", 0, "[API_KEY]"))
derived("encryption_keys", *_ORD, f"'sha1 ' || {_HEX} || ' recovery key: AB-' || {_O8}", only("DET2"), (r"sha1 ([0-9a-f]{40})", 1, "[CERT_HASH]"), (r"recovery key: (\S+)", 1, "[RECOVERY_KEY]"))
derived("license_keys", *_CUST, f"'key AB12C-DE34F-' || lpad({_C}, 5, '0') || '-XY9ZZ for ci: SRV' || lpad({_C}, 7, '0')", only("DET3"), (r"AB12C\S+", 0, "[LICENSE_KEY]"), (r"ci: (\S+)", 1, "[CI_ID]"))
derived("session_tokens", *_ORD, f"'JSESSIONID=' || lpad({_O}, 20, 'q') || ' jwt eyJhbGci.eyJzdWIi' || {_O} || '.sig-' || {_O}", only("DET4"), (r"JSESSIONID=(\S+)", 1, "[SESSION_ID]"), (r"eyJ\S+", 0, "[JWT_TOKEN]"))
derived("database_strings", *_CUST, f"'use mongodb://u' || {_C} || ':pw@db' || {_C} || '/x or uid=u' || {_C} || '; db=1; pwd=s' || {_C}", only("DET5"), (r"mongodb\S+", 0, "[DB_URI]"), (r"uid=.*pwd=\w+", 0, "[DB_CREDS]"))
derived("urls_in_pages", "pages", "page_id", "'see ' || url || ' there'", only("DET6"), (r"(?i)(?:https?|ftp)://[^\s<>\"{}|\\^`\[\]]+", 0, "[URL]"))
derived("emails_with_numbers", *_CUST, f"CASE c_custkey % 4 WHEN 0 THEN 'mail ' || {_C7} || '@tcs.com ok' WHEN 1 THEN 'mail ad.' || {_C7} || '@mail.example.com ok' WHEN 2 THEN 'mail jo.do' || {_C} || '@mail.example.com ok' ELSE 'fix .tail@mail' || {_C} || '.example.com ok' END", only("DET7"), (r"\S+@\S+", 0, "{CASE key % 4 WHEN 0 THEN '[EMP_ID]@[DOMAIN]' WHEN 1 THEN 'AD.[EMP_ID]@[DOMAIN]' ELSE '[EMAIL]' END}"))
derived("excluded_emails", *_CUST, f"'mail user' || {_C} || CASE WHEN c_custkey % 2 = 0 THEN '@keep.example.com' ELSE '@mail.example.com' END", only("DET7", excluded_domains=frozenset({"keep.example.com"}), excluded_emails=frozenset({"user7@mail.example.com"})), (r"\S+@mail\.example\.com", 0, "[EMAIL]"), where="m.v <> 'user7@mail.example.com'")
derived("government_ids", *_CUST, f"'PAN ABCDE' || lpad({_C}, 4, '0') || 'F, passport K' || lpad({_C}, 7, '0') || ', ssn: 123-45-' || lpad({_C}, 4, '0') || ', nin AB' || lpad({_C}, 6, '0') || 'C, voter id: XYZ' || lpad({_C}, 7, '1')", only("DET8"), (r"ABCDE\d{4}F", 0, "[PAN]"), (r"K\d{7}", 0, "[PASSPORT]"), (r"ssn: \S+\d", 0, "[SSN]"), (r"AB\d{6}C", 0, "[NIN]"), (r"voter id: \w+", 0, "[VOTER_ID]"))
derived("driving_and_vehicle_ids", *_CUST, f"'DL MH02 2014 ' || lpad({_C}, 7, '0') || ' reg: KA01AB' || lpad({_C}, 4, '0')", only("DET8"), (r"MH02 2014 \d{7}", 0, "[DL]"), (r"reg: \w+", 0, "[VEHICLE_REG]"))
derived("phones_by_country", *_CUST, f"CASE c_custkey % 6 WHEN 0 THEN 'call +44 7405 ' || lpad({_C}, 6, '1') WHEN 1 THEN 'call 98765' || lpad({_C}, 5, '4') WHEN 2 THEN 'call 1-555-234-' || lpad({_C}, 4, '0') WHEN 3 THEN 'call 971-50-123-' || lpad({_C}, 4, '0') WHEN 4 THEN 'call (22)99902-' || lpad({_C}, 4, '0') ELSE 'call 86-138-1234-' || lpad({_C}, 4, '0') END", only("DET9"), (r"call \+?(\S.*)$", 1, "{'[PHONE_' || (['UK', 'IN', 'US', 'AE', 'BR', 'CN'])[CAST(key % 6 AS INT) + 1] || ']'}"))
derived("excluded_phones", *_CUST, f"'call ' || CASE WHEN c_custkey % 2 = 0 THEN '98765' ELSE '77765' END || lpad({_C}, 5, '4')", only("DET9", excluded_phones=frozenset({"987"})), (r"77765\d{5}", 0, "[PHONE_IN]"))
derived("employee_ids_labelled", *_CUST, f"CASE c_custkey % 5 WHEN 0 THEN 'emp id: ' || {_C7} WHEN 1 THEN 'teams #' || {_C7} WHEN 2 THEN 'unlock my account ' || {_C7} WHEN 3 THEN 'associate (' || {_C7} ELSE 'remove ' || {_C7} END", only("DET10"), (r"(?:emp id: |teams #|account )(\d+)", 1, "{CASE WHEN key % 5 = 1 THEN '[EMP_ID_TEAMS]' ELSE '[EMP_ID]' END}"), (r"(?:associate \(|remove )\d+", 0, "[EMP_ID]"))
derived("employee_accounts", *_CUST, f"'login ' || CASE c_custkey % 3 WHEN 0 THEN 'ad.' WHEN 1 THEN 'oth.' ELSE 'di.' END || {_C7} || ' and CN=' || {_C7} || ',OU=X'", only("DET10"), (r"(?:ad|oth|di)\.\d+", 0, "{'[EMP_ID_' || (['AD', 'OTH', 'DI'])[CAST(key % 3 AS INT) + 1] || ']'}"), (r"CN=\d+", 0, "CN=[EMP_ID_LDAP]"))
derived("employee_ids_scored", *_CUST, f"CASE c_custkey % 3 WHEN 0 THEN 'contact user ' || {_C7} || ' for help' WHEN 1 THEN 'we saw the total ' || {_C7} || ' for help' ELSE 'nothing was seen ' || CAST(10000 + c_custkey AS STRING) || ' there' END", only("DET10", "DET11"), (r"user (\d{7})", 1, "[EMP_ID]"))
derived("asset_ids", *_ORD, f"'asset 01HW' || {_O8} || ' S/N: AB' || {_O8}", only("DET12"), (r"01HW\d+", 0, "[ASSET_ID]"), (r"S/N: (\w+)", 1, "[SERIAL]"))
derived("rfid_tags", *_ORD, f"'tag E280' || lpad({_O}, 20, 'AF09')", only("DET13"), (r"E280\w{20}", 0, "[RFID_TAG]"))
derived("ip_and_mac", *_CUST, f"'from 10.' || CAST(c_custkey % 250 AS STRING) || '.3.4:8080 mac 00:1A:2B:3C:4D:' || lpad(CAST(c_custkey % 90 AS STRING), 2, '0') || ' v6 2001:db8:0:0:0:0:0:' || lpad({_C}, 4, '0')", only("DET14"), (r"10\.\S+", 0, "[IP_V4]"), (r"mac (\S+)", 1, "[MAC]"), (r"2001\S+", 0, "[IP_V6]"))
derived("hostnames", *_ORD, f"'host ER06SVR' || {_O8} || ' and INHYDB' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || ' there'", only("DET15"), (r"ER06\w+", 0, "[HOSTNAME_SVR]"), (r"INHYDB\d+", 0, "[HOSTNAME_GENERIC]"))
derived("fqdns", *_CUST, f"CASE c_custkey % 3 WHEN 0 THEN 'on db' || {_C} || '.prod.corp now' WHEN 1 THEN 'on app' || {_C} || '.eu.acme.org now' ELSE 'on docs' || {_C} || '.eu.google.com now' END", only("DET16"), (r"on (\S+(?:corp|acme\.org))", 1, "{CASE WHEN key % 3 = 0 THEN '[HOSTNAME_INTERNAL]' ELSE '[HOSTNAME_FQDN]' END}"))
derived("ticket_ids", *_ORD, f"CASE o_orderkey % 4 WHEN 0 THEN 'work on INC' || {_O8} WHEN 1 THEN 'work on RFC ' || {_O8} WHEN 2 THEN 'work on PR: ' || lpad({_O}, 7, '5') ELSE 'work on CR-' || {_O8} END", only("DET17"), (r"INC(\d+)", 1, "[TICKET_NUM]"), (r"RFC \d+", 0, "[RFC]"), (r"PR: \d+", 0, "[PR]"), (r"CR-\d+", 0, "[CR]"))
derived("security_incidents", *_CUST, f"'seen ES' || lpad({_C}, 6, '3') || ' at night'", only("DET18"), (r"ES\d{6}", 0, "[INCIDENT_ID]"))
derived("remote_access_ids", *_CUST, f"'anydesk id: 123 456 ' || lpad({_C}, 3, '0') || '; rdp: host-' || {_C}", only("DET19"), (r"id: ([\d ]+)", 1, "[REMOTE_ID]"), (r"rdp: (\S+)", 1, "[REMOTE_ID]"), where="length(m.v) <> 12")
derived("cloud_ids", *_CUST, f"'subscription id: ' || {_GUID} || ' arn:aws:s3::' || lpad({_C}, 12, '1') || ':bucket aws account id: ' || lpad({_C}, 12, '2')", only("DET20"), (r"subscription id: (\S+)", 1, "[AZURE_SUB]"), (r"arn:\S+", 0, "[AWS_ARN]"), (r"account id: (\d+)", 1, "[AWS_ACCOUNT]"))
derived("upi_ids", *_CUST, f"'pay user.' || {_C} || CASE WHEN c_custkey % 2 = 0 THEN '@paytm' ELSE '@other' END || ' now'", only("DET21"), (r"\S+@paytm", 0, "[UPI]"))
derived("bank_accounts", "lineitem", "l_orderkey", "'transfer to ' || lpad(CAST(l_orderkey * 7919 AS STRING), 12, '1') || ', IFSC HDFC0' || lpad(CAST(l_partkey AS STRING), 6, '0')", only("DET22"), (r"transfer to \d+", 0, "[BANK_ACCOUNT_IN]"), (r"HDFC0\w+", 0, "[IFSC]"))
derived("swift_iban_routing", *_CUST, f"'swift: HDFCINBB, iban GB82 WEST 1234 5698 7654 32, routing no: ' || lpad({_C}, 9, '2')", only("DET22"), (r"swift: \w+", 0, "[SWIFT]"), (r"GB82[ \w]+", 0, "[IBAN]"), (r"routing no: \d+", 0, "[ROUTING_NUM]"))
derived("cards_and_policies", "lineitem", "l_orderkey", f"'card 4111 1111 1111 ' || lpad(CAST(l_partkey % 10000 AS STRING), 4, '0') || ', uan: ' || lpad({_L}, 12, '1') || ', policy no: LIC-' || lpad({_L}, 8, '0')", only("DET23"), (r"4111[ \d]+", 0, "[CARD]"), (r"uan: \d+", 0, "[EPF_UAN]"), (r"policy no: \S+", 0, "[INSURANCE_POLICY]"))
derived("births_and_ages", *_ORD, "'born on ' || CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) || ', age: ' || CAST(o_orderkey % 90 AS STRING) || ' years'", only("DET24"), (r"born on [\d/]+", 0, "[DOB]"), (r"age: \d+ years", 0, "[AGE]"))
derived("directory_accounts", *_CUST, f"'CN=u' || {_C} || ',OU=Users,DC=corp; CORP' || chr(92) || 'jdoe' || {_C} || '; S-1-5-21-' || {_C} || '; svc.app' || {_C} || '; joe@dc' || {_C} || '.corp'", only("DET25"), (r"CN=(u\d+)", 1, "[AD_NAME]"), (r"jdoe\d+", 0, "[AD_USER]"), (r"S-1-5-21-\d+", 0, "[SID]"), (r"svc\.app\d+", 0, "[SERVICE_ACCT]"), (r"joe@dc\d+\.corp", 0, "[AD_UPN]"))
derived("service_accounts", *_CUST, f"'S-1-5-21-' || {_C} || ' and svc.app' || {_C} || ' and joe@dc' || {_C} || '.corp and NT' || lpad({_C}, 5, '7')", only("DET25"), (r"S-1-5-21-\d+", 0, "[SID]"), (r"svc\.\w+", 0, "[SERVICE_ACCT]"), (r"joe@\S+", 0, "[AD_UPN]"), (r"NT\d{5}", 0, "[SERVICE_ACCT]"))
derived("distinguished_names", *_CUST, f"'see CN=u' || {_C} || ',OU=Users,CN=x' || {_C} || ',DC=corp'", only("DET25"), (r"CN=(u\d+)", 1, "[AD_NAME]"), (r"CN=(x\d+)", 1, "[AD_NAME]"))
derived("windows_users", *_CUST, f"'in C:' || chr(92) || 'Users' || chr(92) || 'joe' || {_C} || chr(92) || 'docs'", only("DET26"), (r"joe\d+", 0, "[USERNAME]"))
derived("workplace", *_CUST, f"CASE c_custkey % 4 WHEN 0 THEN 'at TCB4/ODC1/WSN/' || {_C} WHEN 1 THEN 'badge no: ' || lpad({_C}, 6, '0') WHEN 2 THEN 'ext: ' || CAST(1000 + c_custkey % 9000 AS STRING) ELSE 'seat B2F-' || CAST(100 + c_custkey % 900 AS STRING) END", only("DET27"), (r"TCB4\S+", 0, "[LOCATION]"), (r"badge no: (\d+)", 1, "[BADGE_NUM]"), (r"ext: (\d+)", 1, "[EXT]"), (r"seat (\S+)", 1, "[SEAT]"))
derived("chat_handles", *_CUST, f"CASE WHEN c_custkey % 4 = 0 THEN 'hello @everyone now' ELSE 'hello @joe.' || {_C} || ' now' END", only("DET28"), (r"@(joe\.\d+)", 1, "[CHAT_USER]"))
derived("audit_users", *_CUST, f"'user u' || {_C} || ' logged in; logon by v' || {_C}", only("DET29"), (r"user (u\d+)", 1, "[AUDIT_USER]"), (r"by (v\d+)", 1, "[LOGIN_USER]"))

_FIRST = "(CASE c_custkey % 3 WHEN 0 THEN 'Rahul' WHEN 1 THEN 'Emma' ELSE 'Peter' END)"
derived("names_with_titles", *_CUST, f"'saw Mr. {{}} Sharma' || ' near ' || {_C}".replace("{}", "' || " + _FIRST + " || '"), only("NAM2"), (r"Mr\. \w+ Sharma", 0, "[NAME]"))
derived("names_labelled", *_CUST, f"CASE WHEN c_custkey % 2 = 0 THEN 'host name: ' || {_FIRST} ELSE 'my name is ' || {_FIRST} END", only("NAM2"), (r"my name is (\w+)", 1, "[NAME]"))
derived("names_in_context", *_CUST, f"'sent by ' || lower({_FIRST}) || CASE WHEN c_custkey % 2 = 0 THEN ' via mail' ELSE ' team' END || ' ' || {_C}", only("NAM3"), (r"sent by (\w+)", 1, "[NAME]"))
derived("names_near_emails", *_CUST, f"'{{}} Doe' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE repeat(' pad', 30) END || ' <' || lower({_FIRST}) || '.doe@mail.example.com>'".replace("'{}", _FIRST + " || '"), only("NAM4"), (r"^(\w+ Doe) <", 1, "[NAME]"))
derived("names_from_dictionary", *_CUST, f"'met Hello ' || {_FIRST} || CASE WHEN c_custkey % 5 = 0 THEN ' Park' ELSE ' Xyz' END || ' at ' || {_C}", only("NAM5"), (r"Hello (\w+ Xyz)", 1, "[NAME]"), (r"Hello (\w+) Park", 1, "[NAME]"))
derived("custom_pattern", *_ORD, f"'part ZX-' || {_O8} || ' here'", only("EXT1"), (r"ZX-\d+", 0, "[PART]"))


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkveil.plans.config import CustomPattern

    config = RedactionConfig(
        only=frozenset({"EXT1"}), enable_data_cleaning=False,
        custom_patterns=(CustomPattern("part", r"\bZX-\d+\b", "[PART]"),),
    )
    rows = short_rows(spark, sf_dir, "orders").selectExpr("o_orderkey AS key", f"'part ZX-' || {_O8} || ' here' AS text")
    return shown(findings(rows, "text", ["key"], config))


QUERIES["custom_pattern"] = _custom
