"""Long chains neither overflow the stack nor change what the patterns find; nothing is cut or refused by size."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import sanitize
from sparkveil.operators import redaction
from sparkveil.plans.catalog import FAMILIES

# The same languages, written with ordinary repeats.
PLAIN = {
    "EMAIL_PARTIAL_LASTNAME": r"(?<![a-zA-Z0-9])\.[a-zA-Z]{2,20}@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}\b",
    "EMP_ID_UPN_NUMERIC": r"\b(\d{4,8})@(?:tcs|tcsapps|tcsappsdev|tcscomprod|tata|tataconsultancy)(?:\.[a-z]+)*\.com\b",
    "FQDN_INTERNAL": r"\b([a-zA-Z][a-zA-Z0-9-]{0,62}(?:\.[a-zA-Z][a-zA-Z0-9-]{0,62})+\.(?:local|internal|corp|lan|intra|private|home))\b",
    "FQDN": r"(?<![@:/])\b(?!www\.)([a-zA-Z][a-zA-Z0-9-]{0,62}(?:\.[a-zA-Z][a-zA-Z0-9-]{0,62}){2,})\b(?![@])",
    "LDAP_DN": r"\b(?:CN|OU|DC|UID)=[^,\s]+(?:,\s*(?:CN|OU|DC|UID)=[^,\s]+)+",
    "LOCATION_UNDERSCORE_ODC": r"\b[A-Z]{2,4}\d?_(?:[A-Z0-9]{1,4}_)*(?:ODC\d*|[A-Z]?\d+F)(?:_[A-Z0-9]+)*\b",
    "LOCATION_UNDERSCORE_TOWER": r"\b(?:IND|USA|UK|EUR|APAC|EMEA|BLR|CHN|HYD|MUM|PUN|DEL)_[A-Z]{2,5}_[A-Z]{2,5}_[A-Z]?\d+(?:_[A-Z0-9_]+)*\b",
}
PARTS = {
    "EMAIL_PARTIAL_LASTNAME": [".ab@", "x", ".", "co", "com", "-", "1", "é", " ", "@", "a.b."],
    "EMP_ID_UPN_NUMERIC": ["12345@tcs", "1234@tata", ".", "com", ".com", "ab", "-", " ", "1", ".comx"],
    "FQDN_INTERNAL": ["a", ".", "lan", ".local", ".corp", "-", "1", " ", "é", "b" * 62, "www.", ".home"],
    "FQDN": ["a", ".", "bc", "@", "-", "1", " ", "é", "b" * 62, "www.", "/", ":", ".c"],
    "LDAP_DN": ["CN=", "a", ",", " ", "OU=b", ", DC=c", "=", "uid=", "\n"],
    "LOCATION_UNDERSCORE_ODC": ["AB1_", "A1_", "ODC", "1", "F", "_", "2F", "٣", "é", " ", "ODC2_", "ABCDE"],
    "LOCATION_UNDERSCORE_TOWER": ["IND_AB_CD_", "1", "A1", "_", "B", "é", " ", "__"],
}
DETECTORS = {d.name: d for f in FAMILIES for d in f.detectors}


@pytest.mark.parametrize("name", PLAIN)
def test_rewritten_patterns_find_the_same(name):
    detector = DETECTORS[name]
    flags = re.IGNORECASE if detector.icase else 0
    new, old = re.compile(detector.pattern, flags), re.compile(PLAIN[name], flags)
    chance, found = random.Random(name), 0
    for _ in range(20_000):
        text = "".join(chance.choices(PARTS[name], k=chance.randint(1, 9)))
        want = [(m.span(), m.groups()) for m in old.finditer(text)]
        found += bool(want)
        assert [(m.span(), m.groups()) for m in new.finditer(text)] == want, text
    assert found > 100


LONG = [
    "ab." * 6000,
    "CN=a," * 6000,
    "AB1_" + "A1_" * 4000 + "ODC1",
    ".ab@" + "ab." * 6000 + "com",
    "12345@tcs" + ".ab" * 6000 + ".com",
    "IND_AB_CD_1" + "_" * 6000 + "é",
    "host." + "ab." * 6000 + "local",
    "S-1-5" + "-21" * 6000,
]


def test_long_chains_come_through(spark):
    df = spark.createDataFrame([(i, f"{t} mail a.b@x.example") for i, t in enumerate(LONG)], "i int, t string")
    rows = {r["i"]: r["t_cleaned"] for r in redaction.redact_columns(df, ["t"]).collect()}
    assert len(rows) == len(LONG) and not any("a.b@x.example" in t for t in rows.values())
    assert "CN=a,CN=a" not in rows[1] and "ODC1" not in rows[2] and "ab.ab" not in rows[6]


def test_no_size_is_cut_or_refused(spark):
    df = spark.range(1).select(F.repeat(F.lit("abcdefghij"), 1_100_000).alias("t"))
    row = df.select(F.length(sanitize.sanitize("t")["text"]), sanitize.row_error("t")).first()
    assert tuple(row) == (11_000_000, None)
    late = df.select(F.encode(F.concat("t", F.lit("<iframe src=a>")), "utf-8").alias("c"))
    error = late.select(sanitize.file_error(F.lit("a.txt"), F.length("c"), "c")).first()[0]
    assert error == "File contains potentially malicious content"
    assert df.select(sanitize.file_error(F.lit("a.txt"), F.lit(10), F.lit(b"abc"), max_size=5)).first()[0].startswith("File exceeds")


@pytest.mark.parametrize("form", ["NFD", "NFKD"])
def test_decomposed_forms_in_the_chain(spark, form):
    df = spark.createDataFrame([(0, "café ﬁ"), (1, None), (2, "plain"), (3, "")], "i int, t string")
    config = sanitize.SanitizerConfig(unicode_normalization=form, escape_html=True)
    rows = {r["i"]: r["s"] for r in df.select("i", sanitize.sanitize("t", config).alias("s")).collect()}
    assert rows[0].text == unicodedata.normalize(form, "café ﬁ") and rows[0].was_modified
    assert rows[0].warnings == [f"Text was Unicode normalized ({form})"]
    assert rows[1] is None or rows[1].text is None
    assert rows[2].text == "plain" and not rows[2].was_modified and rows[3].text == ""


def test_more_marks_than_sixty_three(spark):
    text = "e" + "̖" * 70 + "́ x"
    df = spark.createDataFrame([("é" + "̖" * 100,), ("ǻ" + "̸" * 70 + "ö",), (text,)], "t string")
    rows = [r[0] for r in df.select(sanitize.unicode_form("t", "NFC")).collect()]
    assert rows[0] == "é" + "̖" * 100 and rows[1] == "ǻ" + "̸" * 70 + "ö"
