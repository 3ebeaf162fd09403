"""What a short row costs: no look past the first letter, no sums for one match, nothing carried along unasked."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import spans as S
from sparkveil.functions.detect import Plan
from sparkveil.functions.sql import apply, regex
from sparkveil.operators import redaction
from sparkveil.plans import catalog
from sparkveil.plans.config import RedactionConfig, only

TEXTS = [
    "card 4111 1111 1111 0007, uan: 111111000001, policy no: LIC-11100001",
    "UAN 123456789012 epf no 123456789012 pf 123456789012", "INSURANCE id AB-12345 Policy#XY1234567",
    "host ER06SVR00000001 and INHYDB07 there", "vpn password: s1 and api_key=kkkkkkkkkkkkkkkkkkkkkkk1",
    "Key API KEY: aaaaaaaaaaaaaaaaaaaaaaaaa", "ſs-1 sS-1-5-21-7 S-1-5-21-8", "١٢ emp id: 1234567 emp1234567", "", "x",
]


def test_first_letters():
    found = {p: "".join(sorted(S.first_letters(p))) for p in ("(?:uan|epf|pf)x", "(?:(?:ab|cd)|e)f", "[A-C]{2}", "b{2}")}
    assert found == {"(?:uan|epf|pf)x": "epu", "(?:(?:ab|cd)|e)f": "ace", "[A-C]{2}": "ABC", "b{2}": "b"}
    for pattern in ("(?:a|b)?c", "a*b", "a|b", r"(?:a|\+b)", r"\d", "[A-Z]?b", "(ab)", "a{0,2}b", "", "[^a]b"):
        assert not S.first_letters(pattern), pattern


def test_heads_lose_no_match(spark):
    """Each detector matches the same with and without what is tested first; most test the first letter."""
    letters = [d for _, d in catalog.all_detectors() if not d.head and S.first_letters(d.pattern.removeprefix(r"\b"))]
    assert len(letters) > 100
    assert sum("(?=[" in S.present("t", d) for d in letters) > 80
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plain = F.array(*[F.expr(f"t RLIKE {regex(d.pattern, d.icase)}") for d in letters])
    headed = F.array(*[F.expr(S.present("t", d)) for d in letters])
    assert [r[0] for r in rows.select(plain).collect()] == [r[0] for r in rows.select(headed).collect()]


@pytest.mark.parametrize("config", [only("DET23"), only("DET1"), only("DET15"), RedactionConfig()])
def test_findings_carry_no_raw_text(config):
    assert not any("'x', s" in stage for stage in Plan(config).found())


def test_one_match_and_many(spark):
    """Offsets of one match, of many, and of more than a block come out alike."""
    counts = [1, 2, 3, S.BLOCK, S.BLOCK + 1]
    rows = spark.createDataFrame([(n, " ".join(["ä 4111 1111 1111 1111,"] * n)) for n in counts], "n int, t string")
    got = {}
    for r in redaction.findings(rows, "t", ["n"], only("DET23", enable_data_cleaning=False)).collect():
        got.setdefault(r["n"], []).append((r["start"], r["end"], r["original"], r["pi_type"]))
    assert got == {n: [(23 * i + 2, 23 * i + 21, "4111 1111 1111 1111", "CARD") for i in range(n)] for n in counts}


def test_places_from_the_start_or_by_the_rules(spark):
    def kept(*spans):
        z = "array(" + ", ".join(f"named_struct('s', {s}, 'e', {e})" for s, e in spans) + ")"
        return spark.range(1).select(apply(F.expr(z), "z", S.resolve("z")).alias("k")).first()["k"]

    assert kept((0, 2), (2, 5), (5, 5), (9, 10)) == [0, 1, 2, 3]
    assert kept((0, 4), (2, 5), (5, 6)) == [0, 2]
    assert kept(("CAST(NULL AS INT)", 3), (1, 2)) == [1]


def test_many_gate_words_are_sought_in_leaps(spark):
    """The flags of many detectors seek longer words by pattern; what they say is the same."""
    many, few = Plan(RedactionConfig()).rows, Plan(only("DET1")).rows
    assert "RLIKE 'password'" not in S.flags("t", "l", few)
    words = [w for w in S.keywords(many) if len(w) > 4]
    assert words and all(S._holds("l", w, True) in S.flags("l", "l", many) and " RLIKE " in S._holds("l", w, True) for w in words)
    rows = spark.createDataFrame([(w,) for w in S.keywords(many)] + [(f"ä {w[:-1]}",) for w in words], "l string")
    leaps = F.array(*[F.expr(S._holds("l", w, True)) for w in words])
    plain = F.array(*[F.expr(S._holds("l", w, False)) for w in words])
    assert rows.where(leaps != plain).count() == 0
