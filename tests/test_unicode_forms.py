"""Native Unicode forms against the standard library, over all code points and generated sequences."""

import random
import sys
import unicodedata

import pytest

from sparkveil.functions.sql import apply
from sparkveil.functions.unicode import affected_sql, compatibility_sql


def _sequences():
    """Marks in any order, Hangul letters in any form, and characters that come apart, in short random texts."""
    rng = random.Random(9)
    marks = [chr(cp) for cp in range(0x300, 0x11700) if unicodedata.category(chr(cp))[0] == "M"]
    pairs = [chr(cp) for cp in range(0x80, 0x11A00) if unicodedata.decomposition(chr(cp))]
    hangul = [chr(cp) for cp in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C4), 0x3131, 0x314F, 0xFFA1, 0xFFC2, 0xAC00, 0xAC01, 0xD7A3, 0xD788)]
    letters = list("aeoAq \n") + [chr(0x9C7), chr(0x9BE), chr(0x1025), chr(0x102E), chr(0x11131), chr(0x11127)]
    every = [marks, marks[:60], pairs, hangul, hangul, letters]
    texts = ["".join(rng.choice(rng.choice(every)) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    return [*texts, "e" + "̖́" * 2000, "̖́abc", "́", "각" * 50]


@pytest.mark.parametrize("form", ["NFC", "NFKC", "NFD", "NFKD"])
def test_forms_are_those_of_the_standard_library(spark, form):
    single = [chr(cp) for cp in range(1, sys.maxunicode + 1) if not 0xD800 <= cp <= 0xDFFF and not 0xFDD0 <= cp <= 0xFDD2]
    texts = [",".join(single[i : i + 400]) for i in range(0, len(single), 400)] + _sequences()
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    done = df.withColumn("n", apply("t", "x", f"IF({affected_sql('x', form)}, {compatibility_sql('x', form)}, x)")).collect()
    wrong = [(r.t, r.n) for r in done if r.n != unicodedata.normalize(form, r.t)]
    assert not wrong, (len(wrong), [[hex(ord(c)) for c in t] for t, _ in wrong[:3] if len(t) < 20], [[hex(ord(c)) for c in n] for t, n in wrong[:3] if len(t) < 20])
