"""Raw places of cleaned characters and findings, against plain Python over (character, begin, end)."""

import random
import re
import unicodedata

import pytest
from conftest import SF

from sparkveil.functions import clean as C
from sparkveil.functions.clean import clean
from sparkveil.operators import raw, redaction
from sparkveil.plans.config import RedactionConfig

PARTS = [
    "a.b@x.example", "AKIA1234", "4111 1111 1111 1111", "10.0.0.1", "10.0.0.1:8080", "1.2.3", "+1.212.555.0100", "12  34", " ", "  ", "\t", "\n", " \n ", "\n\n\n\n", "\r\n", "\r",
    "\u200b", "\ufeff", "\u00ad", "\u00e9", "e\u0301", "\ufb01", "\uff76\uff9e", "\u00bd", "\u212b", "\uff21", "\u0430", "\U0001f600", "\u00e2\u20ac\u2122", "\u00e2\u20ac\u0153", '\u00e2\u20ac"',
    "\u00c3\u00a9", "\u00c3 ", "\u2018", "\u2014", "\u2026", "\u00a0", "&amp;", "&amp;lt;", "&lt;", "&#39;", "&#65;", "&#x41;", "&#x110000;", "&#99999999999;", "&nbsp;", "&amp;#64;", "\x00", "\x1b", "\ufdd0",
    "word", "Name", "q\u0301 ", "\u3000", "\x85", "\uac00",
]


def _swapped(chars, pattern, new):
    """Every match becomes ``new(match)``: (head, old length, new text) with head unchanged."""
    text, out, last = "".join(c for c, _, _ in chars), [], 0
    for m in re.finditer(pattern, text):
        head, old, put = new(m)
        at = m.start() + head
        out += chars[last:at]
        out += [(c, chars[at][1], chars[at + old - 1][2]) for c in put]
        last = at + old
    return out + chars[last:]


def _python_aligned(text):
    chars = [("\ufffd" if c in "\ufdd0\ufdd1\ufdd2" else c, i, i + 1) for i, c in enumerate(text)]
    late = lambda c: unicodedata.category(unicodedata.normalize("NFKC", c)[0])[0] == "M"
    clusters, out = [], []
    for c in chars:
        if clusters and late(c[0]):
            clusters[-1].append(c)
        else:
            clusters.append([c])
    for k in clusters:
        whole = "".join(c for c, _, _ in k)
        form = unicodedata.normalize("NFKC", whole)
        out += k if form == whole and len(k) == 1 else [(c, k[0][1], k[-1][2]) for c in form]
    chars = [(C.HOMOGLYPHS.get(c, c), b, e) for c, b, e in out]
    whole = lambda put: lambda m: (0, len(m.group()), put)
    chars = _swapped(chars, C.INVISIBLE, whole(""))
    for old, new in (*C.MOJIBAKE, *C.PUNCTUATION, *C.ENTITIES):
        chars = _swapped(chars, re.escape(old), whole(new))
    point = lambda m, n: (0, len(m.group()), chr(n) if n < 0x110000 else m.group())
    chars = _swapped(chars, r"&#(\d+);", lambda m: point(m, int(m.group(1))))
    chars = _swapped(chars, r"&#x([0-9a-fA-F]+);", lambda m: point(m, int(m.group(1), 16)))
    chars = _swapped(chars, C.CONTROL, whole(""))
    joined, pieces, last = "".join(c for c, _, _ in chars), [], 0
    for m in re.finditer(C.DOTTED_QUAD, joined):
        pieces += [(chars[last:m.start()], True), (chars[m.start():m.end()], False)]
        last = m.end()
    pieces.append((chars[last:], True))
    group = lambda m: (len(m.group(1)), len(m.group(2)), " ")
    chars = [c for piece, free in pieces for c in (_swapped(piece, r"(\+?\d{1,4})([\s.]+)(\d)", group) if free else piece)]
    for pattern, put in ((r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"[^\S\n]*\n[^\S\n]*", "\n"), (r"^\s+|\s+\Z", "")):
        chars = _swapped(chars, pattern, whole(put))
    return chars


def _texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    return [*texts, "plain text", "\u0301\u0308abc", " x ", "", None, "  \n", "a\u200b" * 3000 + "mail a.b@x.example", "\u2026"]


def test_every_character_has_its_raw_place(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in raw.aligned(df, "t").withColumn("c", clean("t")).collect():
        if r.t is None or not r.t.strip():
            assert r.aligned is None
            continue
        want = _python_aligned(r.t)
        assert r.aligned.text == r.c == "".join(c for c, _, _ in want), repr(r.t)
        assert (r.aligned.starts, r.aligned.ends) == ([b for _, b, _ in want], [e for _, _, e in want]), repr(r.t)


@pytest.mark.parametrize("table, column", [("documents", "text"), ("pages", "html"), ("conversations", "text")])
def test_findings_in_the_raw_text(spark, table, column):
    """The raw part of each finding, cleaned again, is its original; the same findings as without places."""
    df = spark.read.parquet(f"{SF}/{table}.parquet").select(column).distinct()
    found = raw.findings(df, column, [column]).withColumn("again", clean("raw_original")).collect()
    assert found and sorted((r[column], r.start, r.pi_type) for r in found) == sorted((r[column], r.start, r.pi_type) for r in redaction.findings(df, column, [column]).collect())
    for r in found:
        assert r[column][r.raw_start:r.raw_end] == r.raw_original and r.again == clean_once(r.original)


def clean_once(text):
    return text.strip()


def test_redaction_leaves_the_rest_as_it_was(spark):
    text = "\u200bHello &amp; welcome,\r\n\r\n\r\n  write to a.b\u200b@x.example  &lt;now&gt;\x00  or   c.d@y.example\u00a0\u00a0!"
    df = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, ""), (5, "nothing  here ")], "i int, t string")
    got = {r.i: r.t_redacted for r in raw.redacted(df, "t", RedactionConfig()).collect()}
    assert got == {r.i: r.t for r in raw.redacted(df, "t", out="t").collect()}
    assert got == {1: text.replace("a.b\u200b@x.example", "[EMAIL]").replace("c.d@y.example", "[EMAIL]"), 2: None, 3: "  ", 4: "", 5: "nothing  here "}
