"""Unicode compatibility forms as native expressions, from tables made by rule.

The tables come from the Unicode database that ships with Python, read once when the plan
is built. Rows whose characters are all unaffected skip every step.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.functions.sql import ITEM, START, EDGE, let, lit


def affected_sql(x: str, form: str = "NFKC") -> str:
    """Whether any character may change: cheap byte count first, then two simple ranges.

    ASCII is the same in every form, the letters from U+00C0 to U+00FF in the composed forms.
    """
    if form in ("NFD", "NFKD"):
        return f"(octet_length({x}) > length({x}))"
    high, low = lit(r"[^\x00-\xFF]"), lit(r"[\x80-\xBF]")
    return f"(octet_length({x}) > length({x}) AND ({x} RLIKE {high} OR {x} RLIKE {low}))"


@lru_cache(maxsize=4)
def _tables(form: str) -> tuple[str, str, str, str]:
    """(from, to) for one-to-one changes, (keys, values) for one-to-many."""
    one_from, one_to, many_from, many_to = [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0xFDD0 <= cp <= 0xFDEF:
            continue
        ch = chr(cp)
        out = unicodedata.normalize(form, ch)
        if out == ch:
            continue
        if len(out) == 1:
            one_from.append(ch)
            one_to.append(out)
        else:
            many_from.append(ch)
            many_to.append(out)
    return "".join(one_from), "".join(one_to), "".join(many_from), ITEM.join(many_to)


@lru_cache(maxsize=1)
def _pairs() -> str:
    """``base mark composed`` triples, one after the other, each led by a separator."""
    return "".join(f"{ITEM}{pair}{composed}" for pair, composed in _compositions().items())


@lru_cache(maxsize=1)
def _compositions() -> dict[str, str]:
    """Canonical pairs and what they become; pairs that are never composed are left out."""
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == chr(cp):
                out[pair] = chr(cp)
    return out


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Characters of a combining class that is not zero, and as many characters whose code points are 256 more than the classes."""
    marks = [chr(cp) for cp in range(0x80, sys.maxunicode + 1) if unicodedata.combining(chr(cp))]
    return "".join(marks), "".join(chr(256 + unicodedata.combining(m)) for m in marks)


@lru_cache(maxsize=1)
def followers() -> str:
    """The inside of a character class: whatever may be moved, or joined to the character before it.

    The engine's own class of marks, and the ones of a newer Unicode that it may not know as marks.
    """
    every = {*_classes()[0], *(pair[1] for pair in _compositions())}
    late = sorted(ord(c) for c in every if unicodedata.category(c)[0] != "M" or unicodedata.ucd_3_2_0.category(c) == "Cn")
    ranges = []
    for cp in late:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return r"\p{M}" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def _canonical() -> tuple[str, str]:
    """(keys, values): characters that NFC keeps whole but that come apart by their canonical decomposition."""
    keys, values = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if not 0xAC00 <= cp <= 0xD7A3 and unicodedata.normalize("NFC", ch) == ch != unicodedata.normalize("NFD", ch):
            keys.append(ch)
            values.append(unicodedata.normalize("NFD", ch))
    return "".join(keys), ITEM.join(values)


# Hangul syllables are numbered by lead, vowel and tail from their first code point.
SYLLABLE, LEAD, VOWEL, TAIL, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28


def _character(n: str) -> str:
    return f"decode(unhex(lpad(hex({n}), 4, '0')), 'UTF-16BE')"


def _each(text: str, pattern: str, piece: str) -> str:
    """``text`` with every match of a pattern, bound to ``k``, turned into ``piece``."""
    changed = let("k", f"split(p, '{EDGE}')[0]", piece)
    return (
        f"array_join(transform(split(regexp_replace({text}, {lit(pattern)}, '{START}$0{EDGE}'), '{START}'), "
        f"p -> IF(contains(p, '{EDGE}'), concat({changed}, split(p, '{EDGE}')[1]), p)), '')"
    )


def _looked_up(keys: str, values: str) -> str:
    """The value of a character ``c`` above ASCII, or the character."""
    return f"IF(c > '\\u007F', coalesce(try_element_at(split({lit(values)}, {lit(ITEM)}), nullif(instr({lit(keys)}, c), 0)), c), c)"


def _class(c: str) -> str:
    marks, classes = _classes()
    return f"coalesce(nullif(ascii(substring({lit(classes)}, nullif(instr({lit(marks)}, {c}), 0), 1)), 0) - 256, 0)"


def _ordered(k: str) -> str:
    """The characters of ``k`` as ``struct<k class, c character>``, each run of marks sorted by class.

    A character of class zero opens a run: runs are numbered, and one stable sort does them all.
    """
    typed = f"transform(split({k}, ''), c -> named_struct('k', {_class('c')}, 'c', c))"
    opens = "filter(transform(y, (z, i) -> IF(z.k = 0, i, NULL)), i -> i IS NOT NULL)"
    bounds = let("w", opens, "array_distinct(concat(array(0), w, array(size(y))))")
    runs = (
        f"flatten(transform(slice(b, 1, size(b) - 1), (from, j) -> "
        "transform(array_sort(transform(slice(y, from + 1, b[j + 1] - from), (z, i) -> named_struct('k', z.k, 'i', i, 'c', z.c))), "
        "z -> named_struct('k', z.k, 'c', z.c))))"
    )
    return let("y", typed, let("b", bounds, runs))


def _composed(ordered: str) -> str:
    """Characters joined to the last one of class zero, unless one in between has the same class or a higher one."""
    found = f"instr({lit(_pairs())}, concat({lit(ITEM)}, a.s, z.c))"
    joined = f"named_struct('d', a.d, 's', substring({lit(_pairs())}, at + 3, 1), 'm', a.m, 'l', a.l)"
    apart = (
        "IF(z.k = 0, named_struct('d', concat(a.d, a.s, a.m), 's', z.c, 'm', '', 'l', 0), "
        "named_struct('d', a.d, 's', a.s, 'm', concat(a.m, z.c), 'l', z.k))"
    )
    free = "a.s != '' AND (a.m = '' OR a.l < z.k)"
    step = let("at", f"IF({free}, {found}, 0)", f"IF(at > 0, {joined}, {apart})")
    return f"aggregate({ordered}, named_struct('d', '', 's', '', 'm', '', 'l', 0), (a, z) -> {step}, a -> concat(a.d, a.s, a.m))"


def compatibility_sql(x: str, form: str = "NFKC") -> str:
    """NFC, NFKC, NFD or NFKD of ``x``, as the Unicode database of this Python has them.

    Characters are mapped one by one. Where marks follow, they and the character before them are
    decomposed, sorted by combining class and composed again; Hangul is joined or split by arithmetic.
    """
    one_from, one_to, keys, values = _tables(form)
    step = f"translate({x}, {lit(one_from)}, {lit(one_to)})"
    spread = f"array_join(transform(split(u, ''), c -> {_looked_up(keys, values)}), '')"
    follow = followers()
    whole = f"array_join(transform(split(k, ''), c -> {_looked_up(*_canonical())}), '')" if form in ("NFC", "NFKC") else "k"
    ordered = _ordered("q")
    piece = let("q", whole, _composed(ordered) if form in ("NFC", "NFKC") else f"array_join(transform({ordered}, z -> z.c), '')")
    marks = f"IF(v RLIKE {lit(f'[{follow}]')}, {_each('v', f'(?s)[^{follow}]?[{follow}]+', piece)}, v)"
    if form in ("NFC", "NFKC"):
        lead, vowel = f"(ascii(k) - {LEAD})", f"(ascii(substring(k, 2, 1)) - {VOWEL})"
        tail = f"IF(length(k) = 3, ascii(substring(k, 3, 1)) - {TAIL}, 0)"
        jamo = _character(f"{SYLLABLE} + ({lead} * {VOWELS} + {vowel}) * {TAILS} + {tail}")
        open_ = f"IF((ascii(k) - {SYLLABLE}) % {TAILS} = 0, {_character(f'ascii(k) + ascii(substring(k, 2, 1)) - {TAIL}')}, k)"
        pattern = r"[\u1100-\u1112][\u1161-\u1175][\u11A8-\u11C2]?|[\uAC00-\uD7A3][\u11A8-\u11C2]"
        hangul = f"IF(h RLIKE {lit(pattern)}, {_each('h', pattern, f'IF(ascii(k) < {SYLLABLE}, {jamo}, {open_})')}, h)"
    else:
        number = f"(ascii(k) - {SYLLABLE})"
        tail = f"IF({number} % {TAILS} = 0, '', {_character(f'{TAIL} + {number} % {TAILS}')})"
        split = f"concat({_character(f'{LEAD} + {number} div {VOWELS * TAILS}')}, {_character(f'{VOWEL} + {number} % {VOWELS * TAILS} div {TAILS}')}, {tail})"
        pattern = r"[\uAC00-\uD7A3]"
        hangul = f"IF(h RLIKE {lit(pattern)}, {_each('h', pattern, split)}, h)"
    return let("u", step, let("v", spread, let("h", marks, hangul)))


def exact_form(column: Column | str, form: str = "NFKC") -> Column:
    """Any of NFC, NFKC, NFD, NFKD by the workers' own Python, in Arrow batches. Leaves the JVM; off by default."""

    @F.pandas_udf(T.StringType())
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.str.normalize(form)

    return normal(column)
