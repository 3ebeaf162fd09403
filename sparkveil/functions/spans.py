"""Spans: find, fold, resolve and splice, all as native array expressions.

A pattern is run once over a text with ``regexp_replace`` that only *marks* its matches
with reserved characters. Splitting at the marks gives the pieces, and running sums of
piece lengths give exact code-point offsets. Every detector yields the same small array of
pieces, so one shared lambda turns all of them into spans.

Span: ``struct<s, n, o, e, lead, v>``: start, minus length, order, end, text from the start
of the match to the value, value. Sorting the structs as they are puts spans leftmost first,
then longest, then by catalogue order.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

from sparkveil.functions.sql import EDGE, START, array, let, lit, plain_regex, regex, spelled
from sparkveil.plans.catalog import FIRST, LEAD, VALUE, Detector, Row

SPAN = "struct<s:int,n:int,o:int,e:int,lead:string,v:string>"
NONE = f"CAST(array() AS array<{SPAN}>)"
HIT = "struct<o:int,w:int,p:array<string>>"


def split_group(pattern: str) -> tuple[str, str, str]:
    """Text before, inside and after the single capturing group; no group: all is inside."""
    depth, in_class, start, open_depth, i = 0, False, -1, -1, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            if pattern[i + 1] != "?":
                if start >= 0 or depth:
                    raise ValueError(f"one capturing group at the top level expected: {pattern}")
                start, open_depth = i, depth
            depth += 1
        elif ch == ")":
            depth -= 1
            if start >= 0 and depth == open_depth:
                return pattern[:start], pattern[start + 1 : i], pattern[i + 1 :]
        i += 1
    return "", pattern, ""


_WORD_START = re.compile(r"\\b(?:\(\?:)?(?:[A-Za-z]|\\d|\[[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\](?![?*]))")


MANY_LETTERS = 12


def _head(detector: Detector) -> str:
    """What to test before the pattern: the first letter, and a word edge before a word character is cheap for ASCII."""
    if detector.head:
        return detector.head
    letters = first_letters(detector.pattern.removeprefix(r"\b"))
    first = f"(?=[{''.join(sorted(letters))}])" if letters else ""
    if not _WORD_START.match(detector.pattern):
        return first
    # in prose a word edge is rarer than any letter
    return ("" if len(letters) > MANY_LETTERS else first) + "(?<![A-Za-z0-9_])"


def _arms(body: str) -> tuple[list[str], str]:
    """The branches of the group that ``body`` is inside of, up to its end, and what follows the group."""
    arms, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            if not depth:
                return [*arms, body[start:i]], body[i + 1 :]
            depth -= 1
        elif ch == "|" and not depth:
            arms.append(body[start:i])
            start = i + 1
        i += 1
    return [*arms, body[start:]], ""


def first_letters(pattern: str) -> frozenset[str]:
    """ASCII letters and digits one of which every match begins with; empty where that is not plain to see."""
    if len(_arms(pattern)[0]) > 1:
        return frozenset()
    if pattern.startswith("(?:"):
        arms, rest = _arms(pattern[3:])
        found = [first_letters(a) for a in arms]
        chars = frozenset().union(*found) if all(found) else frozenset()
    elif simple := re.match(r"\[((?:[A-Za-z0-9](?:-[A-Za-z0-9])?)+)\]", pattern):
        chars, rest = frozenset(spelled(simple[0])[1:-1]), pattern[simple.end() :]
    else:
        chars, rest = frozenset(c for c in pattern[:1] if c.isascii() and c.isalnum()), pattern[1:]
    return frozenset() if rest[:1] in ("?", "*") or rest.startswith("{0") or rest.startswith("{,") else chars


def marked(text: str, detector: Detector) -> str:
    """The pieces of ``text``: what precedes the first match, then one piece per match."""
    before, value, after = split_group(detector.pattern)
    if before or after:
        pattern, kept = f"({before})({value})({after})", f"{START}$1{EDGE}$2{EDGE}$3"
    else:
        pattern, kept = value, f"{START}{EDGE}$0{EDGE}"
    literal = regex(_head(detector) + pattern, detector.icase)
    return f"split(regexp_replace({text}, {literal}, '{kept}'), '{START}')"


def present(text: str, detector: Detector) -> str:
    return f"{text} RLIKE {regex(_head(detector) + detector.pattern, detector.icase)}"


def keywords(rows: Sequence[Row]) -> list[str]:
    """The distinct gate words of detectors that need no other flag."""
    return sorted({w for r in rows if not r.detector.needs for w in r.detector.words})


def whole_words(rows: Sequence[Row]) -> list[str]:
    return sorted({w for r in rows for w in r.detector.tokens})


# Cheap facts about a text ``$t`` and its lower-case form ``$l``.
FLAGS = {
    "digit": "$t RLIKE " + regex(r"\d"),
    "at": "contains($t, '@')",
    "dot": "$t RLIKE " + plain_regex(r"[A-Za-z0-9_-][.][A-Za-z0-9._-]"),
    "slash": "contains($t, '/')",
    "backslash": "contains($t, " + lit("\\") + ")",
    "hex": "$t RLIKE " + plain_regex(r"[0-9A-Fa-f]{20}"),
    "capitals": "$t RLIKE " + regex(r"[A-Za-z]\s+[A-Z]"),
    "role": "$l RLIKE "
    + plain_regex(r"(?=[dsawpbuq])(?:db|svr|srv|app|web|pri|sec|bak|prd|dev|uat|qa)[0-9]*+(?![a-z0-9_])"),
}


def _branch(words: Sequence[str]) -> str:
    """The words as one pattern that tests each letter once."""
    if "" in words:
        rest = [w for w in words if w]
        return f"(?:{_branch(rest)})?" if rest else ""
    first = sorted({w[0] for w in words})
    arms = [re.escape(c) + _branch([w[1:] for w in words if w[0] == c]) for c in first]
    return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"


def flags(text: str, lower: str, rows: Sequence[Row]) -> str:
    """The flags and gate words the enabled detectors ask for, each computed once.

    Whole-word gates cost one scan that fails at once inside words, however many there are.
    """
    needed = {r.detector.needs for r in rows}
    tokens = whole_words(rows)
    found = "CAST(array() AS array<string>)"
    if tokens:
        found = f"regexp_extract_all({lower}, {plain_regex(f'(?<![a-z0-9_]){_branch(tokens)}(?![a-z0-9_])')}, 0)"
    fields = [f"'words', {found}"]
    fields += [
        f"'{n}', {sql.replace('$t', text).replace('$l', lower)}" for n, sql in FLAGS.items() if n in needed
    ]
    fields += [f"'k{i}', {_holds(lower, w, len(rows) > FEW)}" for i, w in enumerate(keywords(rows))]
    return f"named_struct({', '.join(fields)})"


def _holds(text: str, word: str, many: bool) -> str:
    """Whether ``text`` holds a word. As a pattern, a word of more than four letters is sought in leaps,
    which pays where many words are sought in long texts."""
    return f"{text} RLIKE {lit(re.escape(word))}" if many and len(word) > 4 else f"contains({text}, {lit(word)})"


def _hit(row: Row, text: str, lower: str, flags: str, known: dict[str, str]) -> str:
    d = row.detector
    hit = f"named_struct('o', {row.ordinal}, 'w', {d.span}, 'p', {marked(text, d)})"
    # most texts match few patterns: look first, and rewrite the text only where there is a match
    test = [present(text, d)]
    if d.words:
        gates = [known.get(w) or f"contains({lower}, {lit(w)})" for w in d.words]
        test.insert(0, f"({' OR '.join(gates)})")
    if d.tokens:
        test.insert(0, f"arrays_overlap({flags}.words, {array(d.tokens)})")
    return f"IF({' AND '.join(test)}, {hit}, NULL)"


FEW = 8
"""Up to so many detectors, each asks for its flag by itself; more are skipped together."""


def hits(rows: Sequence[Row], text: str, lower: str, flags: str) -> str:
    """Pieces of every detector whose cheap conditions hold, without the empty ones."""
    known = {w: f"{flags}.k{i}" for i, w in enumerate(keywords(rows))}
    rows = [r for r in rows if r.detector.pattern]
    if 0 < len(rows) <= FEW:
        one = [_hit(r, text, lower, flags, {} if r.detector.needs else known) for r in rows]
        gated = [f"IF({flags}.{r.detector.needs}, {hit}, NULL)" if r.detector.needs else hit for r, hit in zip(rows, one, strict=True)]
        return f"filter(array({', '.join(gated)}), h -> h IS NOT NULL AND size(h.p) > 1)"
    groups = []
    for need in ("", *FLAGS):
        chosen = [r for r in rows if r.detector.needs == need]
        if not chosen:
            continue
        items = "array(" + ", ".join(_hit(r, text, lower, flags, {} if need else known) for r in chosen) + ")"
        if need:
            items = f"IF({flags}.{need}, {items}, CAST(array() AS array<{HIT}>))"
        groups.append(items)
    if not groups:
        return f"CAST(array() AS array<{HIT}>)"
    joined = f"concat({', '.join(groups)})" if len(groups) > 1 else groups[0]
    return f"filter({joined}, h -> h IS NOT NULL AND size(h.p) > 1)"


BLOCK = 512
"""Arrays grow in blocks of this many elements: appending copies, and short copies are cheap."""


def spans(hit_array: str, modes: Collection[int] = (VALUE, LEAD, FIRST)) -> str:
    """Hits to spans: offsets are running sums over the pieces, block by block.

    ``modes``: what the findings of these hits may cover, so that only that is worked out. Most hits are
    one match; its span needs no sums.
    """

    def span(at: str) -> str:
        start, size = f"{at} + length(f[0])", "length(f[1])"
        end = f"{start} + {size}"
        if LEAD in modes:
            start, size = f"IF(h.w = {LEAD}, {at}, {start})", f"IF(h.w = {LEAD}, length(f[0]) + {size}, {size})"
        if FIRST in modes:
            first = f"{at} + instr(concat(f[0], f[1]), f[1]) - 1"
            start, end = f"IF(h.w = {FIRST}, {first}, {start})", f"IF(h.w = {FIRST}, {first} + length(f[1]), {end})"
        return f"named_struct('s', {start}, 'n', -({size}), 'o', h.o, 'e', {end}, 'lead', f[0], 'v', f[1])"

    step = let(
        "f",
        f"split(x, '{EDGE}')",
        f"named_struct('at', a.at + length(f[0]) + length(f[1]) + length(f[2]), 'out', array_append(a.out, {span('a.at')}))",
    )

    # each piece carries two marks that are not part of the text
    block, blocks = f"slice(h.p, 2 + {BLOCK} * int(j), {BLOCK})", f"sequence(0, (size(h.p) - 2) div {BLOCK})"
    totals = f"transform({blocks}, j -> aggregate({block}, 0, (k, x) -> k + length(x) - 2))"
    starts = f"aggregate({totals}, array(length(h.p[0])), (k, x) -> array_append(k, k[size(k) - 1] + x))"
    walk = f"aggregate({block}, named_struct('at', g[int(j)], 'out', {NONE}), (a, x) -> {step}, a -> a.out)"
    many = let("g", starts, f"flatten(transform({blocks}, j -> {walk}))")
    one = f"transform(array(split(h.p[1], '{EDGE}')), f -> {span('length(h.p[0])')})"
    return f"flatten(transform({hit_array}, h -> IF(size(h.p) = 2, {one}, {many})))"


def find(text: str, *detectors: Detector, first: int = 0) -> str:
    """Spans of a few detectors, without any gate; orders count up from ``first``."""
    items = ", ".join(
        f"named_struct('o', {first + i}, 'w', {d.span}, 'p', {marked(text, d)})" for i, d in enumerate(detectors)
    )
    return spans(f"filter(array({items}), g -> size(g.p) > 1)", {d.span for d in detectors})


def resolve(ordered: str) -> str:
    """Leftmost wins; among equal starts the longest; then catalogue order.

    Takes sorted spans and gives the places of the kept ones, which are disjoint. Most are from the
    start, which one look tells.
    """
    disjoint = f"aggregate({ordered}, 0, (a, c) -> IF(a >= 0 AND c.s >= a, c.e, -1)) >= 0"
    none, blocks = "CAST(array() AS array<int>)", "CAST(array() AS array<array<int>>)"
    keep = (
        f"IF(size(a.out) < {BLOCK}, "
        f"named_struct('last', {ordered}[i].e, 'out', array_append(a.out, i), 'done', a.done), "
        f"named_struct('last', {ordered}[i].e, 'out', array(i), 'done', array_append(a.done, a.out)))"
    )
    places = f"IF(size({ordered}) = 0, {none}, sequence(0, size({ordered}) - 1))"
    return (
        f"IF({disjoint}, {places}, aggregate({places}, "
        f"named_struct('last', -1, 'out', {none}, 'done', {blocks}), (a, i) -> "
        f"IF({ordered}[i].s >= a.last, {keep}, a), a -> flatten(array_append(a.done, a.out))))"
    )


def first_wins(candidates: str) -> str:
    """Keep a span unless its start or its end lies in a span kept earlier in the order.

    Only spans of one cluster of overlapping spans can meet, so the quadratic check runs
    inside clusters and never over the whole text.
    """
    clash = "exists(k, r -> (r.s <= c.s AND c.s < r.e) OR (r.s < c.e AND c.e <= r.e))"
    settle = (
        "aggregate(array_sort(transform({0}, q -> named_struct('o', q.o, 's', q.s, 'q', q))), "
        f"{NONE}, (k, z) -> {let('c', 'z.q', f'IF({clash}, k, array_append(k, c))')})"
    )
    step = (
        "IF(size(a.open) = 0 OR c.s >= a.last, "
        f"named_struct('last', c.e, 'open', array(c), 'out', concat(a.out, {settle.format('a.open')})), "
        "named_struct('last', greatest(a.last, c.e), 'open', array_append(a.open, c), 'out', a.out))"
    )
    return (
        f"aggregate(array_sort({candidates}), named_struct('last', -1, 'open', {NONE}, 'out', {NONE}), "
        f"(a, c) -> {step}, a -> concat(a.out, {settle.format('a.open')}))"
    )


PAGE = 4096


def splice(text: str, kept: str, token: str) -> str:
    """Put tokens in place of disjoint sorted spans. ``token`` is SQL over the span ``c``.

    Finding a place in a text means walking to it, so a long text is cut into pages first and
    the parts between the spans are taken from their pages.
    """
    before, last = "IF(i = 0, 0, k[i - 1].e)", "k[size(k) - 1].e"

    def part(start: str, end: str) -> str:
        piece = (
            f"substring(y[int(j)], greatest({start} - {PAGE} * j, 0) + 1, "
            f"least({end}, {PAGE} * (j + 1)) - greatest({start}, {PAGE} * j))"
        )
        pages = f"sequence({start} div {PAGE}, ({end} - 1) div {PAGE})"
        return f"IF({end} <= {start}, '', array_join(transform({pages}, j -> {piece}), ''))"

    joined = f"concat(array_join(transform(k, (c, i) -> concat({part(before, 'c.s')}, {token})), ''), {part(last, 'z')})"
    pages = f"regexp_extract_all({text}, '(?s).{{1,{PAGE}}}', 0)"
    return let("k", kept, f"IF(size(k) = 0, {text}, {let('y', pages, let('z', f'length({text})', joined))})")
