"""Where each character of a cleaned text stands in the raw text, as native expressions.

Every cleaning step is written once more as swaps: a pattern whose matches hold an unchanged head and
an old part that becomes a new one. The matches are marked in one pass, a split at the marks gives
the pieces, and running sums of their lengths cut two arrays along with the text: the raw place
where each character begins, and where it ends. So the edits of all steps are composed as they
happen, and a place is looked up by its index. A text that no step changes carries no arrays.

Two numbers a character are dear where only a few places are asked for. A traced text carries the
parts of each step instead, and a place goes back through them one by one, by binary search.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, partial

from sparkveil.functions import clean as C
from sparkveil.functions.spans import BLOCK
from sparkveil.functions.sql import EDGE, ITEM, START, array, let, lit, regex
from sparkveil.functions.unicode import compatibility_sql, followers
from sparkveil.plans.config import RedactionConfig

KEEP = "named_struct('x', s.x, 't', {t}, 'b', {b}, 'e', {e})"

EDITS = "array<struct<a:array<int>,z:array<int>,h:array<int>,o:array<int>,n:array<int>>>"
"""The parts of a text, one entry per step that changed it: where each part begins before and after
the step, and the lengths of its head, of what was replaced and of what replaced it."""


def running_sql(lengths: str) -> str:
    """Where each of some consecutive parts begins, by blocks, so that no array grows one by one for long."""
    block = f"slice(w, 1 + {BLOCK} * int(j), {BLOCK})"
    blocks = f"sequence(0, (size(w) - 1) div {BLOCK})"
    grow = "(k, x) -> array_append(k, k[size(k) - 1] + x)"
    firsts = f"aggregate(transform({blocks}, j -> aggregate({block}, 0, (k, x) -> k + x)), array(0), {grow})"
    inner = f"aggregate({block}, array(g[int(j)]), {grow}, k -> slice(k, 1, size(k) - 1))"
    return let("w", lengths, let("g", firsts, f"flatten(transform({blocks}, j -> {inner}))"))


def _swap(pattern: str, new: str, head: str = "", old: str = "$0", text: str = "s.t", traced: bool = False) -> str:
    """A stage that turns the part ``old`` of each match into ``new``, which is SQL over the old part ``o``.

    ``pattern`` is a literal; what follows the old part in the match stays as it is, like ``head``.
    """
    tail = "" if old == "$0" else "$4"
    marked = f"regexp_replace({text}, {pattern}, '{START}{head}{EDGE}{old}{EDGE}{tail}')"
    part = let(
        "f", f"split(q, '{EDGE}')",
        "IF(size(f) < 3, named_struct('h', length(q), 'o', 0, 'n', 0, 'r', 0, 't', q), "
        + let("o", "f[1]", let("n", new, "named_struct('h', length(f[0]), 'o', length(o), 'n', length(n), 'r', length(f[2]), 't', concat(f[0], n, f[2]))"))
        + ")",
    )

    def cut(places: str, whole: str, at: str) -> str:
        return let(
            "y", f"coalesce({places}, {whole})",
            f"flatten(transform(p, (c, i) -> concat(slice(y, a[i] + 1, c.h), array_repeat(get(y, {at}), c.n), slice(y, a[i] + c.h + c.o + 1, c.r))))",
        )

    begin = cut("s.b", "sequence(0, length(s.t) - 1)", "a[i] + c.h")
    end = cut("s.e", "sequence(1, length(s.t))", "a[i] + c.h + c.o - 1")
    done = KEEP.format(t="array_join(transform(p, c -> c.t), '')", b=begin, e=end)
    if traced:
        edit = f"named_struct('a', a, 'z', {running_sql('transform(p, c -> c.h + c.n + c.r)')}, 'h', p.h, 'o', p.o, 'n', p.n)"
        done = f"named_struct('x', s.x, 't', array_join(p.t, ''), 'ed', array_append(s.ed, {edit}))"
    moved = let("p", f"transform(split({marked}, '{START}'), q -> {part})", let("a", running_sql("transform(p, c -> c.h + c.o + c.r)"), done))
    return f"IF(s.t = '' OR NOT {text} RLIKE {pattern}, s, {moved})"


def _swaps(pairs: tuple[tuple[str, str], ...], traced: bool = False) -> str:
    """All of some plain replacements in one pass; the longer of two that begin alike comes first in ``pairs``."""
    pattern = "|".join("".join("\\" + c if c.isascii() and not c.isalnum() and c not in "\r\n" else c for c in old) for old, _ in pairs)
    return _swap(lit(pattern), f"element_at({array(n for _, n in pairs)}, int(array_position({array(o for o, _ in pairs)}, o)))", traced=traced)


@lru_cache(maxsize=1)
def _late_marks() -> str:
    """Characters that are no marks but become one by their compatibility form."""
    out = []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch)[0] != "M" and unicodedata.category(unicodedata.normalize("NFKC", ch)[0])[0] == "M":
            out.append(ch)
    return "".join(out)


# Hangul letters of every kind, and syllables that a tail may follow.
_JAMO = r"\u1100-\u11FF\u3131-\u318E\uFFA0-\uFFDC"
_HANGUL = rf"[\uAC00-\uD7A3{_JAMO}][{_JAMO}]+"


def align_stages(config: RedactionConfig | None = None, traced: bool = False) -> list[str]:
    """From a raw text ``s`` to ``s.t`` (cleaned) with ``s.b`` and ``s.e``: raw begin and end of each
    character, or NULL where raw and cleaned text agree place by place. Blank texts become NULL.

    ``traced`` gives the EDITS of all steps in ``s.ed`` instead, for :func:`traced_span_sql`."""
    c = config or RedactionConfig()
    places = f"'ed', CAST(array() AS {EDITS})" if traced else "'b', CAST(NULL AS array<int>), 'e', CAST(NULL AS array<int>)"
    swap, swaps = partial(_swap, traced=traced), partial(_swaps, traced=traced)
    stages = [f"IF(s IS NOT NULL AND s RLIKE {regex(r'\S')}, named_struct('x', s, 't', {C.unmark_sql('s')}, {places}), NULL)"]
    if not c.enable_data_cleaning:
        return stages
    if c.clean_nfkc_normalize:
        follows = followers() + _late_marks()
        # all followers and Hangul lie behind U+00FF: looking for such a character first spares the long classes
        stages.append(swap(lit(rf"(?s)(?=.?[^\x00-\xFF])(?:{_HANGUL}|[^{follows}]?[{follows}]+|[^\x00-\xFF])|[\x80-\xBF]"), compatibility_sql("o")))
    letters = C.homoglyph_sql("s.t")
    stages.append(f"named_struct('x', s.x, 't', {letters}, 'ed', s.ed)" if traced else KEEP.format(t=letters, b="s.b", e="s.e"))
    if c.clean_strip_zero_width:
        stages.append(swap(lit(C.INVISIBLE), "''"))
    if c.clean_fix_encoding:
        stages.append(swaps(C.MOJIBAKE))
    if c.clean_normalize_unicode:
        stages.append(swaps(C.PUNCTUATION))
    if c.clean_decode_html:
        # the first two can complete the others
        stages += [swaps(C.ENTITIES[:2]), swaps(C.ENTITIES[2:])]
        stages += [swap(regex(p), C.numeric_entity_sql("o", p)) for p in (C.DECIMAL_ENTITY, C.HEX_ENTITY)]
    if c.clean_strip_control_chars:
        stages.append(swap(lit(C.CONTROL), "''"))
    if c.clean_digit_groups:
        # a dotted quad is fenced off and matched whole, so that nothing in it changes
        fenced = f"regexp_replace(s.t, {regex(C.DOTTED_QUAD)}, '{ITEM}$0{ITEM}')"
        stages.append(swap(regex(rf"{ITEM}([^{ITEM}]*){ITEM}|(\+?\d{{1,4}})([\s.]+)(\d)"), "IF(o = '', '', ' ')", head="$1$2", old="$3", text=fenced))
    if c.clean_normalize_whitespace:
        # only what really changes: a plain blank between words, or a bare line break, is no part of its own
        stages += [swap(lit(r"[ \t]{2,}|\t"), "' '"), swap(lit(r"\n{3,}"), "'\\n\\n'"), swap(regex(r"[^\S\n]+\n[^\S\n]*|\n[^\S\n]+"), "'\\n'")]
    return [*stages, swap(regex(r"^\s+|\s+\z"), "''")]


def raw_span_sql(begin: str, end: str) -> tuple[str, str]:
    """Raw begin and end of a part of the cleaned text that is not empty."""
    return f"IF(s.b IS NULL, {begin}, get(s.b, {begin}))", f"IF(s.e IS NULL, {end}, get(s.e, {end} - 1))"


def traced_span_sql(begin: str, end: str) -> tuple[str, str]:
    """Raw begin and end of a part of a traced text that is not empty."""

    def back(place: str, inner: str) -> str:
        # the last part that begins at or before the place; parts that became empty lie before it
        halve = "IF(q.r - q.l < 2, q, IF(d.z[int((q.l + q.r) div 2)] <= k, named_struct('l', int((q.l + q.r) div 2), 'r', q.r), named_struct('l', q.l, 'r', int((q.l + q.r) div 2))))"
        part = f"aggregate(sequence(0, int(ceil(log2(size(d.z))))), named_struct('l', 0, 'r', size(d.z)), (q, y) -> {halve}, q -> q.l)"
        step = f"CASE WHEN k - d.z[i] < d.h[i] THEN d.a[i] + k - d.z[i] WHEN k - d.z[i] < d.h[i] + d.n[i] THEN {inner} ELSE d.a[i] + d.o[i] - d.n[i] + k - d.z[i] END"
        return f"aggregate(reverse(s.ed), {place}, (k, d) -> {let('i', part, step)})"

    return back(begin, "d.a[i] + d.h[i]"), f"{back(f'{end} - 1', 'd.a[i] + d.h[i] + d.o[i] - 1')} + 1"
