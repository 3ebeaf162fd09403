"""Text cleaning as native expressions. The order of the steps is part of the meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from sparkveil.functions.sql import EDGE, MARKS, START, any_of, apply, let, lit, regex
from sparkveil.functions.unicode import affected_sql, compatibility_sql
from sparkveil.plans.config import RedactionConfig

# Look-alike letters and what they become.
HOMOGLYPHS = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p",
    "\u0441": "c", "\u0443": "y", "\u0445": "x", "\u0456": "i",
    "\u0410": "A", "\u0412": "B", "\u0415": "E", "\u041a": "K",
    "\u041c": "M", "\u041d": "H", "\u041e": "O", "\u0420": "P",
    "\u0421": "C", "\u0422": "T", "\u0425": "X",
    "\u03bf": "o", "\u03b1": "a", "\u03b5": "e",
}

# Invisible characters that are dropped.
INVISIBLE = (
    r"[\u200b-\u200f\u2028-\u202f\u205f-\u206f\ufeff\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5"
    r"\u180e\u2060-\u2064\u2066-\u206f\u3164\uffa0\ufff0-\ufff8]+"
)

# Repairs for UTF-8 text that was read as Windows-1252, in order.
MOJIBAKE = (
    ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ('â€"', "-"),
    ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"), ("Ã¢", "â"), ("Ã´", "ô"), ("Ã§", "ç"),
    ("Ã¯", "ï"), ("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã±", "ñ"),
)

# Typographic characters and line ends.
PUNCTUATION = (
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"),
    ("—", "-"), ("…", "..."), ("\u00a0", " "), ("\r\n", "\n"), ("\r", "\n"),
)

# Named entities, in order.
ENTITIES = (
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&apos;", "'"), ("&#39;", "'"), ("&ndash;", "-"), ("&mdash;", "-"),
)

# Fixed value: a dotted quad with an optional port, which digit grouping must not touch.
DOTTED_QUAD = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}"
    r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?::\d{2,5})?\b"
)

# Fixed value: control characters except tab, newline and carriage return.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def strip_sql(x: str) -> str:
    """Trim every kind of white space at both ends."""
    blank = regex(r"\s")
    return (
        f"IF(left({x}, 1) RLIKE {blank} OR right({x}, 1) RLIKE {blank}, "
        f"regexp_replace({x}, {regex(r'^\s+|\s+\z')}, ''), {x})"
    )


def replaces_sql(x: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {lit(old)}, {lit(new)})"
    return x


def homoglyph_sql(x: str) -> str:
    return f"translate({x}, {lit(''.join(HOMOGLYPHS))}, {lit(''.join(HOMOGLYPHS.values()))})"


def invisible_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit(INVISIBLE)}, '')"


def mojibake_sql(x: str) -> str:
    return f"IF({any_of(x, ('â', 'Ã'))}, {replaces_sql(x, MOJIBAKE)}, {x})"


def punctuation_sql(x: str) -> str:
    return replaces_sql(x, PUNCTUATION)


def _code_point(x: str) -> str:
    """The character of a number held as text, or NULL when there is none or it could be one of our marks."""
    return let(
        "n",
        x,
        "CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 OR n BETWEEN 64976 AND 65007 THEN NULL "
        "ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END",
    )


def _numeric_sql(x: str, pattern: str, number: str) -> str:
    """Replace every numeric entity; the digits sit between the two marks."""
    piece = let(
        "f",
        f"split(p, '{EDGE}')",
        f"IF(size(f) < 3, p, concat(coalesce({_code_point(number)}, f[0]), f[2]))",
    )
    marked = f"regexp_replace({x}, {regex(pattern)}, '{START}$0{EDGE}$1{EDGE}')"
    return f"array_join(transform(split({marked}, '{START}'), p -> {piece}), '')"


DECIMAL_ENTITY, HEX_ENTITY = r"&#(\d+);", r"&#x([0-9a-fA-F]+);"
_DECIMAL = "try_cast({0} AS BIGINT)"
_HEX = "IF(length(TRIM(LEADING '0' FROM {0})) < 9, try_cast(conv({0}, 16, 10) AS BIGINT), NULL)"


def numeric_entity_sql(x: str, pattern: str) -> str:
    """What one numeric entity, which matches ``pattern``, stands for; itself if for nothing."""
    lead, number = ("&#", _DECIMAL) if pattern == DECIMAL_ENTITY else ("&#x", _HEX)
    digits = f"substring({x}, {len(lead) + 1}, length({x}) - {len(lead) + 1})"
    return f"coalesce({_code_point(number.format(digits))}, {x})"


def entities_sql(x: str) -> str:
    numeric = let(
        "e",
        replaces_sql(x, ENTITIES),
        "IF(contains(e, '&#'), "
        + let(
            "g",
            _numeric_sql("e", DECIMAL_ENTITY, _DECIMAL.format("f[1]")),
            _numeric_sql("g", HEX_ENTITY, _HEX.format("f[1]")),
        )
        + ", e)",
    )
    return f"IF(contains({x}, '&'), {numeric}, {x})"


def control_sql(x: str) -> str:
    return f"IF({x} RLIKE {lit(CONTROL)}, regexp_replace({x}, {lit(CONTROL)}, ''), {x})"


def digit_groups_sql(x: str) -> str:
    """One space between digit groups, dotted quads left alone."""
    quad = regex(DOTTED_QUAD)

    def grouped(y: str) -> str:
        return f"regexp_replace({y}, {regex(r'(\+?\d{1,4})[\s.]+(\d)')}, '$1 $2')"

    piece = let(
        "f",
        f"split(p, '{EDGE}')",
        f"IF(size(f) < 2, {grouped('p')}, concat(f[0], {grouped('f[1]')}))",
    )
    split = f"array_join(transform(split(regexp_replace({x}, {quad}, '{START}$0{EDGE}'), '{START}'), p -> {piece}), '')"
    return (
        f"IF({x} RLIKE {regex(r'\d')} AND {x} RLIKE {regex(r'\d[\s.]+\d')}, "
        f"IF({x} RLIKE {quad}, {split}, {grouped(x)}), {x})"
    )


def whitespace_sql(x: str, rare_blanks: bool = True) -> str:
    """Collapse blanks and blank lines and trim every line.

    ``rare_blanks=False`` says that the other steps have already removed every white space
    except blank, tab, newline, U+0085 and U+1680.
    """
    blanks = let("w0", x, f"IF({any_of('w0', ('  ', chr(9)))}, regexp_replace(w0, '[ \\\\t]+', ' '), w0)")
    lines = let("w1", blanks, "IF(contains(w1, '\\n\\n\\n'), regexp_replace(w1, '\\n{3,}', '\\n\\n'), w1)")
    edge = regex(r"[^\S\n]*\n[^\S\n]*")
    # plain blanks are found by a byte search; rarer kinds of white space need the pattern
    rare = regex(r"[^\S\n\t ]")
    probe = f"({any_of('w2', (' ' + chr(10), chr(10) + ' '))} OR w2 RLIKE {rare})"
    if not rare_blanks:
        probe = any_of("w2", (" " + chr(10), chr(10) + " ", "\x85", "\u1680"))
    return let("w2", lines, f"IF({probe}, regexp_replace(w2, {edge}, '\\n'), w2)")


def clean_steps(config: RedactionConfig | None = None) -> list[str]:
    """The enabled steps in order, as SQL over the place holder ``{0}``."""
    c = config or RedactionConfig()
    uni = "{0}"
    if c.clean_nfkc_normalize:
        uni = compatibility_sql(uni)
    uni = let("ch", uni, homoglyph_sql("ch"))
    if c.clean_strip_zero_width:
        uni = let("cz", uni, invisible_sql("cz"))
    # Text of ASCII and Latin letters alone needs none of the Unicode steps: their sources lie
    # outside it, except one mojibake pair that ends in a blank.
    if c.clean_fix_encoding:
        uni = let("cm", uni, mojibake_sql("cm"))
    if c.clean_normalize_unicode:
        uni = let("cp", uni, punctuation_sql("cp"))
    other = "{0}"
    if c.clean_fix_encoding:
        other = "IF(contains({0}, 'Ã '), replace({0}, 'Ã ', 'à'), {0})"
    if c.clean_normalize_unicode:
        other = let("cr", other, f"IF(contains(cr, '\\r'), {replaces_sql('cr', PUNCTUATION[-2:])}, cr)")
    steps = [f"IF({affected_sql('{0}')}, {uni}, {other})"]
    if c.clean_decode_html:
        steps.append(entities_sql("{0}"))
    if c.clean_strip_control_chars:
        steps.append(control_sql("{0}"))
    if c.clean_digit_groups:
        steps.append(digit_groups_sql("{0}"))
    if c.clean_normalize_whitespace:
        all_on = c.clean_nfkc_normalize and c.clean_strip_zero_width and c.clean_normalize_unicode
        steps.append(whitespace_sql("{0}", rare_blanks=not (all_on and c.clean_strip_control_chars)))
    steps.append(strip_sql("{0}"))
    return steps


def clean_sql(x: str, config: RedactionConfig | None = None) -> str:
    """All enabled steps over the SQL name ``x``."""
    text = unmark_sql(x)
    for i, step in enumerate(clean_steps(config)):
        text = let(f"c{i}", text, step.replace("{0}", f"c{i}"))
    return text


def unmark_sql(x: str) -> str:
    """Take our own marker characters out of the input; the length stays the same."""
    return f"IF(octet_length({x}) > length({x}) AND {any_of(x, MARKS)}, translate({x}, '{MARKS}', '\ufffd\ufffd\ufffd'), {x})"


def clean(column: Column | str, config: RedactionConfig | None = None) -> Column:
    return apply(column, "x", f"IF(x IS NULL, NULL, {clean_sql('x', config)})")


def step(column: Column | str, name: str) -> Column:
    """One cleaning step by name, for use on its own."""
    builders = {
        "nfkc": compatibility_sql,
        "homoglyphs": homoglyph_sql,
        "invisible": invisible_sql,
        "mojibake": mojibake_sql,
        "punctuation": punctuation_sql,
        "entities": entities_sql,
        "control": control_sql,
        "digit_groups": digit_groups_sql,
        "whitespace": lambda x: let("ws", whitespace_sql(x), strip_sql("ws")),
    }
    return apply(column, "x", let("y", unmark_sql("x"), builders[name]("y")))


def clean_columns(df: DataFrame, columns: list[str], config: RedactionConfig | None = None) -> DataFrame:
    """Clean the named columns in place; unknown names are ignored."""
    return df.withColumns({c: clean(c, config) for c in columns if c in df.columns})
