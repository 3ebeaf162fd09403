"""Redaction inside structures: nested columns, JSON text and HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.functions.clean import unmark_sql
from sparkveil.functions.spans import BLOCK
from sparkveil.functions.sql import EDGE, ITEM, START, apply, lit, regex
from sparkveil.operators.redaction import run_stages
from sparkveil.functions.detect import Plan
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.words import NameLists


def _leaves(value: Column, kind: T.DataType) -> list[Column]:
    """Arrays of the text leaves below ``value``, in walk order."""
    if isinstance(kind, T.StringType):
        return [F.array(value)]
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(value.getField(f.name), f.dataType)]
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner, items = (
            (kind.elementType, value) if isinstance(kind, T.ArrayType) else (kind.valueType, F.map_values(value))
        )
        if not _has_text(inner):
            return []
        each = F.transform(F.coalesce(items, F.array().cast(T.ArrayType(inner))), lambda x: F.concat(*_leaves(x, inner)))
        return [F.flatten(each)]
    return []


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_text(kind.valueType)
    return isinstance(kind, T.StringType)


def _rebuild(value: Column, kind: T.DataType, known: Column) -> Column:
    """``value`` with every text leaf looked up in the map ``known`` (old text -> new text)."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.element_at(known, value), value)
    if isinstance(kind, T.StructType):
        fields = [_rebuild(value.getField(f.name), f.dataType, known).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and _has_text(kind.elementType):
        return F.transform(value, lambda x: _rebuild(x, kind.elementType, known))
    if isinstance(kind, T.MapType) and _has_text(kind.valueType):
        return F.transform_values(value, lambda _, v: _rebuild(v, kind.valueType, known))
    return value


def redact_nested(
    df: DataFrame,
    columns: Sequence[str],
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
) -> DataFrame:
    """Redact every text leaf of nested columns in place; keys and other scalars stay.

    The distinct leaves of a row are redacted as one array and put back by value, so each
    text is worked on once and nothing is exploded or shuffled.
    """
    plan = Plan((config or RedactionConfig()).repaired(), names)
    for column in columns:
        kind = df.schema[column].dataType
        if not _has_text(kind):
            continue
        leaves = F.array_compact(F.array_distinct(F.concat(*_leaves(F.col(column), kind))))
        work = run_stages(df.withColumn("__old", leaves), {"__new": "__old"}, plan.redacted())
        pairs = F.map_from_arrays("__old", F.zip_with("__new", "__old", lambda n, o: F.coalesce(n, o)))
        df = work.withColumn("__map", pairs).withColumn(column, _rebuild(F.col(column), kind, F.col("__map")))
        df = df.drop("__old", "__new", "__map")
    return df


def redact_json(
    df: DataFrame,
    column: str,
    schema: T.DataType | str,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    out: str | None = None,
) -> DataFrame:
    """Redact the text leaves of JSON held as text. A text that is no JSON becomes NULL."""
    parsed = df.withColumn("__j", F.from_json(column, schema))
    done = redact_nested(parsed, ["__j"], config, names)
    return done.withColumn(out or column, F.to_json("__j", {"ignoreNullFields": "false"})).drop("__j")


# -- JSON of any depth, as text -----------------------------------------------

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_LEAF = "struct<path:string,text:string>"


def _unescaped(literal: str) -> str:
    return f"from_json(concat('[', {literal}, ']'), 'array<string>')[0]"


def _escaped(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def _valid_json(x: str) -> str:
    """Well-formed, and nothing but marks, numbers and literals stands outside the strings."""
    outside = f"regexp_replace({x}, {lit('(?s)' + _STRING)}, '')"
    plain = lit(r"^[-+.0-9eEtrufalsn\s\[\]{}:,]*$")
    return f"((get_json_object({x}, '$') IS NOT NULL OR trim({x}) = 'null') AND {outside} RLIKE {plain})"


def _state(path: str = "a.p", objects: str = "a.k", places: str = "a.i", key: str = "false", out: str = "a.out", done: str = "a.done") -> str:
    """The walk's state: path parts, which open containers are objects, places in arrays, whether a key comes next, leaves."""
    return f"named_struct('p', {path}, 'k', {objects}, 'i', {places}, 'e', {key}, 'out', {out}, 'done', {done})"


def _walk_sql(x: str) -> str:
    """The leaves of the JSON text ``x`` in one pass over its tokens, with the path as a stack."""
    tokens = f"regexp_extract_all({x}, {lit('(?s)' + _STRING + r'|[{}\[\],:]')}, 0)"
    start = _state(
        "CAST(array() AS array<string>)", "CAST(array() AS array<boolean>)", "CAST(array() AS array<int>)", "false",
        f"CAST(array() AS array<{_LEAF}>)", f"CAST(array() AS array<array<{_LEAF}>>)",
    )
    rest = {name: f"slice(a.{name}, 1, size(a.p) - 1)" for name in "pki"}
    place = "a.i[size(a.p) - 1] + 1"
    leaf = f"named_struct('path', concat('$', array_join(a.p, '')), 'text', {_unescaped('t')})"
    full = _state(out=f"array({leaf})", done="array_append(a.done, a.out)")  # leaves grow in blocks: appending copies
    cases = [
        ("t = '{'", _state("array_append(a.p, '')", "array_append(a.k, true)", "array_append(a.i, 0)", "true")),
        ("t = '['", _state("array_append(a.p, '[0]')", "array_append(a.k, false)", "array_append(a.i, 0)")),
        ("t IN ('}', ']')", _state(rest["p"], rest["k"], rest["i"])),
        ("t = ':'", _state()),
        ("t = ',' AND a.k[size(a.p) - 1]", _state(key="true")),
        ("t = ','", _state(f"array_append({rest['p']}, concat('[', {place}, ']'))", places=f"array_append({rest['i']}, {place})")),
        ("a.e", _state(f"array_append({rest['p']}, concat('.', {_unescaped('t')}))")),
        (f"size(a.out) < {BLOCK}", _state(out=f"array_append(a.out, {leaf})")),
    ]
    step = "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in cases) + f" ELSE {full} END"
    return f"aggregate({tokens}, {start}, (a, t) -> {step}, a -> flatten(array_append(a.done, a.out)))"


def json_leaves(df: DataFrame, column: str, keep: Sequence[str], depth: int | None = None) -> DataFrame:
    """All text leaves of untyped JSON with their paths, at any depth, without knowing a schema.

    Where ``depth`` is given, leaves below it fail the job. A text that is no JSON has no leaves.
    """
    walked = apply(column, "x", f"IF({_valid_json('x')}, {_walk_sql('x')}, NULL)")
    found = df.select(*keep, F.inline_outer(walked))
    if depth is not None:
        parts = F.size(F.regexp_extract_all("path", F.lit(r"\.[^.\[]+|\[\d+\]"), F.lit(0)))
        fail = F.raise_error(F.lit(f"JSON nested deeper than {depth}")).cast("string")
        found = found.withColumn("text", F.when(parts > depth, fail).otherwise(F.col("text")))
    return found.filter("text IS NOT NULL")


def redact_json_text(
    df: DataFrame,
    column: str,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    out: str | None = None,
) -> DataFrame:
    """Redact the text values of JSON held as text, at any depth, without a schema.

    Keys, numbers, blanks and values without a finding come back byte for byte. A text that is no
    JSON becomes NULL.
    """
    plan = Plan((config or RedactionConfig()).repaired(), names)
    strings = lit("(?s)(" + _STRING + r")(\s*+:)?+")
    marked = f"regexp_replace({unmark_sql('x')}, {strings}, '{START}$1{EDGE}$2{ITEM}')"
    piece = (
        f"named_struct('value', substring_index(p, '{EDGE}', 1), 'key', NOT contains(p, '{EDGE}{ITEM}'), "
        f"'rest', translate(substring(p, instr(p, '{EDGE}')), '{EDGE}{ITEM}', ''))"
    )
    rows = df.withColumn("__c", apply(column, "x", f"IF({_valid_json('x')}, split({marked}, '{START}'), NULL)"))
    rows = rows.withColumn("__p", apply("__c", "c", f"transform(slice(c, 2, size(c)), p -> {piece})"))
    rows = rows.withColumn("__t", F.expr(f"transform(__p, p -> IF(p.key, NULL, {_unescaped('p.value')}))"))
    done = run_stages(rows, {"__r": "__t"}, plan.rewritten())
    joined = F.array_join(F.zip_with("__p", "__r", lambda p, r: F.concat(F.when(r.isNull(), p.value).otherwise(_escaped(r)), p.rest)), "")
    return done.withColumn(out or column, F.concat(F.get("__c", F.lit(0)), joined)).drop("__c", "__p", "__t", "__r")


# -- HTML --------------------------------------------------------------------

# One scan of alternatives that never go back: comments, CDATA, raw elements, tags with quoted attributes,
# declarations, and tags whose quotes do not close. A "<" that starts none of them is text.
_QUOTED = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
_MARKUP = (
    r"(?is)<!--(?:.*?-->|.*\z)|<!\[CDATA\[(?:.*?\]\]>|.*\z)"
    rf"|<(script|style)(?=[\s/>]){_QUOTED}(?:.*?</\1\s*>|.*\z)"
    rf"|</?[a-z]{_QUOTED}|<[/!?][^>]*+>|</?[a-z][^>]*+>"
)


def _html_part(text: str, part: str, kind: str) -> str:
    return f"named_struct('is_text', {text}, 'part', {part}, 'kind', '{kind}')"


def _inside(head: str, tail: str, kind: str) -> str:
    """The marks of ``p`` and what stands between them; an unfinished one has no tail."""
    ends = f"endswith(p, '{tail}')"
    body = f"substring(p, {len(head) + 1}, length(p) - {len(head)} - IF({ends}, {len(tail)}, 0))"
    parts = (("false", f"left(p, {len(head)})", "markup"), ("true", body, kind), ("false", f"IF({ends}, '{tail}', '')", "markup"))
    return "array(" + ", ".join(_html_part(*x) for x in parts) + ")"


def html_parts(column: Column | str) -> Column:
    """``array<struct<pos, is_text, part, kind>>``: markup and text of a page, in order.

    Tags, declarations and whole script and style elements are markup. Text is of kind text,
    comment or cdata, without the marks around it; an unfinished comment reaches to the end.
    """
    cut = f"split(regexp_replace({unmark_sql('x')}, {regex(_MARKUP)}, '{START}$0{EDGE}'), '[{START}{EDGE}]')"
    parts = (
        f"CASE WHEN i % 2 = 0 THEN array({_html_part('true', 'p', 'text')}) "
        f"WHEN startswith(p, '<!--') THEN {_inside('<!--', '-->', 'comment')} "
        f"WHEN upper(left(p, 9)) = '<![CDATA[' THEN {_inside('<![CDATA[', ']]>', 'cdata')} "
        f"ELSE array({_html_part('false', 'p', 'markup')}) END"
    )
    numbered = "(e, i) -> named_struct('pos', i, 'is_text', e.is_text, 'part', e.part, 'kind', e.kind)"
    return apply(column, "x", f"transform(flatten(transform({cut}, (p, i) -> {parts})), {numbered})")


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def html_texts(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per text node that is not blank, comments and CDATA included."""
    parts = df.select(*keep, F.inline_outer(html_parts(column)))
    return parts.filter("is_text").filter(F.trim("part") != "").select(*keep, "pos", F.col("part").alias("text"))


def redact_html(
    df: DataFrame,
    column: str,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    out: str | None = None,
) -> DataFrame:
    """Redact text, comments and CDATA and keep the markup. Stays in the row: no explode, no regroup.

    What has no finding comes back byte for byte; the rest keeps the white space at its ends.
    """
    config = (config or RedactionConfig()).repaired()
    plan = Plan(config, names)
    decoded = config.enable_data_cleaning and config.clean_decode_html
    parts = df.withColumn("__p", html_parts(column))
    texts = parts.withColumn("__t", F.transform("__p", lambda p: F.when(p.is_text, p.part)))
    done = run_stages(texts, {"__r": "__t"}, plan.rewritten())

    def written(p: Column, r: Column) -> Column:
        # where cleaning has decoded the entities of a text, they are written again: text never turns into markup
        new = F.when(p.kind == "text", escape_html(r) if decoded else r).when(p.kind == "comment", F.replace(r, F.lit("--"), F.lit("- -")))
        new = new.otherwise(F.replace(r, F.lit("]]>"), F.lit("]]&gt;")))
        head, tail = (F.regexp_extract(p.part, side, 0) for side in (r"^\s*+", r"(?<!\s)\s*+\z"))
        return F.when(r.isNull(), p.part).otherwise(F.concat(head, new, tail))

    return done.withColumn(out or column, F.array_join(F.zip_with("__p", "__r", written), "")).drop("__p", "__t", "__r")
