"""Small helpers for writing Spark SQL expression text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode noncharacters: reserved for use inside a program, so they mark places in a text.
# ``functions.clean`` removes them from the input first.
START, EDGE, ITEM = "\ufdd0", "\ufdd1", "\ufdd2"
MARKS = START + EDGE + ITEM


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spelled(pattern: str) -> str:
    """Write ASCII letter and digit ranges in classes out as single characters.

    The regular-expression engine tests single characters of a class with one table look-up,
    but ranges one after the other.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if not in_class and ch == "[":
            in_class = True
        elif in_class and ch == "]":
            in_class = False
        elif in_class and pattern[i + 1 : i + 2] == "-" and ch.isascii() and ch.isalnum():
            last = pattern[i + 2]
            if last.isascii() and last.isalnum() and last > ch:
                out.append("".join(map(chr, range(ord(ch), ord(last) + 1))))
                i += 3
                continue
        out.append(ch)
        i += 1
    return "".join(out)


def regex(pattern: str, icase: bool = False) -> str:
    """A regex literal: Unicode classes, ``$`` only before a final newline, ASCII case folding."""
    return lit(f"(?Ud{'i' if icase else ''}-u){spelled(pattern)}")


def plain_regex(pattern: str) -> str:
    """A regex literal with ASCII classes only."""
    return lit(spelled(pattern))


def words(values: Iterable[str]) -> str:
    """The inside of an ``IN (...)`` list; Spark turns it into a hash set."""
    return ", ".join(lit(v) for v in sorted(values)) or "''"


def array(values: Iterable[str]) -> str:
    return "array(" + ", ".join(lit(v) for v in values) + ")"


def let(name: str, value: str, body: str) -> str:
    """Name an intermediate value, so that it is computed once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def any_of(text: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def apply(column: Column | str, var: str, body: str) -> Column:
    """Bind a column to ``var`` and evaluate the SQL text ``body`` over it."""
    col = F.col(column) if isinstance(column, str) else column
    return F.call_function("transform", F.array(col), F.expr(f"{var} -> {body}")).getItem(0)
