"""Input checks: hostile patterns, control characters, row and file validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.clean import CONTROL
from sparkveil.functions.sql import apply, lit, regex
from sparkveil.functions.unicode import affected_sql, compatibility_sql, exact_form
from sparkveil.functions.sql import let

# Category -> (pattern, ignore case).
INJECTION = {
    "sql_injection": (
        (r"(?:--|#|/\*)\s*$", True),
        (r";\s*(?:DROP|DELETE|UPDATE|INSERT|ALTER|TRUNCATE)\s+", True),
        (r"'\s*OR\s+'?\d+'?\s*=\s*'?\d+", True),
        (r"'\s*OR\s+'\w+'\s*=\s*'\w+'", True),
        (r"UNION\s+(?:ALL\s+)?SELECT", True),
        (r"(?:EXEC|EXECUTE)\s*\(?\s*(?:xp_|sp_)", True),
    ),
    "command_injection": (
        (r"[;&|]\s*(?:cat|ls|dir|rm|del|wget|curl|bash|sh|cmd|powershell)", True),
        (r"\$\(\s*\w+", True),
        (r"`[^`]+`", False),
        (r">\s*/(?:dev/|etc/|tmp/)", False),
        (r"\|\s*(?:bash|sh|zsh|cmd|powershell)", True),
    ),
    "script_injection": (
        (r"<\s*script\b[^>]*>", True),
        (r"javascript\s*:", True),
        (r"on\w+\s*=\s*[\"'][^\"']*[\"']", True),
        (r"<\s*iframe\b", True),
        (r"<\s*object\b", True),
        (r"<\s*embed\b", True),
        (r"<\s*svg\b[^>]*\s+on\w+", True),
        (r"expression\s*\(", True),
        (r"vbscript\s*:", True),
        (r"data\s*:\s*text/html", True),
    ),
    "path_traversal": (
        (r"\.\.[\\/]", False),
        (r"[\\/]\.\.", False),
        (r"%2e%2e[\\/]", True),
        (r"\.\.%2f", True),
    ),
}
# How the issues of each category are worded, and how much of the pattern is shown.
_LABEL = {
    "sql_injection": ("SQL injection", 50),
    "command_injection": ("Command injection", 50),
    "script_injection": ("Script injection", 50),
    "path_traversal": ("Path traversal", 30),
}

# Text content that makes a file suspicious.
SUSPICIOUS = (
    r"<script", r"javascript:", r"=cmd\|", r"=HYPERLINK\s*\(", r"@SUM\(", r"=DDE\s*\(",
    r"on\w+\s*=\s*[\"\']", r"<\s*iframe", r"<\s*object", r"<\s*embed", r"data:\s*text/html",
)
# Markers that make a PDF suspicious.
PDF_MARKERS = ("/JavaScript", "/JS ", "/Launch", "/OpenAction", "/AA ", "/EmbeddedFile", "/GoToR", "/GoToE")
# First bytes (hex) that a file with the extension must have.
MAGIC = {
    "504B0304": ("xlsx", "docx", "pptx"),
    "D0CF11E0": ("xls", "doc", "ppt"),
    "25504446": ("pdf",),
}
ALLOWED_EXTENSIONS = (
    "csv", "xlsx", "xls", "json", "txt", "docx", "doc", "pptx", "ppt", "pdf", "html", "htm", "xml", "md", "log",
)
CONTROL_KEEPING_BREAKS = CONTROL
CONTROL_ALL = r"[\x00-\x1f\x7f]"


@dataclass(frozen=True)
class SanitizerConfig:
    max_length: int | None = None
    """Texts are cut only where a length is given."""
    allow_newlines: bool = True
    allow_tabs: bool = True
    allow_carriage_return: bool = True
    unicode_normalization: str | None = "NFKC"
    escape_html: bool = False
    strip_null_bytes: bool = True


def issues(column: Column | str, categories: Sequence[str] = tuple(INJECTION)) -> Column:
    """One line for every hostile pattern found."""
    tests = []
    for category in categories:
        label, shown = _LABEL[category]
        for pattern, icase in INJECTION[category]:
            text = lit(f"{label} pattern detected: {pattern[:shown]}")
            tests.append(f"IF(x RLIKE {regex(pattern, icase)}, {text}, NULL)")
    return apply(column, "x", f"coalesce(array_compact(array({', '.join(tests)})), CAST(array() AS array<string>))")


def flag(column: Column | str, category: str) -> Column:
    """Whether a text holds any pattern of one category; null and empty are safe."""
    tests = " OR ".join(f"x RLIKE {regex(p, i)}" for p, i in INJECTION[category])
    return apply(column, "x", f"coalesce({tests}, FALSE)")


def inspect(column: Column | str, categories: Sequence[str] = tuple(INJECTION)) -> Column:
    """``struct<is_safe, issues, categories>``."""
    found = issues(column, categories)
    kinds = F.array_compact(F.array(*[F.when(flag(column, c), F.lit(c)) for c in categories]))
    return F.struct((F.size(found) == 0).alias("is_safe"), found.alias("issues"), kinds.alias("categories"))


def _removed(x: str, pattern: str) -> tuple[str, str]:
    kept = f"regexp_replace({x}, {lit(pattern)}, '')"
    return kept, f"length({x}) - length({kept})"


def without_control(column: Column | str, config: SanitizerConfig | None = None) -> Column:
    """``struct<text, removed>``. Any allowance keeps tab, newline and carriage return alike."""
    c = config or SanitizerConfig()
    keep = c.allow_newlines or c.allow_tabs or c.allow_carriage_return
    kept, count = _removed("x", CONTROL_KEEPING_BREAKS if keep else CONTROL_ALL)
    return apply(column, "x", f"named_struct('text', {kept}, 'removed', {count})")


def without_nulls(column: Column | str) -> Column:
    kept, count = _removed("x", r"\x00")
    return apply(column, "x", f"named_struct('text', {kept}, 'removed', {count})")


def escape_html(column: Column | str) -> Column:
    text = "x"
    # Ampersand first.
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    return apply(column, "x", text)


def unicode_form(column: Column | str, form: str = "NFKC", exact: bool = False) -> Column:
    """All four forms stay in the JVM; ``exact`` asks the workers' own Python, in Arrow batches."""
    if exact:
        return exact_form(column, form)
    return apply(column, "x", f"IF({affected_sql('x', form)}, {compatibility_sql('x', form)}, x)")


def sanitize(column: Column | str, config: SanitizerConfig | None = None, detect: bool = False) -> Column:
    """``struct<text, was_modified, warnings, removed_chars>``.

    Truncate (on demand), drop null bytes, drop control characters, normalise, escape. ``detect`` puts
    the hostile patterns in front of the warnings; they never block.
    """
    c = config or SanitizerConfig()
    none = "CAST(array() AS array<string>)"
    steps = [f"named_struct('o', s, 't', s, 'n', 0, 'w', {none})"]
    if c.max_length is not None:
        steps = [
            f"named_struct('o', s, 't', left(s, {c.max_length}), 'n', 0, 'w', IF(length(s) > {c.max_length}, "
            f"array(concat('Text truncated from ', length(s), ' to {c.max_length} chars')), {none}))"
        ]

    def drop(pattern: str, what: str) -> str:
        kept, count = _removed("s.t", pattern)
        return let(
            "z",
            f"named_struct('t', {kept}, 'n', {count})",
            "named_struct('o', s.o, 't', z.t, 'n', s.n + z.n, 'w', IF(z.n > 0, "
            f"array_append(s.w, concat('Removed ', z.n, ' {what}')), s.w))",
        )

    def change(sql: str, warning: str) -> str:
        return let(
            "z", sql,
            f"named_struct('o', s.o, 't', z, 'n', s.n, 'w', IF(z != s.t, array_append(s.w, {lit(warning)}), s.w))",
        )

    if c.strip_null_bytes:
        steps.append(drop(r"\x00", "null byte(s)"))
    keep = c.allow_newlines or c.allow_tabs or c.allow_carriage_return
    steps.append(drop(CONTROL_KEEPING_BREAKS if keep else CONTROL_ALL, "control character(s)"))
    if c.unicode_normalization:
        form = c.unicode_normalization
        steps.append(change(f"IF({affected_sql('s.t', form)}, {compatibility_sql('s.t', form)}, s.t)", f"Text was Unicode normalized ({form})"))
    out = col = F.col(column) if isinstance(column, str) else column
    if c.escape_html:
        escaped = "s.t"
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            escaped = f"replace({escaped}, {lit(old)}, {lit(new)})"
        steps.append(change(escaped, "HTML entities were escaped"))
    for step in steps:
        out = apply(out, "s", f"IF(s IS NULL, NULL, {step})")
    out = apply(out, "s", "named_struct('text', s.t, 'was_modified', s.t != s.o, 'warnings', s.w, 'removed_chars', s.n)")
    if not detect:
        return out
    noted = F.transform(issues(col), lambda i: F.concat(F.lit("Warning: "), i))
    return out.withField("warnings", F.concat(noted, out["warnings"]))


def text_stats(column: Column | str) -> Column:
    """``struct<length, lines, has_unicode, has_control_chars, has_null_bytes>``."""
    return apply(
        column,
        "x",
        "IF(x IS NULL OR x = '', named_struct('length', 0, 'lines', 0, 'has_unicode', FALSE, "
        "'has_control_chars', FALSE, 'has_null_bytes', FALSE), named_struct('length', length(x), "
        "'lines', length(x) - length(replace(x, '\\n', '')) + 1, 'has_unicode', octet_length(x) > length(x), "
        f"'has_control_chars', x RLIKE {lit(CONTROL_ALL)}, 'has_null_bytes', x RLIKE {lit(r'\x00')}))",
    )


def row_error(column: Column | str, max_length: int | None = None) -> Column:
    """Why a text cannot be processed, or NULL. Long texts are refused only where a length is given."""
    long = f"WHEN length(x) > {max_length} THEN 'Text exceeds maximum length of {max_length} characters' " if max_length is not None else ""
    return apply(
        column,
        "x",
        "CASE WHEN x IS NULL OR x = '' THEN 'Text cannot be empty' "
        f"{long}WHEN x RLIKE {lit(r'\x00')} THEN 'Text contains invalid null bytes' END",
    )


def quarantine(df: DataFrame, column: str, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows into processable ones and ones with a reason; both stay lazy and whole."""
    checked = df.withColumn("row_error", row_error(column, max_length))
    return checked.filter("row_error IS NULL").drop("row_error"), checked.filter("row_error IS NOT NULL")


def valid_request_id(column: Column | str) -> Column:
    return apply(column, "x", r"coalesce(length(x) BETWEEN 1 AND 64 AND replace(replace(x, '-', ''), '_', '') RLIKE '^(?U)[\\p{Alpha}\\p{Digit}]+\\z', FALSE)")


def filename_error(column: Column | str) -> Column:
    allowed = ", ".join(lit(e) for e in ALLOWED_EXTENSIONS)
    return apply(
        column,
        "x",
        "CASE WHEN x IS NULL OR x = '' THEN 'Filename cannot be empty' "
        "WHEN contains(x, '..') OR startswith(x, '/') OR startswith(x, '\\\\') THEN 'Invalid filename: path traversal detected' "
        f"WHEN NOT (x RLIKE {regex(r'^[\w\-. ]+$')}) THEN 'Filename contains invalid characters' "
        f"WHEN NOT (contains(x, '.') AND lower(substring_index(x, '.', -1)) IN ({allowed})) THEN 'File type not allowed' END",
    )


def suspicious(column: Column | str) -> Column:
    """Whether a text looks like an attack, anywhere in it."""
    tests = " OR ".join(f"x RLIKE {regex(p, True)}" for p in SUSPICIOUS)
    return apply(column, "x", f"coalesce({tests}, FALSE)")


def file_error(name: Column | str, size: Column | str, content: Column | str, max_size: int | None = None) -> Column:
    """Triage of a ``binaryFile`` row: name, first bytes, whole text content, PDF markers; size in bytes on demand."""
    n, s, c = (F.col(v) if isinstance(v, str) else v for v in (name, size, content))
    ext = F.lower(F.substring_index(n, ".", -1))
    magic = F.hex(F.substring(c, 1, 4))
    wrong = F.lit(False)
    for head, kinds in MAGIC.items():
        wrong = wrong | (ext.isin(*kinds) & (magic != F.lit(head)))
    text = c.cast("string")
    pdf = F.decode(c, "ISO-8859-1")
    marked = F.lit(False)
    for marker in PDF_MARKERS:
        marked = marked | pdf.contains(marker)
    return (
        F.when(F.lit(False) if max_size is None else s > max_size, F.lit(f"File exceeds maximum size of {max_size} bytes"))
        .when(s == 0, F.lit("File is empty"))
        .when(filename_error(n).isNotNull(), filename_error(n))
        .when(wrong, F.lit("File content does not match extension"))
        .when(
            ext.isin("csv", "txt", "json", "md", "log", "html", "htm", "xml") & suspicious(text),
            F.lit("File contains potentially malicious content"),
        )
        .when((ext == "pdf") & marked, F.lit("PDF contains content which may be unsafe"))
    )
