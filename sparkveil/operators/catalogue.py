"""What can be found, as a table; a check of the patterns; functions for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.functions.checks import luhn_sql, verhoeff_sql
from sparkveil.functions.clean import clean_sql
from sparkveil.functions.mask import LOG_MASKS
from sparkveil.functions.spans import present
from sparkveil.functions.sql import lit, regex
from sparkveil.plans import catalog
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.tokens import token


def supported_types(spark: SparkSession, config: RedactionConfig | None = None) -> DataFrame:
    """One row per enabled detector: place in the order, family, pattern name, type, token, provenance."""
    cfg = config or RedactionConfig()
    rows = [
        (
            r.ordinal, r.family.layer, r.family.ident, r.name,
            token(cfg, r.detector.kind, r.detector.sub).strip("[]"), token(cfg, r.detector.kind, r.detector.sub),
            r.family.method, r.family.confidence,
        )
        for r in catalog.rows(cfg)
    ]
    return spark.createDataFrame(
        rows, "ordinal int, layer int, family string, name string, pi_type string, token string, method string, confidence double"
    )


def broken_patterns(spark: SparkSession, config: RedactionConfig | None = None) -> list[str]:
    """Names of patterns that do not compile, found by running each once on an empty text."""
    bad = []
    for row in catalog.rows(config or RedactionConfig()):
        if not row.detector.pattern:
            continue
        try:
            spark.range(1).selectExpr(present("string(id)", row.detector)).first()
        except Exception:  # noqa: BLE001 - any failure means the pattern is unusable
            bad.append(row.name)
    return bad


def register_functions(spark: SparkSession, prefix: str = "sv_", config: RedactionConfig | None = None) -> list[str]:
    """Temporary SQL functions that expand to native expressions.

    Redaction itself is a chain of stages too deep for one expression; use
    ``operators.redaction`` for it.
    """
    masked = "x"
    for pattern, mask in LOG_MASKS:
        masked = f"regexp_replace({masked}, {regex(pattern)}, {lit(mask)})"
    bodies = {
        "clean": ("STRING", clean_sql("x", config)),
        "mask_log": ("STRING", masked),
        "verhoeff": ("BOOLEAN", verhoeff_sql("x")),
        "luhn": ("BOOLEAN", luhn_sql("x")),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in bodies]
