"""Findings as a relation: joins with word lists, exclusion lists and entity tables.

These are for lists too large to sit in a plan. A list is broadcast only when its file size
is known to Spark and small; otherwise the join shuffles on the joined word. Hot words are
handled by pre-aggregation (see :func:`dictionary_hits`) and by adaptive skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.functions.detect import Plan
from sparkveil.functions import spans as S
from sparkveil.functions.sql import apply
from sparkveil.operators.redaction import run_stages
from sparkveil.plans import catalog
from sparkveil.plans import words as W
from sparkveil.plans.config import RedactionConfig
from sparkveil.plans.tokens import token
from sparkveil.plans.words import NameLists

CANDIDATE = (
    "array<struct<start:int,end:int,ord:int,original:string,replacement:string,pi_type:string,"
    "confidence:double,method:string>>"
)


def words_of(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One row per distinct word of a text, with the number of times it occurs there."""
    word = F.explode(F.split(F.lower(column), r"[^\p{L}]+")).alias("word")
    return (
        df.select(*keep, word).filter("word != ''").groupBy(*keep, "word").agg(F.count("*").alias("n"))
    )


def dictionary_hits(words: DataFrame, names: DataFrame, word: str = "word", name: str = "name") -> DataFrame:
    """Words that are known names. The list is made distinct first, so no row is multiplied.

    No broadcast hint: Spark broadcasts the list itself when its size allows.
    """
    known = names.select(F.lower(F.trim(name)).alias("__name")).filter("__name != ''").distinct()
    return words.join(known, F.lower(F.col(word)) == F.col("__name"), "left_semi")


def without_excluded(found: DataFrame, excluded: DataFrame, value: str, by_domain: bool = False) -> DataFrame:
    """Findings whose text (or mail domain) is not in a table of exclusions.

    The exclusions are first cut down to those that occur, by distinct values that are aggregated
    before the shuffle; a value that holds much of all findings is then dealt over 16 parts.
    """
    key = F.lower(F.col("original"))
    if by_domain:
        key = F.substring_index(key, "@", -1)
    keyed = found.withColumn("__key", key)
    seen = keyed.select("__key").distinct()
    drop = seen.join(excluded.select(F.lower(value).alias("__key")).distinct(), "__key", "left_semi")
    drop = drop.select("__key", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("__part"))
    dealt = keyed.withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    return dealt.join(drop, ["__key", "__part"], "left_anti").select(*found.columns)


def entity_findings(entities: DataFrame, config: RedactionConfig | None = None, names: NameLists | None = None) -> DataFrame:
    """Filter an upstream entity table ``(…, start, end, label, text)`` down to findings.

    People unless a word of theirs is a stop word or a known system; organisations only from
    the company list; places unless they are common ones.
    """
    cfg, lists = config or RedactionConfig(), names or NameLists()
    low = F.lower("text")
    words = F.split(low, r"\s+")
    stop = sorted(lists.entity_stop)
    person = (
        (F.col("label") == "PERSON")
        & ~F.arrays_overlap(words, F.array(*[F.lit(w) for w in stop]))
        & ~low.isin(*stop)
        & ~low.isin(*W.SYSTEMS)
    )
    org = (F.col("label") == "ORG") & low.isin(*W.COMPANIES) & F.lit(cfg.redact_companies)
    place = F.col("label").isin("GPE", "LOC") & ~low.isin(*W.COMMON_PLACES) & F.lit(cfg.redact_locations)
    kind = (
        F.when(person & F.lit(cfg.redact_names), "NAME").when(org, "ORG").when(place, "LOCATION")
    )
    shown = F.concat(F.lit("["), F.col("pi_type"), F.lit("]")) if cfg.use_typed_tokens else F.lit(cfg.replacement_token)
    return (
        entities.withColumn("pi_type", kind)
        .filter("pi_type IS NOT NULL")
        .withColumn("replacement", shown)
        .withColumns({"confidence": F.lit(0.85), "method": F.lit("ner")})
        .withColumnRenamed("text", "original")
        .drop("label")
    )


def _resolved(rows: DataFrame, key: str, extra: DataFrame, plan: Plan, extra_layer: int) -> DataFrame:
    """`rows` (candidates of the rules in `__c`) with the kept findings of both sides in `__k`."""
    place = sum(1 for r in plan.rows if r.family.layer < extra_layer)
    grouped = extra.groupBy(key).agg(
        F.collect_list(
            F.struct(
                F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(place).alias("ord"), "original",
                "replacement", "pi_type", F.col("confidence").cast("double").alias("confidence"), "method",
            )
        ).alias("__e")
    )

    def placed(column: str, order):
        return F.transform(
            F.coalesce(column, F.array().cast(CANDIDATE)),
            lambda c: F.struct(c.start.alias("s"), (c.start - c.end).alias("n"), order(c.ord).alias("o"), c.end.alias("e"), c.alias("c")),
        )

    # rules at or after the extra layer move back one place, so that ties follow the layers
    rules = placed("__c", lambda o: F.when(o >= place, o + 1).otherwise(o))
    both = rows.join(grouped, key, "left").withColumn("__z", F.array_sort(F.concat(rules, placed("__e", lambda o: o))))
    return both.withColumn("__k", apply("__z", "z", f"transform({S.resolve('z')}, i -> z[i].c)")).drop("__c", "__e", "__z")


def merge_candidates(
    df: DataFrame,
    column: str,
    key: str,
    extra: DataFrame,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    extra_layer: int = 14,
) -> DataFrame:
    """Rule findings of ``df`` together with findings from another table, overlaps resolved.

    ``extra`` has ``key, start, end, original, replacement, pi_type, confidence, method``;
    offsets refer to the cleaned text. One shuffle on the document key, which is unique on
    the text side; a document's findings are bounded by the length of its text.
    """
    plan = Plan(config, names)
    rules = run_stages(df.select(key, column), {"__c": column}, plan.candidates()).drop(column)
    kept = _resolved(rules, key, extra, plan, extra_layer)
    return kept.select(key, F.inline_outer("__k")).filter("start IS NOT NULL").drop("ord")


def redact_with(
    df: DataFrame,
    column: str,
    key: str,
    extra: DataFrame,
    config: RedactionConfig | None = None,
    names: NameLists | None = None,
    extra_layer: int = 14,
    suffix: str = "_cleaned",
) -> DataFrame:
    """``df`` with ``<column><suffix>``: rule findings and those of ``extra`` written into the text.

    ``extra`` is as in :func:`merge_candidates`: entities, names from a table or any other
    findings. Null stays null and blank stays as it is; a row without a key gets the rules alone.
    """
    plan = Plan(config, names)
    rows = run_stages(df.withColumn("__x", F.col(column).cast("string")), {"__c": "__x"}, plan.candidates())
    rows = run_stages(rows, {"__s": "__x"}, plan.text_stages())
    rows = _resolved(rows, key, extra, plan, extra_layer)
    kept = F.transform("__k", lambda c: F.struct(c.start.alias("s"), c.end.alias("e"), c.replacement.alias("tok")))
    state = F.struct(F.col("__s.x").alias("x"), F.col("__s.t").alias("t"), kept.alias("k"))
    rows = rows.withColumn("__s", F.when(F.col("__s").isNotNull(), state))
    done = run_stages(rows, {"__r": "__s"}, [*plan.rewrite_stages(), "s.r"])
    return done.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce("__r", "__x").alias(f"{column}{suffix}"))


#: Parts that the rows of one word are dealt over, so that a hot name is not one task's work.
SALTS = 16


def dictionary_findings(
    df: DataFrame, column: str, key: str, names: DataFrame, name: str = "name", config: RedactionConfig | None = None
) -> DataFrame:
    """Phrases that hold a name from a table of any size, overlaps resolved.

    The three rules of the plan form: capitalised phrases of two words or more, phrases in
    capitals, and single names behind a lead-in word. They are found without a list. The table
    is first cut down to the words that occur (distinct words, aggregated before the shuffle);
    what is left is joined back over ``SALTS`` parts of each word. ``key`` is unique.
    """
    cfg = config or RedactionConfig()
    family = next(f for f in catalog.FAMILIES if f.ident == "NAM5")
    rules = [d for d in family.detectors if d.name in ("CAPITALISED_NAME", "UPPER_NAME", "SINGLE_NAME")]
    at = {d.name: k for k, d in enumerate(rules)}
    text = run_stages(df.select(key, column), {"__t": column}, Plan(cfg).cleaned())
    found = text.select(
        key, F.inline_outer(apply("__t", "t", f"IF(t IS NULL, {S.NONE}, {S.find('t', *rules)})"))
    ).filter("s IS NOT NULL")
    lead = F.array(*[F.lit(w) for w in W.LEAD_IN_WORDS])
    cut = F.aggregate(
        F.split("v", r"\s+"),
        F.lit(0),
        lambda a, w: F.when((a < 0), a).when(F.array_contains(lead, F.lower(w)), a + F.length(w) + 1).otherwise(-a - 1),
    )
    capital = F.col("o") == at["CAPITALISED_NAME"]
    one = F.col("o") == at["SINGLE_NAME"]
    phrases = (
        found.withColumn("__cut", F.when(capital, cut).otherwise(0))
        .withColumn("__cut", F.when(F.col("__cut") < 0, -F.col("__cut") - 1).otherwise(F.col("__cut")))
        .withColumn("original", F.expr("substring(v, __cut + 1, length(v))"))
        .select(key, (F.col("s") + F.col("__cut")).alias("start"), F.col("e").alias("end"), "o", "original")
        .withColumn("__w", F.when(one, F.array(F.lower("original"))).otherwise(F.split(F.lower("original"), r"\s+")))
        .filter(
            F.when(capital, (F.size("__w") >= 2) & ~F.element_at("__w", -1).isin(*W.PLACE_WORDS))
            .when(one, ~F.lower("original").isin(*W.NOT_A_SINGLE_NAME))
            .otherwise(True)
        )
    )
    exploded = phrases.select(key, "start", "end", "o", "original", F.explode(F.array_distinct("__w")).alias("word"))
    known = dictionary_hits(exploded.select("word").distinct(), names, "word", name)
    known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = exploded.withColumn("__salt", F.pmod(F.xxhash64(key, "start"), F.lit(SALTS)).cast("int")).join(known, ["word", "__salt"], "left_semi")
    order = F.struct(F.col("start").alias("s"), (F.col("start") - F.col("end")).alias("n"), "o", F.col("end").alias("e"), "original")
    kept = hits.groupBy(key).agg(F.sort_array(F.collect_set(order)).alias("z"))
    kept = kept.select(key, F.inline(apply("z", "z", f"transform({S.resolve('z')}, i -> z[i])")))
    return kept.select(
        key, F.col("s").alias("start"), F.col("e").alias("end"), "original",
        F.lit(token(cfg, "NAME")).alias("replacement"), F.lit("NAME").alias("pi_type"),
        F.lit(family.confidence).alias("confidence"), F.lit(family.method).alias("method"),
    )


def near_pairs(left: DataFrame, right: DataFrame, key: str, distance: int = 100, bucket: int = 100) -> DataFrame:
    """Pairs of a right span that ends at most ``distance`` characters before a left span.

    ``left`` has ``key, start, end`` and ``right`` has ``key, r_start, r_end``. The theta
    join becomes an equi-join on document and position bucket, so a document with very many
    spans spreads over many tasks and no two far spans ever meet.
    """
    reach = -(-distance // bucket)
    spread = left.select("*", F.explode(F.sequence(
        F.floor(F.col("start") / bucket) - reach, F.floor(F.col("start") / bucket)
    )).alias("__b"))
    placed = right.withColumn("__b", F.floor(F.col("r_start") / bucket))
    return spread.join(placed, [key, "__b"]).filter(
        (F.col("r_start") >= F.col("start") - distance) & (F.col("r_end") <= F.col("start"))
    ).drop("__b")
