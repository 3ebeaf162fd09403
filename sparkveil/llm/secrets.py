"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger remembers which
rule versions have seen which blob and what they found, so a run reads the texts of blobs with
unseen (blob, rule version) pairs only, each blob once however many paths hold it, and only by the
rules that have not seen it. Findings are joined back to all paths, old and new.

The ledger is a folder: `scans/<run>` holds the rows of a run, `runs` names the runs that came to
their end. A run that was lost half way is not named and so does not count.

Defined results: a null text counts as empty; repeated rows and paths stay as they are, each with
its findings; a null path is a path; an empty table gives no rows; columns named like ours keep
their names and ours get a trailing underscore. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkveil.llm.common import free_name, held, join_counted, stored, text_of


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has `least` characters or more.

    `needs` is a string that every match holds; texts without it are not searched. The version
    follows from everything that decides the findings, so an edited rule scans all blobs again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: str = ""

    @property
    def version(self) -> str:
        what = "\0".join((self.pattern, str(self.group), str(self.least)))
        return f"{self.kind}@{hashlib.sha256(what.encode()).hexdigest()[:16]}"


#: Kinds every scan has (fixed values).
BASE = (
    Rule(
        "assign",
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Kinds of our own: key blocks, tokens with a known head, passwords in addresses.
MORE = (
    Rule("key_block", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("host_token", "gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("url_password", "://[^\\x09-\\x0D\\x20:/@]{1,64}:[^\\x09-\\x0D\\x20:/@]{1,64}@", needs="://"),
)
RULES = (*BASE, *MORE)


def _committed(spark: SparkSession, folder: str) -> DataFrame | None:
    """Rows of all finished runs; None for a new ledger."""
    try:
        runs = [r.run for r in spark.read.parquet(f"{folder}/runs").select("run").distinct().collect()]  # one row a run
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.schema(_SCAN).parquet(*(f"{folder}/scans/{run}" for run in sorted(runs)))


_SCAN = "blob binary, rules array<string>, k int, kind string, start long, end long"


def _spans(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rules, k, kind, start, end) of texts (blob, text, todo); one row without kind for a blob without findings.

    Matches and the gaps between them come from the same search, and running sums of their lengths
    are the places. The sums run over rows of one blob and rule, so a text with any number of
    matches takes linear time.
    """
    found = []
    for k, rule in enumerate(rules):
        wanted = F.array_contains("todo", rule.version) & (F.contains("text", F.lit(rule.needs)) if rule.needs else F.lit(True))
        hits = F.when(wanted, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))
        found.append(F.struct(F.lit(k).alias("k"), hits.alias("hits")))
    rows = texts.withColumn("found", F.filter(F.array(*found), lambda f: F.size(f.hits) > 0))
    rows = rows.select("blob", "todo", "text", F.explode_outer("found").alias("f")).select("blob", "todo", "text", "f.k", "f.hits")
    gaps, parts, least = F.lit(None), F.lit(None), F.lit(0)
    for k, rule in enumerate(rules):
        this = F.col("k") == k
        gaps = F.when(this, F.split("text", rule.pattern, -1)).otherwise(gaps)
        parts = F.when(this, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else F.col("hits")).otherwise(parts)
        least = F.when(this, F.lit(rule.least)).otherwise(least)
    sizes = lambda c: F.transform(c, F.char_length)
    rows = rows.select("blob", "todo", "k", least.alias("least"), sizes(F.col("hits")).alias("hits"), sizes(gaps).alias("gaps"), sizes(parts).alias("parts"))
    rows = held(rows, "hits", "gaps", "parts")
    each = F.transform("hits", lambda n, i: F.struct(n.alias("size"), F.get("gaps", i).alias("gap"), F.get("parts", i).alias("part")))
    rows = rows.select("blob", "todo", "k", "least", F.posexplode_outer(each).alias("i", "m"))
    by = Window.partitionBy("blob", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(by)
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("k") + 1)
    good = F.col("m.part") >= F.col("least")
    return rows.select("blob", "todo", "k", end.alias("end"), "m", good.alias("good")).select(
        "blob", F.col("todo").alias("rules"), "k", F.when(F.col("good"), kind).alias("kind"), (F.col("end") - F.col("m.size")).alias("start"), "end"
    )


def update(addressed: DataFrame, versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES) -> DataFrame | None:
    """Scans what no finished run has seen; the rows of this run, or None where there was nothing to do.

    `addressed` has the column blob; `versions` has blob and text. Known blobs cost a join on their
    addresses; their texts do not travel.
    """
    spark = versions.sparkSession
    names = F.array(*(F.lit(r.version) for r in rules))
    known = _committed(spark, folder)
    if known is None:
        texts = versions.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", names)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.version for r in rules]))
        seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = F.when(F.col("seen").isNull(), names).otherwise(F.array_except(names, "seen"))
        unseen = addressed.select("blob").distinct().join(seen, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)
        unseen = stored(unseen)
        if unseen.isEmpty():
            return None
        texts = versions.join(unseen.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob")
    run = uuid.uuid4().hex
    rows = stored(_spans(texts, rules), f"{folder}/scans/{run}")
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{folder}/runs")
    return rows


def address(text: Column) -> Column:
    """The address of a text: SHA-256 of its UTF-8 bytes."""
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def scan(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every row of `versions` without its text, with `blob` and `secrets`: array<struct<kind, start, end>>.

    Starts are code points from 0, ends are exclusive, in order of start and then of the rules.
    `folder` is the ledger, kept from run to run, in a place that driver and executors share.
    """
    rest = [c for c in versions.columns if c != text]
    blob, secrets = free_name(versions.select(*rest), "blob"), free_name(versions.select(*rest), "secrets")
    plain = versions.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), text_of(text).alias("text"))
    addressed = stored(plain.select("row", address(F.col("text")).alias("blob"), F.monotonically_increasing_id().alias("spot")))
    update(addressed, plain.select(address(F.col("text")).alias("blob"), "text"), folder, rules)
    current = F.array(*(F.lit(r.version) for r in rules))
    found = _committed(addressed.sparkSession, folder).where(F.col("kind").isNotNull())
    # a finding counts if its rule version is among the rules of this call, numbered as they are here
    place = F.lit(None).cast("int")
    for k, rule in enumerate(rules):
        place = F.when((F.col("kind") == rule.kind) & F.array_contains("rules", rule.version), k).otherwise(place)
    found = found.where(F.arrays_overlap("rules", current)).withColumn("k", place).where(F.col("k").isNotNull())
    each = F.struct("start", "k", "kind", "end")
    found = found.groupBy("blob").agg(F.sort_array(F.collect_set(each)).alias("secrets"))
    joined = join_counted(addressed, found, "blob", "spot")
    tidy = F.transform("secrets", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return joined.select(*(F.col(f"row.`{c}`") for c in rest), F.col("blob").alias(blob), F.coalesce(tidy, none).alias(secrets))
