"""Toxic passages: maximum-scoring segments over token log-odds.

Token scores are log-odds between toxic and clean training documents under a Dirichlet prior that
follows the pooled counts. One linear scan per text finds all maximal scoring segments; the chance
of such a segment in clean text of the same length (extreme-value law of segment scores) turns
each into evidence, and a logistic curve over the summed evidence is the document's score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.common import free_name, sampled, slices, text_of

#: Labelled documents that the model is fitted on, at most about this many, chosen by hash.
TRAINING_ROWS = 40_000
#: Tokens of the lexicon, at most: those with the most evidence. Each must be so much likelier in toxic text (log).
LEXICON, LEAST_LIFT = 20_000, 1.0
#: Documents that the Dirichlet prior adds to each word, split as the training documents are.
PRIOR = 1.0
#: Largest chance, in clean text of the same length, of a segment worth counting.
CHANCE = 0.05

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


@dataclass
class Model:
    """Scores of lexicon tokens; `other` (negative) for the rest; the law's k and lambda; the curve."""

    scores: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    k: float = 0.1
    decay: float = 1.0
    bias: float = -3.0
    slope: float = 0.0

    def segments(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, end, score), ends exclusive, in linear time."""
        get, other = self.scores.get, self.other
        hits = [(at, s) for at, t in enumerate(tokens) if (s := get(t)) is not None]
        return maximal_segments(hits, other)

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
        """Summed -log chance of the significant segments, and those segments."""
        total, kept = 0.0, []
        for start, end, score in segments:
            log_expected = math.log(self.k * max(n, 1)) - self.decay * score
            chance = -math.expm1(-math.exp(min(log_expected, 700.0)))
            if chance <= CHANCE:
                kept.append((start, end, score))
                total += -log_expected if log_expected < -30 else -math.log(max(chance, 1e-300))
        return total, kept

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        tokens = words(text)
        total, kept = self.evidence(len(tokens), self.segments(tokens))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.slope * total)))), kept


def maximal_segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """Maximal scoring segments of a sequence that scores `other` < 0 wherever no hit stands.

    A stack holds candidates with the running sum left of them and at their end. A new positive run
    is joined to the last candidate whose left sum is lower, if the total at its end is lower than
    the new one; each candidate is pushed and taken once.
    """
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    links: list[int] = []  # index of the nearest candidate with a lower sum before, per candidate
    total, last = 0.0, -1
    for at, score in hits:
        total += other * (at - last - 1)
        before, total, last = total, total + score, at
        if score <= 0:
            continue
        start, left, right = at, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = links[j]
            if j < 0 or stack[j][3] >= right:
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:], links[j:]
        stack.append((start, at + 1, left, right))
        links.append(j)
    return [(start, end, right - left) for start, end, left, right in stack]


def _law(values: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """lambda and k of the extreme-value law for independent token scores with a negative mean."""
    weights = weights / weights.sum()
    if (values * weights).sum() >= 0 or values.max() <= 0:
        return 1.0, 1.0
    low, high = 0.0, 1.0
    grown = lambda x: float((weights * np.exp(np.minimum(x * values, 700))).sum())
    while grown(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (low, middle) if grown(middle) > 1 else (middle, high)
    decay = (low + high) / 2
    drift = abs(float((values * weights).sum()))
    # one-sided bound of the constant: rate of upward steps seen under the tilted law
    k = max(1e-6, min(1.0, drift * decay / (1 + drift * decay) if drift else 1.0))
    return decay, k


def _curve(evidence: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, a little shrunk so that separable data stay finite."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    w = np.array([math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)), 0.0])
    penalty = np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def training_labels(labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, toxic) of a bounded sample of labelled ids outside the held-out fold.

    Ids labelled twice count as toxic if any label is; null ids and labels are left out. The fold is
    crc32 of the id as text, modulo 5, equal to 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(sampled(F.col("doc_id"), known.count(), bound))


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.encode(F.col(id_column).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> Model:
    """A model from the labelled documents; without toxic or clean ones it scores below 0.5."""
    sample = training_labels(labels, bound)
    # the sample is bounded by `bound`, so that the documents are not shuffled for it
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies teach nothing new
    # documents with a word, not its occurrences: one text that repeats a word is one witness
    counts = rows.select("toxic", F.explode(F.array_distinct(F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1), ""))).alias("w"))
    counts = counts.groupBy("w").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    sums = counts.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    bad, good, kinds = int(sums[0] or 0), int(sums[1] or 0), sums[2]
    if not bad or not good:
        return Model()
    share = bad / (bad + good)
    n = F.col("bad") + F.col("good")
    a, b = F.col("bad") + PRIOR * share, F.col("good") + PRIOR * (1 - share)
    lift = F.log(a / bad) - F.log(b / good)
    # log-likelihood ratio against "as frequent in both"; of all words, about one passes by chance
    ratio = F.col("bad") * F.log(F.greatest("bad", F.lit(1)) / (n * share)) + F.col("good") * F.log(F.greatest("good", F.lit(1)) / (n * (1 - share)))
    chosen = counts.withColumn("lift", lift).withColumn("ratio", ratio)
    chosen = chosen.where((F.col("lift") >= LEAST_LIFT) & (F.col("ratio") >= math.log(kinds)))
    lexicon = chosen.orderBy(F.desc("ratio"), "w").limit(LEXICON).collect()
    model = Model(scores={r["w"]: float(r["lift"]) for r in lexicon})
    if not lexicon:
        return model
    covered_bad, covered_good = sum(r["bad"] for r in lexicon), sum(r["good"] for r in lexicon)
    rest = math.log(max(bad - covered_bad, 1) / bad) - math.log(max(good - covered_good, 1) / good)
    model.other = min(rest, -0.005)
    values = np.array([*model.scores.values(), model.other])
    clean = np.array([*(r["good"] + PRIOR * (1 - share) for r in lexicon), good - covered_good], dtype=float)
    model.decay, model.k = _law(values, clean)
    seen = rows.select("toxic", "text").mapInArrow(_evidence_of(model), "toxic int, evidence double, n long")
    seen = seen.groupBy("toxic", F.round("evidence", 1).alias("evidence")).count().orderBy("toxic", "evidence").collect()
    # distinct rounded values only: the curve needs no more
    weights = np.array([r["count"] for r in seen])
    evidence, target = np.array([r["evidence"] for r in seen]), np.array([r["toxic"] for r in seen], dtype=float)
    model.bias, model.slope = _curve(np.repeat(evidence, weights), np.repeat(target, weights))
    return model


def _evidence_of(model: Model):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, sizes = [], []
            for t in texts:
                tokens = words(t)
                found.append(model.evidence(len(tokens), model.segments(tokens))[0])
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array([int(t) for t in toxic], pa.int32()), pa.array(found), pa.array(sizes)], names=["toxic", "evidence", "n"])

    return add


SEGMENT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("toxicity", "passages")) -> DataFrame:
    """`docs` with a score between 0 and 1 and the significant passages (word positions, scores).

    Null texts are empty and score like any text without a passage.
    """
    names = [free_name(docs, n) for n in into]
    fields = [*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], SEGMENT)]
    schema = T.StructType(fields)
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(SEGMENT)
        for batch in slices(batches):
            found = [model.score(t or "") for t in batch.column(at).to_pylist()]
            scores = pa.array([f[0] for f in found], pa.float64())
            passages = pa.array([[{"start": a, "end": b, "score": s} for a, b, s in f[1]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, passages], names=schema.names)

    return docs.mapInArrow(add, schema)
