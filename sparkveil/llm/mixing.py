"""Mixing sources to target weights with soft membership.

A word model learned from labelled rows gives each document its share of every domain (a few EM
steps over its words, so a text in two languages belongs to both in part). Nonnegative document
rates are then moved by projected-gradient least squares until the expected tokens of each domain
meet the targets. A step needs one sum per domain, so only as many numbers as there are domains
reach the driver, and a document's rate follows from its shares and the list of steps.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.llm.common import free_name, sampled, shared_folder, slices, stored, text_of
from sparkveil.llm.toxicity import words

#: Labelled documents that the word model is fitted on, at most about this many, chosen by hash.
TRAINING_ROWS = 20_000
#: Words of the model, at most: the most frequent ones. Each must occur so often.
WORDS, LEAST_COUNT = 30_000, 3
EM_STEPS = 6
#: Relative gap of a domain's tokens that ends the steps, and the largest number of steps.
TOLERANCE, MOST_STEPS = 1e-3, 80
#: Newton steps at most, and totals that are tried for rates of 1 or more, each a quarter higher.
MOST_NEWTON, MOST_TOTALS = 20, 8
#: Words that one block of the EM holds.
_BLOCK = 200_000


@dataclass
class WordModel:
    domains: list[str]
    prior: np.ndarray
    index: dict[str, int] = field(default_factory=dict)
    likelihood: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Domain shares (rows sum to 1) and word counts of some texts."""
        out, counts = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
        held: list[np.ndarray] = []
        rows: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            tokens = words(text)
            counts[k] = len(tokens)
            known = np.array([i for t in tokens if (i := self.index.get(t)) is not None], dtype=np.int64)
            if len(known):
                held.append(known)
                rows.append(k)
                size += len(known)
            if held and (size >= _BLOCK or k == len(texts) - 1):
                out[rows] = self._em(held)
                held, rows, size = [], [], 0
        if held:
            out[rows] = self._em(held)
        return out, counts

    def _em(self, texts: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        seen = self.likelihood[np.concatenate(texts)]
        shares = np.tile(self.prior, (len(texts), 1))
        for _ in range(EM_STEPS):
            joint = np.repeat(shares, lengths, axis=0) * seen
            joint /= joint.sum(axis=1, keepdims=True)
            # half a word of the prior keeps every share above 0
            shares = (np.add.reduceat(joint, starts, axis=0) + 0.5 * self.prior) / (lengths[:, None] + 0.5)
        return shares


def fit(docs: DataFrame, labels: DataFrame, domain: Column, bound: int = TRAINING_ROWS) -> WordModel:
    """Word likelihoods per domain from the labelled documents whose domain is known.

    Without any, every document belongs wholly to one domain, "all".
    """
    ids = labels.where("doc_id is not null").select("doc_id").distinct()
    ids = ids.where(sampled(F.col("doc_id"), ids.count(), bound))
    # bounded by `bound`, so that the documents are not shuffled for it
    rows = docs.select("doc_id", domain.cast("string").alias("domain"), text_of().alias("text")).where("domain is not null").join(F.broadcast(ids), "doc_id")
    found = rows.select("domain", F.explode(F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+", -1), "")).alias("w"))
    found = found.groupBy("domain", "w").agg(F.count("*").alias("n"))
    totals = {r["domain"]: int(r["n"]) for r in found.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return WordModel(["all"], np.ones(1))
    domains = sorted(totals)
    frequent = found.groupBy("w").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("domain", "n"))).alias("by"))
    frequent = frequent.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "w").limit(WORDS).collect()
    if not frequent:
        return WordModel(["all"], np.ones(1))
    n = np.array([totals[d] for d in domains], dtype=float)
    counts = np.array([[r["by"].get(d, 0) for d in domains] for r in frequent], dtype=float)
    # smoothed towards the pooled frequency
    pooled = counts.sum(axis=1, keepdims=True) / n.sum()
    return WordModel(domains, n / n.sum(), {r["w"]: k for k, r in enumerate(frequent)}, (counts + pooled * 10) / (n + 10))


def with_shares(docs: DataFrame, model: WordModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with n_words and shares (in the order of `model.domains`)."""
    rest = [c for c in docs.columns if keep_text or c != text]
    names = [free_name(docs, "n_words"), free_name(docs, "shares")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType(), False))])
    given = free_name(docs, "mixed_text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            shares, counts = model.shares(batch.column(len(rest)).to_pylist())
            ends = pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(counts), pa.ListArray.from_arrays(ends, pa.array(shares.ravel()))], names=schema.names)

    return docs.select(*rest, text_of(text).alias(given)).mapInArrow(add, schema)


def rates_after(shares: np.ndarray, steps: list[np.ndarray], least: float = 0.0) -> np.ndarray:
    """Rates of documents with these shares: from 1, each step moves along the shares and stays >= `least`."""
    rates = np.ones(len(shares))
    for step in steps:
        rates = np.maximum(least, rates - shares @ step)
    return rates


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _sums(rows: DataFrame, width: int, steps: list[np.ndarray], second: bool = False, least: float = 0.0) -> np.ndarray:
    """Expected words per domain at the rates after `steps`; with `second` the moments of the shares
    of documents that are above `least`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * (width if second else 1))
        for batch in batches:
            shares, n = _matrix(batch.column(1), width), batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            if second and steps:
                n = np.where(rates_after(shares, steps, least) > least, n, 0.0)
            total += ((shares * n[:, None]).T @ shares).ravel() if second else (rates_after(shares, steps, least) * n) @ shares
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    found = {r["k"]: r["v"] for r in rows.mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    size = width * (width if second else 1)
    return np.array([found.get(k, 0.0) for k in range(size)])


def _lowest(rows: DataFrame, width: int, slope: np.ndarray) -> float:
    """The smallest shares @ slope of all documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float((_matrix(batch.column(1), width) @ slope).min())])], names=["v"])

    return rows.mapInArrow(add, "v double").agg(F.min("v")).first()[0]


def _solved(moments: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """x of moments @ x = wanted, scaled per domain, so that small domains count as much as large ones."""
    size = np.sqrt(np.maximum(np.diag(moments), 1e-300))
    return np.linalg.lstsq(moments / np.outer(size, size), wanted / size, rcond=1e-12)[0] / size


def _gap(got: np.ndarray, target: np.ndarray) -> float:
    """The largest relative gap of a domain; one that is to have no words counts against all of them."""
    return float((np.abs(got - target) / np.where(target > 0, target, target.sum())).max())


def _newton(rows: DataFrame, width: int, moments: np.ndarray, target: np.ndarray, least: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps to the targets, exact at once unless rates meet `least`; what they give."""
    # shares sum to 1, so this step leads from rates of 1 to shares @ slope
    steps = [1 - _solved(moments, target)]
    got = _sums(rows, width, steps, least=least)
    for _ in range(MOST_NEWTON):
        if _gap(got, target) <= TOLERANCE:
            break
        step = _solved(_sums(rows, width, steps, second=True, least=least).reshape(width, width), got - target)
        for part in (1.0, 0.5, 0.25, 0.125):
            now = _sums(rows, width, [*steps, step * part], least=least)
            if _gap(now, target) < _gap(got, target):
                steps, got = [*steps, step * part], now
                break
        else:
            break
    return steps, got


def solve_keeping(rows: DataFrame, width: int, weights: np.ndarray | None = None, power: float = 0.7) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As `solve` without a total, but with a rate of 1 or more for every document.

    With moments M and M @ u = weights, rates in proportion to shares @ u meet the weights at any
    total; it is raised until none is below 1. Where some shares @ u are not above 0, rates are held
    at 1 and the total is raised until the others can meet it.
    """
    available = _sums(rows, width, [])
    if available.sum() <= 0:
        return [], available, available
    weights = smoothed_weights(available, power) if weights is None else np.where(available > 0, weights, 0.0)
    weights = weights / weights.sum()
    moments = _sums(rows, width, [], second=True).reshape(width, width)
    slope = _solved(moments, weights)
    lowest = _lowest(rows, width, slope)
    if lowest > 0:
        steps = [1 - slope / lowest]
        return steps, weights / lowest, _sums(rows, width, steps, least=1.0)
    total = float((available[weights > 0] / weights[weights > 0]).max())
    best = None
    for _ in range(MOST_TOTALS):
        steps, got = _newton(rows, width, moments, total * weights, 1.0)
        if best is None or _gap(got, total * weights) < _gap(best[2], best[1]):
            best = steps, total * weights, got
        if _gap(got, total * weights) <= TOLERANCE:
            break
        total *= 1.25
    return best


def smoothed_weights(available: np.ndarray, power: float) -> np.ndarray:
    """Weights in proportion to a power of what there is: below 1, small domains gain."""
    weights = np.where(available > 0, np.power(np.maximum(available, 1e-12), power), 0.0)
    return weights / weights.sum() if weights.sum() else weights


def solve(rows: DataFrame, width: int, weights: np.ndarray | None = None, words_wanted: float | None = None, power: float = 0.7) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps whose rates give each domain its target; also the targets and what the rates give.

    `rows`: n_words, shares. `weights` default to the smoothed ones. Without `words_wanted`, the
    total is the smallest at which no domain shrinks, so that documents are repeated, not lost.
    Domains without any word are left out and the other weights scaled up.
    """
    available = _sums(rows, width, [])
    if available.sum() <= 0:
        return [], available, available
    weights = smoothed_weights(available, power) if weights is None else np.where(available > 0, weights, 0.0)
    weights = weights / weights.sum()
    live = weights > 0
    total = words_wanted if words_wanted is not None else float((available[live] / weights[live]).max())
    target = total * weights
    n = available.sum()
    scale = np.where(live, n / np.where(live, target, 1.0), n / total)  # a domain of weight 0 is pushed to 0
    goal = np.where(live, 1.0, 0.0)
    unit = np.where(live, target, total)
    moments = _sums(rows, width, [], second=True).reshape(width, width) / n
    steepest = np.linalg.eigvalsh(moments * np.outer(scale, scale)).max()
    steps: list[np.ndarray] = []
    got = available
    for _ in range(MOST_STEPS):
        gap = got / unit - goal
        if np.abs(gap).max() <= TOLERANCE:
            break
        steps.append(scale * gap / steepest)
        got = _sums(rows, width, steps)
    if _gap(got, target) > TOLERANCE:  # small domains take many plain steps
        again, now = _newton(rows, width, moments * n, target, 0.0)
        if _gap(now, target) < _gap(got, target):
            steps, got = again, now
    return steps, target, got


def mixed(docs: DataFrame, model: WordModel, id_column: str = "doc_id", text: str = "text", keep_text: bool = False, keep_all: bool = False, **targets) -> DataFrame:
    """`docs` (with its text on demand) with n_words, shares, rate and copies.

    copies is the rate rounded up or down by a hash of the id, so that its mean is the rate. Empty
    and null texts have the prior's shares and a rate like any other. With `keep_all` no rate is below
    1. Without it and without targets, rates may fall a little below 1 where documents belong to
    several domains; such a document has one copy.
    """
    names = {c: free_name(docs, c) for c in ("n_words", "shares", "rate", "copies")}
    scored = stored(with_shares(docs, model, text, keep_text), f"{shared_folder(docs.sparkSession)}/shares")
    width = len(model.domains)
    rows = scored.select(names["n_words"], names["shares"])
    steps, target, got = (solve_keeping if keep_all else solve)(rows, width, **targets)
    if target.sum() > 0 and (gap := _gap(got, target)) > TOLERANCE:
        far = ", ".join(f"{d}: {g:.0f} of {t:.0f}" for d, g, t in zip(model.domains, got, target, strict=True) if abs(g - t) > TOLERANCE * t)
        warnings.warn(f"mixing misses its targets by up to {gap:.2%}; expected words {far}", stacklevel=2)
    least = 1.0 if keep_all else 0.0
    columns = scored.columns
    at = columns.index(names["shares"])
    schema = T.StructType([*scored.schema.fields, T.StructField(names["rate"], T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_after(_matrix(batch.column(at), width), steps, least))], names=schema.names)

    chance = F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), F.col(id_column)), 11) / F.lit(float(1 << 53))
    rate = F.col(names["rate"])
    copies = F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")
    if targets.get("words_wanted") is None and targets.get("weights") is None:
        copies = F.greatest(copies, F.lit(1).cast("long"))
    return scored.mapInArrow(add, schema).withColumn(names["copies"], copies)


def repeated(docs: DataFrame, model: WordModel, id_column: str = "doc_id", text: str = "text", **targets) -> DataFrame:
    """Each row of `docs` as often as its copies say, with the same columns; at least once where no total is asked for.

    Weights of 0 ask for a loss, so rows may go then too.
    """
    weights = targets.get("weights")
    keep_all = targets.get("words_wanted") is None and (weights is None or bool((np.asarray(weights) > 0).all()))
    targets = {k: v for k, v in targets.items() if k != "words_wanted"} if keep_all else targets
    found = mixed(docs, model, id_column, text, keep_text=True, keep_all=keep_all, **targets)
    copies = found.columns[-1]
    times = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    return found.where(F.col(copies) > 0).withColumn(free_name(found, "copy"), times).select(*docs.columns)
