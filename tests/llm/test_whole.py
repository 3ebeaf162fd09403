"""What the operators must not leave out, against brute force over all pairs, lines or rows."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from sparkveil.llm import chat, lines, mixing, simhash


def _edited(words, rng, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def _components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_copies_of_one_original(spark):
    """Families of edited copies, against all pairs of fingerprints: one document of each group stays."""
    rng = random.Random(7)
    texts = {}
    for family in range(6):
        words = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for copy in range(20):
            texts[family * 100 + copy + 1] = " ".join(_edited(words, rng, 0.004 * (family + 1)))
        texts[family * 100] = " ".join(words)
    texts |= {900: "", 901: "  ", 902: "one", 903: "one two"}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    group = _components(texts, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert 20 < len(set(group.values())) < len(texts) - 40  # some links, not all
    docs = spark.createDataFrame([(i, t, t[:3]) for i, t in texts.items()], "doc_id long, text string, fp string").repartition(3)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))


def test_an_id_of_two_texts_loses_only_the_copy(spark):
    rng = random.Random(3)
    one, two = (" ".join(f"w{rng.randrange(4000)}" for _ in range(200)) for _ in range(2))
    docs = spark.createDataFrame([(1, one), (5, one), (5, two), (None, one), (None, None)], "doc_id long, text string")
    kept = simhash.without_near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == sorted([("1", one), ("5", two), ("None", one)]) and len(kept) == 4


def _shares(rng, sizes, overlap):
    """Documents of some domains; `overlap` of each belongs to the largest domain."""
    out = []
    for domain, size in enumerate(sizes):
        for _ in range(size):
            shares = np.full(len(sizes), 1e-6)
            shares[domain] += 1
            shares[0] += overlap * rng.random() * 2 if domain else 0
            out.append((int(rng.integers(20, 400)), (shares / shares.sum()).tolist()))
    return out


def test_mixing_loses_no_document(spark):
    """Documents of small domains carry some of the largest, which is then above its target."""
    data = _shares(np.random.default_rng(4), (900, 60, 40), 0.08)
    rows = spark.createDataFrame(data, "n_words long, shares array<double>")
    steps, target, got = mixing.solve_keeping(rows, 3)
    n, shares = np.array([x for x, _ in data], dtype=float), np.array([x for _, x in data])
    rates = mixing.rates_after(shares, steps)
    assert rates.min() >= 1 - 1e-9 and np.abs((rates * n) @ shares / target - 1).max() <= 1e-3 and np.allclose((rates * n) @ shares, got)
    weights = (n @ shares) ** 0.7 / ((n @ shares) ** 0.7).sum()
    assert np.allclose(target / target.sum(), weights) and target.sum() <= 1.2 * ((n @ shares) / weights).max()


def test_mixing_keeps_every_row(spark):
    """Three languages with texts in two of them: all rows come back, also from `mixed`."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = {k: [f"{k}{i}" for i in range(40)] for k in "abc"}
    docs = []
    for i in range(3000):
        own = "a" if i % 20 > 1 else "b" if i % 20 else "c"
        docs.append((i, " ".join(rng.choice(words[own if rng.random() > 0.15 else "a"]) for _ in range(20)), own))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    model = mixing.fit(docs, docs.select("doc_id"), F.col("lang"))
    assert mixing.repeated(docs, model).select("doc_id").distinct().count() == 3000
    assert mixing.mixed(docs, model).where("copies < 1").count() == 0


def test_mixing_meets_the_target_of_a_tiny_domain(spark):
    """One domain of two documents in 10002, with overlap: plain steps alone stay far from its target."""
    rng = np.random.default_rng(6)
    data = _shares(rng, (8000, 2000, 2), 0.2)
    rows = spark.createDataFrame(data, "n_words long, shares array<double>").repartition(2)
    steps, target, got = mixing.solve(rows, 3)
    assert np.abs(got / target - 1).max() <= mixing.TOLERANCE
    n, shares = np.array([x for x, _ in data], dtype=float), np.array([x for _, x in data])
    assert np.allclose((mixing.rates_after(shares, steps) * n) @ shares, got)


def _without_repeats(texts):
    """Every line goes that stands in a row with the one before or after it at an earlier place; plain loops."""
    cut = {}
    for i, text in texts.items():
        parts = text.split("\n")
        units = [parts[0]]
        for part in parts[1:]:
            if part.strip(" \t\r\x0b\x0c") and units[-1].strip(" \t\r\x0b\x0c\n"):
                units.append(part)
            else:
                units[-1] += "\n" + part
        cut[i] = units
    seen, gone = set(), {i: set() for i in texts}
    for i in sorted(cut):
        for k, pair in enumerate(zip(cut[i], cut[i][1:])):
            if pair in seen:
                gone[i] |= {k, k + 1}
            seen.add(pair)
    return {i: ("\n".join(u for k, u in enumerate(cut[i]) if k not in gone[i]), len(gone[i])) for i in cut}


def _passages():
    """Passages of 2 to 16 lines between own lines, blank lines, one passage in half of all documents, and few different lines."""
    rng = random.Random(11)
    own = iter(range(10**6))
    passages = [[f"passage {p} line {k}" + "\n" * rng.choice([0, 0, 0, 1, 2]) for k in range(rng.randrange(2, 17))] for p in range(60)]
    texts = {}
    for i in range(150):
        parts = [f"own {next(own)}" for _ in range(rng.randrange(4))]
        for p in [*rng.sample(range(1, 60), 2), *([0] if i % 2 else [])]:
            parts += [*passages[p], *(f"own {next(own)}" for _ in range(rng.randrange(3)))]
        texts[i] = "\n".join(parts)
    texts |= {200 + i: "\n".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for i in range(40)}
    texts |= {300: "", 301: "\n\n", 302: "\n \nx\ny", 303: "x\ny\n", 304: "z\n" * 500, 305: "z\r\nz", 306: "é\u2028\nü", 307: "é\u2028\nü\nv"}
    return texts


@pytest.mark.parametrize("bits", [128, 5])
def test_every_repeated_run_of_lines_goes(spark, monkeypatch, bits):
    """Also where different lines share a hash: then lines themselves are compared."""
    if bits < 64:
        monkeypatch.setattr(lines, "line_key", lambda seed: lambda line: F.pmod(F.xxhash64(F.lit(7), line), F.lit(1 << bits)))
    texts = _passages()
    docs = spark.createDataFrame([*texts.items(), *list(texts.items())[:9]], "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.text, r.removed_lines) for r in lines.without_repeats(docs).collect()}
    expected = _without_repeats(texts)
    assert found == expected and sum(n for _, n in expected.values()) > 2000


@pytest.mark.parametrize("branches", [1, 3])
def test_best_branches_of_random_trees(spark, branches):
    """Deep, bushy and single-node trees with equal, missing and negative scores, and one tree of a thousand leaves."""
    rng = random.Random(branches)
    rows = []
    for t in range(40):
        for n in range(rng.choice([1, 2, 12, 60])):
            parent = None if n == 0 or rng.random() < 0.05 else rng.randrange(max(0, n - rng.choice([1, 3, 60])), n)
            rows.append((f"t{t}", n, parent, rng.choice(["user", "assistant", "a: b", None]), rng.choice(["x", "### y", "\\b </turn>", "", None]), rng.choice([None, -1.0, 0.0, 0.5, 1.0])))
    rows += [("hot", 0, None, "user", "top", 0.0), *(("hot", n, 0, "assistant", f"leaf {n}", float(n % 7)) for n in range(1, 1001))]
    known = {(t, n): (parent, role or "", text or "", score or 0.0) for t, n, parent, role, text, score in rows}
    inner = {(t, v[0]) for (t, _), v in known.items() if v[0] is not None}
    expected = {}
    for tree in {t for t, _ in known}:
        found = []
        for (t, leaf) in known:
            if t == tree and (t, leaf) not in inner:
                path, at = [], leaf
                while at is not None:
                    path.append(known[t, at])
                    at = known[t, at][0]
                found.append((-sum(v[3] for v in path), leaf, [(v[1], v[2]) for v in reversed(path)]))
        for rank, (_, leaf, turns) in enumerate(sorted(found)[:branches], 1):
            expected[tree, leaf] = (rank, turns)
    schema = "tree string, node long, parent long, role string, text string, score double"
    made = chat.conversations(spark.createDataFrame(rows, schema).repartition(4), branches=branches)
    back = {(r.tree, r.leaf): [(t.role, t.text) for t in r.turns] for r in chat.read_back(made).collect()}
    assert {(r.tree, r.leaf): (r.rank, back[r.tree, r.leaf]) for r in made.collect()} == expected
