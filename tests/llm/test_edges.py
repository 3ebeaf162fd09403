"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import numpy as np
import pytest

from sparkveil.llm import bpe, chat, exact, licenses, lines, mixing, neighbours, simhash, tokenids, toxicity
from sparkveil.llm.graph import components
from sparkveil.llm.queries import tokenizer_path

LONG = "word " * 60_000 + "end"
ROWS = [
    (1, "a b c d e f\nsame\nlines here", "x"), (2, None, None), (3, "", "x"), (4, LONG, "x"), (5, "a  b c d e f same lines here", "y"),
    (5, "a  b c d e f same lines here", "y"), (None, "a b", "z"), (7, "\U0001f600 é \\### </turn> <|endoftext|> \x00 ok", None), (8, "   \n\t", "x"),
]
SCHEMA = "doc_id long, text string, kept string"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    rows = exact.groups(docs).collect()
    assert len(rows) == len(ROWS) and rows[0].__fields__ == ["doc_id", "kept", "keep_id", "group_size", "kept_", "text_sha256"]
    fives = [r for r in rows if r.doc_id == 5]
    assert [r.group_size for r in fives] == [3, 3] and not any(r.kept_ for r in fives) and fives[0].keep_id == 1
    assert {r.group_size for r in rows if r.doc_id in (2, 3)} == {2}
    left = exact.without_copies(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "4", "7", "8", "None"]
    assert exact.groups(none).count() == 0


def test_a_group_over_many_partitions(spark):
    rows = [(i, "copy") for i in range(900)] + [(1000 + i, f"own {i}") for i in range(100)]
    found = exact.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    copies = [r for r in found if r.doc_id < 900]
    assert {(r.keep_id, r.group_size) for r in copies} == {(0, 900)} and sum(r.kept for r in copies) == 1
    assert all(r.kept and r.group_size == 1 for r in found if r.doc_id >= 1000)


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    blank = [r for r in rows if r.doc_id in (2, 3, 8)]
    assert {(r.fp, r.component_id) for r in blank} == {(0, 2)}
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.without_near_duplicates(docs).columns == docs.columns


def test_ball_hashing_against_all_pairs(spark):
    random.seed(3)
    fps = set()
    for _ in range(40):
        base = random.getrandbits(64)
        for _ in range(12):
            value = base
            for bit in random.sample(range(64), random.randint(0, 5)):
                value ^= 1 << bit
            fps.add(value)
    signed = [int(x) for x in np.array(sorted(fps), dtype=np.uint64).view(np.int64)]
    found = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert all(found.get(x, x) == find(x) for x in signed)


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ROWS) and all(r.score == 0 and r.labels == [] for r in rows)
    assert licenses.scan(none).count() == 0
    filler = " ".join(f"w{i}" for i in range(100))
    sentence = licenses.TEMPLATES[0][1].replace("charge", "cost").title()
    found = licenses.scan(docs.sparkSession.createDataFrame([(1, f"{filler} {sentence} {filler}"), (2, "The MIT License and the mit-license")], "doc_id long, text string"))
    one, two = found.orderBy("doc_id").collect()
    assert one.labels == ["mit"] and 0.8 <= one.score < 1 and one.base_labels == []
    assert two.base.mit == [1, 5] and two.score == 1


def test_lines(docs, none):
    rows = lines.without_repeats(docs).collect()
    assert len(rows) == len(ROWS) and sum(r.removed_lines for r in rows) == 0 and {r.text for r in rows if r.doc_id == 2} == {None}
    assert lines.without_repeats(none).count() == 0
    block = [f"shared line {i} of a notice" for i in range(30)]
    texts = [(i, "\n".join([f"top {i}", *([f"more {i}"] * (i % 2)), *block, f"end {i}"])) for i in range(4)]
    found = lines.without_repeats(docs.sparkSession.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id").collect()
    assert found[0].text == texts[0][1] and [r.removed_lines for r in found] == [0, 30, 30, 30]
    assert [r.text.split("\n") for r in found[1:]] == [[f"top {i}", *([f"more {i}"] * (i % 2)), f"end {i}"] for i in (1, 2, 3)]
    named = docs.sparkSession.createDataFrame([(1, "a\nb", 5), (2, "a\nb", None)], "gone long, lines string, N_LINES int")
    found = lines.without_repeats(named, "gone", "lines").orderBy("gone")
    assert found.columns == ["gone", "lines", "N_LINES", "n_lines_", "n_chunks", "removed_lines"]
    assert [(r.gone, r.lines, r.removed_lines) for r in found.collect()] == [(1, "a\nb", 0), (2, "", 2)]


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    encoder = bpe.Encoder(bpe.Vocabulary(tokenizer_path()))
    assert "".join(encoder.tokens("x" * 5000)) == "x" * 5000
    for r in bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect():
        text = next(t for i, t, _ in ROWS if i == r.doc_id) or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text
    random.seed(1)
    for _ in range(300):
        text = "".join(random.choice("abcdeinorst   'é1.\n中") for _ in range(random.randint(1, 80)))
        assert np.frombuffer(bpe.coder(tokenizer_path()).encode(text), "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(none, tokenizer_path()).count() == 0


def test_token_ids(docs, none, tmp_path):
    spark = docs.sparkSession
    tokenids.write(docs, f"file://{tmp_path}/t", tokenizer_path())
    rows = tokenids.read(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, _, _ in ROWS), key=lambda i: (i is not None, i)) and rows[0].start == 0
    assert all(b.start == a.start + a.n for a, b in zip(rows, rows[1:], strict=False))
    tokenids.write(none, f"file://{tmp_path}/n", tokenizer_path())
    assert tokenids.read(spark, f"file://{tmp_path}/n").count() == 0


def test_token_blocks():
    ids = np.random.default_rng(5).zipf(1.3, 300_000) % 500
    model = tokenids.Model(tokenids.normalised(np.bincount(ids, minlength=500)))
    block = tokenids.pack(model, [(None, ids[:7]), (3, ids[7:])])
    docs, lengths, back = tokenids.unpack(model, block)
    assert docs == [None, 3] and lengths.tolist() == [7, len(ids) - 7] and (back == ids).all() and len(block) < len(ids) * 2
    for mark in (1, 2):
        assert (tokenids.unpack(model, block, mark)[2] == ids[mark * tokenids.EVERY * tokenids.LANES :]).all()
    with pytest.raises(ValueError):
        tokenids.unpack(model, block[:500] + bytes([block[500] ^ 1]) + block[501:])


def test_chat(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "short", 1.0), ("t", 3, 1, "assistant", r"\h ### </turn> \\", 5.0), ("t", 4, 3, None, None, None),
        ("t", 4, 3, None, None, None), (None, 9, None, "a: b", "###", 0.0), ("loop", 1, 2, "user", "x", 0.0), ("loop", 2, 1, "user", "x", 0.0),
    ]
    schema = "tree string, node long, parent long, role string, text string, score double"
    found = {(r.tree, r.leaf): r for r in chat.read_back(chat.conversations(spark.createDataFrame(rows, schema))).collect()}
    assert set(found) == {("t", 2), ("t", 4), ("\0null", 9)}
    assert [(t.role, t.text) for t in found["t", 4].turns] == [("user", "q"), ("assistant", r"\h ### </turn> \\"), ("", "")]
    assert found["t", 4].learned == r"\h ### </turn> \\" and found["\0null", 9].turns[0].role == "a: b"
    best = chat.conversations(spark.createDataFrame(rows, schema), branches=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {("t", 4), ("\0null", 9)}
    assert chat.conversations(spark.createDataFrame([], schema)).count() == 0


def test_neighbours(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [float("nan"), 1.0]), (104, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.search(df, df.where("vec_id in (0, 40, 100, 101)"), k=5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {0: [1, 2, 3, 4, 5], 40: [0, 1, 2, 3, 4], 100: [0, 1, 2, 3, 4]}
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_in_double(spark):
    """Differences below single precision decide, and components beyond its range take part."""
    rows = [(i, [1 + i * 1e-9, 0.5]) for i in range(40)] + [(100, [1e39, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(df, df.where("vec_id = 0"), k=4).orderBy("rank").collect()
    assert [r.id for r in found] == [100, 39, 38, 37] and found[1].score == (1 + 39e-9) + 0.25


def test_exact_names_follow_the_kept_columns(spark):
    df = spark.createDataFrame([(1, "a b", 0, 0), (2, "a  b", 0, 0)], "doc_id long, text string, keep_id int, text_sha256 int")
    assert exact.groups(df, keep=["doc_id"]).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact.groups(df).columns == ["doc_id", "keep_id", "text_sha256", "keep_id_", "group_size", "kept", "text_sha256_"]
    left = exact.without_copies(df).collect()
    assert [tuple(r) for r in left] == [(1, "a b", 0, 0)]
    ours = df.select("doc_id", "text", *(df.keep_id.alias(c) for c in ("part", "run", "row", "first_edge", "opens", "own_id", "column_0", "sha")))
    assert [tuple(r) for r in exact.without_copies(ours).collect()] == [(1, "a b", *[0] * 8)]


def test_segments_against_all_spans():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 14)
        hits = sorted((at, random.choice([1.0, 2.0, 3.0])) for at in random.sample(range(n), random.randint(1, n)))
        scores = [dict(hits).get(i, -1.5) for i in range(n)]
        best = max(sum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1))
        found = toxicity.maximal_segments(hits, -1.5)
        assert max(s for _, _, s in found) == pytest.approx(best)
        assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in found)


def test_toxicity_and_mixing(docs, none):
    labels = docs.sparkSession.createDataFrame([(1, 1), (1, 0), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.toxicity <= 1 for r in rows)
    blank = toxicity.score(docs, toxicity.fit(none, labels.limit(0))).collect()
    assert all(r.toxicity < 0.5 and r.passages == [] for r in blank)
    from pyspark.sql import functions as F

    model = mixing.fit(docs, labels, F.col("kept"))
    mixed = mixing.mixed(docs, model).collect()
    assert len(mixed) == len(ROWS) and all(r.rate >= 0 and abs(sum(r.shares) - 1) < 1e-9 for r in mixed)
    assert mixing.repeated(docs, model).columns == docs.columns
    assert mixing.mixed(none, mixing.fit(none, labels, F.col("kept"))).count() == 0
