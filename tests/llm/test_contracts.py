"""Each registered operator query against plain Python over whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def registered():
    import __spark_entry__

    return __spark_entry__.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat(spark, registered):
    from sparkveil.llm.queries import HARD_TURN

    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", HARD_TURN), ("assistant", HARD_TURN)]
    found = {r.conv_id: r for r in registered["op1_chat_format"](spark, SF).collect()}
    assert found.keys() == turns.keys()
    for conv, lines in turns.items():
        learned = "".join(t for role, t in lines if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256) == (len(lines), sha("".join(f"{role}\n{t}\n" for role, t in lines)))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_licenses(spark, registered, texts):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in registered["op2_license_scan"](spark, SF).collect():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        at = [(k, label) for phrase, label in phrases.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_token_ids(spark, registered, texts, tokenizer):
    found = {r.doc_id: r for r in registered["op3_token_ids"](spark, SF).collect()}
    start = 0
    for doc in sorted(texts):
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 2]
        r = found.pop(doc)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not found


def test_simhash(spark, registered, texts):
    from xxhash import xxh64_intdigest

    prints = {}
    for doc, text in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in registered["op4_simhash_near_dedup"](spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints.pop(r.doc_id):016x}", find(r.doc_id))
    assert not prints


def test_nearest(spark, registered):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    found = {}
    for r in registered["op6_nearest_neighbours"](spark, SF).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(found[r.query_id]) == r["rank"]
    hits = total = 0
    for k, i in enumerate(ids):
        if i % 20:
            assert i not in found
            continue
        score = v @ v[k]
        order = [j for j in np.lexsort((ids, -score)) if j != k][:20]
        hits += len({x for x, _ in found[i]} & set(ids[order].tolist()))
        total += 20
        assert len(found[i]) == 20
        for x, s in found[i]:
            assert s == pytest.approx(score[np.flatnonzero(ids == x)[0]], abs=1e-12)
    assert hits / total >= 0.9


def test_bpe(spark, registered, texts, tokenizer):
    for r in registered["op7_bpe"](spark, SF).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_toxicity(spark, registered):
    big = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    found = registered["op10_toxicity"](spark, big).collect()
    assert len(found) == spark.read.parquet(f"{big}/documents.parquet").count()
    right = seen = 0
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in labels:
            seen, right = seen + 1, right + (r.predicted == labels[r.doc_id])
    assert seen > 40 and right / seen >= 0.93


def test_mixing(spark, registered):
    """The rates against the same steps in plain numpy, and the targets."""
    rows = registered["op8_mixing"](spark, SF).collect()
    shares, n = np.array([r.shares for r in rows]), np.array([r.n_words for r in rows], dtype=float)
    available = n @ shares
    weights = available**0.7 / (available**0.7).sum()
    target = (available / weights).max() * weights
    got = (np.array([r.rate for r in rows]) * n) @ shares
    assert np.abs(got / target - 1).max() <= 2e-3
    rate = np.ones(len(n))
    scale = n.sum() / target
    steepest = np.linalg.eigvalsh((shares * n[:, None]).T @ shares / n.sum() * np.outer(scale, scale)).max()
    for _ in range(400):
        gap = ((rate * n) @ shares) / target - 1
        if np.abs(gap).max() <= 1e-3:
            break
        rate = np.maximum(0, rate - shares @ (scale * gap / steepest))
    assert np.allclose(rate, [r.rate for r in rows], atol=1e-6)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert abs(sum(r.copies * r.n_words for r in rows) / target.sum() - 1) < 0.15


def test_pipeline(spark, registered, tokenizer):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and all(r.round_trip for r in rows)
    for r in rows:
        assert r.ids == tokenizer.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
    kept = {r.doc_id for r in rows}
    same = [re.sub(r"[\x20\x09-\x0D]+", " ", docs[d].text or "") for d in kept]
    assert len(same) == len(set(same))


def test_pipeline_stages_against_plain_python(spark, tokenizer):
    """Each stage on all that its predecessor kept, with families of copies and near copies."""
    import random

    import corpus_pipeline
    from sparkveil.llm import simhash, toxicity
    from sparkveil.llm.common import table

    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(11)
    number = 10_000
    for r in [r for r in rows if r["text"] and len(r["text"]) > 600][:12]:
        words = r["text"].split(" ")
        for edits in (0, 0, 1, 2, 5):
            own = list(words)
            for at in rng.sample(range(len(own)), edits):
                own[at] = f"x{rng.randrange(999)}"
            number += 1
            rows.append(r | {"doc_id": number, "text": " ".join(own)})
    rows += [rows[0] | {"doc_id": 9_000, "text": None}, rows[0] | {"doc_id": 9_001, "text": ""}]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    texts = {r["doc_id"]: r["text"] or "" for r in rows}

    def ids(frame):
        return sorted(r.doc_id for r in frame.select("doc_id").collect())

    model = toxicity.fit(docs, table(spark, SF, "labels"))
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns and ids(clean) == sorted(i for i, t in texts.items() if model.score(t)[0] < 0.5)
    left = ids(clean)
    single = corpus_pipeline.drop_copies(spark, clean, SF)
    first = {}
    for i in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert ids(single) == sorted(first.values())
    left = ids(single)
    apart = corpus_pipeline.drop_near_copies(spark, single, SF)
    prints = {i: simhash.fingerprint(texts[i]) for i in left}
    root = {i: i for i in left}
    for i in left:
        for j in left:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                old, new = root[j], root[i]
                root = {k: min(old, new) if r in (old, new) else r for k, r in root.items()}
    assert apart.columns == docs.columns and ids(apart) == sorted(set(root.values())) and len(set(root.values())) < len(left)
    left = ids(apart)
    mixed = corpus_pipeline.mix(spark, apart, SF)
    assert mixed.columns == docs.columns and sorted(set(ids(mixed))) == left and len(ids(mixed)) > len(left)
    extra = mixed.withColumn("ids", mixed.lang).withColumn("N_tokens", mixed.lang).withColumn("text_sha256", mixed.lang)
    for r in corpus_pipeline.encode(spark, extra, SF).collect():
        assert r.ids_ == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens_ == len(r.ids_) and r.round_trip and r.ids == r.lang
