import random

import pytest

import corpus_pipeline
from quadtide.llm import minhash, packing, pii, quality


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with labels: prose, junk, copies, near copies and personal data."""
    rng, root = random.Random(12), tmp_path_factory.mktemp("corpus")
    word = lambda: "".join(rng.choice("aeioutnrsl") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for k in range(300):
        w = [word() for _ in range(rng.randrange(40, 150))]
        bad = k % 3 == 0
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w).capitalize() + "."
        if k % 10 == 1:
            text += " write to joe.12@mail.example.com soon"
        docs.append((k, text))
        if k % 2:
            labels.append((k, int(not bad), 0))
    docs += [(1000 + k, docs[k * 3 + 1][1]) for k in range(20)] + [(2000 + k, docs[k * 3 + 2][1] + " more") for k in range(20)] + [(3000, None), (3001, "")]
    df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_one_by_one(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality"](spark, docs, corpus)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns and kept == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    assert not any(i % 3 == 0 for i in kept if i < 300) and all(i in kept for i in range(300) if i % 3)
    one = stage["near_duplicates"](spark, good, corpus)
    sets = {r["doc_id"]: set(minhash.shingles(r["text"], 5).tolist()) for r in good.collect()}
    ids = sorted(i for i in sets if sets[i])
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = {i for i in ids if root(i) == i} | {i for i in sets if not sets[i]}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == want and not any(1000 <= i < 2999 for i in want)
    private = stage["personal_data"](spark, one, corpus)
    before = {r["doc_id"]: r for r in one.collect()}
    for r in private.collect():
        assert r["text"] == pii.masked(before[r["doc_id"]]["text"]) and (r["text"] is None or r["n_chars"] == len(r["text"]))
        assert "@" not in (r["text"] or "")
    packed = stage["packing"](spark, private, corpus)
    assert {r["doc_id"] for r in packed.collect()} == want


def test_run(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus).collect()
    fill, seen = {}, set()
    for r in rows:
        seen.add((r["doc_id"], r["piece"]))
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert len(seen) == len(rows) and max(fill.values()) <= packing.SEQUENCE
    assert len(fill) <= -(-sum(fill.values()) // packing.SEQUENCE) + 1
