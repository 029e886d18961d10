"""The pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
from tracelake.llm import near_copies


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def grouped(texts):
    """Each text's smallest connected number, by all pairs."""
    sets, first = [grams(t) for t in texts], list(range(len(texts)))
    for j in range(len(sets)):
        for i in range(j):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((first[i], first[j]))
                first = [a if x == b else x for x in first]
    return first


def near_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for k in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 40)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out + [out[0].upper(), "", None, " \n", "one two", "One  two", "one two three"]


def test_near_copies_brute_force(spark, monkeypatch):
    texts = near_texts()
    monkeypatch.setattr(near_copies, "CHUNK", 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    found = {r.rid: r.first for r in near_copies.groups(docs).collect()}
    want = dict(enumerate(grouped(texts)))
    assert found == want and len(set(want.values())) > 20
    assert near_copies.groups(docs.limit(0)).count() == 0


def test_stage_keeps_one_near_copy(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, extra int")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(grouped(texts))) and kept.columns == docs.columns


def test_stage_with_null_and_repeated_ids(spark):
    """Null and repeated ids of different texts; a null id stands for its group only where there is no other."""
    texts = near_texts()
    for ids in ([None if i % 3 == 0 else i // 2 for i in range(len(texts))], [None if i % 2 else i for i in range(len(texts))]):
        docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(zip(ids, texts))], "doc_id long, text string, extra int")
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        group = grouped(texts)
        assert sorted(group[r.extra] for r in kept) == sorted(set(group))
        assert all((r.doc_id, r.text) == (ids[r.extra], texts[r.extra]) for r in kept)
        for r in kept:
            others = [d for d, g in zip(ids, group) if g == group[r.extra] and d is not None]
            assert r.doc_id == min(others, default=None)
