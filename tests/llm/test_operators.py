"""Edge cases and brute force for the operators that SQL can't express, or only in part."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, html_text, mixing, quality, simhash, topk, toxicity, warc


def test_topk_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], i) for i in range(150)]
    rows += [(200, None, 0), (201, [1.0, None, 0.0], 0), (202, [1.0, float("nan"), 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (203, [], 0), (204, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    found = topk.top_k(df, df.filter("vec_id % 20 = 0"), 5).collect()
    good = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [512, 2])
def test_simhash_links_brute_force(spark, hot):
    rng = random.Random(2)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) * rng.randrange(2)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(5, "A b  C"), (3, "a b c"), (None, None), (9, " \n"), (4, "x"), (4, "x")], "doc_id long, text string").withColumn("fp", F.lit(1))
    found = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    one, x = xxhash.xxh64_intdigest(b"a b c", 42), xxhash.xxh64_intdigest(b"x", 42)
    assert sorted(found, key=str) == sorted([(5, one, 3), (3, one, 3), (None, 0, 9), (9, 0, 9), (4, x, 4), (4, x, 4)], key=str)
    assert simhash.keep_one_of_each(docs).count() == 3


@pytest.mark.parametrize("few", [10_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def plain_fingerprint(text):
    """Bit by bit, as the contract says."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_brute_force(spark, tmp_path):
    """Texts of many shingles, near copies, capitals and other white space, against all pairs."""
    rng = random.Random(6)
    words = ["Aé", "b", "Cc", "dd", "e", "İ", "ß", "x\x0b", "y\u00a0z"]
    texts = [None, "", "  ", "one", "One", "one two", "one two three"]
    for _ in range(25):
        base = [rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randint(3, 120))]
        for _ in range(4):
            own = list(base)
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] += "!"
            texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, str(tmp_path)).collect()}
    fps, first = [plain_fingerprint(t) for t in texts], list(range(len(texts)))
    for j in range(len(fps)):
        for i in range(j):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((first[i], first[j]))
                first = [a if x == b else x for x in first]
    assert found == {i: (f"{fp:016x}", c) for i, (fp, c) in enumerate(zip(fps, first))}


def test_segments():
    rng = random.Random(3)
    for _ in range(200):
        x = np.array([rng.choice([-2.0, -1.0, 1.0, 3.0]) for _ in range(rng.randint(1, 14))])
        best = max(float(x[i:j].sum()) for i in range(len(x)) for j in range(i + 1, len(x) + 1))
        found = toxicity.segments(x)
        assert (max(found)[0] if found else 0) == max(best, 0)
        assert all(abs(x[s:e].sum() - v) < 1e-9 for v, s, e in found)


def test_labelled_models_on_edges(spark):
    text = lambda i: "you idiot fool " * (i % 3 == 0) + "plain words here number " + str(i)
    docs = spark.createDataFrame([(i, text(i), "x") for i in range(120)] + [(None, None, "x"), (500, "", "x"), (501, "word " * 30000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(120)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((found[i] >= 0.7) == (i % 3 == 0) for i in range(120)) and found[500] < 0.5 and len(found) == 123
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    scores = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(scores) == 123 and all(0 <= r.score <= 1 for r in scores)
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_toxicity_with_little_clean_text(spark):
    """Six clean documents of a word: no model that calls clean texts toxic."""
    docs = spark.createDataFrame([(i, f"bad worse worst {i}" if i < 60 else "fine") for i in range(66)] + [(900, "clean and plain words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(66)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert scores[900] < 0.7 and all(scores[i] < 0.7 for i in range(60, 66))


def test_evidence_of_segments():
    """One segment: ln(1 / E); two: the sum statistic, at a price; the curve follows the evidence."""
    m = toxicity.Model({}, 1.0)
    m.scale = 0.1
    space = math.log(0.1 * 100)
    assert m.evidence([], 100) == max(-space, -10) and m.evidence([(9.0, 0, 1)], 100) == pytest.approx(9.0 - space)
    two = 16 - 2 * space
    assert m.evidence([(9.0, 0, 1), (7.0, 3, 4)], 100) == pytest.approx(max(9 - space, two - math.log(two) - math.log(2) + math.log(2)))
    toxicity.calibrate(m, [([9.0], 100), ([8.0], 100), ([], 100), ([1.0], 100)], np.array([1.0, 1.0, 0.0, 0.0]))
    assert m.scale == pytest.approx(2 / (100 + 100 * math.exp(-1.0))) and m.score(5) > m.score(1)


def test_vote_brute_force():
    """The vote against plain cosines over the same latent vectors, and the decomposition against numpy's."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["red", "Green", "blue", "k9", "x-y", "|"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rows = [(*quality.terms(t), i % 2) for i, t in enumerate(texts)]
    m = quality.Model(rows)
    x = np.zeros((60, quality.BUCKETS))
    for i, (t, w, _) in enumerate(rows):
        x[i, t] = w * m.idf[t]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    used = np.flatnonzero(x.any(axis=0))
    assert np.linalg.norm(x[:, used] @ m.projection[used]) ** 2 == pytest.approx((np.linalg.svd(x[:, used], compute_uv=False)[: m.projection.shape[1]] ** 2).sum(), rel=1e-3)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    latent = [unit(v @ m.projection) for v in x]
    want = []
    for v in latent:
        near = sorted(((float(v @ u), y) for u, (_, _, y) in zip(latent, rows)), reverse=True)[: quality.NEIGHBOURS]
        total = sum(max(c, 0) for c, _ in near)
        want.append(sum(max(c, 0) * y for c, y in near) / total if total > 1e-9 else m.prior)
    found = m.scores([(t, w) for t, w, _ in rows])
    assert np.mean(np.abs(found - want) < 0.05) > 0.9  # ties at the last neighbour may fall either way


def test_contamination_blocks_and_edges(spark):
    words = [f"t{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "A " + " ".join(words[:25])), (2, None), (3, "short item, yes"), (4, " ".join(words[30:45])), (4, ""), (None, "Short; ITEM")], "doc_id long, text string").withColumn("items", F.lit(0))
    bench = spark.createDataFrame([(1, " ".join(words[:30])), (2, "short item"), (3, None), (4, " ".join(words[33:50])), (None, "yes"), (2, "short item")], "item_id long, text string")
    want = [(1, 26, 25, ["1"]), (2, 0, 0, []), (3, 3, 3, ["2"]), (4, 15, 12, ["4"]), (4, 0, 0, []), (None, 2, 2, ["2"])]
    for block in (2_000_000, 15):
        found = decontaminate.contamination(docs, bench, block_words=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=str) == sorted(want, key=str)
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()) == [2, 4]
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    most = {(r.doc_id, r.n_words): r.longest and tuple(r.longest) for r in decontaminate.contamination(docs, bench, block_words=15).collect()}
    assert most[1, 26] == (25, 1, "1", 0) and most[4, 15] == (12, 3, "4", 0) and most[3, 3] == (2, 0, "2", 0) and most[2, 0] is None


def test_long_items_and_brute_force(spark):
    """Places, items and longest matches against all pairs; an item of 100,000 words takes memory in proportion to them."""
    rng = random.Random(4)
    long = [f"z{rng.randrange(50_000)}".encode() for _ in range(100_000)]
    tests = decontaminate.TestSuffixes([("long", long)])
    assert sum(x.nbytes for x in vars(tests).values() if isinstance(x, np.ndarray)) < 400 * len(long)
    words = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(str(i), text(rng.choice([3, 10, 14, 40]))) for i in range(8)] + [("8", " ".join(map(bytes.decode, long)))]
    texts = [text(rng.choice([0, 5, 60])) + " " + " ".join(rng.choice(items[:8])[1].split()[rng.randrange(4) :]) + " " + text(4) for _ in range(30)] + ["", " ".join(map(bytes.decode, long[5:90_000]))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (2_000_000, 20):
        found = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string"), block_words=block).collect()}
        for i, t in enumerate(texts[:-1]):
            w, hit, names, best = t.split(), set(), set(), None
            for name, item in items[:8]:
                x = item.split()
                n = min(10, len(x))
                for p in range(len(w)):
                    for q in range(len(x) - n + 1):
                        if w[p : p + n] == x[q : q + n]:
                            m = n
                            while n == 10 and p + m < len(w) and q + m < len(x) and w[p + m] == x[q + m]:
                                m += 1
                            hit.update(range(p, p + m))
                            names.add(name)
                            best = min(best or (-m, p, name, q), (-m, p, name, q))
            assert (found[i].n_words, found[i].n_hit, list(found[i]["items"])) == (len(w), len(hit), sorted(names))
            assert (found[i].longest and tuple(found[i].longest)) == (best and (-best[0], best[1], best[2], best[3]))
        assert tuple(found[31].longest) == (89_995, 0, "8", 5) and found[31].n_hit == 89_995
    assert decontaminate.contamination(docs.limit(0), docs.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert decontaminate.keep_clean(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).count() == len(texts)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), "big") for i in range(300)] + [(1000, "a b c", "small"), (1000, "a b c", "small"), (None, None, None), (7, "x y", None)], "doc_id long, text string, source string").withColumn("size", F.lit("?"))
    rows = mixing.mix(docs).collect()
    total = sum(r.size for r in rows)
    assert len(rows) == 304 and sum({r.source_size: r.target for r in rows}.values()) == pytest.approx(1.5 * total)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(x) - t) <= 2 for (_, t), x in by.items())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[None] * 500, [7] * 500, [i % 3 for i in range(500)]])
def test_mixing_of_shared_ids(spark, ids):
    """Rows that share a hash reach the target all the same: with equal texts, and with unlike ones."""
    for text in (lambda i: "a b c", lambda i: "w " * (i % 9)):
        docs = spark.createDataFrame([(d, text(i), "s0") for i, d in enumerate(ids)] + [(1000 + i, "x " * 20, "s1") for i in range(30)], "doc_id long, text string, source string").repartition(5)
        rows = mixing.mix(docs).collect()
        by = {}
        for r in rows:
            assert 0 <= r.taken <= 2 * r.size
            by.setdefault((r.source_size, r.target), []).append(r.taken)
        assert len(rows) == 530 and all(sum(x) == int(t) for (_, t), x in by.items())
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)


def test_merkle_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * i) for i in range(300)] + [(None, None, None)], "page_id long, url string, html string").withColumn("n", F.lit(1))
    recs = warc.records(pages)
    assert warc.audit(recs, recs).count() == 0
    other = recs.withColumn("body", F.when(F.col("n") == 77, F.lit("e" * 154)).otherwise(F.col("body"))).filter("n <> 299")
    found = {(r.n, r.state) for r in warc.audit(recs, other).collect()}
    assert (77, "changed") in found and (299, "missing") in found and all(s != "changed" or n == 77 for n, s in found)


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("just  text", "just text"), ("<p>a &lt; b&nbsp;c<p>d", "a < b c d"),
        ("<body><nav><p>menu, menu, menu</p></nav><article><h1>T</h1><p>x<b>y</b>z<br>w</article><footer><p>f, f, f</p></footer>", "T xyz w"),
        ('<div><article><p>body, of, it</p></article><div class="comments"><p>nice, nice, nice</p></div><script>var a="</p>";</script></div>', "body, of, it"),
        ('<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>text, text</p><aside>side</aside></main>', "Title text, text"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_extract_whole_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None), (1, "u", "<p>a</p>")], "page_id long, url string, html string").withColumn("text", F.lit(3))
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("a", 1), ("a", 1)]
