"""The pipeline's stages and run() against brute force, with null and repeated ids."""

import random

import corpus_pipeline
from tracelake.llm import suffix_array


def uncovered(texts, length=200):
    """Each text without what strings of length bytes cover that start before, in texts or in place; None where nothing is covered."""
    seen, out = set(), []
    for data in ((t or "").encode() for t in texts):
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(data[k : k + length])
        out.append(bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore") if any(gone) else None)
    return out


def sample():
    rng = random.Random(11)
    words = [f"w{i}é" for i in range(4000)]
    passage = " ".join(rng.choice(words) for _ in range(100))
    texts = []
    for i in range(40):
        own = " ".join(rng.choice(words) for _ in range(rng.randint(80, 200)))
        texts.append(own + (" " + passage if i % 3 else ""))
    texts += [passage, "  " + passage, "\n" + passage, passage + "x", None, "", "word " * 300, own + "\n" + own]
    return [(None if i % 3 == 0 else i // 4, t, "en", f"s{i % 2}", len(t or ""), i) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, extra int"


def in_order(rows):
    """By doc_id, nulls last, then by the other columns, nulls first."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode(), r[2:]))


def cleaned(rows):
    out, rows = [], in_order(rows)
    for r, kept in zip(rows, uncovered([r[1] for r in rows])):
        if kept is None:
            out.append(r)
        elif kept.strip(" \t\n\v\f\r"):
            out.append((r[0], kept, r[2], r[3], len(kept), r[5]))
    return sorted(out, key=lambda r: r[5])


def test_cut_repeats_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = corpus_pipeline.cut_repeats(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=lambda r: r[5]) == cleaned(rows)


def test_run_with_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    """No labels: quality keeps all. A leak and an exact copy go; the sizes that are mixed are those of the cut texts."""
    rows = [r for r in sample() if r[1] and (r[5] <= 40 or r[5] == 46)]  # without near copies
    rows.append((3, rows[0][1], "en", "s0", 0, 98))
    rows.append((None, "the item asked about seven green boats on the old river today", "en", "s1", 0, 99))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = {tuple(r) for r in corpus_pipeline.keep_good_text(spark, docs, str(tmp_path)).collect()}
    assert good == set(rows)
    want = cleaned([r for r in rows[:-1] if r[5] != 0])  # of the copies that with an id stays
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.size) for r in found), key=key) == sorted(((r[0], len(r[1].split())) for r in want), key=key)


def test_cut_repeats_with_clashing_columns_and_empty(spark):
    """Columns called like those that the operators use themselves, white space that remains, and an empty table."""
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [(1, passage, 1, 2, 3, 4), (1, "\n" + passage, 1, 2, 3, 4), (None, passage + " more", 1, 2, 3, 4), (None, "short", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rid long, kept int, n_removed int, _kept long")
    for stage in (corpus_pipeline.cut_repeats, corpus_pipeline.drop_near_duplicates):
        found = stage(spark, docs, "")
        assert found.columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    found = sorted((r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()))
    assert found == ["\n" + passage, " more", "short"]


def test_crowded_passages_keep_the_first_copy(spark):
    """Anchors with more different pieces than a shard takes, by blocks of windows."""
    texts = [r[1] for r in sample()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.kept for r in suffix_array.deduplicate(docs, crowd=2, keep_first=True).collect()}
    assert [found[i] for i in range(len(texts))] == uncovered(texts)
