"""What the pipeline's stages keep out of the driver and out of shuffles."""

import tracemalloc

import pytest

from tracelake.llm import near_copies, quality, simhash


def test_quality_is_fitted_outside_the_driver(spark):
    """The decomposition's matrices are several times the model, which alone comes to the driver."""
    docs = spark.createDataFrame([(i, f"term{i % 7} term{i % 11} word{i % 5} of {i % 3}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = quality.train(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.projection.shape[0] == quality.BUCKETS and len(model.vectors) == len(model.labels) > 100
    assert peak < 5 * model.projection.nbytes


@pytest.mark.parametrize("ids, shuffled", [(near_copies.IDS, False), (1, True)])
def test_documents_are_shuffled_only_beyond_the_bound(spark, monkeypatch, ids, shuffled):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(6)]
    docs = spark.createDataFrame([(i, texts[i % 6]) for i in range(18)], "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(near_copies, "IDS", ids)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        found = simhash.keep_one_of_each(docs)
        assert sorted(r.doc_id for r in found.collect()) == list(range(6))
        assert ("Exchange hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()) == shuffled
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
