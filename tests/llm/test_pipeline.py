def test_stages(spark):
    import corpus_pipeline
    from landtally.llm.store import stored
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        if name != "mixing":
            assert docs.columns == columns
    assert docs.count() > 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, sf), name)


def test_steps_carry_no_arrays_of_the_driver(spark):
    """The driver hashes words itself in decontamination; the arrays of that travelled with every later Python step, 34 MB each."""
    import numpy as np
    from pyspark import cloudpickle

    from landtally.llm import decontaminate, near_dedup, quality, words as W

    before, _ = W.word_hashes([b"some words of the driver"], W.SPACED)
    for step in (near_dedup._signatures(5), near_dedup._sets(5), near_dedup._owner_nodes(5), near_dedup._widened,
                 quality._count(None), decontaminate._pass([], 10, True)):
        sent = cloudpickle.dumps(step)
        assert len(sent) < 1 << 20
    docs = spark.createDataFrame([(1, "some words of the driver")], "id long, text string")
    row = docs.select("id", "text").mapInArrow(near_dedup._signatures(5), "id long, n long, node long, keys array<long>, packed array<long>").first()
    assert row["node"] == near_dedup._node(W.gram_hashes(before, 5)) and np.array_equal(W.word_hashes([b"some words of the driver"], W.SPACED)[0], before)
