"""Survivors and neighbours on inputs that the given tables don't hold."""

import numpy as np

import corpus_pipeline
from quarry.llm import annsearch


def test_deduplication_is_by_row(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey", "lorem ipsum dolor sit amet elit"]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (1, texts[1], "a"), (None, texts[0], "a"), (None, texts[2], "b"), (None, texts[2], "a"), (4, texts[1].upper(), "a"), (9, texts[3], "a"), (9, texts[3], "a"), (2, None, "b"), (None, "", "a")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, texts[0], "a"), (1, texts[1], "a"), (None, texts[2], "a"), (9, texts[3], "a"), (2, None, "b")], key=repr)


def test_every_query_gets_k_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 8)))] + [(0, [1.0] * 8), (605, [1.0] * 3), (610, [2.0] * 3)]
    # one part is probed, and 16 parts of 600 rows hold fewer than 50 each
    got = annsearch.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=5, k=50, recall=0.01).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 50 for i in range(0, 600, 5)} | {605: 1, 610: 1}
