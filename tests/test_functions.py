import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import ids, text
from quarry.operators import chunking, fusion, graph, upserts
from quarry.sources import files
from quarry.streaming import queries as streams


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("s, want", [("AIIntegration", "AI Integration"), ("HTTPSConnection", "HTTPS Connection"), ("userPayment", "user Payment")])
def test_camel_split(spark, s, want):
    assert value(spark, text.camel_split(F.lit(s))) == want


@pytest.mark.parametrize("s, want", [("Payment Processing", "payment_process"), ("User Authentication", "authentica_user"), ("Order Management", "manage_order"), ("Billing", "bill")])
def test_domain_key(spark, s, want):
    assert value(spark, text.domain_key(F.lit(s))) == want


@pytest.mark.parametrize("s, want", [("emergency_care", "emergency care"), ("  Internal  Medicine  ", "internal medicine")])
def test_reject_key(spark, s, want):
    assert value(spark, text.reject_key(F.lit(s))) == want


@pytest.mark.parametrize("name", ["Foo Bar", "it's", "größe 日本", ""])
def test_uuid5(spark, name):
    assert value(spark, ids.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_OID, name))


def test_document_chunks():
    got = chunking.document_chunks("# Title\n\nFirst paragraph.\n\n## Section\n\nSecond paragraph.\n\nThird paragraph.", 30, 1)
    assert len(got) >= 2 and [c["chunk_index"] for c in got] == list(range(len(got))) and all(c["total_chunks"] == len(got) for c in got)
    assert chunking.document_chunks("") == [] and chunking.document_chunks(None) == []
    assert all(len(c["chunk"]) <= 100 for c in chunking.document_chunks("word " * 500, 100, 10))


def test_skeleton_and_lines():
    assert chunking.python_skeleton("class A:\n  def f(self, x): pass\ndef g(): pass") == ["class A", "    def f(self, x)", "def g()"]
    assert chunking.python_skeleton("def (") == []
    assert "\n".join(chunking.greedy_lines("a\nbb\nccc", 5)) == "a\nbb\nccc"


def test_paths_repeat_nodes_but_no_edge(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a"), ("b", "r", "c")], "src string, rel string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert sorted((r.node, r.depth) for r in graph.paths(e, start, 3).collect()) == [("a", 2), ("b", 1), ("c", 2)]


def test_rrf_keeps_first_payload(spark):
    rows = [(0, 1, "x", "first", 1.0), (1, 1, "y", "y", 0.8), (1, 2, "x", "second", 0.8), (1, 3, None, "none", 0.8)]
    got = fusion.rrf(spark.createDataFrame(rows, "list_idx int, rank int, id string, payload string, weight double")).collect()
    assert [(r.id, r.payload, r.fusion_rank) for r in got] == [("x", "first", 1), ("y", "y", 2)]
    assert got[0].score == pytest.approx(1 / 61 + 0.8 / 62, abs=1e-8)


def test_apply_changes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "entity_id long, text string")
    changes = spark.createDataFrame([(1, "x", "update", 1), (1, "y", "update", 2), (2, "", "delete", 3), (3, "c", "create", 4), (4, "d", "what", 5)], "entity_id long, text string, action string, offset long")
    assert sorted(map(tuple, streams.apply_changes(target, changes).collect())) == [(1, "y"), (3, "c")]


def test_stream_dedup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"event_id": 1, "ts": "2024-01-01T00:00:00"}\n{"event_id": 1, "ts": "2024-01-01T00:01:00"}\n{"event_id": 2, "ts": "2024-01-01T00:02:00"}\n')
    schema = spark.createDataFrame([], "event_id long, ts timestamp").schema
    seen = []
    q = streams.run_batches(streams.once_per_event(streams.file_stream(spark, str(tmp_path / "in"), schema)), lambda df, _: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted(seen) == [1, 2]


def test_record_versions(spark):
    stored = spark.createDataFrame([("a", "h1", 1), ("a", "h2", 2)], "path string, content_hash string, version long")
    new = spark.createDataFrame([("a", "h2"), ("a", "h3"), ("b", "h1")], "path string, content_hash string")
    assert sorted((r.path, r.content_hash, r.version) for r in upserts.record_versions(stored, new, ["path"]).collect()) == [("a", "h3", 3), ("b", "h1", 1)]


def test_zip_rules():
    assert files.check_zip(b"no zip") == "not a zip file"
