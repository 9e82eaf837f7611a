"""The streaming workers over the events, each held against what SQL says of all of them at once."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.clusters import kept, kept_dir
from ..sources import log
from ..streaming import keyed, workers
from .base import op

RUNS = 3
#: Longer than any query runs: what waits is flushed at its end.
_LONG_MS = 86_400_000


class Feed:
    """A table that comes as a stream: a log that grows by a part of the table, in the given order, between the runs of its queries."""

    def __init__(self, t, df, order: str = "event_id", key: str | None = None, time_col: str | None = None, partitions: int = log.PARTITIONS):
        self.spark, self.columns = t.spark, log.ddl(df)
        self.path = f"{kept_dir(t.spark)}/quarry-log-{uuid.uuid4().hex}"
        self.options = {"order": [order], "key": key, "time_col": time_col, "partitions": partitions}
        each = max(1, int(t.spark.conf.get("spark.sql.shuffle.partitions")) // RUNS)
        cut = df.repartitionByRange(RUNS * each, order)
        self.cut = kept(cut.withColumn("__run", F.least(F.floor(F.spark_partition_id() / each), F.lit(RUNS - 1)).cast("int")))

    def stream(self):
        return log.stream(self.spark, self.path, self.columns, partitions=self.options["partitions"])

    def parts(self):
        """After each step the log holds one part more."""
        for nr in range(RUNS):
            log.append(self.cut.where(F.col("__run") == nr).drop("__run"), self.path, **self.options)
            yield nr

    def through(self, step, update: bool = False) -> workers.Job:
        """The job of step(stream), run after every part, from its checkpoint each time."""
        job = workers.Job(self.spark, lambda: step(self.stream()), update=update)
        for _ in self.parts():
            job.run()
        return job


def _collected(t, df, step, order: str = "event_id", **options):
    return Feed(t, df, order, **options).through(step).rows().drop("batch")


def _events(t):
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


_ACTION = "CASE event_id % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'noise' END"


@op("STR1_micro_batches", f"SELECT {RUNS} AS batches, CAST(count(*) AS BIGINT) AS rows_seen FROM events")
def _(t):
    feed = Feed(t, _events(t))
    place = f"{kept_dir(t.spark)}/quarry-batches-{uuid.uuid4().hex}"
    for _ in feed.parts():
        workers.run(feed.stream(), lambda batch, nr: log.put(batch.agg(F.count("*").alias("n")), f"{place}/table", nr), f"{place}/offsets")
    return log.got(t.spark, f"{place}/table", "n long, batch long").agg(F.count("*").cast("int").alias("batches"), F.sum("n").alias("rows_seen"))


@op("STR3_once_per_event", "SELECT event_id, event_type FROM events")
def _(t):
    e = _events(t).select("event_id", "ts", "event_type")
    return _collected(t, e.unionByName(e), lambda s: workers.once_within(s, "event_id", "ts", "1 hour"), "ts").select("event_id", "event_type")


_HASHED = "SELECT user_id AS item_id, event_type AS stage, md5(CAST(event_id % 3 AS VARCHAR)) AS content_hash FROM events"


@op("STR4_checkpoints", f"SELECT DISTINCT * FROM ({_HASHED})")
def _(t):
    e = _events(t).select("event_id", F.col("user_id").alias("item_id"), F.col("event_type").alias("stage"), F.md5((F.col("event_id") % 3).cast("string")).alias("content_hash"))
    return _collected(t, e, lambda s: workers.new_content(s.drop("event_id")))


@op("STR5_change_stream", f"WITH c AS (SELECT user_id AS entity_id, event_id AS \"offset\", {_ACTION} AS action, value FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY \"offset\" DESC) AS nr FROM c WHERE action <> 'noise') SELECT entity_id, \"offset\", value FROM l WHERE nr = 1 AND action <> 'delete'")
def _(t):
    c = _events(t).select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("offset"), F.expr(_ACTION).alias("action"), "value")
    job = Feed(t, c.withColumnRenamed("offset", "at"), "at").through(lambda s: workers.changes_applied(s.withColumnRenamed("at", "offset")), update=True)
    return job.latest("entity_id").where("action <> 'delete'").select("entity_id", "offset", "value")


@op("STR6_completion", "WITH c AS (SELECT user_id AS ingestion_id, count(*) FILTER (event_type = 'click') AS produced, count(*) FILTER (event_type <> 'click') AS received, bool_or(event_type = 'error') AS finalised FROM events GROUP BY 1) SELECT ingestion_id FROM c WHERE finalised AND received >= produced")
def _(t):
    # the counter of a run comes with its events, so what was produced is known only when all of them are there: the run is final then
    e = _events(t).select("event_id", F.col("user_id").alias("ingestion_id"), (F.col("event_type") == "click").cast("long").alias("produced"), (F.col("event_type") != "click").cast("long").alias("received"), (F.col("event_type") == "error").alias("finalised"))
    last = F.max("event_id").over(Window.partitionBy("ingestion_id"))
    final = F.bool_or("finalised").over(Window.partitionBy("ingestion_id"))
    e = e.withColumn("finalised", final & (F.col("event_id") == last))
    return _collected(t, e, lambda s: keyed.completed(s.drop("event_id"), "ingestion_id")).select("ingestion_id")


@op("STR7_late_nodes", "SELECT DISTINCT 'u' || user_id AS src, event_type AS dst FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def _(t):
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    edges = _events(t).select("event_id", F.lit("edge").alias("kind"), u.alias("src"), F.col("event_type").alias("dst"))
    nodes = _events(t).where("event_type = 'error'").select("event_id", F.lit("node").alias("kind"), u.alias("src"), F.lit(None).cast("string").alias("dst"))
    return _collected(t, edges.unionByName(nodes), lambda s: keyed.edges_with_nodes(s.drop("event_id")))


@op("STR8_deletes_first", f"WITH c AS (SELECT user_id AS entity_id, event_id AS \"offset\", {_ACTION} AS action, value FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY \"offset\" DESC) AS nr FROM c WHERE action <> 'delete') SELECT entity_id, value FROM n WHERE nr = 1 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey NOT IN (SELECT entity_id FROM c)")
def _(t):
    c = _events(t).select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("offset"), F.expr(_ACTION).alias("action"), "value")
    target = t.customer.select(F.col("c_custkey").alias("entity_id"), F.lit(0.0).alias("value"))
    return workers.deletes_first(target, c, "entity_id", "offset")


@op("STR9_fan_out", "SELECT 'types' AS consumer, count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'rows', count(*) FROM events")
def _(t):
    feed = Feed(t, _events(t))
    keys = {"types": "event_type", "users": "user_id", "rows": "event_id"}
    # each consumer has its own offsets in the one log
    jobs = {name: workers.Job(t.spark, lambda c=c: feed.stream().select(F.col(c).cast("string").alias("k")).dropDuplicates(["k"])) for name, c in keys.items()}
    for _ in feed.parts():
        for job in jobs.values():
            job.run()
    out = None
    for name, job in jobs.items():
        part = job.rows().agg(F.count("*").alias("n")).select(F.lit(name).alias("consumer"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def _flaky(text: str, attempt: int) -> str:
    """Stands for a provider: some texts take two calls, some never pass."""
    if len(text) % 5 == 0 or (len(text) % 3 == 0 and attempt < 2):
        raise RuntimeError("unavailable")
    return text.upper()


@op("STR10_retries", "SELECT item_id AS id, CAST(CASE WHEN length(text) % 5 = 0 THEN 3 WHEN length(text) % 3 = 0 THEN 2 ELSE 1 END AS INT) AS attempts, CASE WHEN length(text) % 5 = 0 THEN 'unavailable' END AS error FROM benchmark WHERE text IS NOT NULL")
def _(t):
    rows = t.benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    return workers.with_retries(rows, _flaky).select("id", "attempts", "error")


@op("STR11_tenant_partitions", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    feed, place = Feed(t, _events(t)), f"{kept_dir(t.spark)}/quarry-tenants-{uuid.uuid4().hex}"
    for _ in feed.parts():
        workers.run(feed.stream(), lambda batch, nr: batch.write.mode("overwrite").partitionBy("event_type").parquet(f"{place}/rows/batch={nr}"), f"{place}/offsets")
    return t.spark.read.option("basePath", f"{place}/rows").parquet(f"{place}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


@op("STR13_request_cache", "SELECT CASE WHEN event_id % 5 <> 0 THEN event_id END AS request_id, event_type FROM events UNION ALL SELECT NULL, event_type FROM events WHERE event_id % 5 = 0")
def _(t):
    e = _events(t).select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("request_id"), "ts", "event_type")
    return _collected(t, e.unionByName(e), lambda s: workers.once_within(s.drop("event_id"), "request_id", "ts", "3600 seconds"), "ts", key="event_id").select("request_id", "event_type")


@op("STR15_window_flush", "SELECT time_bucket(INTERVAL '60 seconds', ts) AS start, user_id, max(struct_pack(ts := ts, value := value)).value AS value FROM events GROUP BY 1, 2")
def _(t):
    job = Feed(t, _events(t).select("event_id", "ts", "user_id", "value"), "ts").through(lambda s: workers.last_by_window(s.drop("event_id"), "user_id", "value", "ts", "60 seconds"), update=True)
    return job.latest("start", "user_id").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "value")


@op("STR17_replay", "SELECT event_id, event_type FROM events WHERE event_id BETWEEN 100 AND 499 AND ts >= TIMESTAMP '2024-01-02 00:00:00'")
def _(t):
    feed = Feed(t, _events(t), time_col="ts")
    for _ in feed.parts():
        pass
    since = datetime(2024, 1, 2, tzinfo=timezone.utc)
    return log.replay(t.spark, feed.path, feed.columns, startingMillis=int(since.timestamp() * 1000)).where("event_id between 100 and 499").select("event_id", "event_type")


@op("STR18_keyed_groups", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (n % 20 > 0) AS rests FROM c GROUP BY 1")
def _(t):
    job = Feed(t, _events(t).select("event_id", "event_type")).through(lambda s: keyed.accumulated(s, ["event_type"], 20, _LONG_MS))
    fired = job.rows().select("event_type", F.size("rows").alias("n"), F.lit(0).alias("rest"))
    rest = keyed.waiting(t.spark, job.checkpoint).groupBy(F.col("key.event_type").alias("event_type")).agg(F.count("*").cast("int").alias("n")).withColumn("rest", F.lit(1))
    got = fired.where("n = 20").unionByName(rest)
    return got.groupBy("event_type").agg(F.sum("n").alias("items"), F.sum("rest").alias("rests"))


@op("SRC6_json_stream", "SELECT event_id, event_type, value FROM events")
def _(t):
    e = workers.messages(t.events.select("event_id", "event_type", "value"), "events", "event_id").select("value").unionByName(t.spark.createDataFrame([(None,)], "value string"))
    return _collected(t, e, lambda s: workers.decoded(s, "event_id long, event_type string, value double"), "value")


@op("SRC7_topic_routing", "SELECT CASE event_id % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'summary' ELSE 'chunk' END AS kind, count(*) AS n FROM events GROUP BY 1")
def _(t):
    topic = F.get(F.array(*[F.lit(x) for x in ("code.entities.v1", "code.summaries.v1", "doc.chunks.v1")]), (F.col("event_id") % 3).cast("int"))
    s = _collected(t, t.events.select("event_id", topic.alias("topic")), lambda s: s.select("event_id", workers.item_kind(F.col("topic")).alias("kind")))
    return s.groupBy("kind").agg(F.count("*").alias("n"))


@op("SNK5_publish", "SELECT 'chunks' AS topic, CAST(doc_id AS VARCHAR) AS key, doc_id, lang FROM documents")
def _(t):
    path = f"{kept_dir(t.spark)}/quarry-topic-{uuid.uuid4().hex}"
    sent = workers.messages(t.documents.select("doc_id", "lang"), "chunks", "doc_id")
    for _ in range(2):  # published twice under one batch number, it is there once
        log.put(sent, path, 0)
    return workers.decoded(log.got(t.spark, path, "topic string, key string, value string"), "doc_id long, lang string")


@op("STR1_size_or_idle", "WITH c AS (SELECT event_id % 4 AS lane, count(*) AS n FROM events GROUP BY 1) SELECT lane, CAST(n // 100 AS BIGINT) AS full_batches, CAST(n % 100 AS BIGINT) AS waiting FROM c")
def _(t):
    job = Feed(t, _events(t)).through(lambda s: workers.sized_batches(s, F.col("event_id") % 4, 100, _LONG_MS))
    full = job.rows().groupBy("lane").agg(F.count_if(F.size("rows") == 100).alias("full_batches"))
    rest = keyed.waiting(t.spark, job.checkpoint).groupBy(F.col("key.lane").alias("lane")).agg(F.count("*").alias("waiting"))
    return full.join(rest, "lane", "full").select("lane", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("full_batches", "waiting")])


@op("STR17_replay_range", "WITH o AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events) SELECT CAST(place AS BIGINT) AS place, event_id, event_type FROM o WHERE place BETWEEN 250 AND 899")
def _(t):
    feed = Feed(t, _events(t), partitions=1)
    for _ in feed.parts():
        pass
    rows = log.replay(t.spark, feed.path, f"{feed.columns}, offset long", startingOffsets='{"0": 250}', endingOffsets='{"0": 900}')
    return rows.select(F.col("offset").alias("place"), "event_id", "event_type")


@op("SNK1_vector_sink", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END AS label, CAST(len(embedding) AS INT) AS dims FROM embeddings")
def _(t):
    path = f"{kept_dir(t.spark)}/quarry-points-{uuid.uuid4().hex}"
    points = t.embeddings.select("vec_id", "embedding", "label")
    log.put(points, path, 0)
    for _ in range(2):  # the second time the batch is there already
        log.put(points.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 1), path, 1)
    rows = log.got(t.spark, path, f"{log.ddl(points)}, batch long")
    last = rows.groupBy("vec_id").agg(F.max_by(F.struct("embedding", "label"), "batch").alias("last"))
    return last.select("vec_id", "last.label", F.size("last.embedding").alias("dims"))
