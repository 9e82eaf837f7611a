"""Centroid clustering (k-means over whole numbers) by Exponion search.

Method: every vector keeps an upper bound u on the distance to its centroid a and a lower bound l on that to any other.
Where u < max(l, s(a) / 2), with s(a) the distance from a to the nearest other centroid, the assignment stands.  Else the
distance to a is computed, and if the bound still does not hold, only centroids within 2 u + s(a) of a are scanned: they
are a prefix of a's list of the other centroids sorted by distance.  The prefix is inclusive and the bounds are widened by
a relative SLACK, so centroids at the same distance are all looked at and ties go to the smaller number.  After a round
u grows by a's own move and l shrinks by the longest move of the others.

Vectors are packed into blocks once and written bucketed by block; a round joins them with the thin state of their blocks
(a, u, l), written each round, so only state is ever shuffled.  A round's new sums come from the vectors that changed their
centroid: each task adds up its blocks and emits k rows of sums, split in two halves of 32 bits so that they add exactly.
Centroids and their lists (k rows) are all that the driver holds.  Where no centroid moves the rounds end early, as all
later ones would give the same.

Defined results: components become floor(scale * x); vectors that are null, of another length or hold a null, NaN or infinity
take no part; rows with a null id are clustered but never start a centroid; of rows that share an id the smaller vector
comes first as a start; repeated rows each count; ties go to the smaller centroid number; fewer vectors than k give fewer
centroids; an empty table gives an empty table; other columns are ignored.  Components of 2^22 and more are computed
in unbounded integers; distances and their sums end at 2^63 - 1.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, shared_dir, table, written

K, DIM, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, 3
BLOCK = 4096
SLACK = 1e-9
_FLOAT_SAFE = 1 << 22
_MOST = (1 << 63) - 1
_STATE = "block long, a binary, u binary, l binary, moved boolean, sums array<array<bigint>>"


def whole_vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, ints) of the vectors of exactly ``dim`` finite components."""
    inf = float("inf")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    vec = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    out = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), vec.alias("vec"))
    return out.where(F.col("vec").isNotNull() & (F.size("vec") == dim) & F.coalesce(F.forall("vec", fine), F.lit(False))).select("id", F.transform("vec", lambda x: F.floor(x * scale)).alias("ints"))


def _packed(dim: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        nr = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            nonlocal nr
            rows = rows.combine_chunks()
            ids = rows.column(0).combine_chunks()
            vecs = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype("<i8") for c in rows.column(1).chunks])
            nr += 1
            whole = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks))
            return pa.RecordBatch.from_arrays([pa.array([nr - 1], pa.int64()), whole, pa.array([vecs.tobytes()], pa.binary())], names=["block", "ids", "vecs"])

        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= block:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, block))
                held = rows.slice(block).to_batches()
        if sum(map(len, held)):
            yield out(pa.Table.from_batches(held))

    return run


def distances(vecs, centre):
    """Exact squared distances (rows of vecs, rows of centre): floats where all whole numbers on the way are below 2^53, else unbounded integers."""
    import numpy as np

    if len(vecs) == 0 or max(np.abs(vecs.astype(float)).max(), np.abs(np.array(centre, float)).max()) < _FLOAT_SAFE:
        v, c = vecs.astype(np.float64), np.array(centre, np.float64).reshape(len(centre), -1)
        return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
    v, c = vecs.astype(object), np.array(centre, object)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1)


class Centroids:
    """A round's centroids: rows of whole numbers, and by centroid the others sorted by distance."""

    def __init__(self, rows: list[list[int]], before: Centroids | None = None):
        import numpy as np

        self.rows, k = rows, len(rows)
        between = np.array([[float(sum((x - y) ** 2 for x, y in zip(p, q))) for q in rows] for p in rows]) ** 0.5
        self.order = np.argsort(between, axis=1, kind="stable")
        for a in range(k):  # a itself comes first, also where another centroid stands at the same place
            self.order[a] = [a, *[j for j in self.order[a] if j != a]]
        self.sorted = np.take_along_axis(between, self.order, 1)
        self.nearest = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        moved = [0.0] * k if before is None else [float(sum((x - y) ** 2 for x, y in zip(p, q))) ** 0.5 for p, q in zip(rows, before.rows)]
        self.moved = np.array(moved)
        # the longest move among the others
        self.others = np.array([max((m for j, m in enumerate(moved) if j != a), default=0.0) for a in range(k)])


def assigned(vecs, c: Centroids, state=None):
    """(a, u, l, rows whose centroid was looked for) of a block's vectors; state is that of the round before."""
    import numpy as np

    n, k = len(vecs), len(c.rows)

    def two_least(d, numbers):
        """Nearest centroid (ties: smaller number) and the two least distances, numbers ascending along d's columns."""
        at = np.argmin(d, axis=1)
        first = d[np.arange(len(d)), at]
        if d.shape[1] > 1:
            rest = d.copy()
            rest[np.arange(len(d)), at] = rest.max() + 1
            second = np.sqrt(rest.min(axis=1).astype(float))
        else:
            second = np.full(len(d), np.inf)
        return numbers[at], np.sqrt(first.astype(float)), second

    if state is None:
        a, u, low = two_least(distances(vecs, c.rows), np.arange(k))
        return a.astype(np.int32), u, low, np.arange(n)
    a, u, low = (x.copy() for x in state)
    u, low = (u + c.moved[a]) * (1 + SLACK), (low - c.others[a]) * (1 - SLACK)
    bound = np.maximum(low, c.nearest[a] / 2) * (1 - SLACK)
    open_ = np.flatnonzero(~(u < bound))
    for j in np.unique(a[open_]):  # the distance to the own centroid first
        rows = open_[a[open_] == j]
        u[rows] = np.sqrt(distances(vecs[rows], [c.rows[j]])[:, 0].astype(float))
    open_ = open_[~(u[open_] * (1 + SLACK) < bound[open_])]
    own = a[open_].copy()
    for j in np.unique(own):
        rows = open_[own == j]
        radius = (2 * u[rows] + c.nearest[j]) * (1 + SLACK)
        reach = np.searchsorted(c.sorted[j], radius, side="right")  # inclusive
        for m in np.unique(reach):
            some = rows[reach == m]
            numbers = np.sort(c.order[j][:m])
            a[some], u[some], low[some] = two_least(distances(vecs[some], [c.rows[i] for i in numbers]), numbers)
    return a, u, low, open_


def _halves(total) -> tuple[list[int], list[int]]:
    """A row of whole numbers as its upper and lower halves."""
    return [int(x) >> 32 for x in total], [int(x) & 0xFFFFFFFF for x in total]


def _round(c: Centroids, dim: int):
    """Blocks with their state: the state of the next round, and what the sums of each centroid gain or lose."""
    k = len(c.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for block, raw, *old in zip(*(col.to_pylist() for col in b.columns)):
                vecs = np.frombuffer(raw, "<i8").reshape(-1, dim)
                state = (np.frombuffer(old[0], "<i4"), np.frombuffer(old[1], "<f8"), np.frombuffer(old[2], "<f8")) if old else None
                a, u, low, _ = assigned(vecs, c, state)
                changed = np.arange(len(a)) if state is None else np.flatnonzero(a != state[0])
                v = vecs[changed]
                wide = len(v) and np.abs(v.astype(float)).max() * len(v) >= 2.0**62
                gain = np.zeros((k, dim + 1), object if wide else np.int64)
                v = np.concatenate([np.ones((len(v), 1), np.int64), v], 1).astype(gain.dtype)
                np.add.at(gain, a[changed], v)
                if state is not None:
                    np.subtract.at(gain, state[0][changed], v)
                sums = [half for row in gain for half in _halves(row)] if len(changed) else None
                out = [pa.array([x]) for x in (block, a.astype("<i4").tobytes(), u.tobytes(), low.tobytes(), bool(len(changed)))]
                yield pa.RecordBatch.from_arrays([*out, pa.array([sums], pa.list_(pa.list_(pa.int64())))], names=["block", "a", "u", "l", "moved", "sums"])

    return run


def _added(k: int, dim: int):
    """A task's blocks added up: (row, sums) for the two halves of each centroid's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, some = np.zeros((2 * k, dim + 1), np.int64), False
        for b in batches:
            for sums in b.column(0):
                total += sums.values.flatten().to_numpy().reshape(2 * k, dim + 1)
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["row", "sums"])

    return run


def _final(dim: int, rows: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for i in range(len(b)):
                ids, vecs = b.column(0)[i].values, np.frombuffer(b.column(1)[i].as_buffer(), "<i8").reshape(-1, dim)
                a = np.frombuffer(b.column(2)[i].as_buffer(), "<i4")
                d = np.zeros(len(a), np.int64)
                for j in np.unique(a):
                    at = np.flatnonzero(a == j)
                    own = distances(vecs[at], [rows[j]])[:, 0]
                    d[at] = own.astype(np.int64) if own.dtype != object else [min(x, _MOST) for x in own]
                yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def starts(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors of smallest SHA-256 of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["ints"]) for r in vectors.where("id is not null").select(h.alias("h"), "ints").orderBy("h", "ints").limit(k).collect()]


def kmeans(rows: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector after ``rounds`` rounds and one more assignment, and the centroids."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, dim, scale, vec_id, embedding)
    now = starts(vectors, k, seed)
    if not now:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    k = len(now)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    name = f"quarry_{uuid.uuid4().hex}"
    packed = vectors.mapInArrow(_packed(dim, block), "block long, ids array<long>, vecs binary")
    packed.repartition(parts, "block").write.format("parquet").bucketBy(parts, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    blocks = spark.table(name)
    c, state, path, sums = Centroids(now), None, None, [[0] * (dim + 1) for _ in range(k)]
    for nr in range(rounds + 1):
        met = blocks.select("block", "vecs") if state is None else blocks.select("block", "vecs").join(state.select("block", "a", "u", "l"), "block")
        state, new = written(met.mapInArrow(_round(c, dim), _STATE))
        if path:
            removed(spark, path)
        path = new
        if nr == rounds:
            break
        changed = state.where("moved").select("sums").mapInArrow(_added(k, dim), "row int, sums array<bigint>")
        for r in changed.select("row", F.posexplode("sums").alias("at", "x")).groupBy("row", "at").agg(F.sum("x").alias("x")).collect():  # 2 k (dim + 1) rows
            sums[r["row"] // 2][r["at"]] += r["x"] << 32 if r["row"] % 2 == 0 else r["x"]
        before, c = c, Centroids([[x // s[0] for x in s[1:]] if s[0] else old for s, old in zip(sums, c.rows)], c)
        if c.rows == before.rows:
            break
    out, _ = written(blocks.join(state.select("block", "a"), "block").select("ids", "vecs", "a").mapInArrow(_final(dim, c.rows), "vec_id long, cluster int, distance long"))
    spark.sql(f"DROP TABLE {name}")
    removed(spark, path)
    removed(spark, f"{shared_dir(spark)}/{name}")
    return out, c.rows


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's cluster among eight, its squared distance, and the sums of these by cluster and in all."""
    found, rows = kmeans(table(spark, sf_dir, "embeddings"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(rows)]
    bounded = lambda x: F.least(x, F.lit(_MOST)).cast("long")
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))  # k rows
    whole = by_cluster.agg(bounded(F.sum("d")).alias("inertia"))
    named = by_cluster.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster").select("cluster", bounded(F.col("d")).alias("cluster_inertia"), "centroid_sha256")
    named = named.withColumn("inertia", whole.scalar())
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """All rounds one after the other; every vector against every centroid."""
    square = "CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.ints, c.ints)]) AS BIGINT)"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), ints) - 1 AS INT) AS cluster, ints FROM v
  WHERE vec_id IS NOT NULL QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), ints) <= {K})""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} AS (SELECT v.nr, v.vec_id, v.ints, c.cluster, {square} AS distance FROM v CROSS JOIN c{r} c)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY nr ORDER BY distance, cluster) = 1)")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(ints) AS x, unnest(range({DIM})) AS place FROM a{r}) GROUP BY 1, 2)""")
            steps.append(f"""m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS ints FROM s{r} GROUP BY 1)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.ints, c.ints) AS ints FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    last = ROUNDS
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(x AS VARCHAR) FOR x IN c.ints], ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.cluster = c.cluster"""
    )


SQL = _sql()
