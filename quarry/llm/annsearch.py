"""Approximate nearest neighbours over learned partitions.

Method: on a bounded sample of SAMPLE vectors the exact neighbour graph is built and cut into balanced parts, whose number
grows with the square root of the table's rows (parts_for; at most one for every 32 vectors of the sample),
(bisection along the graph's spectral order, then capacity-bound moves of nodes to where most of their neighbours are).  A
small classifier with one hidden layer learns which parts hold a vector's neighbours.  Every row of the table is indexed in
its most probable part; a query is routed to as many of its most probable parts as reached RECALL on the sample,
and on to further ones while these hold fewer than k other rows; the rows there are reranked by their exact inner product.
Parts are dealt over shards by a hash of the id, so a part that holds a
third of all rows is many tasks' work; queries travel to the shards in blocks, by an equi-join on (part, shard), and each
shard is shuffled once.

Recall on the synthetic vectors, which have next to no structure, takes most parts; see the README for figures.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component take no part; vectors meet only
vectors of the same length, and the classifier reads the most frequent length of the sample (rows of others meet in part 0);
rows that share the query's id are its own; of queries that share an id the smallest vector asks; repeated candidate rows
count each; ties go to the smaller id; tables below SAMPLE rows are fitted whole; empty tables give none.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import QUERY_ROWS, SHARD_ROWS, best, lane, matrix, shards_for, usable
from .common import table, written

SAMPLE = 4096
#: Parts of a small table.
PARTS = 16
GRAPH = 16
RECALL = 0.96
TOP = 20


def neighbour_graph(x, k: int):
    """The k nearest others of each row by inner product."""
    import numpy as np

    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), int)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph, n: int, parts: int, sweeps: int = 6, seed: int = 7):
    """A part for each node: spectral bisection, then moves that gain neighbours while no part grows beyond its share by a tenth."""
    import numpy as np

    rng, part = np.random.default_rng(seed), np.zeros(n, int)
    src = np.repeat(np.arange(n), graph.shape[1])
    a, b = np.concatenate([src, graph.ravel()]), np.concatenate([graph.ravel(), src])
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    pieces = [np.arange(n)]
    while len(pieces) < parts:
        pieces.sort(key=len)
        own = pieces.pop()
        if len(own) < 2:
            pieces.append(own)
            break
        inside = np.zeros(n, bool)
        inside[own] = True
        e = inside[a] & inside[b]
        v = rng.standard_normal(n)
        for _ in range(40):  # power steps towards the second eigenvector of the walk on the piece
            v = 0.5 * v + 0.5 * np.bincount(a[e], v[b[e]], n) / degree
            v[own] -= v[own].mean()
            v /= max(np.abs(v[own]).max(), 1e-30)
        own = own[np.argsort(v[own], kind="stable")]
        pieces += [own[: len(own) // 2], own[len(own) // 2 :]]
    for i, own in enumerate(pieces):
        part[own] = i
    room, counts = int(1.1 * n / len(pieces)) + 1, np.bincount(part, minlength=parts)
    start, order = np.searchsorted(np.sort(a), np.arange(n + 1)), np.argsort(a, kind="stable")
    near = b[order]
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[near[start[i] : start[i + 1]]], minlength=parts).astype(float)
            here = votes[part[i]]
            votes[counts >= room] = -1
            to = int(votes.argmax())
            if votes[to] > here:
                counts[part[i]] -= 1
                counts[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


def train(x, target, hidden: int = 64, steps: int = 300, seed: int = 7):
    """A classifier x -> tanh -> softmax fitted to target's rows (shares of parts), by Adam."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    w = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) * 0.1, np.zeros(target.shape[1])]
    z, m, v = (x - mean) / spread, [0.0] * 4, [0.0] * 4
    for t in range(1, steps + 1):
        h = np.tanh(z @ w[0] + w[1])
        o = h @ w[2] + w[3]
        p = np.exp(o - o.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) / len(x)
        dh = (d @ w[2].T) * (1 - h * h)
        for i, g in enumerate((z.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
            g = g + 1e-5 * w[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    return {"mean": mean, "spread": spread, "w": w}


def ranked_parts(model, x):
    """Parts by falling probability, for each row."""
    import numpy as np

    w = model["w"]
    o = np.tanh(((x - model["mean"]) / model["spread"]) @ w[0] + w[1]) @ w[2] + w[3]
    return np.argsort(-o, axis=1, kind="stable")


def parts_for(n: int) -> int:
    """Parts of a table of n rows: an eighth of the square root, PARTS at least."""
    return max(PARTS, math.isqrt(n) // 8)


def learn(x, parts: int = PARTS, graph: int = GRAPH, recall: float = RECALL, k: int = TOP) -> dict:
    """The router: a classifier and the number of parts to probe."""
    import numpy as np

    parts = max(1, min(parts, len(x) // 32))
    if parts == 1:
        return {"dim": x.shape[1], "probes": 1, "model": None}
    near = neighbour_graph(x, graph)
    part = balanced_parts(near, len(x), parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    target[np.arange(len(x)), part] += near.shape[1] / 2
    model = train(x, target / target.sum(1, keepdims=True))
    order = ranked_parts(model, x)
    wanted = neighbour_graph(x, k)
    place = np.argsort(order, axis=1)  # place[i, p]: when query i probes part p
    probe = np.sort(place[np.arange(len(x))[:, None], order[:, 0][wanted]].ravel())
    return {"dim": x.shape[1], "probes": int(probe[min(len(probe) - 1, int(np.ceil(recall * len(probe))) - 1)]) + 1, "model": model}


def _routed(router: dict, probes: int | None = None):
    """The ``probes`` most probable parts of each row, all of them where None."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for pdf in batches:
            if not len(pdf):
                continue
            fits = np.array([len(v) == router["dim"] for v in pdf["vec"]])
            parts = [[0]] * len(pdf)
            if router["model"] is not None and fits.any():
                x = np.stack([np.asarray(v, np.float64) for v in pdf["vec"][fits]])
                for i, p in zip(np.flatnonzero(fits), ranked_parts(router["model"], x)[:, :probes].tolist()):
                    parts[i] = p
            yield pdf.assign(parts=parts)

    return run


def _packed(key: list[str]):
    def run(pdf):
        import pandas as pd

        return pd.DataFrame({**{k: [int(pdf[k].iloc[0])] for k in key}, "data": [pickle.dumps(matrix(pdf.sort_values("id")))]})

    return run


def _reranked(k: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for asked, data in zip(pdf["asked"], pdf["data"]):
                (q_ids, q), (ids, x) = pickle.loads(asked), pickle.loads(data)
                out = []
                for at in range(0, len(q), 256):
                    s = q[at : at + 256] @ x.T
                    for j, row in enumerate(s):
                        i = q_ids[at + j]
                        row = np.where(ids == i, -np.inf, row)
                        least = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                        pick = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (ids != i) if np.isfinite(least) else ids != i)
                        exact = np.cumsum(x[pick] * q[at + j], axis=1)[:, -1]  # in the order of the components, whatever the block
                        top = np.lexsort((ids[pick], -exact))[:k]
                        out += zip([i] * len(top), ids[pick][top].tolist(), exact[top].tolist())
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _asked(whole: DataFrame, every: int) -> DataFrame:
    """The queries (see queries_of), with the number of rows that share their id."""
    own = whole.where(F.col("id") % every == 0)
    return own.groupBy("id").agg(F.min("vec").alias("vec"), F.count("*").alias("own"))


def enough(asked: DataFrame, counts: DataFrame, probes: int, k: int) -> DataFrame:
    """(id, vec, dim, parts): of all parts of a query by falling probability the first ``probes``, and as many more as it takes until they hold k rows besides its own, or none is left."""
    sizes = counts.groupBy("dim").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("n_of"))
    taken = lambda n, parts: F.struct(n.cast("long").alias("n"), parts.cast("int").alias("parts"))

    def take(s, part):
        full = (s["parts"] >= probes) & (s["n"] >= F.col("own") + k)
        return F.when(full, s).otherwise(taken(s["n"] + F.coalesce(F.element_at("n_of", part), F.lit(0)), s["parts"] + 1))

    found = asked.withColumn("dim", F.size("vec")).join(sizes, "dim")
    return found.select("id", "vec", "dim", F.slice("parts", 1, F.aggregate("parts", taken(F.lit(0), F.lit(0)), take)["parts"]).alias("parts"))


def nearest(rows: DataFrame, every: int = 20, k: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``, against all rows."""
    import numpy as np

    whole = usable(rows, vec_id, embedding, nonzero=True)
    rows_of = whole.count()
    parts = parts or parts_for(rows_of)
    some = whole.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if len(some):
        lengths = some["vec"].map(len)
        some = some[lengths == lengths.mode().iloc[0]].sort_values("id")
        router = learn(np.stack([np.asarray(v, np.float64) for v in some["vec"]]), parts, recall=recall, k=k)
    else:
        router = {"dim": 0, "probes": 1, "model": None}
    kind = "id long, vec array<double>{}, parts array<int>"
    placed, _ = written(whole.mapInPandas(_routed(router, 1), kind.format("")).select("id", "vec", F.size("vec").alias("dim"), F.get("parts", F.lit(0)).alias("part")))
    counts = placed.groupBy("dim", "part").agg(F.count("*").alias("n"))
    asked = enough(_asked(whole, every).mapInPandas(_routed(router), kind.format(", own long")), counts, router["probes"], k)
    # each part in shards of bounded size: one row a (length, part) comes back
    sized = counts.select("dim", "part", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"))
    index = placed.join(F.broadcast(sized) if parts <= 1024 else sized, ["dim", "part"]).withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int"))
    index = index.groupBy("dim", "part", "shard").applyInPandas(_packed(["dim", "part", "shard"]), "dim int, part int, shard int, data binary")
    n_blocks = shards_for(rows_of, every * query_rows)
    blocks = asked.select("id", "vec", "dim", F.explode("parts").alias("part"), lane(n_blocks).alias("block"))
    blocks = blocks.groupBy("dim", "part", "block").applyInPandas(_packed(["dim", "part", "block"]), "dim int, part int, block int, data binary").withColumnRenamed("data", "asked")
    meet = blocks.join(sized, ["dim", "part"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(index, ["dim", "part", "shard"])
    return best(meet.select("asked", "data").mapInPandas(_reranked(k), "query_id long, vec_id long, score double"), k)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found of every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
