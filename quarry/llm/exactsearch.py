"""Exact top-k by integer inner product: ball-tree branch and bound per shard.

Method: candidates are dealt by a hash of their id over shards of about SHARD_ROWS rows; each shard becomes one ball tree
(one task, bounded memory).  Queries are packed in blocks.  A block opens a tree's leaves by their bound q.c + |q| r on the
inner product, the highest first, and leaves out those below the kth score so far of each of its queries, as it does what
lies below a node that is left out; the leaves that are opened together are one product of matrices.

Trees meet blocks in waves, of which each takes WAVE times as many trees as all before it: the kth scores of the waves before
are what a candidate must reach, so about WAVE * k candidates a query come out of a wave, however many trees it has.  In a
wave groups of trees and groups of blocks, both bounded, are dealt to cells by a cogroup on both group numbers; so neither
side is broadcast, and what is shuffled is each side once for each group of the other.

Defined results: components become floor(scale * x) in whole numbers; vectors that are null, empty or hold a null or
non-finite component take no part; vectors meet only vectors of the same length; rows that share the query's id are its own
and no candidates; of queries that share an id the smallest vector asks; every repeated candidate row counts; ties go to the
smaller id; empty tables give none; other columns are ignored.  Exact as long as scores fit in 63 bits: products are taken in
floating point only where |q| |c|, and with it every partial sum, is a whole number that the type holds.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import QUERY_ROWS, SHARD_ROWS, best, lane, queries_of, shards_for, usable
from .common import lean, table, written

LEAF = 128
SCALE = 1024
TOP = 10
#: Growth of the waves; trees and blocks of a cell at most; cells that a wave should have at least, if trees and blocks allow; leaves opened together; candidates kept before they are sorted.
WAVE, CELL_TREES, CELL_BLOCKS, CELLS, TOGETHER, PENDING = 16, 8, 128, 64, 8, 1 << 16


def build(ids, vecs) -> dict:
    """A ball tree over whole-number vectors: rows in leaf order and, by node, centre, radius, range and children."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], vecs[order]
    rows = np.arange(len(ids))
    centre, radius, span, kids = [], [], [], []

    def node(lo: int, hi: int) -> int:
        at = len(centre)
        v = vecs[rows[lo:hi]].astype(np.float64)
        c = v.mean(0)
        centre.append(c), radius.append(float(np.sqrt(((v - c) ** 2).sum(1).max()))), span.append((lo, hi)), kids.append(None)
        if hi - lo > LEAF and radius[at] > 0:
            far = v[((v - c) ** 2).sum(1).argmax()]
            other = v[((v - far) ** 2).sum(1).argmax()]
            rows[lo:hi] = rows[lo:hi][np.argsort(v @ (other - far), kind="stable")]
            mid = (lo + hi) // 2
            kids[at] = (node(lo, mid), node(mid, hi))
        return at

    node(0, len(ids))
    return {"ids": ids[rows], "vecs": _narrow(vecs[rows]), "centre": np.array(centre), "radius": np.array(radius), "span": span, "kids": kids}


def _narrow(ints):
    """The same whole numbers in as few bytes as they need."""
    import numpy as np

    low, high = ints.min(initial=0), ints.max(initial=0)
    return ints.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _longest(ints) -> float:
    import numpy as np

    return float(np.sqrt((ints.astype(np.float64) ** 2).sum(1).max(initial=0)))


def _exact_in(longest: float):
    """The fastest type in which sums of products up to this size are exact."""
    import numpy as np

    return np.float32 if longest * 1.001 < 2**24 else np.float64 if longest * 1.001 < 2**53 else np.int64


class Held:
    """The k best candidates so far of each query of a block, and what a further one must reach: the kth (score, id)."""

    def __init__(self, ids, vecs, k: int, floors: dict[int, tuple[int, int]]):
        import numpy as np

        self.ids, self.vecs, self.k, self.longest = ids, vecs, k, _longest(vecs)
        self.full = vecs.astype(np.float64)
        self.norms = np.sqrt((self.full**2).sum(1))
        self.has = np.array([i in floors for i in ids.tolist()], bool)
        self.floor, self.edge = (np.array([floors.get(i, (0, 0))[n] for i in ids.tolist()], np.int64) for n in (0, 1))
        self.kept, self.pending = [np.zeros(0, np.int64)] * 3, []

    def add(self, row, score, vec_id) -> None:
        fit = vec_id != self.ids[row]
        fit &= ~self.has[row] | (score > self.floor[row]) | ((score == self.floor[row]) & (vec_id < self.edge[row]))
        if fit.any():
            self.pending.append((row[fit], score[fit], vec_id[fit]))
        if sum(len(x[0]) for x in self.pending) > PENDING:
            self.settle()

    def settle(self) -> None:
        import numpy as np

        if not self.pending:
            return
        row, score, vec_id = (np.concatenate(x) for x in zip(self.kept, *self.pending))
        order = np.lexsort((vec_id, -score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]], self.edge[row[last]], self.has[row[last]] = score[last], vec_id[last], True
        top = place < self.k
        self.kept, self.pending = [row[top], score[top], vec_id[top]], []


def search(tree: dict, held: Held) -> None:
    """Puts the candidates of a tree into held."""
    import numpy as np

    centre, radius = tree["centre"], tree["radius"]
    far = np.sqrt((centre**2).sum(1)) + radius
    # by node and query; rounding may not hide a node
    bound = centre @ held.full.T + radius[:, None] * held.norms + 1e-9 * far[:, None] * held.norms + 1e-6
    for at, kids in enumerate(tree["kids"]):
        for kid in kids or ():
            np.minimum(bound[kid], bound[at], out=bound[kid])
    leaves = np.array([at for at, kids in enumerate(tree["kids"]) if not kids])
    leaves = leaves[np.argsort(-bound[leaves].max(1), kind="stable")]
    kind = _exact_in(held.longest * tree["longest"])
    if kind not in tree["in"]:
        tree["in"][kind] = tree["vecs"].astype(kind)
    vecs = tree["in"][kind]
    own = held.vecs.astype(kind)
    for at in range(0, len(leaves), TOGETHER):
        some = leaves[at : at + TOGETHER]
        rows = np.flatnonzero(~held.has | (bound[some] >= held.floor).any(0))
        if not len(rows):
            continue
        cols = np.concatenate([np.arange(*tree["span"][leaf]) for leaf in some])
        scores, ids = own[rows] @ vecs[cols].T, tree["ids"][cols]
        new = ~held.has[rows]
        if new.any():  # without a kth score yet: the k best of these, and what ties with them
            asked, got = rows[new], scores[new]
            mine = ids == held.ids[asked][:, None]
            got[mine] = np.iinfo(np.int64).min
            hit = ~mine
            if got.shape[1] > held.k:
                hit &= got >= np.partition(got, -held.k, axis=1)[:, -held.k :][:, :1]
            r, c = np.nonzero(hit)
            held.add(asked[r], got[r, c].astype(np.int64), ids[c])
            held.settle()
        if not new.all():
            asked, got = (rows, scores) if not new.any() else (rows[~new], scores[~new])
            r, c = np.nonzero(got >= held.floor[asked].astype(kind)[:, None])
            held.add(asked[r], got[r, c].astype(np.int64), ids[c])
    held.settle()


def _rows(t: pa.Table):
    """ids and whole-number vectors of rows (id, ints) of one length."""
    ids, ints = (t.column(c).combine_chunks() for c in ("id", "ints"))
    return ids.to_numpy(), ints.flatten().to_numpy().reshape(len(ids), -1)


def _tree(t: pa.Table) -> pa.Table:
    lean()
    return pa.table({"dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "tree": [pickle.dumps(build(*_rows(t)))]})


def _block(t: pa.Table) -> pa.Table:
    lean()
    ids, vecs = _rows(t.sort_by("id"))
    return pa.table({"dim": t.column("dim")[:1], "block": t.column("block")[:1], "queries": [pickle.dumps((ids, _narrow(vecs)))]})


def _cell(k: int):
    def run(blocks: pa.Table, trees: pa.Table) -> pa.Table:
        import numpy as np

        lean()
        opened = []
        for x in trees.column("tree"):
            opened.append(tree := pickle.loads(x.as_buffer()))
            tree |= {"longest": _longest(tree["vecs"]), "in": {}}
        out = []
        for queries, floors in zip(blocks.column("queries"), blocks.column("floors")):
            held = Held(*pickle.loads(queries.as_buffer()), k, {f["query_id"]: (f["score"], f["vec_id"]) for f in floors.as_py() or ()})
            for tree in opened:
                search(tree, held)
            row, score, vec_id = held.kept
            out.append((held.ids[row], vec_id, score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def _waves(shards: int) -> list[tuple[int, int]]:
    """Ranges of shard numbers: the first, then WAVE times as many as before."""
    cuts = [0, 1]
    while cuts[-1] < shards:
        cuts.append(min(cuts[-1] * WAVE, shards))
    return list(zip(cuts, cuts[1:]))


def _groups(n_trees: int, n_blocks: int) -> tuple[int, int]:
    """Trees and blocks of a cell: as many as may be, unless there would be few cells."""
    trees = max(1, min(CELL_TREES, n_trees // CELLS))
    return trees, max(1, min(CELL_BLOCKS, n_blocks * -(-n_trees // trees) // CELLS))


def top_inner_products(rows: DataFrame, every: int = 100, k: int = TOP, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores for each row whose id is divisible by ``every``, against all rows."""
    whole = usable(rows, vec_id, embedding)
    n = rows.count()  # an upper bound, as good for sizes
    shards, n_blocks = shards_for(n, shard_rows), shards_for(n, every * query_rows)
    ints = F.transform("vec", lambda x: F.floor(x * scale))
    made = whole.select("id", ints.alias("ints"), F.size("vec").alias("dim"), lane(shards).alias("shard"))
    trees, _ = written(made.groupBy("dim", "shard").applyInArrow(_tree, "dim int, shard int, tree binary"))
    asked = queries_of(whole, every).select("id", ints.alias("ints"), F.size("vec").alias("dim"), lane(n_blocks).alias("block"))
    blocks, _ = written(asked.groupBy("dim", "block").applyInArrow(_block, "dim int, block int, queries binary"))
    held = None
    for lo, hi in _waves(shards):
        if held is None:
            known = blocks.withColumn("floors", F.lit(None).cast("array<struct<query_id:bigint,score:bigint,vec_id:bigint>>"))
        else:
            held, _ = written(held)
            floors = held.where(F.col("rank") == k).withColumnRenamed("query_id", "id").groupBy(lane(n_blocks).alias("block")).agg(F.collect_list(F.struct(F.col("id").alias("query_id"), "score", "vec_id")).alias("floors"))
            known = blocks.join(floors, "block", "left")
        per_cell, per_side = _groups(hi - lo, n_blocks)
        tree_group, block_group = F.floor((F.col("shard") - lo) / per_cell).cast("int"), F.floor(F.col("block") / per_side).cast("int")
        every_group = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cells = known.select("dim", block_group.alias("h"), every_group(-(-(hi - lo) // per_cell)).alias("g"), "queries", "floors").groupBy("dim", "g", "h")
        cells = cells.cogroup(trees.where(F.col("shard").between(lo, hi - 1)).select("dim", tree_group.alias("g"), every_group(-(-n_blocks // per_side)).alias("h"), "tree").groupBy("dim", "g", "h"))
        found = cells.applyInArrow(_cell(k), "query_id long, vec_id long, score long")
        held = best(found if held is None else found.unionByName(held.drop("rank")), k)
    return held


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector."""
    return top_inner_products(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.ints, c.ints)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
