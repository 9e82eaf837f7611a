"""Toxicity: a counterfactual-regularised linear classifier.

Method: logistic regression over the presence of words and word beginnings.  In every labelled document's sentences that
mention a group, the group's name is swapped for others of its list; the training loss adds the squared change of the
document's logit, so a group's name alone can't move the score, and neutral mentions aren't taken for toxic ones.

Bounds: the classifier is fitted on at most MAX_LABELLED labelled documents (by a hash of doc_id, one text each: the least
where an id repeats; the ids are broadcast to the scan of documents, so only sampled texts are shuffled).  Its features are
all those of that sample whose share among toxic rows departs from the mean, up or down, by more than the largest departure
that so many chance features would show, sqrt(2 ln m) standard errors; they are counted on the executors.  The ridge penalty
is the one of PENALTIES with the least loss in cross-validation over the same sample.  Scoring reads every whole text.  Label rows whose crc32(doc_id as text) mod 3 is
1 are held out and never learned from.  Doc_id, source, lang and labels are no inputs of a score.

Defined results: null and empty texts, like all without a known feature, get the share of toxic labels; repeated rows are scored each;
where one doc_id has several labels, toxic wins; null labels are ignored; without labels of both kinds all scores are the
smoothed share of toxic labels; an empty table gives an empty table; output columns replace columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Own, removed, table, written

MAX_LABELLED = 16384
MIN_ROWS = 3
PENALTIES = (1e-6, 1e-5, 1e-4)
FOLDS = 3
PREFIXES = (4, 5)
THRESHOLD = 0.7
#: Names of groups that may stand for each other in a sentence.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "blind", "deaf", "elderly", "young"),
)

_WORDS = re.compile(r"\w+")
_SENTENCES = re.compile(r"[^.!?\n]+[.!?\n]*")


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """Words, and their beginnings marked by ^."""
    found = set(words)
    for k in PREFIXES:
        found.update("^" + w[:k] for w in words if len(w) >= k)
    return found


def swapped(text: str, groups) -> list[str]:
    """The text with each mentioned group, one at a time, swapped for each other of its list in the sentences that mention it."""
    other = {t: [u for u in g if u != t] for g in groups for t in g}
    mentioned = sorted(words_of(text) & other.keys())
    out = []
    for term in mentioned:
        whole = re.compile(rf"\b{re.escape(term)}\b", re.IGNORECASE)
        sentences = _SENTENCES.findall(text)
        for to in other[term]:
            out.append("".join(whole.sub(to, s) for s in sentences))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()
    toxic: Counter = Counter()
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = features_of(words_of(text))
            n.update(found)
            if y:
                toxic.update(found)
        if len(n) > 500_000:  # what one task holds stays bounded; the sums meet in the aggregate
            yield _sums(n, toxic)
            n, toxic = Counter(), Counter()
    yield _sums(n, toxic)


def _sums(n: Counter, toxic: Counter) -> pa.RecordBatch:
    keys = list(n)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], names=["feature", "n", "toxic"])


def _examples(place: dict[str, int], groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda text: sorted(place[f] for f in features_of(words_of(text)) if f in place)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            own = [at(t) for t in texts]
            # of a swap only what it changes: the features that come or go
            swaps = [[sorted({*x} ^ {*at(s)}) for s in swapped(t, groups)] for t, x in zip(texts, own)]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(swaps, pa.list_(pa.list_(pa.int32())))],
                names=["toxic", "h", "x", "swaps"],
            )

    return run


def fit(rows: list[tuple[int, list[int], list[list[int]]]], strength: list[float], penalty: float = 1.0, l2: float = 1e-5, steps: int = 500):
    """Weights and intercept for rows (toxic, features, features that each swap brings or takes), by Adam over all rows.

    The intercept stays at the log odds of the (smoothed) share of toxic rows, so a text without known features gets that share.
    strength: how well each feature is supported, 0 to 1; a weight's ridge penalty is divided by its square, so that rare features explain little.
    """
    import numpy as np

    n_features, s2 = len(strength), np.array(strength, float) ** 2

    y = np.array([r[0] for r in rows], float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    w, c = np.zeros(n_features), float(np.log(share / (1 - share)))
    if n_features == 0 or y.min(initial=1) == y.max(initial=0):
        return w, c
    lens = np.array([len(r[1]) for r in rows])
    doc, col = np.repeat(np.arange(len(rows)), lens), np.fromiter((j for r in rows for j in r[1]), int, int(lens.sum()))
    pair_col, pair_sign, pair_id, pairs = [], [], [], 0
    for _, x, swaps in rows:
        own = set(x)
        for s in swaps:
            for j in s:
                pair_col.append(j), pair_sign.append(1.0 if j in own else -1.0), pair_id.append(pairs)
            pairs += 1
    pc, ps, pi = np.array(pair_col, int), np.array(pair_sign), np.array(pair_id, int)
    m, v = np.zeros(n_features), np.zeros(n_features)
    for t in range(1, steps + 1):
        z = np.bincount(doc, w[col], len(rows)) + c
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gw = np.bincount(col, g[doc], n_features) + 2 * l2 * w / s2
        if pairs:
            d = np.bincount(pi, ps * w[pc], pairs)
            gw += 2 * penalty * np.bincount(pc, ps * d[pi], n_features) / pairs
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w, c


def chosen_penalty(rows: list[tuple[int, list[int], list[list[int]]]], folds: list[int], strength: list[float], penalty: float) -> float:
    """The ridge penalty of PENALTIES with the least log loss over left-out folds of the learning rows; the larger one on ties."""
    import numpy as np

    loss = {}
    for l2 in PENALTIES:
        loss[l2] = 0.0
        for k in range(FOLDS):
            w, c = fit([r for r, f in zip(rows, folds) if f != k], strength, penalty, l2, 150)
            for (y, x, _), f in zip(rows, folds):
                if f == k:
                    z = float(w[x].sum()) + c
                    loss[l2] += float(np.logaddexp(0, -z if y else z))
    return min(PENALTIES, key=lambda l2: (loss[l2], -l2))


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", groups=GROUPS, penalty: float = 1.0, max_labelled: int = MAX_LABELLED, label_id: str | None = None) -> tuple[dict[str, float], float]:
    """The weight of each feature and the intercept."""
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    labels = labels.select(F.col(f"`{label_id or doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label"))
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("label").cast("int").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)  # so a broadcast of at most that many rows
    found = docs.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).groupBy("__id").agg(F.min(F.coalesce(F.col("text"), F.lit(""))).alias("text"), F.max("__y").alias("toxic"))
    sample, path = written(found.select("text", "toxic", F.xxhash64("text").alias("h")))
    counts = sample.mapInArrow(_counted, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    size = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = size[1] / max(size[0], 1)
    departs = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(max(share * (1 - share), 1e-9)))
    counts = counts.where(F.col("n") >= MIN_ROWS).withColumn("z", departs)
    limit = math.sqrt(2 * math.log(max(counts.count(), 2)))
    found = counts.where(F.abs("z") > limit).orderBy(F.desc(F.abs("z")), "feature").select("feature", "z").collect()
    place = {r.feature: i for i, r in enumerate(found)}
    rows = sample.mapInArrow(_examples(place, groups), "toxic int, h long, x array<int>, swaps array<array<int>>").toArrow().to_pylist()
    removed(docs.sparkSession, path)
    rows.sort(key=lambda r: (r["h"], r["toxic"], r["x"]))
    examples, strength = [(r["toxic"], r["x"], r["swaps"]) for r in rows], [abs(r.z / found[0].z) for r in found]
    l2 = chosen_penalty(examples, [r["h"] % FOLDS for r in rows], strength, penalty)
    w, c = fit(examples, strength, penalty, l2)
    return {f: float(w[i]) for f, i in place.items()}, float(c)


def _scored(weights: dict[str, float], intercept: float, names: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import exp, fsum

        known = set(weights)
        for b in batches:
            scores = []
            for text in b.column(0).to_pylist():
                z = fsum(weights[f] for f in features_of(words_of(text)) & known) + intercept
                scores.append(1 / (1 + exp(-max(-60.0, min(60.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[*names, "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """docs' columns (or those in keep) with held_out, score and predicted."""
    own = Own(docs, keep, ["held_out", "score", "predicted"])
    weights, intercept = learned(own.rows, labels, own.name(text), own.name(doc_id), **({"label_id": doc_id} | fitting))
    rows = own.rows.select(own.at(text).alias("__text"), *own.columns, held_out(own.at(doc_id)).alias("held_out"))
    schema = T.StructType([*rows.schema[1:], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    done = rows.mapInArrow(_scored(weights, intercept, [*own.columns, "held_out"], threshold), schema)
    return own.restored(done, "held_out", "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
