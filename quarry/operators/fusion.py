"""Rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: DataFrame, limit: int = 10, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Weighted reciprocal rank fusion of rows (list_idx, rank from 1, id, payload, weight): a group by id.

    The first payload seen stays; an id repeated in a list scores each time; rows without id only consume a rank.
    """
    fused = lists.where("id is not null").groupBy("id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(k) + F.col("rank"))), digits).alias("score"),
        F.min_by("payload", F.struct("list_idx", "rank")).alias("payload"),
        F.sort_array(F.collect_set("list_idx")).alias("sources"),
    )
    top = fused.orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("fusion_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def ranked(rows: DataFrame, list_idx: int, weight: float, order: list[Column]) -> DataFrame:
    """A scored list (id, payload, ...) as fusion input."""
    return rows.select("id", "payload", F.lit(list_idx).alias("list_idx"), F.lit(float(weight)).alias("weight"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def min_max(score: Column, over: Window) -> Column:
    """Scores scaled to 0..1 within a result set; 0.5 where all are equal."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.5))


def blended(rerank: Column, original: Column, over: Window) -> Column:
    return F.lit(0.7) * min_max(rerank, over) + F.lit(0.3) * F.when(original > 1, F.least(original / 10, F.lit(1.0))).otherwise(original)


def _mmr(k: int, weight: float):
    def run(pdf):
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        sets = [set((t or "").lower().split()) for t in pdf["text"]]
        picked: list[int] = [0] if len(pdf) else []
        while len(picked) < min(k, len(pdf)):
            best, best_value = -1, float("-inf")
            for i in range(len(pdf)):
                if i in picked:
                    continue
                near = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 0.0) for j in picked)
                value = weight * pdf["score"][i] - (1 - weight) * max(near, 0.0)
                if value > best_value:
                    best, best_value = i, value
            picked.append(best)
        out = pdf.iloc[picked].copy()
        out["position"] = range(1, len(picked) + 1)
        return out[["query_id", "position", "id", "score"]]

    return run


def mmr(results: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance of each query's result list, which its search bounds: greedy, so one group a query in pandas, k passes over it.  A null text is like no other."""
    return results.select("query_id", "id", "score", "text").groupBy("query_id").applyInPandas(_mmr(k, weight), "query_id long, position int, id long, score double")
