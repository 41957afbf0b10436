"""Exact top-k search by MaxScore over integer vectors.

Each component is a query term. Vectors are dealt into shards; a shard keeps for every term the greatest and the least of
its values, found once when the shard is opened, and its postings block by block as a column of values. For a query, a
term's impact is its product less the least one in the shard, so impacts are never negative and their bounds add up.
Terms are taken in falling order of bound: the essential ones are those without which a vector could still reach the k-th
score so far; their postings are traversed for all vectors of a block, the other terms are probed only while the vector's
score plus the bounds left can compete. Shards are merged by score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARD_ROWS = 4096
QUERY_BLOCK = 1024
POSTING_BLOCK = 2048


def quantised(vector) -> F.Column:
    """floor(256 x) per component, or null if the vector is null or holds a null or non-finite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


class Shard:
    """rows, ids and values (int64, a row per vector) of a shard, and the bounds of each term's values."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.rows, self.ids = rows, ids
        self.postings = [np.ascontiguousarray(values[at : at + POSTING_BLOCK].T) for at in range(0, len(ids), POSTING_BLOCK)]
        self.most, self.least = values.max(axis=0), values.min(axis=0)

    def best(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) for a query, but for the row own; ties to the smaller id."""
        products = self.most * query, self.least * query
        least, bound = np.minimum(*products), np.abs(products[0] - products[1])
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # rest[i]: bounds of the terms from the i-th on
        floor = int(least.sum())
        best: list[tuple[int, int]] = []
        for n, block in enumerate(self.postings):
            at = n * POSTING_BLOCK
            names, live = self.ids[at : at + block.shape[1]], np.flatnonzero(self.rows[at : at + block.shape[1]] != own)
            full = len(best) == k
            need = best[-1][0] - floor if full else 0  # what the impacts must add up to; an equal score may win by its id
            essential = min(len(order), max(1, int(np.searchsorted(-rest, -need, side="right")))) if full else len(order)
            terms = order[:essential]
            score = (query[terms] @ block[terms])[live] - int(least[terms].sum())
            for i in range(essential, len(order)):
                keep = score + rest[i] >= need
                live, score = live[keep], score[keep]
                if not len(live):
                    break
                score = score + block[order[i], live] * query[order[i]] - least[order[i]]
            if len(live):
                total = score + floor
                top = np.lexsort((names[live], -total))[:k]
                best = sorted([*best, *((int(total[j]), int(names[live[j]])) for j in top)], key=lambda x: (-x[0], x[1]))[:k]
        return best


def _search(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One block of queries against one shard."""
        out = []
        if len(left) and len(right):
            wide = max(right["v"].map(len).max(), left["v"].map(len).max())
            fit = lambda v: np.pad(np.asarray(v, dtype=np.int64), (0, wide - len(v)))
            right = right.sort_values("vec_id", kind="stable")
            shard = Shard(right["row"].to_numpy(), right["vec_id"].to_numpy(), np.stack([fit(v) for v in right["v"]]))
            for row, q, v in zip(left["row"], left["vec_id"], left["v"], strict=True):
                out += [(row, q, name, score) for score, name in shard.best(fit(v), int(row), k)]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")

    return search


def top_k(vectors: DataFrame, asks: Column | str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best vectors of each query: query_id long, rank int from 1, vec_id long, score long (integer inner product of
    floor(256 x)); ties go to the smaller id; all, if there are fewer. Queries are the rows of vectors that asks, a
    condition on vec_id, holds for; candidates are all rows but the query's own.

    Vectors that are null, hold a null or non-finite component or have no id take no part, as queries or candidates. A
    shorter vector counts as filled up with zeros. Of rows that repeat an id, each is a candidate and a query of its own,
    and one is a candidate for the other; each has k rows in the result. Scores must fit 64 bits. An empty table gives an
    empty result. Other columns are not read. Each block of queries meets each shard once; a task holds one shard and one
    block.
    """
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    rows = staged(picked.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(asks)
    shards, blocks = (-(-max(1, df.count()) // size) for df, size in ((rows, shard_rows), (asked, query_block)))
    deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    left = asked.withColumn("block", deal(blocks, 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("shard", deal(shards, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(_search(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
