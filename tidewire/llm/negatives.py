"""Hard negatives of anchors by coordinate pruning of inner products, exact.

Rows are packed into shards where they lie, without a shuffle. Within a shard vectors are put in order of length and cut
into buckets; a bucket has one sorted list per coordinate of its vectors' directions. An anchor needs vectors of some
least score. Divided by its own and the bucket's greatest length, this is a least cosine: a bucket for which it exceeds one
is left out, and for each of the anchor's focus coordinates, its largest, it tells between which values a vector's
coordinate must lie, since the angle of two vectors is at least the difference of their angles to any axis. The candidates
are what lies in all these ranges: the shortest one is read from its list, the others are tested. Candidates are verified
by exact products of integers, and their scores raise what later buckets must reach.

That is done twice: for the best rows of an anchor's own label, its positives, from no least score on; and for the rows of
other labels that score between a share of a positive and the positive itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .topk import quantised

SHARD_ROWS, ANCHOR_ROWS, BUCKET_ROWS, FOCUS = 4096, 1024, 512, 4
#: What rounding can add to an angle, amply.
SLACK = 1e-7
LOWEST = np.iinfo(np.int64).min
_PACKED = "rows binary, ids binary, labels binary, width int, vectors binary"
_FACTS = ("anchor_row", "anchor_id", "place", "positive_id", "positive_score")


class Bucket:
    """Vectors of a shard that are alike in length; order[f] lists them by coordinate f of their direction, sorted[f] these values."""

    def __init__(self, members: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.members, self.least, self.most = members, float(lengths.min()), float(lengths.max())
        self.directions = np.ascontiguousarray((vectors / np.maximum(lengths, 1e-300)[:, None]).T)
        self.order = np.argsort(self.directions, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.directions, self.order, axis=1)

    def candidates(self, direction: np.ndarray, length: float, focus: np.ndarray, score: int) -> np.ndarray:
        """Members that may have at least this score with a vector of that direction and length."""
        other = self.most if score > 0 else self.least
        if score == LOWEST or length == 0 or other == 0:
            return self.members if score <= 0 else self.members[:0]
        cosine = score / (length * other)
        if cosine > 1 + SLACK:
            return self.members[:0]
        angle = np.arccos(np.clip(cosine, -1, 1)) + SLACK
        own = np.arccos(np.clip(direction[focus], -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + angle)) - SLACK, np.cos(np.maximum(0, own - angle)) + SLACK
        ranges = [(np.searchsorted(self.sorted[f], a, "left"), np.searchsorted(self.sorted[f], b, "right")) for f, a, b in zip(focus, low, high, strict=True)]
        first = min(range(len(focus)), key=lambda i: ranges[i][1] - ranges[i][0])
        found = self.order[focus[first]][slice(*ranges[first])]
        for i, f in enumerate(focus):
            if i != first and len(found):
                values = self.directions[f][found]
                found = found[(values >= low[i]) & (values <= high[i])]
        return self.members[found]


class Shard:
    """rows, ids, labels and vectors (int64, a row each), with their buckets from the longest vectors on."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bucket_rows: int = BUCKET_ROWS):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.buckets = [Bucket(m, vectors[m], lengths[m]) for m in (order[at : at + bucket_rows] for at in range(0, len(order), bucket_rows))]

    def search(self, query: np.ndarray, wanted: Callable, need: Callable, take: Callable, focus: int = FOCUS) -> None:
        """Goes through the buckets: take(members, scores) gets those of the candidates for the score need() that wanted holds for."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        direction = query / max(length, 1e-300)
        axes = np.argsort(-np.abs(direction), kind="stable")[:focus]
        for bucket in self.buckets:
            members = bucket.candidates(direction, length, axes, need())
            members = members[wanted(members)]
            if len(members):
                take(members, self.vectors[members] @ query)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def positives(shard: Shard, row: int, label: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows of the label, but for the row itself."""
    best: list[tuple[int, int]] = []

    def take(members: np.ndarray, scores: np.ndarray) -> None:
        top = members[_best(shard.ids[members], scores, k)]
        best[:] = sorted([*best, *zip((shard.vectors[top] @ query).tolist(), shard.ids[top].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]

    shard.search(query, lambda m: (shard.labels[m] == label) & (shard.rows[m] != row), lambda: best[-1][0] if len(best) == k else LOWEST, take)
    return best


def negatives(shard: Shard, label: int, query: np.ndarray, scores_of: list[int], k: int, num: int, den: int) -> list[list[tuple[int, int]]]:
    """For each positive's score p the k best (score, id) of other labels with num * p <= den * score <= den * p."""
    best: list[list[tuple[int, int]]] = [[] for _ in scores_of]
    live = [i for i, p in enumerate(scores_of) if p >= 0]
    least = {i: -(-num * scores_of[i] // den) for i in live}

    def take(members: np.ndarray, scores: np.ndarray) -> None:
        for i in live:
            fits = np.flatnonzero((scores >= least[i]) & (scores <= scores_of[i]))
            top = fits[_best(shard.ids[members[fits]], scores[fits], k)]
            best[i] = sorted([*best[i], *zip(scores[top].tolist(), shard.ids[members[top]].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
            if len(best[i]) == k:
                least[i] = best[i][-1][0]

    if live:
        shard.search(query, lambda m: shard.labels[m] != label, lambda: min(least.values()), take)
    return best


def _ints(values) -> np.ndarray:
    return np.asarray(values, np.int64)


def _packs(size: int, facts: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, vec_id, label, v (and for facts a list of places, ids and scores) -> packs of at most size rows."""

        def out(rows: pa.Table) -> pa.RecordBatch:
            vectors = rows["v"].combine_chunks()
            lens = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            width = int(lens.max())
            dense = np.zeros((len(lens), width), np.int64)
            dense[np.arange(width) < lens[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
            cols = [_ints(rows[c]).tobytes() for c in ("row", "vec_id", "label")]
            arrays, names = [*([c] for c in cols), [width], [dense.tobytes()]], ["rows", "ids", "labels", "width", "vectors"]
            more = [pa.array([rows["found"].to_pylist()], pa.list_(rows.schema.field("found").type))] if facts else []
            types = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([*(pa.array(a, t) for a, t in zip(arrays, types, strict=True)), *more], names + ["found"] * facts)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= size:
                table = pa.Table.from_batches(waiting)
                yield out(table.slice(0, size))
                waiting = [b for b in table.slice(size).to_batches() if b.num_rows]
        if waiting:
            yield out(pa.Table.from_batches(waiting))

    return pack


def _unpacked(ids, width: int, vectors) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(vectors, np.int64).reshape(len(names), width)


def _searched(ask: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pack of anchors (q_...) against a shard (s_...); the shard of the row before is kept if it is the same."""
        number, shard = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                r = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
                ids, vectors = _unpacked(r["s_ids"], r["s_width"], r["s_vectors"])
                if r["s_shard"] != number:
                    number, shard = r["s_shard"], Shard(np.frombuffer(r["s_rows"], np.int64), ids, np.frombuffer(r["s_labels"], np.int64), vectors)
                names, queries = _unpacked(r["q_ids"], r["q_width"], r["q_vectors"])
                wide = shard.vectors.shape[1]
                fit = queries[:, :wide] if queries.shape[1] >= wide else np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
                out = []
                for i, (row, label) in enumerate(zip(np.frombuffer(r["q_rows"], np.int64).tolist(), np.frombuffer(r["q_labels"], np.int64).tolist(), strict=True)):
                    out += ask(shard, row, int(names[i]), label, fit[i], r["q_found"][i] if "q_found" in r else None)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], [*_FACTS, "negative_id", "negative_score"])

    return run


def _grid(shards: DataFrame, packs: DataFrame, ask: Callable) -> DataFrame:
    """Every pack of anchors, the stated query set, meets every shard once: packs are sent to the shards' numbers."""
    numbers = shards.select("shard")
    left = packs.select(*(F.col(c).alias(f"q_{c}") for c in packs.columns)).withColumn("s_shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, numbers.count() - 1)))))
    right = shards.select(*(F.col(c).alias(f"s_{c}") for c in shards.columns))
    return right.hint("shuffle_hash").join(left, "s_shard").mapInArrow(_searched(ask), ", ".join(f"{c} long" for c in (*_FACTS, "negative_id", "negative_score")))


def _numbered(packed: DataFrame, what: str) -> DataFrame:
    """Packs in a written table, with a gapless number shard: the packs of each partition counted first, a row per partition."""
    at = F.spark_partition_id()
    kept = staged(packed.select(at.alias("part"), F.monotonically_increasing_id().alias("within"), *packed.columns), what)
    counts = sorted(kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("within").alias("first")).collect())
    spark, start, rows = kept.sparkSession, 0, []
    for part, n, first in counts:
        rows.append((part, start - first))
        start += n
    shift = F.broadcast(spark.createDataFrame(rows, "part int, shift long"))  # a row per partition
    return kept.join(shift, "part").withColumn("shard", (F.col("within") + F.col("shift")).cast("int")).drop("part", "within", "shift")


def mine(vectors: DataFrame, anchors: Column | str, positives_each: int = 5, k: int = 5, num: int = 80, den: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """Per anchor and positive the k best rows of other labels (all, if fewer) whose score n with the anchor has
    num * p <= den * n <= den * p, p being the positive's score: anchor_id, positive_id, rank int from 1, negative_id,
    positive_score, negative_score. Anchors are the rows that anchors, a condition on vec_id and label, holds for; an anchor's
    positives are the positives_each best other rows of its label. Scores are integer inner products of floor(256 x), higher
    ones first, ties by the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component take no part; a shorter vector counts as
    filled up with zeros. Of rows that repeat an id each is a row of its own, and an anchor that repeats one has its
    own results. A positive with a negative score has no negatives, as no score fits. Scores times den must fit 64 bits. An empty
    table gives an empty result; other columns are not read. Rows stay in their partitions; a task holds one shard and
    one pack of anchors.
    """
    picked = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col)).alias("v")).where("vec_id is not null and label is not null and v is not null")
    rows = staged(picked.withColumn("row", F.monotonically_increasing_id()), "vectors").select("row", "vec_id", "label", "v")
    shards = _numbered(rows.mapInArrow(_packs(shard_rows, False), _PACKED), "shards")
    asked = rows.where(anchors)

    def own_label(shard, row, name, label, query, _):
        return [(row, name, 0, i, s, 0, 0) for s, i in positives(shard, row, label, query, positives_each)]

    found = _grid(shards, asked.mapInArrow(_packs(anchor_rows, False), _PACKED), own_label)
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives_each)
    listed = best.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "positive_id", "positive_score"))).alias("found"))
    told = staged(asked.join(listed, asked["row"] == listed["anchor_row"]).select("row", "vec_id", "label", "v", "found"), "anchors")

    def other_labels(shard, row, name, label, query, given):
        each = negatives(shard, label, query, [p["positive_score"] for p in given], k, num, den)
        return [(row, name, p["place"], p["positive_id"], p["positive_score"], i, s) for p, own in zip(given, each, strict=True) for s, i in own]

    packs = told.mapInArrow(_packs(anchor_rows, True), f"{_PACKED}, found array<array<struct<place:long,positive_id:long,positive_score:long>>>")
    hard = _grid(shards, packs, other_labels)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
