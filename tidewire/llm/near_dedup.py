"""Near-duplicate detection: MinHash with many universal hash functions, banding, signature verification, confirmation on
full shingle sets, and connected components by alternating large-star and small-star.

Rows with equal sets form a class, which its least row represents; only representatives are compared. A bucket of a band
is never turned into all its pairs. Every bucket has a hub, the member that meets most others in all buckets, and each
member is compared with the hub. Confirmed links give components; around a hub all of whose members are in one component
nothing more can be learnt. Around the other hubs only links between components count:

- A member of whose shingles fewer than the threshold's share are found in any other component has no such link.
- A member that is alone at its pivot is paired with others around the hub. The pivot of a member is the hub that it is linked with and that meets most others, or itself; so a family of near
  copies has few pivots. If A and B are linked, their pivots P and Q differ by no more than d(A, P) + d(B, Q) and the
  difference that a link of A and B allows. Only pairs of pivots within the reach of their members are alive.
- Of a pair that is alive, members of the pivot with fewer members that reach far enough are compared with the other pivot.
  Where that links the components, nothing is left to do; elsewhere only those remain whose difference from that pivot the
  reach of its members can bridge, and those members of it that can.

Pairs, first of pivots around a hub and last of such members around a pivot, are found by how their sets differ from the
hub's. Two sets differ by |A| + |B| - 2 |A and B|, where A and B are their differences from the hub, so A and B must
have a number of shingles in common that follows from |A|, |B| and the reaches. With the shingles of differences in order
of how many have them, the prefixes of A and B that are one longer than what may be missing share a shingle. Those that
share none are never paired; those that do are paired if what is left behind the shared place can still suffice. Where no
shared shingle is needed, the pair is within reach by the triangle over the hub, and so alive.

The components are those that all pairs of all buckets would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, small_parts, staged
from .components import parents

ROWS, BANDS = 4, 28
#: A pair whose signatures agree in a smaller share than the threshold less this isn't looked at further. With 112
#: functions this is more than five standard deviations.
SLACK = 0.22

_MULTIPLY, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
_PRIME = np.uint64(0x100000001B3)
#: Rows of one key that a task should meet at most; a key with more is dealt over several tasks.
DEALT = 2048
#: Pairs of one text that a task should meet at most, so that tasks have about as many; its text is written once for each task.
PAIRED = 32
#: Bytes of both texts of the pairs that are compared at once.
PAIR_BYTES = 4_000_000
#: Tasks that a key of unknown weight is dealt over.
SALTS = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit hashes of word shingles for many texts at once. Words are what [^\\x20\\x09-\\x0D]+ matches after A-Z became
    lower case; with fewer words than a shingle takes, the whole sequence is one shingle."""

    def __init__(self, words: int):
        self.words = words
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 16)
            back = pow(int(_PRIME), -1, 1 << 64)
            self.power, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_PRIME, np.uint64(back)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shingles with repeats, how many each text has)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self._powers(len(data) + 1)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.diff(np.concatenate([[True], white]).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
        word = _mixed((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * _MULTIPLY)
        per_text = np.diff(np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes))]))
        k, n = self.words, len(word)
        full = np.maximum(per_text - k + 1, 0)
        short = (per_text > 0) & (per_text < k)
        counts = np.where(short, 1, full)
        first = np.cumsum(per_text) - per_text
        out_first = np.cumsum(counts) - counts
        at = np.repeat(first, counts) + np.arange(int(counts.sum())) - np.repeat(out_first, counts)
        own = np.repeat(np.minimum(per_text, k), counts)
        value = np.full(len(at), np.uint64(k), np.uint64)
        for i in range(k):
            use = own > i
            value = np.where(use, _mixed(value * _MULTIPLY + word[np.minimum(at + i, max(n - 1, 0))] + np.uint64(i)) if n else value, value)
        return value, counts


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of the hash functions x -> (a x + b) >> 32."""
    seeds = _mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _MULTIPLY)
    return seeds[:count] | np.uint64(1), seeds[count:]


def _runs(texts: list[str], chars: int = 400_000):
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


SIGNED = "row long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary, doc_id"


def _signed(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (mul, add) = Shingler(words), _hashes(bands * rows)
        for batch in small_parts(batches, 1):
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                value, counts = shingle(texts[a:b])
                sets = [np.unique(x) for x in np.split(value, np.cumsum(counts)[:-1])]
                sizes = np.array([len(x) for x in sets])
                some = sizes > 0
                flat = np.concatenate(sets)
                begin = (np.cumsum(sizes) - sizes)[some]
                least = np.zeros((len(sets), bands * rows), np.uint32)
                sums = np.zeros((2, len(sets)), np.uint64)
                if len(begin):
                    for j in range(bands * rows):
                        least[some, j] = np.minimum.reduceat((flat * mul[j] + add[j]) >> _SHIFT, begin)
                    for j, mix in enumerate((flat * np.uint64(0xD6E8FEB86659FD93), _mixed(flat + _MULTIPLY))):
                        sums[j, some] = np.add.reduceat(mix, begin)
                key = np.zeros((len(sets), bands), np.uint64)
                for j in range(rows):
                    key = _mixed(key * _MULTIPLY + least[:, j::rows].astype(np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(j == 0))
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)), pa.array(key[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a).cast(pa.int64()), pa.array(sizes), *(pa.array(s.view(np.int64)) for s in sums), keys, pa.array([x.tobytes() for x in least], pa.binary()), batch.column(2).slice(a, b - a)],
                    ["row", "n_shingles", "s1", "s2", "bands", "signature", "doc_id"],
                )

    return sign


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows row, text, component -> row, component, distinct shingles."""
        shingle = Shingler(words)
        for batch in small_parts(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _runs(texts):
                value, counts = shingle(texts[a:b])
                own = [np.unique(x) for x in np.split(value, np.cumsum(counts)[:-1])]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 2)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))], ["row", "component", "shingles"])

    return sets


def _set_pairs(batch: pa.RecordBatch, shingle: Shingler) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of both texts of each row a, b, ..., text_a, text_b; each text's set is made once a batch."""
    a, b = (batch.column(i).to_pylist() for i in ("a", "b"))
    texts: dict[int, str] = {}
    for ids, col in ((a, batch.column("text_a")), (b, batch.column("text_b"))):
        for at, name in enumerate(ids):
            if name not in texts:
                texts[name] = col[at].as_py() or ""
    names, sets = list(texts), {}
    for i, j in _runs(list(texts.values())):
        value, counts = shingle([texts[x] for x in names[i:j]])
        sets |= {x: np.unique(v) for x, v in zip(names[i:j], np.split(value, np.cumsum(counts)[:-1]), strict=True)}
    return ((sets[x], sets[y]) for x, y in zip(a, b, strict=True))


def _pair_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of pairs, whose last columns are text_a and text_b, cut by the bytes of both."""
    for batch in batches:
        yield from small_parts(iter([batch]), (batch.num_columns - 2, batch.num_columns - 1), PAIR_BYTES)


def _with(batch: pa.RecordBatch, less: int = 2, **more) -> pa.RecordBatch:
    """The batch without its last columns, less of them, and more columns."""
    n = batch.num_columns - less
    return pa.RecordBatch.from_arrays([*batch.columns[:n], *more.values()], [*batch.schema.names[:n], *more])


def _confirmed(words: int, num: int, den: int, share: float | None = None):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows a, b, ..., text_a, text_b -> those that are linked, without texts, and d, the shingles that one of them has. With a
        share, signature_a and signature_b stand before the texts, and where fewer of their places agree texts aren't looked at."""
        shingle = Shingler(words)
        for batch in _pair_parts(batches):
            if share is not None and batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in ("signature_a", "signature_b"))
                batch = batch.filter(pa.array((x == y).mean(axis=1) >= share))
            keep, apart = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            for i, (p, q) in enumerate(_set_pairs(batch, shingle)):
                if len(p) > len(q):
                    p, q = q, p
                if not len(p) or den * len(p) < num * len(q):
                    continue
                both = _common(p, q)
                keep[i] = den * both >= num * (len(p) + len(q) - both)
                apart[i] = len(p) + len(q) - 2 * both
            yield _with(batch, 2 if share is None else 4, d=pa.array(apart)).filter(pa.array(keep))

    return confirm


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """How many of the shingles p, no more than q, are in q."""
    at = np.searchsorted(q, p)
    return int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p)) if len(q) else 0


def _distances(words: int):
    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows a, b, ..., text_a, text_b -> the same without texts, sizes of both sets, shingles that one of them has."""
        shingle = Shingler(words)
        for batch in _pair_parts(batches):
            sizes = [(len(p), len(q), _common(*sorted((p, q), key=len))) for p, q in _set_pairs(batch, shingle)]
            n, m, both = (np.array([x[k] for x in sizes], np.int64) for k in range(3))
            yield _with(batch, na=pa.array(n), nb=pa.array(m), d=pa.array(n + m - 2 * both))

    return distances


def _differing(words: int):
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows a, b, ..., text_a, text_b -> the same without texts, shingles that one of them has."""
        shingle = Shingler(words)
        for batch in _pair_parts(batches):
            apart = [np.setxor1d(p, q, assume_unique=True) for p, q in _set_pairs(batch, shingle)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in apart])]).astype(np.int32)
            flat = np.concatenate(apart).view(np.int64) if apart else np.zeros(0, np.int64)
            yield _with(batch, apart=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return differ


def _both(pairs: DataFrame, of: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """pairs (a, b, ...) with cols of both as their last columns. Many pairs may have one b: with a column deals its rows are dealt
    over so many tasks; without, Spark's adaptive execution splits what is too large, as it does in a join of two shuffles."""
    rest = [c for c in pairs.columns if c != "deals"]
    side = lambda name: of.select(F.col("row").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in cols))
    by, hubs = ["b"], side("b")
    if "deals" in pairs.columns:
        hubs = pairs.groupBy("b").agg(F.max("deals").alias("deals")).join(hubs, "b").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")
        by, pairs = ["b", "deal"], pairs.withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")))
    return pairs.join(side("a"), "a").join(hubs, by).select(*rest, *(f"{c}_{x}" for c in cols for x in "ab"))


def _told(pairs: DataFrame, texts: DataFrame, how, adds: str, cols: tuple[str, ...] = ("text",)) -> DataFrame:
    """pairs (a, b, ...) with the columns adds that how finds from cols of both."""
    both = _both(pairs, texts, cols)
    return both.mapInArrow(how, T.StructType([*both.schema.fields[: -2 * len(cols)], *T.StructType.fromDDL(adds).fields]))


def _dealt(n: Column, each: int = DEALT) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / each)).cast("long")


def _links(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b, ...) that are linked, and the shingles d that one of them has. texts: row, signature, text."""
    return staged(_told(pairs, texts, _confirmed(words, num, den, num / den - SLACK), "d long", ("signature", "text")), "links")


def _classes(signed: DataFrame, given: DataFrame, words: int) -> DataFrame:
    """row, rep: the least row with the same set, confirmed on the sets themselves; rows with an empty set have none."""
    sums = ["n_shingles", "s1", "s2"]
    several = staged(signed.where("n_shingles > 0").groupBy(*sums).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1"), "several")
    pairs = signed.select("row", *sums).join(several, sums).where("row <> rep").select(F.col("row").alias("a"), F.col("rep").alias("b"), _dealt(F.col("k"), PAIRED).alias("deals"))
    same = staged(_told(pairs, given, _confirmed(words, 1, 1), "d long"), "classes")
    return same.select(F.col("a").alias("row"), F.col("b").alias("rep"))


def _members(reps: DataFrame) -> DataFrame:
    """row, n, hubs: rows in buckets of several and the hubs of their buckets, which stand among them too, each with how many it
    meets, counted by bucket (met), and its size (h)."""
    places = reps.select("row", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key"))
    sizes = places.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = staged(places.join(sizes, ["band", "key"]), "buckets")
    met = shared.groupBy("row").agg(F.sum("k").alias("met"))
    hubs = shared.join(met, "row").groupBy("band", "key").agg(F.max(F.struct("met", (-F.col("row")).alias("minus"), F.col("n").alias("h"))).alias("top"))
    around = shared.select("band", "key", "row", "n").join(hubs, ["band", "key"]).select("row", "n", F.struct((-F.col("top.minus")).alias("hub"), "top.met", "top.h").alias("hub"))
    # A row is in no more buckets than there are bands.
    of_row = around.groupBy("row").agg(F.first("n").alias("n"), F.collect_set("hub").alias("hubs"))
    return staged(of_row, "members")


def _open(members: DataFrame) -> DataFrame:
    """Those of members whose hub has several components around it."""
    several = members.groupBy("hub").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("hub")
    return members.join(several, "hub", "left_semi")


def _able(members: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Members (row, component, n, hub, ...) with enough shingles that another component has too, around hubs with several
    components."""
    of = members.groupBy("row").agg(F.first("component").alias("component"))
    sets = texts.join(of, "row").select("row", "text", "component").mapInArrow(_sets(words), "row long, component long, shingles array<long>")
    places = staged(sets.select("row", "component", F.explode("shingles").alias("s")), "places")
    # Written, so that the join is one of two shuffles, of which Spark splits what a frequent shingle makes large.
    own = staged(places.groupBy("s").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 = c2").select("s"), "own")
    alone = places.select("row", "s").join(own, "s", "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("alone"))
    return _open(members.join(alone, "row", "left").where(f"{den} * (n - coalesce(alone, 0)) >= {num} * n").drop("alone"))


def _sharing(things: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components in one group that may be within reach. things: grp, hub, row, component, lo and hi
    (sizes that a partner's must fit), reach (in parts of den + num), side: 0 and 2 are paired with others only, 0 with 1 and 2,
    2 with 0 and 1; 1 with all. A column deals has the tasks that the rows of a hub are dealt over."""
    total = den + num
    apart = staged(_told(things.withColumnsRenamed({"row": "a", "hub": "b"}), texts, _differing(words), "apart array<long>"), "apart")
    sized = apart.withColumnRenamed("a", "row").withColumn("v", F.size("apart").cast("long") * total - F.col("reach"))
    # The least v of another component of the group; deals: tasks that a key of the group is dealt over.
    lows = sized.groupBy("grp", "component").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("k"))
    lowest = lows.groupBy("grp").agg(F.min(F.struct("v", "component")).alias("low"), _dealt(F.sum("k")).alias("deals"))
    second = staged(lows.join(lowest, "grp").where("component <> low.component").groupBy("grp").agg(F.min("v").alias("next"), F.first("low").alias("low"), F.first("deals").alias("deals")), "lows")
    need = (F.col("v") + F.when(F.col("component") == F.col("low.component"), F.col("next")).otherwise(F.col("low.v"))).alias("need")
    met = sized.join(second, "grp").select("grp", "row", "component", "side", "lo", "hi", "v", need, "deals", F.pmod(F.xxhash64("row"), "deals").alias("deal"), "apart")
    met = staged(met, "described")
    told = met.select("grp", "row", "component", "deals", "deal", F.explode("apart").alias("s"))
    # A shingle counts if two components have it.
    often = told.groupBy("grp", "s").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("deals").alias("deals")).where("c1 < c2")
    often = often.select("grp", "s", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    own = told.join(often, ["grp", "s", "deal"]).groupBy("grp", "row").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("own"))
    own = met.drop("apart").join(own, ["grp", "row"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<struct<k:bigint,s:bigint>>"))).withColumn("left", F.size("own").cast("long"))
    must = F.greatest(F.lit(1), F.ceil(F.col("need") / (2 * total))).cast("long")
    own = own.withColumn("must", must).where("left >= must or need <= 0")
    # Where nothing need be shared, a place that all have stands for it.
    places = F.transform(F.slice("own", F.lit(1), F.greatest(F.lit(0), F.col("left") - F.col("must") + 1).cast("int")), lambda x, i: F.struct(x["s"].alias("s"), (F.col("left") - i).alias("rest")))
    free = F.when(F.col("need") <= 0, F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("rest")))).otherwise(F.array().cast("array<struct<s:bigint,rest:bigint>>"))
    prefix = staged(own.select("grp", "row", "component", "side", "lo", "hi", "v", "deals", "deal", F.explode(F.concat(places, free)).alias("x")).select("*", "x.s", "x.rest").drop("x"), "prefixes")
    # Only places that several components have can make pairs.
    used = prefix.groupBy("grp", "s").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("deals").alias("deals")).where("c1 < c2")
    used = used.select("grp", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"))
    prefix = prefix.join(used, ["grp", "s", "deal"], "left_semi")
    names = {"row": "b", "component": "c", "side": "over", "lo": "lo2", "hi": "hi2", "v": "w", "rest": "tail"}
    other = prefix.where("side > 0").drop("deal").withColumnsRenamed(names).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))).drop("deals")
    fits = F.expr(f"{den} * hi >= {num} * lo2 and {den} * hi2 >= {num} * lo and {2 * total} * least(rest, tail) >= v + w and component <> c and (side <> over or row < b)")
    return prefix.where("side < 2").join(other, ["grp", "s", "deal"]).where(fits).select(F.col("row").alias("a"), "b").distinct()


def _links_between(members: DataFrame, pivots: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links, possible): links (a, b) that are confirmed, and pairs (a, b) that may be linked besides, so that all of them join
    the components that links between members around one hub join. members: row, n, hub, met, component; pivots: row, pivot, d
    (rows without one are their own)."""
    total, less = den + num, den - num
    able = _able(members, texts, words, num, den).groupBy("row", "n", "component").agg(F.collect_list(F.struct("hub", "met")).alias("hubs")).join(pivots, "row", "left")
    able = able.select("row", "n", "component", "hubs", F.coalesce("pivot", "row").alias("pivot"), F.coalesce("d", F.lit(0)).alias("d")).withColumn("reach", total * F.col("d") + less * F.col("n"))
    rows = staged(able, "able")
    able, rows = rows.select(*(c for c in rows.columns if c != "hubs"), F.inline("hubs")), rows.drop("hubs")
    reach = staged(rows.groupBy(F.col("pivot").alias("p")).agg(F.max("reach").alias("reach"), F.first("component").alias("component"), F.count(F.lit(1)).alias("k")), "reach")
    # Pairs with a row that is alone at its pivot: by their differences from the hub.
    around = able.join(reach.select(F.col("p").alias("pivot"), "k"), "pivot")
    around = around.select("hub", "row", "component", F.col("n").alias("lo"), F.col("n").alias("hi"), (less * F.col("n")).alias("reach"), F.when(F.col("k") > 1, 0).otherwise(1).alias("side"), _dealt(F.col("met") / BANDS, PAIRED).alias("deals"))
    around = around.join(around.where("side = 1").select("hub").distinct(), "hub", "left_semi").select(F.struct(F.lit(False).alias("facing"), "hub").alias("grp"), *around.columns)
    # Pairs of rows at pivots with several.
    classes = able.join(reach.where("k > 1").select(F.col("p").alias("pivot")), "pivot", "left_semi").groupBy("hub", "pivot", "component").agg(F.max("reach").alias("reach"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    things = staged(_open(classes).select(F.col("hub").alias("grp"), "hub", F.col("pivot").alias("row"), "component", "lo", "hi", "reach", F.lit(1).alias("side")), "pivots-around")
    met = staged(_sharing(things, texts, words, num, den), "pivot-pairs") if not things.isEmpty() else None
    links = None
    if met is not None and not met.isEmpty():
        links, last = _facing(met, rows, reach, texts, words, num, den)
        around = around.unionByName(last)
    # What is around hubs and what faces pivots, in groups of their own.
    around = staged(around, "around-hubs")
    possible = around.select(F.col("row").alias("a"), F.col("hub").alias("b")).limit(0) if around.isEmpty() else staged(_sharing(around, texts, words, num, den), "possible")
    return possible.limit(0) if links is None else links, possible


def _facing(met: DataFrame, rows: DataFrame, reach: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """For pairs of pivots met (a, b): confirmed links (a, b) of pivots, or of their members with the other pivot; and of the
    members that may be linked besides, things for _sharing. rows: row, n, pivot, d, reach, component; reach: by pivot p."""
    total, less = den + num, den - num
    of = lambda name, tag: reach.select(F.col("p").alias(name), *(F.col(c).alias(f"{c}_{tag}") for c in ("reach", "component", "k")))
    linked = f"{total} * d <= {less} * (na + nb)"
    apart = _told(met, texts, _distances(words), "na long, nb long, d long")
    apart = staged(apart.join(of("a", "a"), "a").join(of("b", "b"), "b").where(f"{total} * d <= reach_a + reach_b"), "alive")
    # Of a pair that is alive, the members of the pivot with fewer (q) are compared with the other pivot (p).
    first = F.expr("k_a > k_b or k_a = k_b and a < b")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    ways = apart.where(f"not ({linked})").select(pick("a", "b").alias("p"), pick("b", "a").alias("q"), pick("reach_a", "reach_b").alias("over"), pick("component_a", "component_b").alias("c"), F.col("d").alias("gap"))
    salted = ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    facing = rows.withColumnsRenamed({"pivot": "q", "d": "own"}).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["q", "salt"]).where(f"reach + over >= {total} * gap")
    facing = staged(facing.select("row", "n", "component", "p", "q", "c", "over", "gap"), "facing")
    # A row has one pivot, so it faces another one once.
    told = staged(_told(facing.where("row <> q").withColumnsRenamed({"row": "a", "p": "b"}), texts, _distances(words), "na long, nb long, d long"), "facing-apart")
    links = staged(apart.where(linked).select("a", "b").unionByName(told.where(linked).select("a", "b")), "pivot-links")
    known = told.drop("gap", "na", "nb").withColumnsRenamed({"a": "row", "b": "p"}).unionByName(facing.where("row = q").withColumnRenamed("gap", "d"))
    # What the links joined needs no more; of the rest, those whose difference from p a member of p can bridge.
    edges = links.unionByName(rows.select(F.col("row").alias("a"), F.col("component").alias("b"))).unionByName(rows.select(F.col("pivot").alias("a"), F.col("component").alias("b")))
    joined = parents(edges)
    known = known.join(joined.select(F.col("node").alias("row"), F.col("component").alias("now")), "row", "left")
    known = known.join(joined.select(F.col("node").alias("p"), F.col("component").alias("then")), "p", "left").where("coalesce(now, row) <> coalesce(then, p)")
    rim = staged(known.withColumn("v", total * F.col("d") - less * F.col("n")).where("v <= over").select("p", "row", "component", "n", "v").distinct(), "rim")
    bridging = staged(rows.join(rim.groupBy(F.col("p").alias("pivot")).agg(F.min("v").alias("v")), "pivot").where("reach >= v and row <> pivot").withColumnRenamed("pivot", "p"), "bridging")
    group = F.struct(F.lit(True).alias("facing"), F.col("p").alias("hub")).alias("grp")
    side = lambda df, i: df.select(group, F.col("p").alias("hub"), "row", "component", F.col("n").alias("lo"), F.col("n").alias("hi"), (less * F.col("n")).alias("reach"), F.lit(i).alias("side"), F.lit(SALTS).cast("long").alias("deals"))
    return links, side(bridging, 0).unionByName(side(rim.join(bridging.select("p").distinct(), "p", "left_semi"), 2))


def near_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, row_col: str | None = None) -> DataFrame:
    """Per document: id_col, n_shingles long, component_id long, kept boolean, and row_col if it is given.

    Two documents are linked if den * common shingles >= num * shingles of either. component_id is the least id that a
    document reaches over links, itself included; kept marks the document with that id, and of rows that repeat the id
    one. A null text, or one without words, has an empty set and is linked with nothing. Very long texts are taken whole.
    Rows without an id are left out. An empty table gives an empty result. row_col names a long column that tells rows
    apart; without it ids do, or, where they repeat, numbers in a written copy. Other columns are not read.
    """
    given = keyed(docs, id_col, text_col, row_col)
    signed = staged(given.select("row", "text", "doc_id").mapInArrow(_signed(words, bands, rows), f"{SIGNED} {given.schema['doc_id'].dataType.simpleString()}"), "signed")
    classes = _classes(signed, given, words)
    members = _members(signed.where("n_shingles > 0").join(classes, "row", "left_anti"))
    texts = staged(given.select("row", "text").join(signed.select("row", "signature").join(members.select("row"), "row", "left_semi"), "row"), "bucket-texts")
    asked = members.select("row", "n", F.inline("hubs")).where(f"row <> hub and {den} * least(n, h) >= {num} * greatest(n, h)")
    links = _links(asked.select(F.col("row").alias("a"), F.col("hub").alias("b"), "met", _dealt(F.col("met") / bands, PAIRED).alias("deals")), texts, words, num, den)
    components = parents(links)
    named = members.join(components.withColumnRenamed("node", "row"), "row", "left").select("row", "n", F.coalesce("component", "row").alias("component"), F.inline("hubs"))
    open_ = staged(_open(named.drop("h")), "around")
    if not open_.isEmpty():
        pivots = links.groupBy(F.col("a").alias("row")).agg(F.max(F.struct("met", (-F.col("b")).alias("minus"), "d")).alias("top")).select("row", (-F.col("top.minus")).alias("pivot"), "top.d")
        between, possible = _links_between(open_, pivots, texts.drop("signature"), words, num, den)
        more = between.unionByName(_links(possible, texts, words, num, den).select("a", "b"))
        if not more.isEmpty():
            components = parents(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    of_row = signed.select("row", "doc_id", "n_shingles").join(classes, "row", "left").withColumn("rep", F.coalesce("rep", "row"))
    ended = staged(of_row.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("row", "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component")), "ended")
    first = staged(ended.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "firsts")
    out = ended.join(first, "component", "left").withColumn("first", F.coalesce("first", F.struct("doc_id", "row")))
    return out.select(*([F.col("row").alias(row_col)] if row_col else []), F.col("doc_id").cast("long").alias(id_col), "n_shingles", F.col("first.doc_id").cast("long").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))
