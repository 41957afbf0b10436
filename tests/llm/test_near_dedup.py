"""Near-duplicate detection against brute force, with the awkward inputs."""

import random

from pyspark.sql import functions as F

from tidewire.llm import near_dedup as near_module
from tidewire.llm.components import connected_components
from tidewire.llm.near_dedup import near_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in WHITE:
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 30, 120]))]
        for _ in range(r.choice([1, 3, 12])):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((n * 7 % 501, r.choice([" ", "\t ", "\n"]).join(words).upper() if r.random() < 0.3 else " ".join(words)))
            n += 1
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "one two"), (904, "One  two"), (905, "one"), (906, "x " * 50_000)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, signature string, component long")
    for k, num in ((3, 85), (5, 80)):
        got = {tuple(x) for x in near_dedup(docs, words=k, num=num).collect()}
        want = brute(rows, k, num, 100)
        # Upper case beyond A-Z stays as it is, in both.
        assert got == want, (k, sorted(got - want)[:9], sorted(want - got)[:9])


def test_large_group_about_the_threshold(spark, monkeypatch):
    """Near copies of one text, each changed in up to ten places, their pairs on both sides of the threshold; and copies of
    a second text that is half the first. Every component is as brute force has it, and few pairs are looked at."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    first = [r.choice(vocabulary) for _ in range(150)]
    second = first[:75] + [r.choice(vocabulary) for _ in range(75)]
    rows = []
    for n in range(600):
        words = list(first if n % 3 else second)
        for _ in range(r.randint(1, 10)):
            words[r.randrange(150)] = r.choice(vocabulary)
        rows.append((n, " ".join(words)))
    looked = []
    sharing = near_module._sharing
    monkeypatch.setattr(near_module, "_sharing", lambda *a: looked.append(sharing(*a)) or looked[-1])
    got = {tuple(x) for x in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=85).collect()}
    want = brute(rows, 3, 85, 100)
    assert got == want and 20 < len({c for _, _, c, _ in want}) < 580
    assert sum(x.count() for x in looked) < 2 * len(rows)


def test_prefixes_find_what_hubs_dont(spark):
    """Differences from a hub, for every hub of a group: a pair that is linked, but not with the hub, shares a prefix."""
    r = random.Random(4)
    base = [f"w{r.randrange(4000)}" for _ in range(60)]
    kin = [list(base) for _ in range(8)]
    for words in kin:
        for at in r.sample(range(60), 4):
            words[at] = f"k{r.randrange(4000)}"
    rows = []
    for n in range(90):
        words = list(r.choice([*kin, base]))
        for at in r.sample(range(60), r.randint(0, 3)):
            words[at] = f"m{r.randrange(40)}"
        rows.append((n, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(58)} for i, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    hubs = (0, 17, 44)
    things = [(h, h, i, 1000 + i, len(sets[i]), len(sets[i]), 20 * len(sets[i]), 1) for h in hubs for i in sets]
    given = spark.createDataFrame(things, "grp long, hub long, row long, component long, lo long, hi long, reach long, side int")
    found = {(x.a, x.b) for x in near_module._sharing(given, spark.createDataFrame(rows, "row long, text string"), 3, 80, 100).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and linked(a, b)}
    assert want <= found and len(want) > 100


def families(r, n, share, size=120, own=1):
    """n texts of two families that share a part of their words, each with own words of its own."""
    vocabulary = [f"w{i}" for i in range(5000)]
    first = [r.choice(vocabulary) for _ in range(size)]
    cut = int(size * share)
    second = first[:cut] + [r.choice(vocabulary) for _ in range(size - cut)]
    rows = []
    for i in range(n):
        words = list(first if i % 2 else second)
        for k in range(own):
            words[r.randrange(size)] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    return rows


def test_families_by_pivots(spark):
    """Families that differ a little more or less than the threshold allows: components are those of all pairs."""
    seen = set()
    for seed, share, own in ((1, 0.87, 2), (2, 0.89, 1), (3, 0.9, 3), (4, 0.92, 5), (5, 0.6, 1)):
        rows = families(random.Random(seed), 120, share, own=own)
        got = {tuple(x) for x in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=80).collect()}
        want = brute(rows, 3, 80, 100)
        assert got == want, (seed, sorted(got - want)[:5], sorted(want - got)[:5])
        seen.add(len({c for _, _, c, _ in want}))
    assert len(seen) > 1


def test_families_are_not_paired(spark, monkeypatch):
    """What the join by prefixes examines, whether it keeps it or not, grows no faster than the documents."""
    tables = []
    real = near_module.staged
    monkeypatch.setattr(near_module, "staged", lambda df, what: (tables.append((what, real(df, what))) or tables[-1][1]))
    examined = {}
    for n in (500, 1000):
        tables.clear()
        near_dedup(spark.createDataFrame(families(random.Random(1), n, 0.86), "doc_id long, text string"), words=3, num=80).count()
        sides = [t.groupBy("grp", "s").agg(F.count_if(F.col("side") < 2).alias("x"), F.count_if(F.col("side") > 0).alias("y")).collect() for what, t in tables if what == "prefixes"]
        examined[n] = sum(k.x * k.y for t in sides for k in t)
    assert sides and examined[1000] <= 2.5 * examined[500] < 2.5 * 2000, examined


def test_few_rounds_of_shuffles(spark):
    """Families that are compared by pivots, with all steps: Spark runs a job for each shuffle, and each costs a task a partition."""
    spark.sparkContext.setJobGroup("near-jobs", "near_dedup")
    try:
        rows = families(random.Random(1), 120, 0.87, own=2)
        assert near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=80).count() == 120
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-jobs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < 200, jobs


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert near_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    assert sorted(map(tuple, near_dedup(spark.createDataFrame(rows, schema)).collect())) == [(1, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
