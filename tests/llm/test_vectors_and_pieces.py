"""Pieces, hard negatives and centroids against brute force and the library, on awkward small inputs."""

import hashlib
import random

import numpy as np
import pytest

from tidewire.llm import centroids, negatives, pieces
from tidewire.llm.queries import _tokenizer

TEXTS = [
    None, "", " ", "one", " one ", "a  b   c", "a\nb\n\nc", "x" * 9000, "the" * 3000, "ab " * 20_000, " " * 1000 + "y" + " " * 33, "▁▁ x▁", "<s></s><unk><0x0A>", "\0é́ﬁ日本\U0001F600ＡＢ\tz",
    "One  two\n\nthree's 1,234 été", "日本語のテキスト" * 50,
]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_tokenizer("piece_bpe_32k.model"))


def test_pieces(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "lost", "c"), (99, "twice", "c"), (99, "twice", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    model, sp = _tokenizer("piece_bpe_32k.model"), library()
    got = sorted((r.doc_id, list(r.ids), r.text) for r in pieces.decode(pieces.encode(df, model), model).collect())
    want = []
    for i, t, _ in rows:
        if i is not None:
            ids = sp.encode(t or "", add_eos=True)
            want.append((i, ids, sp.decode(ids)))
    assert got == sorted(want)
    assert pieces.encode(df.limit(0), model).count() == 0
    shown = pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), model)
    assert sorted((r.doc_id, r.text) for r in shown.collect()) == [(1, None), (2, "")]


@pytest.mark.parametrize("long", [0, 12, 4096])
def test_merge_rounds(long, monkeypatch):
    """Every kind of text as the library merges it, by rounds and by the queue."""
    monkeypatch.setattr(pieces, "LONG", long)
    encoder, sp, r = pieces.PieceEncoder(_tokenizer("piece_bpe_32k.model")), library(), random.Random(long)
    letters = ["abcdefghij ", "etaoin shrdlu", "   a▁\n", "日本の語一二三 ", "0123456789,. ", "éßüöñ́  ", "()[]{}=+-*/;:'\"\\ \n\t", "the"]
    texts = ["".join(r.choice(letters[n % len(letters)]) for _ in range(r.randrange(80))) for n in range(800)]
    flat, counts = encoder.ids(texts)
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [sp.encode(t) for t in texts]


def test_decode_of_any_ids():
    words, sp, r = pieces.Vocabulary(_tokenizer("piece_bpe_32k.model")), library(), random.Random(3)
    for _ in range(500):
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(32000), 28705]) for _ in range(r.randrange(9))]
        assert words.text(np.array(ids, np.int64)) == sp.decode(ids)


def _vectors(r, n, dims):
    rows = [(int(i), [float(x) for x in r.normal(size=dims) * r.choice([0.2, 1, 3])], int(r.integers(0, 3)), "v", 1) for i in range(n)]
    rows += [(1000 + i, [0.25] * dims, i % 2, "v", 1) for i in range(9)] + [(1100, [0.0] * dims, 1, "v", 1), (1200, [0.5] * (dims - 1), 0, "v", 1), (50, [0.75] * dims, 2, "v", 1), (50, [0.75] * dims, 2, "v", 1)]
    return [*rows, (1300, None, 1, "v", 1), (1400, [float("nan")] * dims, 1, "v", 1), (1500, [None, *[1.0] * (dims - 1)], 1, "v", 1), (1600, [1.0] * dims, None, "v", 1), (None, [1.0] * dims, 1, "v", 1)]


VECTORS = "vec_id long, embedding array<float>, label int, row string, score int"


def _whole(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v] if v is not None and all(x is not None and np.isfinite(x) for x in v) else None


def test_negatives(spark):
    rows = _vectors(np.random.default_rng(4), 300, 6)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(map(tuple, negatives.mine(df, "vec_id % 50 = 0", positives_each=3, k=4, shard_rows=64, anchor_rows=5).collect()))
    own = [(i, label, _whole(v, 256)) for i, v, label, *_ in rows if i is not None and label is not None and _whole(v, 256)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = []
    for at, (i, label, v) in enumerate(own):
        if i % 50 == 0:
            scored = sorted((-score(v, w), j, other) for n, (j, other, w) in enumerate(own) if n != at)
            for s, j, _ in [x for x in scored if x[2] == label][:3]:
                fits = [(j2, -s2) for s2, j2, other in scored if other != label and 80 * -s <= 100 * -s2 <= 100 * -s][:4]
                want += [(i, j, n + 1, j2, -s, s2) for n, (j2, s2) in enumerate(fits)]
    assert got == sorted(want) and len(got) > 20
    assert negatives.mine(df.limit(0), "vec_id % 50 = 0").count() == 0
    assert negatives.mine(df, "vec_id = -1").count() == 0


def test_ranges_leave_candidates_out():
    """On vectors of uneven coordinates the ranges leave most out, and nothing that has the score."""
    r = np.random.default_rng(8)
    vectors = np.floor(r.normal(size=(4096, 16)) * 256 / np.arange(1, 17) ** 1.5).astype(np.int64)
    shard = negatives.Shard(np.arange(4096), np.arange(4096), np.zeros(4096, np.int64), vectors)
    for own in range(0, 4096, 512):
        q, scores, seen = vectors[own], vectors @ vectors[own], []
        least = int(np.sort(scores)[-20])
        shard.search(q, lambda m: np.ones(len(m), bool), lambda: least, lambda m, s: seen.extend(zip(m.tolist(), s.tolist(), strict=True)))  # noqa: B023
        assert {i for i, s in seen if s >= least} == set(np.flatnonzero(scores >= least).tolist()) and len(seen) < 2048


def test_centroids(spark):
    rows = _vectors(np.random.default_rng(5), 200, 6)
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted(map(tuple, centroids.cluster(df, clusters=5, rounds=2, dims=6).collect()), key=str)
    own = [(i, _whole(v, 64)) for i, v, *_ in rows if v is not None and len(v) == 6 and _whole(v, 64)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in own if i is not None)
    cs = [v for _, v in named[:5]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))  # noqa: E731, B023
    for _ in range(2):
        members = {}
        for _, v in own:
            members.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(x) for x in zip(*members[k], strict=True)] if k in members else c for k, c in enumerate(cs)]
    placed = [(i, *near(v)) for i, v in own]
    sums = [sum(d for _, d, k in placed if k == c) for c in range(5)]
    want = [(i, k, d, sums[k], sum(sums), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, d, k in placed]
    assert got == sorted(want, key=str)
    assert centroids.cluster(df.limit(0)).collect() == [] and centroids.cluster(df.where("vec_id is null"), dims=6).count() == 0
    assert centroids.cluster(df.where("vec_id < 3"), dims=6).select("cluster").distinct().count() == 3
    assert "Python" not in centroids.cluster(df, dims=6)._jdf.queryExecution().toString()
