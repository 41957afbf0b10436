"""Mixing sources to target weights by soft membership (native: DataFrame operations only).

A naive Bayes classifier over binned features of the text, learnt from a labelled table, gives each document a posterior
over domains. A document's expected tokens in a domain are its tokens times its posterior. Projected gradient descent
fits nonnegative rates, such that the rated documents' expected totals per domain come closest to the targets in least
squares. Where the first steps don't reach the targets, as many rates are at 0, the move of one more projected step is
found by Newton's method over the rows that aren't. Every step needs a few sums per domain over all documents; the moves
so far are all that the driver holds, and a document's rate follows from them and its own posterior alone. So the rates
are a column expression, and neither texts nor rates are shuffled.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, staged

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = (0.85, 0.12, 0.03)
#: Labelled rows per domain at most, in the order of a hash of their ids.
SAMPLE_SALTS, SAMPLE_PER_SALT = 64, 48
#: Words that tell a domain, kept per domain.
TELLING = 300
STEPS, CLOSE = 12, 1e-3
#: Newton's method: the parts of a step that are tried in one pass, the weight of the move's size, the gradient at the end
#: as a share of the largest target, and the passes after which it is given up with an error.
TRIED, RIDGE, STILL, GIVEN_UP = (1.0, 0.5, 0.25, 1 / 16, 1 / 256), 1e-7, 1e-6, 200
BINS = 8


def _share_bin(part: Column, whole: Column) -> Column:
    """0 to BINS - 1, finer for small shares."""
    share = part / F.greatest(whole, F.lit(1))
    return F.least(F.lit(BINS - 1), F.ceil(F.sqrt(share) * BINS)).cast("int")


def _spelled(df: DataFrame, text: Column) -> DataFrame:
    """df with what the features need, each computed once: counts of letters and capitals, distinct words, tokens."""
    letters = F.regexp_replace(text, r"[^\p{L} ]+", "")
    df = df.withColumn(f"{OWN}chars", F.length(text)).withColumn(f"{OWN}tokens", F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, " "))).cast("long")).withColumn(f"{OWN}letters", letters)
    capitals = F.length(f"{OWN}letters") - F.length(F.translate(F.col(f"{OWN}letters"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return df.withColumns({f"{OWN}kept": F.length(f"{OWN}letters"), f"{OWN}capitals": capitals, f"{OWN}words": F.array_distinct(F.split(F.lower(f"{OWN}letters"), " "))}).drop(f"{OWN}letters")


def _features(telling: dict[str, list[str]]) -> list[Column]:
    """Bins of: characters that are no letters, capitals, distinct words among all, telling words of each domain."""
    own = lambda name: F.col(f"{OWN}{name}")
    hits = [F.least(F.lit(BINS - 1), F.size(F.array_intersect(own("words"), F.array(*map(F.lit, words))))) if words else F.lit(0) for words in telling.values()]
    return [_share_bin(own("chars") - own("kept"), own("chars")), _share_bin(own("capitals"), own("kept")), _share_bin(F.size(own("words")), own("tokens")), *hits]


class Classifier:
    """domains, telling words per domain, log prior per domain, log odds[feature][bin][domain]."""

    def __init__(self, domains: Sequence[str], telling: dict[str, list[str]], prior: np.ndarray, table: np.ndarray):
        self.domains, self.telling, self.prior, self.table = tuple(domains), telling, prior, table

    def judged(self, df: DataFrame, text: Column) -> DataFrame:
        """df with an array of the posterior of each domain, and the tokens."""
        df = _spelled(df, text).withColumn(f"{OWN}bins", F.array(*_features(self.telling))).drop(f"{OWN}words")
        look = lambda f, d: F.get(F.array(*(F.lit(float(round(x, 6))) for x in self.table[f, :, d])), F.get(f"{OWN}bins", F.lit(f)))
        logs = [sum((look(f, d) for f in range(len(self.table))), F.lit(float(round(self.prior[d], 6)))) for d in range(len(self.domains))]
        df = df.withColumn(f"{OWN}logs", F.array(*logs)).withColumn(f"{OWN}top", F.array_max(f"{OWN}logs"))
        df = df.withColumn(f"{OWN}w", F.array(*(F.exp(F.get(f"{OWN}logs", F.lit(d)) - F.col(f"{OWN}top")) for d in range(len(self.domains)))))
        total = sum((F.get(f"{OWN}w", F.lit(d)) for d in range(len(self.domains))), F.lit(0.0))
        p = F.array(*(F.round(F.get(f"{OWN}w", F.lit(d)) / total, 9) for d in range(len(self.domains))))
        return df.withColumn(f"{OWN}p", p).drop(*(f"{OWN}{c}" for c in ("chars", "kept", "capitals", "bins", "logs", "top", "w")))


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: Sequence[str] = DOMAINS) -> Classifier:
    """docs: doc_id, text; labels: doc_id, domain. A row labelled twice takes the last of its domains in the order given."""
    order = F.array(*map(F.lit, domains))
    key = F.xxhash64("doc_id", F.lit(29))
    marks = labels.where(F.col("doc_id").isNotNull() & F.array_contains(order, F.col("domain"))).groupBy("doc_id").agg(F.max(F.array_position(order, F.col("domain"))).alias("d")).withColumn("key", key)
    rank = F.row_number().over(Window.partitionBy("d", F.pmod("key", F.lit(SAMPLE_SALTS))).orderBy("key", "doc_id"))
    sizes = {r["d"]: r["n"] for r in marks.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    # At most SAMPLE_SALTS * SAMPLE_PER_SALT rows a domain.
    chosen = marks.withColumn("r", rank).where(F.col("r") <= SAMPLE_PER_SALT).select("doc_id", "d")
    sample = staged(docs.join(F.broadcast(chosen), "doc_id").select("d", F.coalesce("text", F.lit("")).alias("text")), "mix-sample")
    have = {r["d"]: r["n"] for r in sample.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(have.values())
    spelled = _spelled(sample, F.col("text"))
    counts = spelled.select("d", F.explode(f"{OWN}words").alias("w")).where(F.length("w") >= 3).groupBy("w").agg(*(F.count(F.when(F.col("d") == i + 1, 1)).alias(f"n{i}") for i in range(len(domains))), F.count(F.lit(1)).alias("n"))
    counts = counts.where("n >= 4")
    telling: dict[str, list[str]] = {}
    for i, name in enumerate(domains):
        mine, others = have.get(i + 1, 0) + 1.0, total - have.get(i + 1, 0) + 1.0
        odds = F.log((F.col(f"n{i}") + 0.5) / mine) - F.log((F.col("n") - F.col(f"n{i}") + 0.5) / others)
        best = counts.withColumn("odds", odds).where((F.col(f"n{i}") >= 4) & (F.col("odds") - 2 / F.sqrt(f"n{i}") > 1)).orderBy(F.desc("odds"), "w").limit(TELLING)
        telling[name] = [r["w"] for r in best.select("w").collect()]
    features = spelled.select("d", F.posexplode(F.array(*_features(telling))).alias("f", "b")).groupBy("d", "f", "b").agg(F.count(F.lit(1)).alias("n")).collect()
    table = np.full((3 + len(domains), BINS, len(domains)), 0.5)
    for r in features:
        table[r["f"], r["b"], r["d"] - 1] += r["n"]
    prior = np.log([sizes.get(i + 1, 0) + 0.5 for i in range(len(domains))])
    return Classifier(domains, telling, prior - np.logaddexp.reduce(prior), np.log(table / table.sum(axis=1, keepdims=True)))


def rate_of(posterior: Column, moves: list[list[float]]) -> Column:
    """The rate that the moves so far give: from 1, each adds its dot product with the posterior, and 0 bounds it below."""
    if not moves:
        return F.lit(1.0)
    steps = F.array(*(F.array(*map(F.lit, m)) for m in moves))
    dot = lambda m: F.aggregate(F.zip_with(posterior, m, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), r + dot(m)))


def fit_rates(members: DataFrame, targets: Sequence[float], steps: int = STEPS, close: float = CLOSE) -> list[list[float]]:
    """The moves of projected gradient descent; members: tokens, p (posterior array). targets: tokens per domain.

    The squares are weighted by the inverse of the domains' Gram matrix and rates by tokens, which makes 1 the right step
    and the Gram matrix the only other sum over documents. Clipped rates make the steps too short: if the targets aren't
    met after so many, the last move is solved for. Targets that no rates reach are warned of, with what is missing.
    """
    k = len(targets)
    gram_row = members.agg(*(F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    gram = np.array([[gram_row[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    back = np.linalg.pinv(gram, rcond=1e-9)
    moves: list[list[float]] = []
    bound = close * max(1.0, np.abs(targets).max())
    for step in range(steps + 1):
        sums = members.select("tokens", "p", rate_of(F.col("p"), moves).alias("r")).agg(*(F.sum(F.col("r") * F.col("tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(k))).first()
        error = np.array([sums[f"t{i}"] or 0.0 for i in range(k)]) - np.array(targets)
        if np.abs(error).max() <= bound:
            return moves
        if step < steps:
            moves.append([float(f"{x:.12g}") for x in -back @ error])
    move, error = _last_move(members, moves, np.array(targets, float), gram)
    if np.abs(error).max() > bound:
        warnings.warn(f"no rates reach the targets: totals {[round(t + e) for t, e in zip(targets, error, strict=True)]} for {[round(t) for t in targets]}", stacklevel=2)
    return [*moves, move]


def _last_move(members: DataFrame, moves: list[list[float]], targets: np.ndarray, gram: np.ndarray) -> tuple[list[float], np.ndarray]:
    """The move that meets the targets with the least change of the rates, or comes closest to them in plain least squares,
    and what the totals then differ by.

    Its dual is convex and piecewise quadratic in one number per domain: half the squared rates, less the move times the
    targets. The totals are its gradient and the Gram matrix of the rows with rates above 0 its second derivative.
    """
    k = len(targets)
    values, axes = np.linalg.eigh(gram)
    # Directions in which no document differs change nothing.
    axes = axes[:, values > 1e-9 * values.max()]
    ridge = RIDGE * np.trace(gram) / k
    base = members.select("tokens", "p", rate_of(F.col("p"), moves).alias("r"))

    def sums(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Dual, gradient and second derivative at each move."""
        rates = base.select("tokens", "p", *(F.greatest(F.lit(0.0), F.col("r") + sum((F.col("p")[i] * float(m[i]) for i in range(k)), F.lit(0.0))).alias(f"r{n}") for n, m in enumerate(tried)))
        own = lambda n: F.col("tokens") * F.col(f"r{n}")
        row = rates.agg(
            *(F.sum(own(n) * F.col(f"r{n}") / 2).alias(f"q{n}") for n in range(len(tried))),
            *(F.sum(own(n) * F.col("p")[i]).alias(f"t{n}_{i}") for n in range(len(tried)) for i in range(k)),
            *(F.sum(F.when(F.col(f"r{n}") > 0, F.col("tokens") * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)).alias(f"h{n}_{i}_{j}") for n in range(len(tried)) for i in range(k) for j in range(i, k)),
        ).first()
        return [
            (
                row[f"q{n}"] - m @ targets + ridge / 2 * m @ m,
                np.array([row[f"t{n}_{i}"] for i in range(k)]) - targets + ridge * m,
                np.array([[row[f"h{n}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge * np.eye(k),
            )
            for n, m in enumerate(tried)
        ]

    move = np.zeros(k)
    dual, slope, curve = sums([move])[0]
    for _ in range(GIVEN_UP):
        if np.abs(axes @ (axes.T @ slope)).max() <= STILL * max(1.0, np.abs(targets).max()):
            return [float(x) for x in move], slope - ridge * move
        way = -axes @ np.linalg.solve(axes.T @ curve @ axes, axes.T @ slope)
        tried = [move + part * way for part in TRIED]
        n, (dual, slope, curve) = min(enumerate(sums(tried)), key=lambda x: x[1][0])
        move = tried[n]
    raise RuntimeError(f"the rates' last move was not found: totals differ by {slope - ridge * move} of {targets}")


def _domain(labels: DataFrame) -> DataFrame:
    """The domain of rows of the labels table."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def mix(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.0, domains: Sequence[str] = DOMAINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with tokens long, p_<domain> double each, rate double and copies long added (columns of docs with these names are
    replaced).

    labels: doc_id, domain. Targets are weights (which are scaled to add up to 1) times budget times the tokens of docs.
    Tokens are words between spaces. copies is the rate rounded up or down by a hash of the id, so that it is the rate
    on average. A null or empty text has no tokens and the rate of its posterior. A null id is hashed like any value;
    rows that repeat an id are rated alike. Without labels all posteriors are alike. An empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    model = fit_classifier(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("doc_id is not null"), labels, domains)
    own = lambda name: f"{OWN}{name}"
    # Judged once and written, so that neither the descent nor the result reads the texts' words again.
    judged = staged(model.judged(docs, text), "mix-judged")
    members = judged.select(F.col(own("tokens")).alias("tokens"), F.col(own("p")).alias("p"))
    total = members.agg(F.sum("tokens")).first()[0] or 0
    targets = [w / sum(weights) * budget * total for w in weights]
    moves = fit_rates(members, targets) if total else []
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(43)), F.lit(1 << 30)) / float(1 << 30)
    added = {"tokens": F.col(own("tokens")), **{f"p_{d}": F.col(own("p"))[i] for i, d in enumerate(domains)}, "rate": rate_of(F.col(own("p")), moves)}
    keep = [c for c in docs.columns if c not in {*added, "copies"}]
    out = judged.select(*(F.col(f"`{c}`") for c in keep), *(v.alias(k) for k, v in added.items()), chance.alias(own("chance")))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col(own("chance")))).drop(own("chance"))


def mix_by_labels(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """mix with the domains of the labels table: toxic, else good or poor by quality."""
    return mix(docs, _domain(labels), **options)
