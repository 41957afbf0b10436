"""Toxicity scores with noisy-channel deobfuscation.

A disguised word (digits and signs for letters, letters spaced or dotted apart, letters repeated) is read as the output
of a channel. A lattice offers for every character the letters that it may stand for, and the possibilities that it was
put in, that it repeats the letter before, or that it ends a word; a Viterbi search under a character trigram model finds
the likeliest words. The trigrams are counted over all documents; words that tell label 1 count as a part of the model
of their own. The restored words are scored by their evidence and that of their beginnings, as learnt from labelled
rows; a logistic curve turns that into a score. Words that need no restoring pass through the channel as they are. Whole
texts are read; each distinct word is looked at once per worker. Restored words have no accents, and are found among the
telling words without theirs.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_parts, staged

#: Labelled rows per class that the evidence is learnt from, at most, in the order of a hash of their ids.
SAMPLE_SALTS, SAMPLE_PER_SALT = 64, 96
#: Features that are kept, the strongest.
FEATURES = 20_000
#: Rows of a class that a feature must occur in.
LEAST_ROWS = 3
#: Words that a worker remembers; it then begins anew, which changes nothing but speed.
REMEMBERED = 500_000
#: Part of the telling words in the character model, and what a trigram's, a pair's and a letter's share count for.
TELLING, SHARES = 0.25, (0.7, 0.25, 0.05)

SCORED = "doc_id long, held_out boolean, score double, predicted int"

# What signs and digits stand for in disguised words.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¥": "y", "#": "h", "&": "e", "%": "o"}
HIDDEN, PUT_IN = "*?#_%", "*.-_~^,'/\\+=:;|"
#: Log costs of the channel: a letter as it is, a sign for a letter, a hidden letter, a sign put in, any other character put
#: in, a letter again, the end of a word at a sign put in.
PLAIN, FOR_LETTER, ANY_LETTER, PUT, ODD, AGAIN, ENDS = -0.05, -0.7, -2.5, -0.3, -8.0, -0.4, -1.5

LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BARE = {c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, range(0xC0, 0x250)) if "a" <= unicodedata.normalize("NFKD", c)[0] <= "z"} | {"ß": "s"}
_FOLD = str.maketrans(_BARE)
_WORDY = re.compile(r"\w")
_SPACED = re.compile(r"(?<!\S)\S(?: {1,2}\S(?!\S)){2,}")
_RUN = re.compile(r"([^\w\s])\1")
_REPEATED = re.compile(r"(.)\1\1")
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def folded(text: str) -> str:
    return text.lower().translate(_FOLD)


def trigrams(text: str) -> np.ndarray:
    """How often each trigram occurs in the words of text, in lower case and without accents: an array [two before, before,
    letter] of 27 each, 0 being what is no letter, before a word and at its end."""
    text = text.lower()
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = folded(text).encode("latin-1", "replace")
    code = _CODES[np.frombuffer(raw, np.uint8)]
    code = np.concatenate([[0, 0], code, [0]]).astype(np.int64)
    last, one, two = code[2:], code[1:-1], code[:-2] * (code[1:-1] > 0)
    at = (two * 27 + one) * 27 + last
    return np.bincount(at[(last > 0) | (one > 0)], minlength=27**3).reshape(27, 27, 27)


_CODES = np.zeros(256, np.uint8)
_CODES[[ord(c) for c in LETTERS]] = np.arange(1, 27)
for _c, _bare in _BARE.items():
    if _c <= "\xff":
        _CODES[ord(_c)] = ord(_bare) - 96


def char_model(counts: np.ndarray, telling: Iterable[str]) -> np.ndarray:
    """log P(letter | the two before) as an array like trigrams gives, from counts of all documents and telling words."""

    def shares(counts: np.ndarray) -> np.ndarray:
        by = lambda x, axes: x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-9)
        three, two, one = by(counts, 2), by(counts.sum(axis=0), 1), by(counts.sum(axis=(0, 1)) + 0.5, 0)
        return SHARES[0] * three + SHARES[1] * two[None] + SHARES[2] * one[None, None]

    words = sorted(set(map(folded, telling)))
    found = shares(counts.astype(float))
    if words:
        found = (1 - TELLING) * found + TELLING * shares(trigrams(" ".join(words)).astype(float))
    return np.log(found)


class _Lattice:
    """What each character of a token may be: letters with their costs, and costs of being put in or a repeat (stay) and of
    ending a word (end), None where it can't."""

    def __init__(self, token: str):
        self.steps: list[tuple[np.ndarray, np.ndarray, float | None, float | None]] = []
        before = ""
        for c in token:
            ways = {ord(c) - 96: PLAIN} if "a" <= c <= "z" else {ord(x) - 96: FOR_LETTER for x in STANDS_FOR.get(c, "")}
            if c in HIDDEN:
                ways = {i: ways.get(i, ANY_LETTER) for i in range(1, 27)}
            apart = c in PUT_IN or c.isspace()
            stay = PUT if apart else (AGAIN if c == before else None) if c.isalpha() else ODD
            self.steps.append((np.array([*ways], np.int64), np.array([*ways.values()]), stay, ENDS if apart else None))
            if not apart:
                before = c


def restore(token: str, model: np.ndarray) -> tuple[list[str], float]:
    """(the likeliest words behind a token, which is folded, their log probability). A token with a character that no way
    leads through, as a letter of another script, is one word as it is."""
    none = -np.inf
    score = np.full((27, 27), none)
    score[0, 0] = 0.0
    back: list[np.ndarray] = []  # per step and state: the letter two before, 27 for stayed, 28 for ended (from best state)
    ended: list[int] = []
    out: list[int] = []
    limit = 512

    def trace(state: int, upto: int) -> list[int]:
        """Letters (0 for an end of a word) on the way to a state after the last step, down to step upto."""
        found = []
        for step in range(len(back) - 1, upto - 1, -1):
            way = int(back[step][state])
            if way == 28:
                found.append(0)
                state = ended[step]
            elif way != 27:
                found.append(state % 27)
                state = way * 27 + state // 27
        return found[::-1]

    for letters, costs, stay, end in _Lattice(token).steps:
        now, way = np.full((27, 27), none), np.full((27, 27), 27, np.int8)
        if stay is not None:
            now = score + stay
        if len(letters):
            reach = score[:, :, None] + model[:, :, letters]
            best = reach.argmax(axis=0)
            value = np.take_along_axis(reach, best[None], 0)[0] + costs
            better = value > now[:, letters]
            now[:, letters] = np.where(better, value, now[:, letters])
            way[:, letters] = np.where(better, best, way[:, letters])
        if end is not None:
            ends = score + model[:, :, 0]
            ends[0, 0] = none  # a word has letters
            k = int(ends.argmax())
            if ends.flat[k] + end > now[0, 0]:
                now[0, 0], way[0, 0] = ends.flat[k] + end, 28
            ended.append(k)
        else:
            ended.append(0)
        if now.max() == none:
            return [token], none
        score = now
        back.append(way.ravel())
        if len(back) >= limit:  # what all ways share is settled and need not be kept
            states, step = np.flatnonzero(np.isfinite(score)), len(back)
            while len(states) > 1 and step:
                step -= 1
                ways = back[step][states].astype(np.int64)
                states = np.unique(np.where(ways == 27, states, np.where(ways == 28, ended[step], ways * 27 + states // 27)))
            if len(states) == 1 and step:
                kept = back[step:], ended[step:]
                back, ended = back[:step], ended[:step]
                out += trace(int(states[0]), 0)
                back, ended = kept
            limit = max(512, 2 * len(back))
    last = score + model[:, :, 0]
    last[0, 0] = score[0, 0] if len(token) else 0.0
    k = int(last.argmax())
    out += trace(k, 0)
    return "".join(" " if x == 0 else LETTERS[x - 1] for x in out).split(), float(last.flat[k])


def features(word: str) -> list[str]:
    """A word of letters in lower case, and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in (4, 5) if len(word) > n)] if len(word) >= 3 else []


class Scorer:
    """evidence(text): how strongly its words speak for label 1; model: log probabilities, or None for no restoring."""

    def __init__(self, weights: dict[str, float], model: np.ndarray | None, curve: tuple[float, float]):
        self.weights, self.model, self.curve = weights, model, curve
        self.bare: dict[str, float] = {}
        for f, w in weights.items():
            self.bare[folded(f)] = max(w, self.bare.get(folded(f), w))
        self.known: dict[str, float] = {}

    def word(self, token: str) -> float:
        """The strongest evidence of one token, as it is and restored."""
        get, token = self.weights.get, token.lower()
        spelled = _LETTERS.findall(token)
        best = max((get(f, -9.0) for w in spelled for f in features(w)), default=-9.0)
        if self.model is None or not spelled:
            return best
        bare = token[_WORDY.search(token).start() : len(token) - _WORDY.search(token[::-1]).start()]
        core = token.strip(".,;:\"()[]{}<>")
        # Signs at an edge may stand for letters, but a run of one sign only adorns.
        for odd in {bare} if _RUN.search(core) else {core, bare}:
            # White space, signs or digits among letters, or a letter three times.
            if len(odd) >= 3 and (not odd.isalpha() or _REPEATED.search(odd)):
                best = max(best, max((self.bare.get(f, -9.0) for w in restore(folded(odd), self.model)[0] for f in features(w)), default=-9.0))
        return best

    def evidence(self, text: str) -> float:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        tokens = set(text.split())
        tokens.update(m[0] for m in _SPACED.finditer(text))
        found = []
        for t in tokens:
            e = known.get(t)
            if e is None:
                e = known[t] = self.word(t)
            if e > 0:
                found.append(e)
        found.sort(reverse=True)
        return found[0] + 0.5 * found[1] if len(found) > 1 else found[0] if found else 0.0

    def score(self, text: str) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a * self.evidence(text) + b))))


@functools.lru_cache(maxsize=1)
def _scorer(weights: tuple, model: bytes, curve: tuple) -> Scorer:
    return Scorer(dict(weights), np.frombuffer(model).reshape(27, 27, 27), curve)


def _scored(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(*shared.value)
        for batch in small_parts(batches, 2):
            found = np.array([scorer.score(t or "") for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def _weighed(shared):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows label, text -> label, evidence in tenths."""
        scorer = _scorer(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([round(10 * scorer.evidence(t or "")) for t in batch.column(1).to_pylist()], pa.int64())], ["label", "tenths"])

    return weigh


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows text -> trigram, n: the counts of all trigrams of a task's texts."""
    total = np.zeros(27**3, np.int64)
    for batch in small_parts(batches, 0):
        total += trigrams("\n".join(t for t in batch.column(0).to_pylist() if t)).ravel()
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["trigram", "n"])


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """trigrams of all texts of docs together; at most 27 ** 3 sums reach the driver."""
    counts = np.zeros(27**3, np.int64)
    for r in docs.select("text").mapInArrow(_counted, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[r["trigram"]] = r["n"]
    return counts.reshape(27, 27, 27)


def _curve(counts: dict[int, tuple[float, float]]) -> tuple[float, float]:
    """Logistic slope and offset over evidence, by Newton steps with a small penalty; counts: tenths -> rows of label 0, 1."""
    x = np.array([k / 10 for k in counts])
    n0, n1 = (np.array([v[i] for v in counts.values()], float) for i in (0, 1))
    if not len(x) or not n1.sum():
        return 0.0, -20.0
    w = np.array([1.0, -1.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n1 - (n0 + n1) * p) - 0.05 * w
        hessian = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple:
    """(weights, character model, curve); weights and curve from rows that aren't held out; docs: doc_id, text; labels:
    doc_id, label."""
    session = docs.sparkSession
    key = F.xxhash64("doc_id", F.lit(17))
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("key", key)
    rank = F.row_number().over(Window.partitionBy("label", F.pmod("key", F.lit(SAMPLE_SALTS))).orderBy("key", "doc_id"))
    # At most SAMPLE_SALTS * SAMPLE_PER_SALT rows a class.
    chosen = marks.withColumn("r", rank).where(F.col("r") <= SAMPLE_PER_SALT).select("doc_id", "label")
    sample = docs.join(F.broadcast(chosen), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))
    sample = staged(sample, "toxic-sample")
    rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    spelled = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0))
    rowed = sample.select("label", F.monotonically_increasing_id().alias("row"), spelled.alias("ws"))
    starts = F.transform(F.array(F.lit(4), F.lit(5)), lambda n: F.when(F.length("w") > n, F.concat(F.substring(F.col("w"), F.lit(1), n), F.lit("~"))))
    named = lambda df: df.withColumn("f", F.explode(F.concat(F.array("w"), starts))).where("f is not null and length(f) >= 3")
    # Rows of either label that have a feature; for label 1 no more than the words that it follows, since copies of one
    # text repeat their words in one place, and an insult is found in many. A pair is one string: arrays of strings
    # find their distinct elements by hashing, arrays of structs by comparing all.
    pairs = F.array_distinct(F.zip_with("ws", F.concat(F.array(F.lit("")), F.slice("ws", F.lit(1), F.size("ws") - 1)), lambda w, before: F.concat_ws(" ", w, before)))
    told = named(rowed.where("label = 1 and size(ws) > 0").select("row", F.explode(pairs).alias("p")).select("row", F.substring_index("p", " ", 1).alias("w"), F.substring_index("p", " ", -1).alias("before")).where("w <> ''"))
    told = told.groupBy("f").agg(F.countDistinct("row").alias("rows"), F.countDistinct("before").alias("places")).select("f", F.least("rows", "places").alias("t")).where(F.col("t") >= LEAST_ROWS)
    clean = named(rowed.where("label = 0").select("row", F.explode(F.array_distinct("ws")).alias("w"))).select("f", "row").distinct().groupBy("f").agg(F.count(F.lit(1)).alias("c"))
    counts = told.join(clean, "f", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    n1, n0 = rows.get(1, 0) + 1.0, rows.get(0, 0) + 1.0
    odds = F.log((F.col("t") + 0.3) / n1) - F.log((F.col("c") + 0.3) / n0)
    # Only what is far commoner in label 1 than chance makes it.
    strong = counts.withColumn("weight", odds).where(F.col("weight") - 2.5 / F.sqrt("t") > 1.0).orderBy(F.desc("weight"), "f").limit(FEATURES).collect()
    weights = {r["f"]: float(r["weight"]) for r in strong}
    model = char_model(count_trigrams(docs), (f for f in weights if not f.endswith("~")))
    state = tuple(sorted(weights.items())), model.tobytes()
    shared = session.sparkContext.broadcast((*state, (1.0, 0.0)))
    bins = sample.mapInArrow(_weighed(shared), "label int, tenths long").groupBy("tenths").agg(F.sum(1 - F.col("label")).alias("n0"), F.sum("label").alias("n1")).collect()
    return (*state, _curve({r["tenths"]: (r["n0"], r["n1"]) for r in bins}))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Labels are learnt from rows with crc32(id) mod 5 other than 0 alone, a bounded sample of each class; a row labelled
    twice counts as 1 if either label is. A null or empty text has the score of a text without evidence. Very long texts
    and tokens are read whole, in time that grows with their length. Rows without an id are left out, repeated ones scored
    alike. Without any label 1 all scores are close to 0. An empty table gives an empty result. Other columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    model = fit(given, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return given.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scored(shared), SCORED)
