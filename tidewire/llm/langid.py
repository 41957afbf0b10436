"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton, which follows every substring of the sample.
A text is parsed against each language: the longest match from where the last one ended makes a phrase, and a character
that the sample lacks is a phrase of its own. The language that needs the fewest phrases, each weighted by the logarithm
of its sample's length, wins. Letters count in lower case; anything else is one boundary symbol.

All texts of a batch are parsed side by side, one character a step, long ones in spans: each span is parsed as if a
phrase began with it, and then again from the state that the span before ended in, until both parses are in one state,
from where they agree. The phrases counted are those of one parse of the whole text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, small_parts

#: Characters of labelled text per language at most, of documents in the order of a hash of their ids, of each no more than
#: a tenth of it.
SAMPLE_CHARS = 30_000
SAMPLE_SALTS, SAMPLE_PER_SALT = 32, 16
SPAN = 1024
#: How sharply differences of bits per character tell in the score.
SHARPNESS = 6.0

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The suffix automaton of symbols as a table (states, width) of next states, 0 being the start and -1 no way on."""
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        now = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in follow[p]:
            follow[p][s] = now
            p = link[p]
        if p >= 0:
            q = follow[p][s]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and follow[p].get(s) == q:
                    follow[p][s] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    table = np.full((len(follow), width), -1, np.int32)
    for i, ways in enumerate(follow):
        for s, to in ways.items():
            table[i, s] = to
    return table


class CrossParser:
    """samples: language -> text. Symbols: 0 boundary, 1.. letters of the samples, the last any other letter."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        lowered = {k: samples[k].lower() for k in self.languages}
        letters = sorted({c for t in lowered.values() for c in t if c.isalpha()})
        self.width = len(letters) + 2
        self.symbol = np.fromiter((self.width - 1 if chr(i).isalpha() else 0 for i in range(0x110000)), np.int16, 0x110000)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        parts, roots, base = [], [], 0
        for k in self.languages:
            table = automaton(self.symbols([lowered[k]])[0].tolist(), self.width)
            # An entry is 4 * (where the next state's row starts) + the phrases that end here: the one so far, if the symbol
            # doesn't go on with it, and the symbol itself, if the sample lacks it.
            ended = (table < 0).astype(np.int8)
            ended[1:, table[0] < 0] += 1
            to = np.where(table < 0, np.maximum(table[0], 0), table)
            parts.append((to + base) * self.width * 4 + ended)
            roots.append(base * self.width)
            base += len(table)
        self.table = np.concatenate(parts).astype(np.int64 if base * self.width > 1 << 28 else np.int32).ravel() if parts else np.zeros(0, np.int32)
        self.roots = np.array(roots, self.table.dtype)
        self.bits = np.array([math.log2(max(2, len(samples[k]))) for k in self.languages])

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, how many each text has) with boundaries run together and one at each end."""
        codes = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 2 for t in texts])
        values = self.symbol[codes]
        first = np.zeros(len(values), bool)
        first[ends[:-1]] = True
        keep = (values != 0) | np.concatenate([[True], values[:-1] != 0]) | first
        if len(values):
            keep[0] = True
        return values[keep], np.diff(np.concatenate([[0], np.cumsum(keep)[ends - 1]]))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per text and language, symbols per text)."""
        values, sizes = self.symbols([t.lower() for t in texts])
        n, spans = len(self.languages), np.maximum(1, -(-sizes // SPAN))
        text = np.repeat(np.arange(len(texts)), spans)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans)
        begin = np.repeat(np.cumsum(sizes) - sizes, spans) + inner * SPAN
        long = np.minimum(SPAN, np.repeat(sizes, spans) - inner * SPAN)
        order = np.argsort(-long, kind="stable")
        state = np.repeat(self.roots[:, None], len(text), axis=1)
        count = np.zeros((n, len(text)), np.int64)
        live = np.searchsorted(-long[order], -np.arange(int(long.max()) if len(long) else 0), side="left")  # spans longer than a step
        first = begin[order]
        for step, m in enumerate(live.tolist()):
            entry = self.table.take(state[:, :m] + values[first[:m] + step])
            count[:, :m] += entry & 3
            state[:, :m] = entry >> 2
        back = np.empty(len(text), np.int64)
        back[order] = np.arange(len(text))
        state, count = state[:, back], count[:, back]  # in the order of the texts again
        more, apart = self._stitched(values, state, begin, long, np.flatnonzero(inner > 0))
        last = np.cumsum(spans) - 1
        out = np.add.reduceat(count + more, last - spans + 1, axis=1) if len(texts) else np.zeros((n, 0), np.int64)
        out = out + (state[:, last] != self.roots[:, None])
        for k, i in {(k, int(text[i])) for k, i in apart}:  # a text with a span whose parses don't meet, as of one word again and again
            out[k, i] = self._parsed(values[begin[last[i] - spans[i] + 1] :][: sizes[i]], int(self.roots[k]))
        return out.T.astype(float), sizes

    def _parsed(self, symbols: np.ndarray, root: int) -> int:
        table, state, count = self.table, root, 0
        for s in symbols.tolist():
            entry = int(table[state + s])
            count += entry & 3
            state = entry >> 2
        return count + (state != root)

    def _stitched(self, values: np.ndarray, ended: np.ndarray, begin: np.ndarray, long: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(what to add to the count of each span because the phrase before it goes on, languages and spans whose parses don't
        meet); ended: states at the ends of spans."""
        more = np.zeros(ended.shape, np.int64)
        lang, span = (x.ravel() for x in np.meshgrid(np.arange(len(ended)), spans, indexing="ij"))
        true, own = ended[lang, span - 1], self.roots[lang]
        apart, step, late = np.flatnonzero(true != own), 0, []
        lang, span, true, own = lang[apart], span[apart], true[apart], own[apart]
        while len(span):
            symbol = values[begin[span] + step]
            a, b = self.table.take(true + symbol), self.table.take(own + symbol)
            more[lang, span] += (a & 3).astype(np.int64) - (b & 3)
            true, own, step = a >> 2, b >> 2, step + 1
            apart, over = true != own, step >= long[span]
            late += zip(lang[apart & over].tolist(), span[apart & over].tolist(), strict=True)
            go_on = apart & ~over
            lang, span, true, own = lang[go_on], span[go_on], true[go_on], own[go_on]
        return more, late

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        counts, sizes = self.phrases(texts)
        entropy = counts * self.bits / np.maximum(sizes, 1)[:, None]
        best = entropy.argmin(axis=1)
        weight = np.exp(-SHARPNESS * (entropy - entropy.min(axis=1, keepdims=True)))
        return [self.languages[i] for i in best], weight[np.arange(len(texts)), best] / weight.sum(axis=1)


@functools.lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(dict(samples))


def _predicted(samples, names_out: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples.value)
        for batch in small_parts(batches, 2):
            texts = batch.column(2).to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t and parser.languages and any(map(str.isalpha, t))]
            if known:
                found, scores[known] = parser.predict([texts[i] for i in known])
                for i, x in zip(known, found, strict=True):
                    names[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names), pa.array(scores), *batch.columns[3:]], names_out)

    return predict


def training_sample(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """language -> labelled text, of documents that aren't held out; at most sample_chars characters each. The driver holds
    that much per language that the labels name."""
    key = F.xxhash64("doc_id", "lang")
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "lang", F.least(F.length("text"), F.lit(sample_chars // 10)).alias("n"), key.alias("key"))
    salted = rows.withColumn("salt", F.pmod("key", F.lit(SAMPLE_SALTS))).withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("key", "doc_id"))).where(F.col("r") <= SAMPLE_PER_SALT)
    total = F.sum("n").over(Window.partitionBy("lang").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # At most SAMPLE_SALTS * SAMPLE_PER_SALT rows a language.
    chosen = salted.withColumn("total", total).where(F.col("total") <= sample_chars).select("doc_id", "lang", "key").distinct()
    texts = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "key", "doc_id", F.substring("text", 1, sample_chars // 10).alias("text")).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(texts, key=lambda r: (r["lang"], r["key"], r["doc_id"], r["text"] or "")):
        found.setdefault(row["lang"], []).append(row["text"] or "")
    return {k: "\n".join(v)[: 2 * sample_chars] for k, v in found.items()}


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, samples: dict[str, str] | None = None, row_col: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (0 to 1), and row_col if it is given.

    samples: labelled text per language; if None, it is taken from docs, from rows with crc32(id) mod 3 other than 1
    alone. A text that is null or has no letter, or any text if there are no samples, gets "und" and score 0. Ties go to
    the first language by name. Very long texts are parsed whole. Rows without an id are left out; repeated ones are
    predicted alike. An empty table gives an empty result. Other columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), *([F.col(row_col).alias(f"{OWN}key")] if row_col else []))
    samples = training_sample(given, sample_chars) if samples is None else samples
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))
    more = [f"{OWN}key"] if row_col else []
    rows = given.where("doc_id is not null").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *more)
    schema = PREDICTED + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    found = rows.mapInArrow(_predicted(shared, ["doc_id", "held_out", "lang_pred", "score", *more]), schema)
    return found.withColumnRenamed(f"{OWN}key", row_col) if row_col else found
