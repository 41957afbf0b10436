"""SentencePiece encoding and decoding by vectorised merge rounds.

A text's symbols are one flat numpy array of all words that are new to the worker. In a round every word looks up the
least rank of its neighbouring pairs, all its leftmost pairs of that rank merge at once, words without a pair left are put
aside, and the arrays are compacted; rounds go on until no pair remains. Pairs of one rank merge at once only where the
piece they make can't form a pair of its own rank or a lesser one, else the leftmost alone does, so the order is that of
the library, which merges one pair at a time.

Words end where no piece can cross: before a space that follows none, and between two characters that stand side by side in no
piece of the model. What is longer than LONG all the same merges by a queue of pairs, in the same order. The ids of a word are remembered by the worker.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_parts
from .tokens import WordEncoder

SPACE = "▁"
#: Segments of more characters merge pair by pair: a round for each pair would cost the square of their length.
LONG = 4096
#: The rank of a pair that makes no piece, and what a symbol's number is multiplied by in a pair's key.
NONE, WIDE = np.iinfo(np.int32).max, 1 << 21

# An invalid byte is one U+FFFD, and decoding goes on with the next.
codecs.register_error("tidewire_bytewise", lambda e: ("�", e.start + 1))


class Vocabulary:
    """The tables of a model. A symbol is a piece's id, or for a character that is no piece the number of pieces plus its code."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        own, kinds = spec.normalizer_spec, spec.pieces[0].Type
        fits = spec.trainer_spec.model_type == 2 and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix
        fits = fits and own.add_dummy_prefix and own.escape_whitespaces and not own.remove_extra_whitespaces and not own.precompiled_charsmap
        if not fits or any(p.type in (kinds.Value("USER_DEFINED"), kinds.Value("UNUSED")) for p in spec.pieces):
            raise ValueError("only byte-pair models with byte fallback, a leading space and unchanged characters are known")
        self.size, self.eos = len(spec.pieces), sentencepiece.SentencePieceProcessor(model_file=path).eos_id()
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.Value("NORMAL")}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space behind another character")
        self.byte = np.array([next(i for i, p in enumerate(spec.pieces) if p.piece == f"<0x{b:02X}>") for b in range(256)], np.int32)
        ranks = np.unique([-p.score for p in spec.pieces], return_inverse=True)[1].astype(np.int32)

        symbol = lambda part: normal.get(part, self.size + ord(part) if len(part) == 1 else -1)
        pairs, beside = {}, set()
        for piece, i in normal.items():
            beside.update(map("".join, itertools.pairwise(piece)))
            for at in range(1, len(piece)):
                left, right = symbol(piece[:at]), symbol(piece[at:])
                if left >= 0 and right >= 0:
                    pairs[left * WIDE + right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.into = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = ranks[self.into]
        #: Pieces that may form a pair of their rank or a lesser one.
        self.early = np.zeros(self.size, bool)
        for part in (self.keys // WIDE, self.keys % WIDE):
            made = part < self.size
            self.early[part[made][self.rank[made] <= ranks[part[made]]]] = True
        self.beside = np.array(sorted(ord(a) * WIDE + ord(b) for a, b in beside), np.int64)
        self.codes = np.array(sorted(ord(p) for p in normal if len(p) == 1), np.int64)
        self.of_code = np.array([normal[chr(c)] for c in self.codes.tolist()], np.int32)
        self.lone = re.compile("\n") if not any("\n" in p for p in normal) else None

        # Spaces alone: if pieces of spaces rank last together and nothing else begins with two, the leftmost pair of a run always
        # merges first. So if as many spaces as the longest such piece holds become that piece, a run is cut into such blocks.
        runs, self.run = [normal[p] for p in normal if p.startswith(SPACE * 2)], None
        longest = max((len(spec.pieces[i].piece) for i in runs), default=1)
        if all(set(spec.pieces[i].piece) == {SPACE} and ranks[i] == ranks[list(normal.values())].max() for i in runs) and longest > 1:
            block = self.merged(np.full(longest, ord(SPACE)), np.zeros(longest, np.int64))[0]
            self.run = longest if len(block) == 1 else None

        shown = [b"" if p.type == kinds.Value("CONTROL") else " ⁇ ".encode() if p.type == kinds.Value("UNKNOWN") else p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        for b, i in enumerate(self.byte.tolist()):
            shown[i] = bytes([b])
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.control = np.array([p.type == kinds.Value("CONTROL") for p in spec.pieces])
        self.leading = np.array([p.type == kinds.Value("NORMAL") and p.piece.startswith(SPACE) for p in spec.pieces])

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.of_code[at], self.size + codes).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair; the rank is NONE where it makes no piece."""
        keys = left * WIDE + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        made = self.keys[at] == keys
        return np.where(made, self.rank[at], NONE), np.where(made, self.into[at], -1)

    def cuts(self, codes: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether a segment that merges on its own begins at each character."""
        keys = codes[:-1] * WIDE + codes[1:]
        at = np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (self.beside[at] != keys)])
        if self.run:
            space = codes == ord(SPACE)
            since = np.maximum.accumulate(np.where(~space | new, np.arange(len(codes)), 0))
            # The place of a space in its run; a run that begins its word begins at a space, another behind a character.
            place = np.arange(len(codes)) - since - np.where(space[since], 0, 1)
            new |= space & (place > 0) & (place % self.run == 0)
        return new

    def merged(self, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that the words' characters merge to, and the word of each, in order."""
        segment = np.cumsum(self.cuts(codes, word)) - 1
        of_segment = word[np.flatnonzero(np.diff(segment, prepend=-1))]
        symbol, done = self.symbols(codes), []
        long = np.bincount(segment)[segment] > LONG if len(segment) else np.zeros(0, bool)
        if long.any():
            for own in np.split(np.flatnonzero(long), np.flatnonzero(np.diff(segment[long])) + 1):
                alone = self._by_pairs(symbol[own])
                done.append((np.full(len(alone), segment[own[0]]), alone))
            symbol, segment = symbol[~long], segment[~long]
        rank, into = np.full(len(symbol), NONE), np.full(len(symbol), -1)

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at + 1 < len(symbol))]
            rank[at], into[at] = self.pairs(symbol[at], symbol[at + 1])
            rank[at[segment[at] != segment[at + 1]]] = NONE

        look(np.arange(len(symbol) - 1))
        while len(symbol):
            starts = np.flatnonzero(np.diff(segment, prepend=-1))
            lens = np.diff(starts, append=len(symbol))
            least = np.minimum.reduceat(rank, starts)
            if (least == NONE).any():
                over = np.repeat(least == NONE, lens)
                done.append((segment[over], symbol[over]))
                symbol, segment, rank, into = symbol[~over], segment[~over], rank[~over], into[~over]
                lens, least = lens[least < NONE], least[least < NONE]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lens))
            # Of pairs that overlap the leftmost merges: every other one of a row of neighbours.
            head = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(at - at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]) % 2 == 0]
            first = np.concatenate([[True], segment[at[1:]] != segment[at[:-1]]])
            at = at[first | ~self._early_words(into[at], first)]
            symbol[at] = into[at]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            symbol, segment, rank, into = symbol[left], segment[left], rank[left], into[left]
            new = at - np.arange(len(at))
            rank[new] = NONE
            look(new)
            look(new - 1)
        segments, symbols = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(segments, kind="stable")
        return symbols[order], of_segment[segments[order]]

    def _early_words(self, made: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each merge, whether some merge of its segment in this round makes an early piece."""
        group = np.cumsum(first) - 1
        return np.bincount(group, weights=self.early[made])[group] > 0

    @functools.cached_property
    def made(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.into.tolist(), strict=True), strict=True))

    def _by_pairs(self, symbols: np.ndarray) -> np.ndarray:
        """One segment's symbols, merged by a queue of pairs in order of rank and place."""
        symbol, after, before = symbols.tolist(), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        rank, into = self.pairs(symbols[:-1], symbols[1:])
        queue = [(r, i, a, b, m) for i, (r, a, b, m) in enumerate(zip(rank.tolist(), symbol, symbol[1:], into.tolist())) if r < NONE]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, m = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= len(symbol) or symbol[j] != b:
                continue
            symbol[i], symbol[j], after[i] = m, -1, after[j]
            if after[j] < len(symbol):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(symbol) and (found := self.made.get(symbol[left] * WIDE + symbol[right])):
                    heapq.heappush(queue, (found[0], left, symbol[left], symbol[right], found[1]))
        return np.array([x for x in symbol if x >= 0], np.int64)

    def ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the symbols in order, how many each has): characters that are no piece are spelled in bytes."""
        spelled = symbols >= self.size
        if not spelled.any():
            return symbols.astype(np.int32), np.ones(len(symbols), np.int64)
        text = "".join(map(chr, (symbols[spelled] - self.size).tolist()))
        code = symbols[spelled] - self.size
        lens = np.ones(len(symbols), np.int64)
        lens[spelled] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        out = np.repeat(symbols, lens).astype(np.int32)
        out[np.repeat(spelled, lens)] = self.byte[np.frombuffer(text.encode(), np.uint8)]
        return out, lens

    def text(self, ids: np.ndarray) -> str:
        """What ids spell: control ids nothing, byte ids their byte, and of the first piece the leading space is left out."""
        size = self.shown_at[ids + 1] - self.shown_at[ids]
        ends = np.cumsum(size)
        out = self.shown[np.repeat(self.shown_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        said = np.flatnonzero(~self.control[ids])
        skip = len(said) > 0 and self.leading[ids[said[0]]]
        return out.tobytes()[int(skip) :].decode("utf-8", "tidewire_bytewise")


class PieceEncoder(WordEncoder):
    """ids(texts) -> (all ids, one array; how many each text has), without begin and end."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _split(self, text: str) -> list[str]:
        text = SPACE + text.replace(" ", SPACE)
        lone = self.vocabulary.lone is not None and "\n" in text
        if not lone and SPACE * 2 not in text:
            return [SPACE + w for w in text.split(SPACE)[1:]]
        return re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if lone else f"{SPACE}+[^{SPACE}]*", text)

    def _learn(self) -> None:
        new, self.places.new = self.places.new, []
        lens = np.fromiter(map(len, new), np.int64, len(new))
        codes = np.frombuffer("".join(new).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols, word = self.vocabulary.merged(codes, np.repeat(np.arange(len(new)), lens))
        ids, size = self.vocabulary.ids(symbols)
        per_word = np.bincount(np.repeat(word, size), minlength=len(new))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(per_word)])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.chars += len(codes)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder, which its tasks share one after another."""
    return PieceEncoder(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows doc_id, text -> doc_id, ids."""
        enc = encoder(path)
        for part in small_parts(batches, 1):
            flat, counts = enc.ids([t or "" for t in part.column(1).to_pylist()])
            ends = np.cumsum(counts)
            # The end id goes behind each text's ids.
            ids = np.insert(flat.astype(np.int32), ends, enc.vocabulary.eos)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the ids that the sentencepiece library gives for each whole text with the model of that path, with
    an end id and no sampling.

    A null or empty text has the end id alone. Rows without an id are left out; rows that repeat an id or a text have a row
    each. An empty table gives an empty result, other columns are not read. Very long texts are taken whole; one batch of
    texts of about a megabyte, or one text, is in memory at a time, and nothing is shuffled.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_encoded(model), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows doc_id, ids -> doc_id, ids, text."""
        show = encoder(path).vocabulary.text
        for batch in batches:
            ids, at = batch.column(1), 0
            while at < batch.num_rows:
                part = batch.slice(at, 256)
                at += part.num_rows
                texts = [None if x is None else show(np.asarray(x, np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text: what the library's decode(ids) gives; null for null ids, the empty text for none. Ids must be of the
    model and not null."""
    picked = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(_decoded(model), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
