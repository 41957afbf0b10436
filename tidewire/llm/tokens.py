"""Token ids of whole texts by the tokenizers library, a word at a time.

Both kinds of vocabulary used here cut a text into words before they merge, and always cut between a run of letters and
what is no letter (but for apostrophes) and before a space that follows no white space. So a text is cut there, each
distinct part is encoded once and remembered, and a text's ids are its parts' ids in order: the ids that the library
gives for the whole text. A part of Latin-1 letters alone is one word, which goes to the library's merges directly; any
other goes through the whole tokenizer, and so does the whole of a text that spells a special token, which the library
takes for that token.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np

#: Parts and characters that a worker remembers; beyond, it keeps the most used third, which changes nothing but speed.
REMEMBERED, REMEMBERED_CHARS = 600_000, 12_000_000

#: White space that isn't one space between others: such texts, and those beyond Latin-1, are cut before spaces only.
_ODD_SPACES = ("  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PARTS = re.compile(f" ?[{_LETTER}]++(?!')| ?[^{_LETTER}' ]++(?!')| ?[^ ]+| ")
#: How byte-level vocabularies write a byte: printable ones as they are, the others as the characters from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - _SHOWN))}


class _Places(dict):
    """part -> its number, in order of first sight; new: the parts seen first since it was emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        self.new.append(part)
        return n


class WordEncoder:
    """ids(texts) -> (all ids, one array; how many each text has). lower: the vocabulary is of lower case."""

    def __init__(self, path: str, lower: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.places, self.chars, self.uses = _Places(), 0, np.zeros(0, np.int32)
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _thin(self) -> None:
        """Keep the third of the parts that was used most, if it isn't too long itself."""
        names, uses, starts, flat = list(self.places), self.uses, self.starts, self.flat
        self._forget()
        third = max(2, int(np.partition(uses, -(len(uses) // 3 or 1))[-(len(uses) // 3 or 1)]))
        kept = [i for i in np.flatnonzero(uses > third).tolist() if len(names[i]) <= 32]
        for i in kept:
            self.places[names[i]]
        self.places.new, self.chars = [], sum(len(names[i]) for i in kept)
        size = np.diff(starts)[kept]
        ends = np.cumsum(size)
        self.starts = np.concatenate([[0], ends]).astype(np.int64)
        self.flat = flat[np.repeat(starts[kept] - (ends - size), size) + np.arange(int(size.sum()))]
        self.uses = np.minimum(uses[kept], 1000) // 2

    def _word(self, part: str) -> str | None:
        """The part as the merges see it, if it is one word of Latin-1 letters."""
        core = part[1:] if part[0] == " " else part
        if not core.isalpha() or (self.lower and not core.islower()):
            return None
        if not core.isascii():
            if max(core) > "\xff":
                return None
            core = core.encode().decode("latin-1").translate(_BYTE)
        return core if self.lower or part[0] != " " else _BYTE[32] + core

    def _learn(self) -> None:
        new, self.places.new = self.places.new, []
        merged = self.tokenizer.model.tokenize
        found = [[t.id for t in merged(w)] if (w := self._word(p)) else None for p in new]
        others = [i for i, x in enumerate(found) if x is None]
        for i in range(0, len(others), 8192):
            own = others[i : i + 8192]
            for k, e in zip(own, self.tokenizer.encode_batch_fast([new[k] for k in own], add_special_tokens=False), strict=True):
                found[k] = e.ids
        more = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(more)])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(more.sum()))])
        self.chars += sum(map(len, new))

    def _split(self, text: str) -> list[str]:
        if any(x in text for x in self.special):
            return [text]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _BEFORE_SPACE.split(text)
        if self.lower:
            text = text.lower()
        odd = text[0].isspace() or text[-1].isspace() or any(x in text for x in _ODD_SPACES)
        return _BEFORE_SPACE.split(text) if odd else _PARTS.findall(text)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._thin()
        parts, per_text = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            split = self._split(text) if text else []
            parts += split
            per_text[i] = len(split)
        place = np.fromiter(map(self.places.__getitem__, parts), np.int64, len(parts))
        if self.places.new:
            self._learn()
        used = np.bincount(place, minlength=len(self.places)).astype(np.int32)
        used[: len(self.uses)] += self.uses
        self.uses = used
        size = self.starts[place + 1] - self.starts[place]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(self.starts[place] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return out, np.diff(bounds)


@functools.lru_cache(maxsize=1)
def encoder(path: str, lower: bool) -> WordEncoder:
    """The worker's encoder, which its tasks share one after another."""
    return WordEncoder(path, lower)
