"""Token ids of whole texts, with each distinct word encoded once by a worker.

The word-level vocabulary drops white space and never joins signs across it, so
the ids of a text are the ids of its words, one after the other. A batch of texts
is cut into words and its distinct words are looked up once; their ids are put in the places of
all occurrences by index arithmetic. Words met
before come from a bounded table; new ones are encoded together, with a control
sign of one known id between them. The vocabulary lowers case and takes a sign
after a letter for itself, so an ASCII word is looked up in small letters, and a
closing mark after an ASCII letter apart. Added tokens are found before case is
lowered: a word that holds one is encoded by itself, as the vocabulary does it.
"""

from __future__ import annotations

import os
from unicodedata import normalize

import numpy as np
import pyarrow as pa

from tandem.llm import words

_MARK = "\x01"
_ENCODERS: dict[str, WordEncoder] = {}
#: The name of the encoders among the tables a worker keeps.
TABLE = "encoders"
words.KEPT[TABLE] = _ENCODERS.clear


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        if any(len(token.split()) != 1 or token.split()[0] != token for token in added):
            raise ValueError("an added token holds white space")
        self.added = [(token, token.lower()) for token in added]
        (self.mark,) = self._ids(_MARK)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known, self.older = _Table(), _Table()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_added(self, held: list[bytes], made: dict[bytes, bytes]) -> None:
        """Make the ids of words that hold an added token, each encoded by itself."""
        self.tokenizer.encode_special_tokens = False
        try:
            found = self.tokenizer.encode_batch_fast([w.decode() for w in held], add_special_tokens=False)
        finally:
            self.tokenizer.encode_special_tokens = True
        for word, own in zip(held, found, strict=True):
            made[word] = np.array(own.ids, dtype="<u4").tobytes()

    def _encode_new(self, new: list[bytes], made: dict[bytes, bytes]) -> None:
        # a word of letters alone ends with the first id that ends a word, others with the mark
        letters, others = [], []
        for word in new:
            alone = word.isalpha() if word.isascii() else normalize("NFC", word.decode()).lower().isalpha()
            (letters if alone else others).append(word)
        marked = [w for w in others if b"\x01" not in w]
        for some, between in ((letters, b" "), (marked, f" {_MARK} ".encode())):
            groups = [some[at : at + 256] for at in range(0, len(some), 256)]
            joined = [between.join(group).decode() for group in groups]
            for group, found in zip(
                groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True
            ):
                ids = np.array(found.ids, dtype="<u4")
                skip = int(some is marked)
                last = np.flatnonzero(ids == self.mark) if skip else np.flatnonzero(self.ends[ids]) + 1
                data, start = ids.tobytes(), 0
                for word, end in zip(group, np.append(last, len(ids))[: len(group)].tolist(), strict=True):
                    made[word] = data[4 * start : 4 * end]
                    start = end + skip
        for word in others:
            if b"\x01" in word:
                made[word] = np.array(self._ids(word.decode()), dtype="<u4").tobytes()

    def _learn(self, missing: list[bytes], whole: bool) -> None:
        """Put words into the table, from the older one where they are there; ``whole`` ones in their own case."""
        made = {w: ids for w in missing if (ids := self.older.get(w)) is not None}
        new = [w for w in missing if w not in made]
        if whole:
            self._encode_added([w for w in new if any(token in w for token, _ in self.added)], made)
        self._encode_new([w for w in new if w not in made], made)
        self.known.add(made)

    def _holds_added(self, found: pa.Array) -> bool:
        """Whether an added token is in the words in letters of any case; few batches have one, which one search tells."""
        data = found.buffers()[2].to_pybytes().lower()
        return any(token in data for _, token in self.added)

    def encode_all(
        self, texts: pa.Array, end_id: int | None = None, known_words: int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, and each text's number of ids), with ``end_id`` after each text.

        Tables of more than ``known_words`` words (or ``CACHE_WORDS``) are not carried on; the ids are the same.
        """
        most = words.CACHE_WORDS if known_words is None else known_words
        if len(self.known.number) > most:
            self.older, self.known = self.known, _Table()
        found, counts = words.cut(texts, words.PLAIN)
        # words that hold an added token keep their case, so that it and the token have their own ids
        whole = len(found) > 0 and self._holds_added(found)
        if not whole:
            found, counts = parts_of(found, counts)
        found = found.dictionary_encode()
        distinct = found.dictionary.to_pylist()
        missing = [w for w in distinct if w not in self.known.number]
        if missing:
            self._learn(missing, whole)
        own = np.fromiter(map(self.known.number.__getitem__, distinct), np.int64, len(distinct))
        own = own[found.indices.to_numpy(zero_copy_only=False)]
        sizes = self.known.sizes[own]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.known.ids)) < 1 << 31 else np.int64
        places = np.arange(total, dtype=kind)
        places += np.repeat((self.known.starts[own] - (ends - sizes)).astype(kind), sizes)
        ids = self.known.ids[places]
        stops = np.append(0, ends)[np.cumsum(counts)]
        if end_id is not None:
            ids = np.insert(ids, stops, end_id)
            stops = stops + np.arange(1, len(stops) + 1)
        return ids, np.diff(stops, prepend=0)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        ids, sizes = self.encode_all(pa.array(texts, pa.binary()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []


class _Table:
    """The ids of known words, one after the other."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)

    def get(self, word: bytes) -> bytes | None:
        at = self.number.get(word)
        return None if at is None else self.ids[self.starts[at] : self.starts[at] + self.sizes[at]].tobytes()

    def add(self, made: dict[bytes, bytes]) -> None:
        new = {w: ids for w, ids in made.items() if w not in self.number}
        sizes = np.fromiter(map(len, new.values()), np.int64, len(new)) // 4
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(new.values()), "<u4"))


def _marked(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_IS_CLOSING, _IS_LETTER = _marked(b".,!?;:"), _marked(bytes(range(97, 123)))


def parts_of(found: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words as what their ids are joined from: ASCII words without case, and a closing mark after a letter apart."""
    if not len(found):
        return found, counts
    _, ends, data = found.buffers()
    ends, data = np.frombuffer(ends, np.int32), np.frombuffer(data, np.uint8)
    sizes = np.diff(ends)
    small = _SMALL[data]
    high = data > 127
    ascii_ = np.ones(len(sizes), bool)
    if high.any():
        ascii_ = ~np.logical_or.reduceat(high, ends[:-1])
        small = np.where(np.repeat(ascii_, sizes), small, data)
    last = ends[1:] - 1
    closing = ascii_ & (sizes > 1) & _IS_CLOSING[small[last]] & _IS_LETTER[small[np.maximum(last - 1, 0)]]
    before = np.append(0, np.cumsum(closing))
    bounds = np.append(0, np.cumsum(counts))
    cuts = np.sort(np.concatenate((ends, last[closing])), kind="stable").astype(np.int32)
    made = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(small)])
    return made, counts + np.diff(before[bounds])


def word_encoder(path: str) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
