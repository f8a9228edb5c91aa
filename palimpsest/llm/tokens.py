"""Byte-level BPE ids at corpus speed: the public tokenizer encodes each distinct word once per worker and batches gather them.

A text is cut before every single space that a non-space character follows. No pre-token of the byte-level pattern
spans such a place (only a run of white space could, and the pattern leaves the run's last space to the next word), so the
ids of the pieces, put together, are the ids of the text. Pieces go through the tokenizers library unchanged. A text that
holds the string of a special token goes through it whole, as the library gives such strings ids of their own.
"""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np

#: Words that a worker remembers (about 200 bytes each); beyond it only those of the texts at hand are kept.
REMEMBER = 250_000
#: The same where a job does nothing but tokenize, and bytes of text that it then takes at once: less work for more memory.
REMEMBER_MORE, MORE_BYTES = 1_200_000, 4 << 20
#: Words that one call of the tokenizer encodes together.
JOIN = 64
#: A space before other white space, and the white space that is not ASCII: texts with these are cut word by word.
RUNS = ("  ", " \t", " \n", " \x0b", " \x0c", " \r")
RARE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def gathered(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words ``which``, end to end, and where each ends; word i has ids[ends[i] : ends[i + 1]]."""
    starts = ends[which]
    lengths = ends[which + 1] - starts
    total = np.cumsum(lengths)
    return (ids[np.repeat(starts - total + lengths, lengths) + np.arange(total[-1])] if len(which) else np.zeros(0, ids.dtype)), total


class BatchEncoder:
    """Encodes lists of texts; keeps the ids of words already seen, up to ``remember`` of them."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember = remember
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level BPE writes a space
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.forget()

    def forget(self, but: set | None = None) -> None:
        """Forgets all words, or all that are not in ``but``."""
        old = [(w, self.index[w]) for w in but if w in self.index] if but else []
        if old:
            words, at = zip(*old)
            ids, ends = np.frombuffer(self.ids, self.dtype), np.frombuffer(self.ends, np.int64)
            kept, stops = gathered(ids, ends, np.array(at))
        self.index: dict = {}
        self.ids = array("H" if self.dtype.itemsize == 2 else "I")
        self.ends = array("q", [0])
        if old:
            self.add(words, kept, stops)

    def learn(self, pieces: set) -> None:
        """Keys are words without the one space before them, or tuples with text as it stands.

        Words are encoded many at a time: only their first id has the space, so the ids part again."""
        plain = [p for p in pieces if isinstance(p, str)]
        for at in range(0, len(plain), JOIN * 256):
            part = plain[at : at + JOIN * 256]
            joined = self.tokenizer.encode_batch_fast([" " + " ".join(part[i : i + JOIN]) for i in range(0, len(part), JOIN)], add_special_tokens=False)
            ids = np.concatenate([np.array(got.ids, self.dtype) for got in joined])
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(part):
                raise ValueError("this vocabulary does not mark the spaces before words; its texts cannot be cut at spaces")
            self.add(part, ids, np.append(starts[1:], len(ids)))
        rest = [p for p in pieces if not isinstance(p, str)]
        for piece, got in zip(rest, self.tokenizer.encode_batch_fast([p[0] for p in rest], add_special_tokens=False)):
            self.add([piece], np.array(got.ids, self.dtype), np.array([len(got.ids)]))

    def add(self, pieces, ids: np.ndarray, ends: np.ndarray) -> None:
        first, at = len(self.ends) - 1, len(self.ids)
        self.index.update(zip(pieces, range(first, first + len(pieces))))
        self.ids.frombytes(ids.tobytes())
        self.ends.frombytes((ends + at).astype(np.int64).tobytes())

    def pieces(self, text: str) -> list:
        """The text cut before each single space that a non-space follows; uncut if it holds the string of a special token."""
        if any(map(text.__contains__, self.specials)):
            return [(text,)]
        words: list = text.split(" ")
        if not (any(map(text.__contains__, RUNS)) or text[-1] == " " or not text.isascii() and RARE.search(text)):
            words[0] = (words[0],)
            return words
        out: list = [(words[0],)]
        for word in words[1:]:
            if word and not word[0].isspace():
                out.append(word if not any(map(str.isspace, word)) else (" " + word,))
            else:
                last = out[-1]
                out[-1] = ((" " + last if isinstance(last, str) else last[0]) + " " + word,)
        return out

    def __call__(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids end in it; ``end`` is appended to every text (null: empty)."""
        flat: list = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                got = self.pieces(text)
                flat += got
                counts[i] = len(got)
        if len(self.index) > self.remember:
            self.forget(set(flat))
        which = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(which < 0)):
            unknown = [flat[i] for i in missing.tolist()]
            self.learn(set(unknown))
            which[missing] = np.fromiter(map(self.index.__getitem__, unknown), np.int64, len(unknown))
        out, total = gathered(np.frombuffer(self.ids, self.dtype), np.frombuffer(self.ends, np.int64), which)
        stops = np.concatenate([[0], total])[np.cumsum(counts)]
        if end is not None:
            out = np.insert(out, stops, end)
            stops = stops + np.arange(1, len(texts) + 1)
        return out, stops


#: Words whose pieces can be counted here, and how vocabularies of lower-case words with word ends cut them. Fixed values.
PLAIN = re.compile("[!-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u00ff]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


class WordEncoder(BatchEncoder):
    """The same for vocabularies that drop white space and mark word ends: texts, given as UTF-8, are cut at all ASCII white space."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.forget()

    @staticmethod
    def parts(word: bytes) -> int:
        """Into how many parts the vocabulary's pattern cuts a word; 0 if that is not known here."""
        if word.isalpha():  # of ASCII
            return 1
        text = word.decode("utf-8", "replace")
        return len(PARTS.findall(text.lower())) if PLAIN.fullmatch(text) and "<|" not in text else 0

    def learn(self, pieces: set) -> None:
        """Plain words are encoded many at a time: the number of their parts tells where each one's ids end."""
        words = list(pieces)
        counts = list(map(self.parts, words))
        plain, rest = [w for w, n in zip(words, counts) if n], [w for w, n in zip(words, counts) if not n]
        ends = np.cumsum([n for n in counts if n])
        for at in range(0, len(plain), JOIN * 256):
            part = plain[at : at + JOIN * 256]
            joined = self.tokenizer.encode_batch_fast([b" ".join(part[i : i + JOIN]).decode() for i in range(0, len(part), JOIN)], add_special_tokens=False)
            ids = np.concatenate([np.array(got.ids, self.dtype) for got in joined])
            stops, upto = np.flatnonzero(self.last[ids]) + 1, ends[at : at + len(part)] - (ends[at - 1] if at else 0)
            if len(stops) != upto[-1]:
                raise ValueError("this vocabulary does not mark the ends of words; its words cannot be encoded together")
            self.add(part, ids, stops[upto - 1])
        for word, got in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
            self.add([word], np.array(got.ids, self.dtype), np.array([len(got.ids)]))

    def pieces(self, text: bytes) -> list:
        return text.split()


_ENCODERS: dict[tuple, BatchEncoder] = {}


def encoder(path: str, remember: int = REMEMBER, kind: type = BatchEncoder) -> BatchEncoder:
    """The worker's own encoder of a tokenizer file; it lives as long as the worker."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = kind(path)
    _ENCODERS[path, kind].remember = remember
    return _ENCODERS[path, kind]


def slices(batch, most_bytes: int = 1 << 20):
    """An Arrow batch in slices of about ``most_bytes``, so that long texts don't pile up in memory; a text is never cut."""
    size = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, most_bytes // size)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
