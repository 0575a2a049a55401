"""Token ids by the tokenizers library, one distinct word at a time.

The vocabulary cuts text at white space before it merges, so a text's ids are
those of its words. A worker asks the library only for words it has not met
(up to a bound) and looks up the rest.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

#: Distinct words kept by a worker before it starts anew.
KEPT_WORDS = 900_000
END_OF_WORD = "</w>"
#: Characters of a text that are encoded at a time, up to the next space.
SLICE = 1 << 20
#: A full stop or comma that may belong to a longer run of signs. U+001C to U+001F are white space to Python, signs to the library.
_RUN_OF_SIGNS = re.compile(r"(?:[^\w\s]|[_\x1c-\x1f])[.,]")


def folded(text: str) -> str | None:
    """The text in small letters where that changes none of the library's ids, else as it is; None if words can't be told apart beforehand.

    The library composes marks (NFC) before it folds. A text that is composed
    already, and still is in small letters, comes out the same either way. A
    capital sigma's small form depends on its place in Python only; of a
    dotted capital I the library makes two characters, one of them no letter.
    """
    if text.isascii():
        return text.lower()
    if "\u0130" in text or not unicodedata.is_normalized("NFC", text):
        return None
    low = text if "\u03a3" in text else text.lower()
    return low if unicodedata.is_normalized("NFC", low) else text


def slices(text: str) -> list[str]:
    """The text in pieces of some SLICE characters, cut before spaces."""
    out, lo = [], 0
    while len(text) - lo > SLICE:
        hi = text.find(" ", lo + SLICE)
        if hi < 0:
            break
        out.append(text[lo:hi])
        lo = hi
    return [*out, text[lo:]] if lo else [text]


class _Words(dict):
    """Numbers words as they are met; each is a stem and perhaps a full stop or comma."""

    def __init__(self):
        super().__init__()
        self.stems: dict[str, int] = {"": 0}
        self.fresh: list[str] = []
        self.parts: list[int] = []

    def _stem(self, stem: str) -> int:
        at = self.stems.get(stem)
        if at is None:
            self.stems[stem] = at = len(self.stems)
            self.fresh.append(stem)
        return at

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        if len(word) > 1 and word[-1] in ".," and word[:-1].isalpha():
            self.parts += self._stem(word[:-1]), self._stem(word[-1])
        else:
            self.parts += self._stem(word), 0
        return number


class WordEncoder:
    """ids of whole texts, equal to the library's with add_special_tokens=False."""

    def __init__(self, vocabulary: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.encode_special_tokens = special_as_text
        self.specials = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith(END_OF_WORD)
        self.forget()

    def forget(self) -> None:
        self.words = _Words()
        self.parts = np.zeros((0, 2), np.int64)
        self.flat = np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _ask(self, stems: list[str]) -> None:
        """Adds the library's ids of new stems.

        Stems of letters only are asked for in long runs: each is one unit of
        merging, so the tokens that end a word tell them apart.
        """
        starts, sizes = np.zeros(len(stems), np.int64), np.zeros(len(stems), np.int64)
        parts, base = [self.flat], len(self.flat)
        plain = [i for i, w in enumerate(stems) if w.isalpha()]
        runs = [plain[lo : lo + 256] for lo in range(0, len(plain), 256)]
        rest = [i for i, w in enumerate(stems) if not w.isalpha()]
        for run, e in zip(runs, self.library.encode_batch_fast([" ".join(stems[i] for i in r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(run) and cuts[-1] == len(ids):
                sizes[run] = np.diff(cuts, prepend=0)
                starts[run] = base + cuts - sizes[run]
                parts.append(ids)
                base += len(ids)
            else:
                rest += run
        for i, e in zip(rest, self.library.encode_batch_fast([stems[i] for i in rest], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            starts[i], sizes[i] = base, len(ids)
            parts.append(ids)
            base += len(ids)
        self.flat = np.concatenate(parts)
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])

    def _misread(self, text: str, low: str) -> bool:
        """Whether folding has made a special token of other letters."""
        return "<|" in low and any(low.count(t) != text.count(t) for t in self.specials)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has. A null text is empty.

        A text is encoded in slices, so that one of any length takes little
        more memory than its ids; the library never joins across a space.
        """
        cut = [slices(t or "") for t in texts]
        ids, sizes = self._encode([x for xs in cut for x in xs])
        if len(sizes) > len(texts):
            sizes = np.add.reduceat(sizes, np.cumsum([0, *map(len, cut[:-1])]))
        return ids, sizes

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > KEPT_WORDS:
            self.forget()
        words: list[str] = []
        whole: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                low = folded(text)
                if low is None:
                    whole.append(k)
                    continue
                text = (text if self._misread(text, low) else low).replace("\n", " ")
                if not _RUN_OF_SIGNS.search(text):  # then the sign before a space is a unit of its own
                    text = text.replace(", ", " , ").replace(". ", " . ")
                found = text.split(" ")
                words += found
                counts[k] = len(found)
        number = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.fresh:
            self._ask(self.words.fresh)
            self.words.fresh = []
        if self.words.parts:
            self.parts = np.concatenate([self.parts, np.array(self.words.parts, np.int64).reshape(-1, 2)])
            self.words.parts = []
        stems = self.parts[number].ravel()
        sizes = self.sizes[stems]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[stems] - ends + sizes, sizes) + np.arange(total)]
        edges = np.concatenate([[0], ends])[2 * np.concatenate([[0], np.cumsum(counts)])]
        if not whole:
            return ids, np.diff(edges)
        each = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for k, e in zip(whole, self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False), strict=True):
            each[k] = np.array(e.ids, np.int32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str, special_as_text: bool = False) -> WordEncoder:
    """The worker's encoder for a vocabulary file's content; the last one made is kept."""
    key = f"{hashlib.sha256(vocabulary.encode()).hexdigest()}-{special_as_text}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(vocabulary, special_as_text)
    return _encoders[key]
