"""Token ids of texts by a public word tokenizer, with a bounded memory of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

# Words that a task remembers, some hundred bytes each; it starts anew when they are full.
REMEMBERED = 800_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts from ids of their words.

    Made for tokenizers that drop white space and never join over it: the ids of a text are then those of its
    parts between ASCII white space, one after the other. Parts seen before are looked up. Ids
    equal those of encoding the whole text, which the tests check; strings of special tokens give their ids.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def ids(self, raw: bytes) -> np.ndarray:
        """Unsigned 32-bit ids of a text, without special tokens."""
        # Special tokens are told by case.
        parts = (raw.lower() if raw.isascii() and b"<|" not in raw else raw).split()
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype="<u4")
        except KeyError:
            missing = {p for p in parts if p not in self.known}
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {p: self.known[p] for p in set(parts) - missing}
        self._learn(missing)
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), dtype="<u4")

    def _learn(self, missing: set[bytes]) -> None:
        whole, pairs, others = [], [], []
        for part in missing:
            text = part.decode("utf-8", "replace")
            if text.isalpha():
                whole.append((part, text))
            elif text[-1] in ".," and text[:-1].isalpha():
                pairs.append((part, text))
            else:
                others.append((part, text))
        # A part of letters is one word of the tokenizer, so many of them can be encoded as one text and cut at word ends.
        letters = [(p, t) for p, t in whole] + [(p, t[:-1]) for p, t in pairs]
        for start in range(0, len(letters), 1000):
            some = letters[start : start + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(t for _, t in some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, edges = ids.tobytes(), [0, *(cuts * ids.itemsize).tolist()]
                found = [raw[x:y] for x, y in zip(edges, edges[1:])]
            else:
                found = [self._alone(t).tobytes() for _, t in some]
            self.known.update(zip((part for part, _ in some), found))
        for part, text in pairs:
            self.known[part] += self._mark(text[-1])
        for part, text in others:
            self.known[part] = self._alone(text).tobytes()

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    @lru_cache  # noqa: B019
    def _mark(self, mark: str) -> bytes:
        return self._alone(mark).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this process."""
    return WordEncoder(path)
