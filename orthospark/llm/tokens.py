"""Encoding whole texts with a public tokenizer file, many words at a time."""

from __future__ import annotations

from struct import pack

import numpy as np

_loaded: dict[str, "WordEncoder"] = {}
#: About how many words' ids each of a worker's two stores keeps, and the longest kept.
KEPT_WORDS, KEPT_CHARS = 250_000, 100
BEYOND = "\u0130"  # letters below it have one lower-case form everywhere
_PARTS = "\x1c\x1d\x1e\x1f"  # Python's split() takes these for white space, the tokenizer doesn't


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space and never joins what it separates.

    A text's ids are then the ids of its words, one after another, so each distinct word is encoded once a worker.
    Words that are equal but for ASCII case share an entry, as the tokenizer lower-cases; a final point or comma is a
    token of its own after letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: int | None = None  # words of a store; KEPT_WORDS if not set
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on.
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.alphabet = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    @staticmethod
    def of(path: str) -> "WordEncoder":
        if path not in _loaded:
            _loaded[path] = WordEncoder(path)
        return _loaded[path]

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """The ids of new words.

        Words of Latin letters alone are one piece each, which the vocabulary's merges take as the letters of the
        byte-level alphabet; the others are encoded in one text and told apart by the tokens' places.
        """
        merge, letters, rest = self.tokenizer.model.tokenize, self.alphabet, []
        for w in words:
            if w.isascii() and w.isalpha():
                pieces = merge(w.lower())
            elif w.isalpha() and max(w) < BEYOND:
                pieces = merge(w.lower().encode().decode("latin-1").translate(letters))
            else:
                rest.append(w)
                continue
            self.known[w] = pack(f"<{len(pieces)}I", *[p.id for p in pieces])
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            places = np.array([x[0] for x in found.offsets], dtype=np.int64)
            sizes = np.fromiter(map(len, part), dtype=np.int64) + 1
            cuts = [*np.searchsorted(places, np.cumsum(sizes) - sizes).tolist(), len(places)]
            raw = np.array(found.ids, dtype="<u4").tobytes()
            self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cuts, cuts[1:]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split, whole = [], {}
        for i, x in enumerate(texts):
            x = x or ""
            if any(c in x for c in _PARTS):
                whole[i], x = self.encoded(x), ""
            split.append((x.lower() if x.isascii() and "<|" not in x else x).split())
        if len(self.known) > (self.kept or KEPT_WORDS):  # words in use come back from the older store, the others go with it
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [w for w in set().union(*split) if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in known]
        tails = [w for w in new if w[-1] in ".," and len(w) > 1 and w[:-1].isalpha() and max(w) < BEYOND]
        plain = set(new).difference(tails)
        plain.update(w[:-1] for w in tails)
        plain.update(w[-1] for w in tails)
        self.learn([w for w in plain if w not in known])
        known.update((w, known[w[:-1]] + known[w[-1]]) for w in tails)
        out = [b"".join(map(known.__getitem__, w)) for w in split]
        for w in new:
            if len(w) > KEPT_CHARS:
                del known[w]
        for i, ids in whole.items():
            out[i] = ids
        return out
