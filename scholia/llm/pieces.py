"""Splitting texts for the byte-level BPE vocabulary, shared by the encoder and the token counter.

The vocabulary's own pattern never lets a match run from a non-space character into white space, so a text may be cut
before a single space that follows a non-space character; the results of such pieces are kept per worker (a bounded
memory) because natural text repeats them. A text in which a space follows white space, or which holds a special
token, isn't cut that way.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

#: The pattern of the public byte-level vocabulary (a fixed value), with white space as Unicode's property.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Pieces a worker remembers before it starts afresh.
REMEMBERED = 400_000


def default_vocabulary() -> str:
    """Where the public byte-level vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> "Vocabulary":
    """The vocabulary of that file, once per worker."""
    return Vocabulary(path)


class Vocabulary:
    """Tokens as bytes, merges by rank and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *self.special.values()]))
        for token, i in model["vocab"].items():
            self.tokens[i] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.ids = {t: i for i, t in enumerate(self.tokens) if i not in set(self.special.values())}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = [tuple(self.ids[bytes(letters[c] for c in part)] for part in pair) for pair in pairs]
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(0x100 + k)] = b
    return out


def cut(text: str) -> list[str] | None:
    """Pieces of the text, all but the first without their leading space; None if it can't be cut so."""
    pieces = text.split(" ")
    if any(not p or p[-1].isspace() for p in pieces[:-1]):
        return None
    return pieces
