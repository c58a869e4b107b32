"""Byte-level BPE token ids, exact and cached by word.

The pre-tokenizer of byte-level BPE never joins what stands before a single space to what follows it,
so a text's ids are those of its space-separated pieces, each with its leading space, one after the
other. Pieces repeat, so each Python worker keeps their ids in a bounded cache. Texts where a space
follows white space, or that end in white space, are encoded whole; texts that hold the string of a
special token by `tokenizers` itself, which gives that token's id.

Pieces that are not cached are encoded by `tiktoken` with the ranks read from the same file, if that
library is there and agrees with `tokenizers` on a sample; else by `tokenizers`.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Entries of a worker's cache (about 200 bytes each).
CACHE = 350_000
_ODD = re.compile(r"\s(?=\s*[ ]|\Z)|\A\s")
_SAMPLE = "It's 12 o'clock,\nwe'll  see  what\tÉtienne says: naïve ünïcödé 漢字  x <|end|> end. "
#: The split pattern of byte-level BPE.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Cache(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(self) < CACHE:
            self[piece] = ids
        return ids


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit numbers."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.tokenizer = path, None
        self.whole = self._reference
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = sorted((x["content"] for x in model.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        try:
            self._fast(model, set(added))
            self.tokenizer = None  # loaded again for the rare text that needs it
        except (ImportError, KeyError, ValueError):
            pass
        self.cache = _Cache(self.whole)

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @classmethod
    def forget(cls) -> None:
        """Free all encoders and their caches."""
        cls._open.clear()

    def _reference(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _fast(self, model: dict, special: set[str]) -> None:
        import tiktoken

        if (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space"):
            return
        stand_in = _byte_of()
        ranks = {bytes(stand_in[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        encoding = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        fast = lambda text: np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        if all(fast(x) == self._reference(x) for x in (_SAMPLE, _SAMPLE * 3, "", " ", "\n\n a")):
            self.whole = fast

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return self._reference(text)
        if not text or _ODD.search(text):
            return self.whole(text) if text else b""
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.cache.__getitem__, rest))
