"""Token ids of whole texts by a byte-level BPE vocabulary file.

The file is one of tokenizers; tiktoken runs the same merges several times faster. Texts
that hold the string of a special token, or a run of blanks too long for tiktoken, go
through tokenizers itself.
"""

from __future__ import annotations

import json
import sys
from array import array

import numpy as np

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
assert array("I").itemsize == 4 and sys.byteorder == "little"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """path: a tokenizers JSON file of a byte-level BPE. The ids are those that
    tokenizers gives with add_special_tokens=False."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self._exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_of()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self._bpe = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.token_bytes = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        for token, i in self.special.items():
            self.token_bytes[i] = len(token.encode())

    def exact(self, text: str) -> bytes:
        """By tokenizers itself."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return np.asarray(self._exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as unsigned little-endian 32-bit integers."""
        if not text:
            return b""
        for s in self.special:
            if s in text:
                return self.exact(text)
        try:
            return array("I", self._bpe.encode_ordinary(text)).tobytes()
        except BaseException as e:  # its regular expression runs out of stack in a million blanks
            if type(e).__name__ != "PanicException":
                raise
            return self.exact(text)


_known: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _known:
        _known[path] = Encoder(path)
    return _known[path]
