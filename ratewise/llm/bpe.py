"""Token ids of whole texts for a byte-level BPE vocabulary file (``tokenizers`` JSON).

The vocabulary of the JSON file drives two encoders that give the same ids: the
``tokenizers`` library itself, and ``tiktoken`` with the file's vocabulary as
merge ranks, which is several times faster on prose.  The fast one is used where
the file allows it (ids of merges in merge order, bytes as the base), else the
library's own.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np


def default_path() -> str:
    """The installed public 50k byte-level BPE file."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts under one vocabulary file; special-token strings are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in specials}
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))])
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self._library = None
        self._fast = self._ranked(spec, vocab)

    @staticmethod
    def _ranked(spec: dict, vocab: dict[str, int]):
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            return None
        import public_tokenizers
        import tiktoken
        merged = [m if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        ids = [vocab[m.replace(" ", "")] for m in merged]
        if ids != sorted(ids):
            return None
        byte_of = _byte_of_char()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text (NULL is the empty text)."""
        if not text:
            return np.empty(0, self.dtype)
        text = text.encode("utf-8", "replace").decode()
        if self._fast is not None:
            try:
                return np.array(self._fast.encode_ordinary(text), dtype=self.dtype)
            except BaseException as e:  # the fast encoder's regex engine panics on some endless runs
                if "Panic" not in type(e).__name__ and not isinstance(e, (ValueError, OverflowError)):
                    raise
        return self._slow(text)

    def count(self, text: str) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    return Encoder(path)
