"""Byte-level BPE of one text inside a task.

A space after a Latin character that is not white space always starts a new
pre-token, whatever surrounds it, so a text can be cut there and the parts
encoded apart with the same result. Latin parts are encoded by tiktoken with the
ranks of the same vocabulary file, which takes a third of the time; others,
whose character classes the two libraries could see differently, by the
tokenizers library itself. So are parts with a run of ``LONG`` white space
characters or more, on which tiktoken's pattern would exhaust its stack.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import groupby
from pathlib import Path

import numpy as np
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

_SAFE_CUT = re.compile("(?<=[!-~\u00c0-\u024f])(?= )")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: White space characters in a row that tiktoken surely takes; it fails at a million.
LONG = 100_000
_LONG_RUN = re.compile(r"(?<!\s)\s{%d}" % LONG)  # looked for where a run begins only, so in linear time


def _needs_library(text: str) -> bool:
    return bool(_BEYOND_LATIN.search(text)) or (len(text) >= LONG and bool(_LONG_RUN.search(text)))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        stand_in = _byte_alphabet()
        added = {i: t.content for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.token_bytes: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = added[i].encode() if i in added else bytes(stand_in[c] for c in token)
        self.lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.dtype = np.dtype("<u2") if len(self.token_bytes) <= 1 << 16 else np.dtype("<u4")
        self.ranks = self._ranks(path, added)

    def _ranks(self, path: str, added: dict[int, str]) -> tiktoken.Encoding | None:
        """The same vocabulary for tiktoken, if ids follow the order of the merges and pre-tokens its pattern."""
        spec = json.loads(Path(path).read_text())
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        vocab = model["vocab"]
        if [vocab[m] for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
            return None
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            return None
        ranks = {self.token_bytes[i]: i for i in vocab.values() if i not in added}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t: i for i, t in added.items()})

    def by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _by_ranks(self, text: str) -> np.ndarray:
        return self.ranks.encode_to_numpy(text, allowed_special="all").astype(self.dtype)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, as the library gives them."""
        if not text:
            return np.empty(0, self.dtype)
        if not self.ranks:
            return self.by_library(text)
        if not _needs_library(text):
            return self._by_ranks(text)
        runs = groupby(_SAFE_CUT.split(text), key=_needs_library)
        return np.concatenate([(self.by_library if beyond else self._by_ranks)("".join(parts)) for beyond, parts in runs])

    def decode_bytes(self, ids) -> bytes:
        table = self.token_bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        """As the library's decode without skipping special tokens."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    return Encoder(path)
