"""Byte-level merges of many words at once, in numpy, from a public tokenizer file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from dossierlake.llm._tokenizer import tokenizer_path

#: Longer words go to the library.
LONGEST = 64
_NONE = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


class Merges:
    """Merges the bytes of a word: again and again the leftmost pair of the lowest rank."""

    def __init__(self, tokenizer: str):
        with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.inner, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in byte_alphabet().items():
            self.inner[b], self.final[b] = vocab[c], vocab[c + suffix]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges, and -1 for none."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at[(self.keys[at] != key) | (a < 0) | (b < 0)] = -1
        return at

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self._find(a, b)
        return np.where(at < 0, _NONE, self.rank[at])

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word of 1 to ``LONGEST`` bytes."""
        sizes = np.array([len(w) for w in words])
        out: list = [None] * len(words)
        edge = 0
        for width in (4, 8, 12, 16, 24, 40, LONGEST):
            mine = np.flatnonzero((sizes > edge) & (sizes <= width))
            edge = width
            if len(mine):
                grid, n = self._merge(b"".join(words[i].ljust(width, b"\0") for i in mine), sizes[mine], width)
                for i, row, k in zip(mine.tolist(), grid, n.tolist(), strict=True):
                    out[i] = row[:k]
        return out

    def _merge(self, raw: bytes, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(raw, np.uint8).reshape(-1, width)
        ids = self.inner[data]
        rows = np.arange(len(ids))
        ids[rows, sizes - 1] = self.final[data[rows, sizes - 1]]
        ids[np.arange(width) >= sizes[:, None]] = -1
        ids = np.concatenate([ids, np.full((len(ids), 1), -1, np.int32)], 1)
        n = sizes.copy()
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        done, live = ids.copy(), rows
        columns = np.arange(width + 1)
        while len(live):
            at = ranks.argmin(1)
            k = np.arange(len(live))
            more = ranks[k, at] != _NONE
            if not more.all():
                stop = ~more
                done[live[stop]] = ids[stop]
                live, ids, ranks, at = live[more], ids[more], ranks[more], at[more]
                k = np.arange(len(live))
                if not len(live):
                    break
            new = self.made[self._find(ids[k, at], ids[k, at + 1])]
            shift = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, width] = -1
            ids[k, at] = new
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :-1], width - 1), 1)
            ranks[:, width - 1] = _NONE
            ranks[k, at] = self._ranks(ids[k, at], ids[k, at + 1])
            left = at > 0
            ranks[k[left], at[left] - 1] = self._ranks(ids[k[left], at[left] - 1], ids[k[left], at[left]])
            n[live] -= 1
        return done, n


@lru_cache(maxsize=4)
def merges(tokenizer: str) -> Merges:
    return Merges(tokenizer)
