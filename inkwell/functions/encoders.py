"""Text encoders for embedding jobs. An encoder is any object with encode(texts) -> list of (dense vector, token
vectors, number of tokens); it is made once per Python worker."""

from __future__ import annotations

import hashlib
import re

import numpy as np

_TOKEN = re.compile(r"\w+")


class HashingEncoder:
    """Deterministic stand-in for a neural encoder: every token has a fixed pseudo-random vector."""

    def __init__(self, dim: int = 1024, max_tokens: int = 8192):
        self.dim, self.max_tokens, self._known = dim, max_tokens, {}

    def _token(self, token: str) -> np.ndarray:
        if token not in self._known:
            if len(self._known) >= 20_000:
                self._known.clear()
            v = np.frombuffer(hashlib.shake_128(token.encode()).digest(self.dim), np.uint8) - 127.5
            self._known[token] = v / np.sqrt((v**2).sum())
        return self._known[token]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        out = []
        for t in texts:
            tokens = _TOKEN.findall((t or "").lower())[: self.max_tokens]
            rows = np.stack([self._token(w) for w in tokens]) if tokens else np.empty((0, self.dim))
            dense = rows.sum(axis=0) if tokens else np.zeros(self.dim)
            length = np.sqrt((dense**2).sum())
            out.append((dense / length if length > 0 else dense, rows, len(tokens)))
        return out


class WordLengthEncoder:
    """A plain encoder for tests and queries that SQL can follow: how many words of a text have each length up to dim. It
    refuses texts that hold a given word."""

    def __init__(self, dim: int = 16, refused: str | None = None):
        self.dim, self.refused = dim, refused

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        out = []
        for t in texts:
            words = (t or "").split()
            if self.refused is not None and any(self.refused in w for w in words):
                raise ValueError(f"a word with {self.refused}")
            counts = np.bincount([min(len(w), self.dim) - 1 for w in words], minlength=self.dim).astype(float)
            out.append((counts, counts[None, :], len(words)))
        return out
