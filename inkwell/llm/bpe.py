"""BPE encoding and decoding with a pair occurrence index.

A partition is worked through in slices of bounded size, so that an index fits any memory. The distinct words of a
slice that are not remembered from earlier ones are laid out as one array of symbols. An index maps every adjacent pair
that has a merge rank to all the positions where it stands; the active ranks are taken in ascending order, each merge
is applied to all its positions at once, and the pairs that it creates left and right are added to the index (a lower
rank that becomes active is taken next). Words are independent and inside a word the lowest rank always goes first, so
this gives the same symbols as merging word by word. The ids of finished pieces are remembered, up to MEMORY_BYTES in
each Python worker; ids as text and the decoded text are made from the ids of each document.

The vocabulary file is one of the tokenizers library's JSON files with a BPE model of words (``</w>`` suffix), NFC,
white space and lower-case normalisers, a removing split pattern and the byte-level alphabet. No text is truncated or
padded and no special tokens are added; where the strings of special tokens stand in a text they become their ids.

Defined results: a null or empty text, or one of white space only, has no ids, and the empty text is decoded from it.
Rows that repeat an id are encoded one by one, a null id is passed through. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkwell.llm.common import Memory, slices

#: What an encoder may remember; a Python worker holds one encoder for each vocabulary file that it meets.
MEMORY_BYTES = 24 << 20
_SPACES = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
#: Characters that Python's split() takes for white space and Unicode does not.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexEncoder:
    """Words to ids with one vocabulary file, which is read where the encoder is made."""

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab.update(self.special)
        self.token = {i: t for t, i in self.vocab.items()}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.first_char = {s[0] for s in self.special}
        alphabet = byte_alphabet()
        self.of_byte = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.of_last = np.array([self.vocab[c + self.suffix] for c in alphabet], np.int64)
        self.base = max(self.vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        codes = np.array([self.vocab[a] * self.base + self.vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.memory = Memory(memory_bytes)
        self.kind = "<u2" if self.base <= 1 << 16 else "<u4"
        self.numbers = list(map(str, range(self.base)))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of symbols, -1 where there is no merge."""
        code = a * self.base + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word (its bytes, not empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sym = self.of_byte[raw]
        sym[ends - 1] = self.of_last[raw[ends - 1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Index the pairs that start at these positions."""
            rank = self.rank_of(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        add(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a)]
            nxt = after[at]
            fit = nxt >= 0
            at, nxt = at[fit], nxt[fit]
            fit = sym[nxt] == b
            at, nxt = at[fit], nxt[fit]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair merges, from the left
                keep, taken = [], -1
                for p, q in zip(at.tolist(), nxt.tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep, np.int64)
                nxt = after[at]
            sym[at] = self.made[r]
            alive[nxt] = False
            over = after[nxt]
            after[at] = over
            inner = over >= 0
            before[over[inner]] = at[inner]
            lefts = before[at]
            add(np.unique(np.concatenate([lefts[lefts >= 0], at[inner]])))
        where = np.flatnonzero(alive)
        return np.split(sym[where], np.searchsorted(where, ends[:-1]))

    def _normal(self, piece: str) -> str:
        piece = unicodedata.normalize("NFC", piece)
        low = piece.lower()
        return "".join(map(str.lower, piece)) if "Σ" in piece else low  # each character by itself: no final sigma

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces (texts without white space) and remember the result."""
        plans, words = [], {}
        for p in pieces:
            plan = []
            for part in self.cut_special.split(p) if not self.first_char.isdisjoint(p) else (p,):
                if part in self.special:
                    plan.append(self.special[part])
                elif part:
                    for w in self.split.findall(self._normal(part)):
                        plan.append(words.setdefault(w.encode("utf-8", "surrogatepass"), len(words)) - (1 << 40))
            plans.append(plan)
        done = [a.astype(self.kind).tobytes() for a in self.encode_words(list(words))] if words else []
        self.memory.add({p: b"".join([done[x + (1 << 40)] if x < 0 else np.array(x, self.kind).tobytes() for x in plan]) for p, plan in zip(pieces, plans, strict=True)})

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        cut = []
        for t in texts:
            t = t or ""
            cut.append(t.split() if not _SEPARATORS.search(t) else [p for p in _SPACES.split(t) if p])
        self.learn(list(self.memory.missing(set().union(*cut))))
        known = self.memory.young
        return [np.frombuffer(b"".join(map(known.__getitem__, ps)), self.kind).tolist() for ps in cut]

    def ids(self, text: str | None) -> list[int]:
        return self.encode([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space: what a file without a decoder gives; special tokens are kept, ids that the
        vocabulary lacks are left out."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


@lru_cache(maxsize=2)
def pair_index_encoder(path: str) -> PairIndexEncoder:
    """The encoder of this Python worker; what it remembers serves all of the worker's tasks."""
    return PairIndexEncoder(path)


def _encoded(documents: DataFrame, path: str, columns: str, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_index_encoder(path)
        for b in slices(batches, 1024):
            done = [make(encoder, ids) for ids in encoder.encode(b.column("text").to_pylist())]
            rows = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], ["doc_id", *names])

    names = [c.split(" ")[0] for c in columns.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[c.split(" ")[1]] for c in columns.split(", ")]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {columns}")


def encode_bpe(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of every whole text. The decoded text comes from the ids' tokens."""
    return _encoded(documents, path, "ids array<int>, decoded string", lambda encoder, ids: (ids, encoder.decode(ids)))


def bpe_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_bpe, but only digests leave the tasks."""

    def make(encoder, ids):
        numbers = " ".join(map(encoder.numbers.__getitem__, ids))
        return len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()

    return _encoded(documents, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
