"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text falls into pieces by the split pattern; a piece that is itself in the vocabulary is one
id. The others are dealt into buckets by byte length and become rows of padded id matrices. In
each round every row merges its leftmost pair of least rank and closes the gap, so all rows of a
matrix shrink by one column; rows without a pair in the table leave. Pairs are found in an
open-addressing hash table of (left id, right id), probed for a whole matrix at once. Pieces
beyond ``MATRIX_BYTES`` (rare: no space for a thousand bytes) merge by a heap, with the same result.

Texts repeat words, so what lies between two single spaces (with the space before it) is encoded
once and kept in a bounded table of the worker. That cuts only where the pattern cuts too: texts
with white space after a space take the pattern as a whole.

Defined results: a null text is empty and has no ids; rows stay one to one, in order, repeated
rows included; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

NONE = np.int32(2**31 - 1)
MATRIX_BYTES = 1024
CELLS = 1 << 19
KEPT = 200_000
KEPT_CHARS = 48
SLICE = 512


class PairTable:
    """Open addressing over 64-bit keys left << 32 | right."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.vals = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            claim = todo[free]
            self.keys[at[claim]] = keys[claim]  # of several claims on a slot the last stays
            won = self.keys[at[claim]] == keys[claim]
            self.vals[at[claim[won]]] = rank[claim[won]]
            todo = np.concatenate([todo[~free], claim[~won]])
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair's rank, else NONE; negative ids are padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[todo].astype(np.int64) << 32) | right[todo].astype(np.int64)
        at = self._slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            out[todo[hit]] = self.vals[at[hit]]
            on = ~hit & (there != -1)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    """Encoder and decoder of one vocabulary of byte strings and ranks (a rank is the token's id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        n = max(ranks.values()) + 1
        self.tokens = [b""] * n
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_id = np.full(256, -1, dtype=np.int32)
        for b in range(256):
            self.byte_id[b] = ranks[bytes([b])]
        left, right, rank = [], [], []
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.pair_rank: dict[tuple[int, int], int] | None = None
        self.bytes_of = self._gatherer(self.tokens)
        self.digits_of = self._gatherer([b"%d " % i for i in range(n)])
        self.inner: dict[str, bytes] = {}
        self.outer: dict[str, bytes] = {}

    # --- merging -------------------------------------------------------------------------------

    def _merge_matrix(self, m: np.ndarray, lens: np.ndarray, where: np.ndarray, out: list) -> None:
        rank = self.pairs.find(m[:, :-1], m[:, 1:])
        while len(m):
            if not rank.shape[1]:
                break
            at = rank.argmin(axis=1)  # the first of equals: the leftmost
            least = rank[np.arange(len(m)), at]
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[where[i]] = m[i, : lens[i]].tobytes()
                go = ~done
                m, rank, lens, where, at, least = m[go], rank[go], lens[go], where[go], at[go], least[go]
                if not len(m):
                    return
            rows = np.arange(len(m))
            m[rows, at] = least
            stay = np.ones(m.shape, dtype=bool)
            stay[rows, at + 1] = False
            m = m[stay].reshape(len(m), -1)
            stay = np.ones(rank.shape, dtype=bool)
            stay[rows, at] = False
            rank = rank[stay].reshape(len(m), -1)
            lens = lens - 1
            if rank.shape[1]:
                width = rank.shape[1]
                before = np.flatnonzero(at > 0)
                rank[before, at[before] - 1] = self.pairs.find(m[before, at[before] - 1], m[before, at[before]])
                after = np.flatnonzero(at < width)
                rank[after, at[after]] = self.pairs.find(m[after, at[after]], m[after, at[after] + 1])
        for i in range(len(m)):
            out[where[i]] = m[i, : lens[i]].tobytes()

    def _merge_long(self, piece: bytes) -> bytes:
        if self.pair_rank is None:
            keep = self.pairs.keys >= 0
            keys = self.pairs.keys[keep].tolist()
            self.pair_rank = {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(keys, self.pairs.vals[keep].tolist(), strict=True)}
        rank_of, ids, n = self.pair_rank.get, self.byte_id[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (x := rank_of((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (p := prv[i]) >= 0 and (x := rank_of((ids[p], r))) is not None:
                heapq.heappush(heap, (x, p, ids[p], r))
        return np.array([x for x in ids if x is not None], dtype=np.int32).tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian 32-bit integers."""
        out: list = [None] * len(pieces)
        by_len: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) > MATRIX_BYTES:
                out[i] = self._merge_long(p)
            elif p:
                by_len.setdefault((len(p) - 1).bit_length(), []).append(i)
            else:
                out[i] = b""
        for bits, which in by_len.items():
            step = max(1, CELLS >> bits)
            for at in range(0, len(which), step):
                part = which[at : at + step]
                lens = np.array([len(pieces[i]) for i in part])
                width = int(lens.max())
                m = np.full((len(part), width), -1, dtype=np.int32)
                m[np.arange(width) < lens[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                self._merge_matrix(m, lens, np.array(part), out)
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        found = [[p.encode("utf-8", "replace") for p in self.pattern.findall(c)] for c in chunks]
        unique = list({p for pieces in found for p in pieces})
        ids = dict(zip(unique, self.encode_pieces(unique), strict=True))
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in found]

    #: A space before white space: there the pattern need not cut before the space.
    _joined = re.compile(r" [\s\x1c-\x1f]")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        split = []
        new_inner: set[str] = set()
        new_outer: set[str] = set()
        for t in texts:
            if self._joined.search(t):
                parts = None
                new_outer.update((t,))
            else:
                first, *parts = t.split(" ")
                new_outer.add(first)
                new_inner.update(parts)
            split.append(parts if parts is None else (first, parts))
        for table, new, lead in ((self.inner, new_inner, " "), (self.outer, new_outer, "")):
            new.difference_update(table)
            todo = list(new)
            for at in range(0, len(todo), 20_000):
                some = todo[at : at + 20_000]
                table.update(zip(some, self._encode_chunks([lead + c for c in some]), strict=True))
        out = []
        inner, outer = self.inner.__getitem__, self.outer
        for t, s in zip(texts, split, strict=True):
            out.append(outer[t] if s is None else outer[s[0]] + b"".join(map(inner, s[1])))
        self._forget(new_inner, new_outer)
        return out

    def _forget(self, new_inner: set[str], new_outer: set[str]) -> None:
        self.outer.clear()
        if len(self.inner) > KEPT:
            self.inner.clear()
        else:
            for c in new_inner:
                if len(c) > KEPT_CHARS:
                    del self.inner[c]

    # --- decoding ------------------------------------------------------------------------------

    @staticmethod
    def _gatherer(parts: list[bytes]):
        """A function from ids to the joined parts."""
        lens = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        blob = np.frombuffer(b"".join(parts), np.uint8)

        def gather(ids: np.ndarray) -> bytes:
            out = []
            for at in range(0, len(ids), 1 << 16):
                some = ids[at : at + (1 << 16)]
                n = lens[some]
                ends = np.cumsum(n)
                out.append(blob[np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1])].tobytes())
            return b"".join(out)

        return gather

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes_of(ids)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The vocabulary's codec, once per process; ``path`` is a rank file (base64 token, rank)."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _codecs[path, pattern] = Codec(ranks, pattern)
    return _codecs[path, pattern]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>): the whole text's ids."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in _slices(batches):
            ids = c.encode(b.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    rows = _input(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text_bytes): the bytes the ids stand for; null ids are none."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in _slices(batches):
            got = [c.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["doc_id", "text_bytes"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_bytes binary")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids if wanted): encodes, decodes the ids, and
    returns digests of both, in one pass."""
    path = path or default_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in _slices(batches):
            n, ids_sha, text_sha = [], [], []
            encoded = c.encode(b.column(1).to_pylist())
            for x in encoded:
                ids = np.frombuffer(x, np.int32)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(c.digits_of(ids)[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = _input(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
