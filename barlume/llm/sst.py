"""Token ids of documents in sorted-string-table shards.

A shard holds documents in ascending key order: blocks of prefix-compressed entries, a sparse
index of the blocks' first keys, a Bloom filter over the keys and a footer of fixed length. A
lookup reads footer, filter and index, finds the one block by binary search and scans it.

    file    = block* index filter footer
    block   = zstd(entry*); a block starts anew, its first entry shares nothing
    entry   = varint shared, varint rest, varint value length, rest of the key, value
    key     = 0x00 for null, else 0x01 and the id's 8 bytes, big-endian, sign bit turned
    value   = width (2 or 4), ids as little-endian integers of that width
    index   = zstd((varint key length, key, u64 offset, u32 length, u32 entries)*)
    filter  = bits; a key sets 7 of them (two halves of its XXH64)
    footer  = u64 index offset, u32 length, u64 filter offset, u32 length, u64 entries, u64 ids, magic

The documents are dealt by range of the id, so shards follow each other, and sorted within. A
shard is written by one task under a name of its own and counts only once its task has ended and
returned the name: repeats of a task leave files that nothing refers to. Files are reached
through ``pyarrow.fs`` in the folder all executors share.

Defined results: a null text has no ids but the end id; a null document id sorts first; rows
that repeat an id stay, ordered by the hash of their text; no rows, no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from barlume.llm.common import shared_dir

MAGIC = b"BSST0001"
FOOTER = struct.Struct("<QIQIQQ8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY = 10
BLOOM_HASHES = 7
END_ID = 1
SLICE = 10_000  # documents whose stretches are numbered together
GATHERED = 256


# --- encoding ----------------------------------------------------------------------------------


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct stretch between ASCII white
    space once a slice; Arrow splits and numbers the stretches, numpy puts the ids together again.

    Sound where the vocabulary's pre-tokenizer drops white space and never joins across it.
    Stretches of letters only, and of letters and then marks, go to the library many to a call,
    separated by spaces; their ids part again at the ends of words. All else goes alone. A text
    that holds an added token's string goes whole, since the library looks for those first.
    """

    JOINED = 128
    MARKS = ".,!?;:*$%&#|)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def _alone(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per stretch)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return np.array([i for x in found for i in x], dtype="<u4"), np.array([len(x) for x in found], dtype=np.int64)

    def _together(self, some: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
        """``some``: stretches of so many words each."""
        step, ids, lens = self.JOINED, [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        joined = [" ".join(some[at : at + step]) for at in range(0, len(some), step)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            part = some[k * step : (k + 1) * step]
            x = np.array(e.ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[x]) + 1
            if len(cut) == words * len(part):
                n = np.diff(cut[words - 1 :: words], prepend=0)
            else:
                x, n = self._alone(part)
            ids.append(x)
            lens.append(n)
        return np.concatenate(ids), np.concatenate(lens)

    def _unique(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of words[i] are ids[start[i]:][:length[i]]."""
        kinds: tuple[list[int], ...] = ([], [], [])
        one, two, rest = (x.append for x in kinds)
        marks = self.MARKS
        for i, w in enumerate(words):
            (one if w.isalpha() else two if w.rstrip(marks).isalpha() else rest)(i)
        pick = lambda which: [words[i] for i in which]
        parts = [self._together(pick(kinds[0]), 1), self._together(pick(kinds[1]), 2), self._alone(pick(kinds[2]))]
        order = np.concatenate([np.array(k, dtype=np.int64) for k in kinds])
        lens, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        each = np.concatenate([n for _, n in parts])
        lens[order], start[order] = each, np.cumsum(each) - each
        return np.concatenate([x for x, _ in parts]), start, lens

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids; a null is empty."""
        whole = reduce(pc.or_, (pc.match_substring(texts, a) for a in self.added), pa.repeat(False, len(texts)))
        whole = np.flatnonzero(pc.fill_null(whole, False).to_numpy(zero_copy_only=False)).tolist()
        if whole:
            alone = self.tokenizer.encode_batch_fast([texts[i].as_py() for i in whole], add_special_tokens=False)
            alone = {i: np.array(e.ids, "<u4") for i, e in zip(whole, alone, strict=True)}
            rest = self._split_up(pc.if_else(pc.is_in(pa.array(range(len(texts))), pa.array(whole)), "", texts))
            return [alone.get(i, ids) for i, ids in enumerate(rest)]
        return self._split_up(texts)

    def _split_up(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode() if len(split) else None
        if coded is None or not len(coded):
            return [np.empty(0, "<u4")] * len(texts)
        at = coded.indices.to_numpy()
        ids, start, lens = self._unique(coded.dictionary.to_pylist())
        edges, out = (offsets - offsets[0]).tolist(), []
        for i in range(0, len(texts), GATHERED):  # so that the ids of all texts are not there at once twice
            part = edges[i : i + GATHERED + 1]
            w = at[part[0] : part[-1]]
            n = lens[w]
            ends = np.concatenate([[0], np.cumsum(n)])
            flat = ids[np.arange(ends[-1]) + np.repeat(start[w] - ends[:-1], n)]
            bounds = ends[np.array(part) - part[0]].tolist()
            out += [flat[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


# --- file format -------------------------------------------------------------------------------


def key_bytes(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def key_id(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_slots(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def pack_ids(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\x02" + ids.astype("<u2").tobytes()) if small else (b"\x04" + ids.astype("<u4").tobytes())


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1)


class Writer:
    def __init__(self, out):
        self.out, self.at, self.index, self.keys = out, 0, bytearray(), []
        self.buf, self.entries, self.first, self.last, self.ids = bytearray(), 0, b"", b"", 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            last = self.last
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        else:
            self.first = key
        value = pack_ids(ids)
        self.buf += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.buf) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            block = self.zstd.compress(bytes(self.buf))
            self.out.write(block)
            self.index += _varint(len(self.first)) + self.first + struct.pack("<QII", self.at, len(block), self.entries)
            self.at += len(block)
            self.buf, self.entries = bytearray(), 0

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY + 7 & ~7)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for s in _bloom_slots(k, bits):
                bloom[s >> 3] |= 1 << (s & 7)
        index = self.zstd.compress(bytes(self.index))
        self.out.write(index + bytes(bloom) + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.ids, MAGIC))


class Reader:
    """Over a random-access file of pyarrow."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        at, n, self.bloom_at, self.bloom_len, self.n_docs, self.n_ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of token ids")
        raw = zstandard.ZstdDecompressor().decompress(self._read(at, n)) if n else b""
        self.first: list[bytes] = []
        self.blocks: list[tuple[int, int, int]] = []
        at = 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.first.append(raw[at : at + n])
            at += n
            self.blocks.append(struct.unpack_from("<QII", raw, at))
            at += 16

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, entries = self.blocks[i]
        raw = zstandard.ZstdDecompressor().decompress(self._read(at, n))
        key, at = b"", 0
        for _ in range(entries):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, unpack_ids(raw[at : at + n])
            at += n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        bloom = self._read(self.bloom_at, self.bloom_len)
        return all(bloom[s >> 3] >> (s & 7) & 1 for s in _bloom_slots(key, len(bloom) * 8))

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document of that id, or None."""
        key = key_bytes(doc_id)
        if not self.may_hold(key):
            return None
        i = max(0, bisect_right(self.first, key) - 1)
        while i > 0 and self.first[i] == key:  # a run of one key may start in the block before
            i -= 1
        for j in range(i, len(self.blocks)):
            if self.first[j] > key:
                break
            for k, ids in self.block(j):
                if k == key:
                    return ids
        return None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


# --- Spark -------------------------------------------------------------------------------------


def write_shards(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Encodes every whole text, writes the shards, and returns one entry per shard in key order:
    path, first (key in hex), n_docs, n_ids and start (ids in the shards before)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, out, name, end = encoder(path), None, None, "", np.array([end_id], "<u4")
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1)), strict=True):
                    if writer is None:
                        files, where = _open(folder)
                        name = f"{where.rstrip('/')}/{key_bytes(doc_id).hex()}-{uuid.uuid4().hex}.sst"
                        files.create_dir(where, recursive=True)
                        out = files.open_output_stream(name)
                        writer = Writer(out)
                    writer.add(key_bytes(doc_id), np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name.rsplit("/", 1)[1], "first": writer.keys[0].hex(), "n_docs": len(writer.keys), "n_ids": writer.ids}], schema=pa.schema([("name", pa.string()), ("first", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    start, shards = 0, []
    # one row a shard: the manifest is as long as the list of files
    for r in sorted(dealt.mapInArrow(run, "name string, first string, n_docs long, n_ids long").collect(), key=lambda r: r.first):
        shards.append({"path": f"{folder.rstrip('/')}/{r.name}", "first": r.first, "n_docs": r.n_docs, "n_ids": r.n_ids, "start": start})
        start += r.n_ids
    return shards


def read_shards(spark, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; a task reads a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, where = _open(path)
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with files.open_input_file(where) as f:
                    for key, ids in Reader(f).scan():
                        for c, v in zip(rows.values(), (key_id(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            c.append(v)
                        at += len(ids)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    listed = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    if len(shards) > 1:
        listed = listed.repartition(len(shards))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the shards of ``df`` (to the shared folder by default) and reads them back."""
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
    return read_shards(spark, write_shards(df, folder, **options))


def lookup(shards: list[dict], doc_id: int) -> np.ndarray | None:
    """One document's ids from the shard whose range holds it."""
    i = bisect_right([s["first"] for s in shards], key_bytes(doc_id).hex()) - 1
    for s in shards[max(0, i) : i + 1]:
        files, where = _open(s["path"])
        with files.open_input_file(where) as f:
            return Reader(f).lookup(doc_id)
    return None
