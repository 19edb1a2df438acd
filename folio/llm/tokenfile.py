"""Token-id files with a minimal perfect hash index.

A shard is two files.  ``part-N.bin``: 8 bytes of magic, the width of an id (2 or 4) as u4, zero
as u4, then the raw little-endian ids of its documents in ascending ``doc_id`` order, each
document closed by the end id.  ``part-N.idx``: 8 bytes of magic and u8 counts (documents, keys, null keys,
levels, leftover keys), level sizes (u8), level bits (u8 words), bits set before each word (u8), leftover keys
(i8, sorted), then per slot the fingerprint (u4) and the rank of its first document (u8), then per
document its key (i8) and its first id's place in the shard (u8; one more closes the last).

The index is built from levels of bit maps: a key's bit in the first level in which no other key shares it;
the number of set bits before it is its slot.  A lookup is a bounded number of probes, one
fingerprint comparison (absent keys are refused with odds 1 - 2**-32) and one seek into the
payload.  ``manifest.json`` holds, per shard, its least key and the number of ids before it.

Documents are dealt to shards by ranges of ``doc_id``; a shard is written as a stream, so a task holds one batch
and 16 bytes a document.  A shard file is written under another name and renamed, so a task that is run
again replaces it by the same bytes.

Defined cases: null text counts as empty (the end id alone); a null ``doc_id`` sorts first and is kept in the
payload without a key; rows that repeat a ``doc_id`` follow each other by text, the key leading to the first; an empty
table gives a manifest without shards; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.files import open_store, put
from folio.llm.scratch import partitions
from folio.llm.shingles import mix
from folio.llm.tokens import encoder, public_path

MAGIC_BIN, MAGIC_IDX = b"FOLIOTK1", b"FOLIOIX1"
#: Bits of a level for each key that reaches it, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 24
#: Documents of a shard, roughly: its index is built and read in one task.
SHARD_DOCS = 1 << 20
_SEED = np.uint64(0xA0761D6478BD642F)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(int(_SEED) * (level + 1) & (1 << 64) - 1)
    return mix(keys.astype(np.uint64) + salt) % np.uint64(size)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ _SEED) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1, one each."""

    def __init__(self, sizes, words, before, rest):
        self.sizes, self.words, self.before, self.rest = sizes, words, before, rest
        self.starts = np.concatenate([[0], np.cumsum([s // 64 for s in sizes])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys.astype(np.int64)
        while len(left) and len(sizes) < LEVELS:
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _place(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at.astype(np.int64)]]
        flat = np.concatenate(words) if words else np.empty(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(flat), dtype=np.uint64)]).astype(np.uint64)
        return cls(sizes, flat, before, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a key that was not built in, some slot or -1."""
        keys = keys.astype(np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _place(keys[open_], level, size)
            word = self.starts[level] + (at >> np.uint64(6)).astype(np.int64)
            bit = at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(low))[hit].astype(np.int64)
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[i] == keys[open_]
            out[open_[hit]] = int(self.before[-1]) + i[hit]
        return out


def encode_index(keys: np.ndarray, nulls: int, starts: np.ndarray) -> bytes:
    """``keys``: of all documents of the shard, ascending, the first ``nulls`` without meaning; ``starts``: one more than documents."""
    own = keys[nulls:]
    distinct, first = np.unique(own, return_index=True)
    mph = PerfectHash.build(distinct)
    prints, ranks = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u8")
    at = mph.slots(distinct)
    prints[at], ranks[at] = fingerprints(distinct), first + nulls
    head = np.array([len(keys), len(distinct), nulls, len(mph.sizes), len(mph.rest)], "<u8")
    parts = [head, np.array(mph.sizes, "<u8"), mph.words.astype("<u8"), mph.before.astype("<u8"), mph.rest.astype("<i8"), prints, ranks, keys.astype("<i8"), starts.astype("<u8")]
    return MAGIC_IDX + b"".join(p.tobytes() for p in parts)


class ShardIndex:
    """A parsed ``.idx`` file."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC_IDX:
            raise ValueError("not an index file")
        self._raw, self._at = raw, 8
        self.n_docs, self.n_keys, self.nulls, levels, rest = (int(x) for x in self._take("<u8", 5))
        sizes = [int(x) for x in self._take("<u8", levels)]
        n_words = sum(s // 64 for s in sizes)
        words, before = self._take("<u8", n_words), self._take("<u8", n_words + 1)
        self.mph = PerfectHash(sizes, words, before, self._take("<i8", rest))
        self.prints, self.ranks = self._take("<u4", self.n_keys), self._take("<u8", self.n_keys)
        self.keys, self.starts = self._take("<i8", self.n_docs), self._take("<u8", self.n_docs + 1)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._raw, kind, n, self._at)
        self._at += out.nbytes
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the first document of each key, -1 where the shard has none."""
        slot = self.mph.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        out = np.full(len(keys), -1, np.int64)
        out[known] = self.ranks[slot[known]].astype(np.int64)
        return out


def write_token_files(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, id_bytes: int = 2, shards: int | None = None) -> dict:
    """Encode all documents, write shards and their indexes under ``uri`` and return the manifest."""
    spark, path = docs.sparkSession, tokenizer or public_path()
    n = shards or max(partitions(spark), -(-docs.count() // SHARD_DOCS))
    store, root = open_store(uri)
    store.create_dir(root, recursive=True)

    def run(batches):
        import pyarrow as pa

        encode, shard = encoder(path, end_id).encode, TaskContext.get().partitionId()
        own_store, own_root = open_store(uri)
        keys, sizes, nulls, seen = [], [], 0, False

        def payload():
            nonlocal nulls, seen
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    if not seen:
                        seen = True
                        yield MAGIC_BIN + np.array([id_bytes, 0], "<u4").tobytes()
                    part = batch.slice(lo, 512)
                    nulls += part.column(0).null_count
                    keys.append(part.column(0).fill_null(0).to_numpy())
                    ids = encode(part.column(1).to_pylist())
                    sizes.append(np.array([len(x) // 4 for x in ids], np.int64))
                    raw = np.frombuffer(b"".join(ids), "<u4")
                    if id_bytes == 2 and len(raw) and int(raw.max()) > 0xFFFF:
                        raise ValueError("ids above 65535 need id_bytes=4")
                    yield raw.astype(f"<u{id_bytes}").tobytes()

        name = f"{own_root}/part-{shard:06d}"
        tmp = f"{name}.{uuid.uuid4().hex}"
        stream = payload()
        head = next(stream, None)
        if head is None:
            return
        with own_store.open_output_stream(tmp) as f:
            f.write(head)
            for x in stream:
                f.write(x)
        own_store.move(tmp, f"{name}.bin")
        key, size = np.concatenate(keys), np.concatenate(sizes)
        starts = np.concatenate([[0], np.cumsum(size)])
        put(own_store, f"{name}.idx", encode_index(key, nulls, starts))
        least = int(key[nulls]) if nulls < len(key) else None
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "docs": pa.array([len(key)], pa.int64()), "ids": pa.array([int(starts[-1])], pa.int64()), "least": pa.array([least], pa.int64())})

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, order[0]).sortWithinPartitions(*order)
    found = sorted(rows.mapInArrow(run, "shard long, docs long, ids long, least long").collect())  # a row for each shard
    before, entries = 0, []
    for r in found:
        entries.append({"shard": r["shard"], "docs": r["docs"], "ids": r["ids"], "least": r["least"], "before": before})
        before += r["ids"]
    manifest = {"version": 1, "id_bytes": id_bytes, "end_id": end_id, "ids": before, "shards": entries}
    put(store, f"{root}/manifest.json", json.dumps(manifest).encode())
    return manifest


class TokenFiles:
    """Keyed access to written files: ``get`` returns the ids of a document, or None."""

    def __init__(self, uri: str):
        self.store, self.root = open_store(uri)
        with self.store.open_input_stream(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.shards = [s for s in self.manifest["shards"] if s["least"] is not None]
        self.least = np.array([s["least"] for s in self.shards], np.int64)
        self._index: dict[int, ShardIndex] = {}

    def index(self, shard: int) -> ShardIndex:
        if shard not in self._index:
            with self.store.open_input_stream(f"{self.root}/part-{shard:06d}.idx") as f:
                self._index[shard] = ShardIndex(f.read())
        return self._index[shard]

    def get(self, key: int) -> np.ndarray | None:
        at = int(np.searchsorted(self.least, key, side="right")) - 1
        if at < 0:
            return None
        shard = self.shards[at]["shard"]
        index = self.index(shard)
        rank = int(index.find(np.array([key], np.int64))[0])
        if rank < 0:
            return None
        width, lo, hi = self.manifest["id_bytes"], int(index.starts[rank]), int(index.starts[rank + 1])
        with self.store.open_input_file(f"{self.root}/part-{shard:06d}.bin") as f:
            return np.frombuffer(f.read_at((hi - lo) * width, 16 + lo * width), f"<u{width}").astype("<u4")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, found boolean"


def read_token_files(spark: SparkSession, uri: str, block: int = 2_000) -> DataFrame:
    """A row for each document in the files: where it starts among all ids, its size and checksum.

    A document with a key is read where the hash index of its shard says that the documents of its key begin, and it is an error if
    that is not so; ``found`` tells that it has a key.
    """
    store, root = open_store(uri)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    shards, width = [(s["shard"], s["before"]) for s in manifest["shards"]], manifest["id_bytes"]

    def run(batches):
        import pyarrow as pa

        own_store, own_root = open_store(uri)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                shard, before = shards[i]
                with own_store.open_input_stream(f"{own_root}/part-{shard:06d}.idx") as f:
                    index = ShardIndex(f.read())
                with own_store.open_input_file(f"{own_root}/part-{shard:06d}.bin") as f:
                    if f.read_at(8, 0) != MAGIC_BIN:
                        raise ValueError("not a token file")
                    place = np.arange(index.n_docs)
                    again = (index.keys[1:] == index.keys[:-1]) & (place[1:] > index.nulls)
                    nth = place - np.maximum.accumulate(np.where(np.concatenate([[False], again]), 0, place))  # among documents of its key
                    for lo in range(0, index.n_docs, block):
                        hi = min(lo + block, index.n_docs)
                        keys, null = index.keys[lo:hi], place[lo:hi] < index.nulls
                        rank = np.where(null, place[lo:hi], index.find(keys))
                        at = np.where(null, rank, rank + nth[lo:hi])
                        led = (rank >= 0) & (at < index.n_docs)
                        led[led] = (index.keys[at[led]] == keys[led]) & (null[led] | (rank[led] >= index.nulls) & (nth[rank[led]] == 0))
                        if not led.all():
                            raise ValueError(f"the index of shard {shard} does not lead to document {keys[np.argmin(led)]}")
                        starts, ends = index.starts[at].astype(np.int64), index.starts[at + 1].astype(np.int64)
                        first = int(starts.min())
                        ids = np.frombuffer(f.read_at((int(ends.max()) - first) * width, 16 + first * width), f"<u{width}").astype("<u4")
                        raw = memoryview(ids).cast("B")
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip((starts - first) * 4, (ends - first) * 4, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys.astype(np.int64), mask=null), pa.array(starts + before), pa.array(ends - starts), pa.array(crc, pa.int64()), pa.array(~null)],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "found"],
                        )

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, READ)
