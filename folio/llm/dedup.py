"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when identical after each ``[\\x20\\x09-\\x0D]+`` becomes one space.  A batch is grouped by digest
(SHA-256 of the normalised text, its length and a second 64-bit hash) with sums on each task first, so a large group
costs a row a task.  The batch's digests are then screened, shard by shard, against the binary-fuse filter of each
earlier snapshot; only positives join the snapshot's exact bucket, and a match counts after the two normalised texts
have been compared byte for byte.  Digests without a match become the batch's own snapshot: a table and one filter for
each shard (about ``SHARD_KEYS`` keys), both never changed afterwards.

Defined cases: null text counts as empty; a null ``doc_id`` is larger than any other, so such a row stays only if no
other row has the text; rows that repeat both ``doc_id`` and text are one document and share all values; an empty table gives an
empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch
from folio.llm.screen import screened
from folio.llm.shingles import mix

SHARD_KEYS = 1 << 18
NO_ID = (1 << 63) - 1
_SLOT = np.uint64(0x9E3779B97F4A7C15)


# -- binary-fuse filter, 8-bit fingerprints, three segments in a row ---------------------------------------------------
class FuseFilter:
    """A static set of 64-bit keys; says yes to all of them and to about one in 256 others."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int):
        h = mix(keys + np.uint64(int(_SLOT) * seed & (1 << 64) - 1))
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        low = mix(h)
        at = [(first + np.uint64(k)) * np.uint64(segment) + ((low >> np.uint64(20 * k)) & mask) for k in range(3)]
        return np.stack(at).astype(np.int64), (h ^ (h >> np.uint64(29))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 4, 18))
        cells = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 3 * segment
        segments = max(1, cells // segment - 2)
        for seed in range(1, 200):
            at, prints = cls._places(keys, seed, segment, segments)
            layers = cls._peel(at, (segments + 2) * segment)
            if layers is not None:
                out = np.zeros((segments + 2) * segment, np.uint8)
                for own, slot in reversed(layers):  # a layer's slots are touched by no other key of it
                    out[slot] = 0
                    out[slot] = prints[own] ^ out[at[0, own]] ^ out[at[1, own]] ^ out[at[2, own]]
                return cls(seed, segment, segments, out)
        raise ValueError("no seed peels the keys")

    @staticmethod
    def _peel(at: np.ndarray, size: int):
        """Layers of (key, the slot that is its alone once later layers are gone), or None if some keys never come free."""
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=size)
        xor = np.zeros(size, np.int64)
        for k in range(3):
            np.bitwise_xor.at(xor, at[k], np.arange(n))
        layers, left, free = [], n, np.flatnonzero(count == 1)
        while len(free):
            own, i = np.unique(xor[free], return_index=True)
            layers.append((own, free[i]))
            left -= len(own)
            touched = at[:, own].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(xor, touched, np.tile(own, 3))
            touched = np.unique(touched)
            free = touched[count[touched] == 1]
        return None if left else layers

    def __contains__(self, key: int) -> bool:
        return bool(self.maybe(np.array([key], np.uint64))[0])

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._places(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]] == prints


FILTERS = "shard long, seed long, segment long, segments long, cells binary"


def build_filters(keyed: DataFrame) -> DataFrame:
    """One filter for each shard of ``shard, key``."""

    def build(pdf):
        import pandas as pd

        f = FuseFilter.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.cells.tobytes()]})

    return keyed.select("shard", "key").groupBy("shard").applyInPandas(build, FILTERS)


def screen(keyed: DataFrame, filters: DataFrame) -> DataFrame:
    """Keys of ``shard, key`` that a filter says yes to."""

    def ask(left, right):
        if not len(left) or not len(right):
            return left.iloc[:0][["key"]]
        r = right.iloc[0]
        f = FuseFilter(int(r.seed), int(r.segment), int(r.segments), np.frombuffer(r.cells, np.uint8))
        return left.loc[f.maybe(left["key"].to_numpy().view(np.uint64)), ["key"]]

    return keyed.select("shard", "key").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, "key long")


# -- the operator ----------------------------------------------------------------------------------------------------------
def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


KEY = ["digest", "n_bytes", "check"]


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("norm"))
    return rows.select("doc_id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("check"), "norm")


class Index:
    """Snapshots in the shared folder; ``add`` takes a batch of digests and says which known entry each belongs to."""

    def __init__(self, scratch: Scratch, shards: int):
        self.scratch, self.shards, self.snapshots = scratch, shards, []
        #: ``digest, n_bytes, check, variant, batch`` of batches whose text has the key of an entry but other bytes (not variant 0).
        self.variants: DataFrame | None = None

    def _keyed(self, groups: DataFrame) -> DataFrame:
        key = F.xxhash64("digest", "check")
        return groups.withColumn("key", key).withColumn("shard", F.pmod(F.shiftrightunsigned(key, 32), F.lit(self.shards)))

    def add(self, batch: DataFrame, docs: DataFrame) -> DataFrame | None:
        """Take ``digest, n_bytes, check, doc_id`` rows; returns what it adds to entries of earlier snapshots, if there are any."""
        no = len(self.snapshots)
        groups = batch.groupBy(*KEY).agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("keep_id"), F.count(F.lit(1)).alias("n"))
        groups = self.scratch.keep(self._keyed(groups), f"groups{no}")
        matched, new, seen = None, groups.withColumn("variant", F.lit(0)), None
        for i, (entries, filters) in enumerate(self.snapshots):
            positive = groups.join(screen(groups, filters).distinct(), "key", "left_semi")
            old = entries.select(*KEY, F.col("keep_id").alias("old_id"), "variant")
            hits = self.scratch.keep(positive.select(*KEY, "keep_id", "n").join(old, KEY), f"hits{no}_{i}")
            seen = hits.select(*KEY) if seen is None else seen.unionByName(hits.select(*KEY))
            same = self.scratch.keep(self._same_bytes(hits, docs), f"same{no}_{i}")
            hits = hits.join(same, KEY, "left_semi").select(*KEY, "keep_id", "n", "variant")
            matched = hits if matched is None else matched.unionByName(hits)
        if matched is not None:
            other = self.scratch.keep(seen.distinct().join(matched.select(*KEY), KEY, "left_anti").withColumn("variant", F.lit(no)), f"other{no}")
            new = groups.join(matched.select(*KEY), KEY, "left_anti").join(other, KEY, "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
            own = matched.where("variant <> 0").select(*KEY, "variant").unionByName(other).withColumn("batch", F.lit(no))
            self.variants = own if self.variants is None else self.variants.unionByName(own)
        entries = self.scratch.keep(new, f"entries{no}")
        filters = self.scratch.keep(build_filters(entries), f"filters{no}")
        self.snapshots.append((entries, filters))
        return matched

    @staticmethod
    def _same_bytes(hits: DataFrame, docs: DataFrame) -> DataFrame:
        """Digests of hits whose two texts are identical byte for byte."""
        wanted = hits.select(*KEY, F.explode(F.array("keep_id", "old_id")).alias("wanted_id")).distinct()
        key = [F.col(k) == F.col(f"w_{k}") for k in KEY]
        wanted = wanted.select(*[F.col(k).alias(f"w_{k}") for k in KEY], "wanted_id")
        # a shuffled join at every size: a join that is broadcast while small would change its plan as the batch grows; few other texts pass the screen
        asked = screened(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), wanted.select(F.col("wanted_id").alias("doc_id")))
        texts = asked.join(wanted.hint("merge"), [F.col("doc_id") == F.col("wanted_id"), *key], "inner")
        return texts.groupBy(*KEY).agg((F.min("norm") == F.max("norm")).alias("same")).where("same").select(*KEY)

    def entries(self) -> DataFrame:
        out = self.snapshots[0][0]
        for entries, _ in self.snapshots[1:]:
            out = out.unionByName(entries)
        return out.select(*KEY, "keep_id", "n", "variant")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row, after taking the table in as ``batches`` batches.

    A row's batch is a hash of its ``doc_id``, so the table passes once as snapshot and then as increments.
    A text with the key of an entry of an earlier batch but other bytes is an entry of its own; within one batch the key alone (SHA-256, size, check) decides.
    """
    scratch = scratch or Scratch(docs.sparkSession, "dedup")
    texts = _digested(docs, id_col, text_col)
    digests = scratch.keep(texts.drop("norm"), "digests")
    rows = digests.count()
    index = Index(scratch, max(1, -(-rows // (batches * SHARD_KEYS))))
    of_batch = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NO_ID))), F.lit(batches))
    added = [index.add(digests.where(of_batch == b), texts) for b in range(batches)]
    groups = index.entries()
    for more in added:
        if more is not None:
            groups = groups.unionByName(more)
    groups = scratch.keep(groups.groupBy(*KEY, "variant").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")), "final")
    named = digests.withColumn("batch", of_batch)
    named = named.join(index.variants, [*KEY, "batch"], "left").withColumn("variant", F.coalesce("variant", F.lit(0))) if index.variants is not None else named.withColumn("variant", F.lit(0))
    out = named.join(groups, [*KEY, "variant"], "left")
    keep = F.when(F.col("keep_id") < NO_ID, F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one row of each text, that of the least id; its columns may have any names."""
    found = dedup(docs, id_col, text_col, batches, scratch).where("kept").select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("stay_id"), F.unhex("text_sha256").alias("stay_digest")).distinct()
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("own_id"), F.unhex(F.sha2(normalised(F.col(text_col).cast("string")).cast("binary"), 256)).alias("own_digest"))
    stay = named.join(found.hint("merge"), [F.col("own_id") == F.col("stay_id"), F.col("own_digest") == F.col("stay_digest")], "left_semi")
    return stay.dropDuplicates(["own_id", "own_digest"]).select("row.*")
