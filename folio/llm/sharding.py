"""A uniform shuffle of documents into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in the partitions in which they were read.  How many rows each partition sends to each shard is drawn first: the rows of that matrix are
multivariate hypergeometric, given what the shards still have room for, so its columns add up to the shards' sizes exactly.  Each partition permutes its
rows and deals them by its row of the matrix; the running sums of the matrix then give every row a position in its shard, without a count over rows.  A shard is
cut into chunks, and a second matrix of the same kind says how many positions of each stretch of the shard go to each chunk.  So a row's chunk and its place
there are numbers that any task can work out; rows travel once, straight to their chunk, where they are permuted again.  Every order of all documents is
equally likely (up to the generator), whatever the order and the partitions of the input.

The driver draws counts for groups of partitions only; a task draws the rows of a group, another the chunks of a shard.  They are files of the shared
folder, read a row at a time.  Every draw is seeded by its place, so a task that runs again gives the same rows.  A table that is read with other
splits is shuffled otherwise.

Defined cases: null text has no bytes; null and repeated ids and equal texts are separate rows, each with a place of its own (a group of copies is spread like
any other rows, which shards of equal counts require); with fewer rows than shards the last shards are empty; an empty table gives an
empty result; columns travel in a struct, so their names cannot clash with the new ones.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.files import open_store, put
from folio.llm.scratch import Scratch

SHARDS = 24
#: Partitions whose rows of the matrix are drawn by one task.
GROUP = 1_024
#: Rows of a chunk; more where a shard would have over ``MOST_CHUNKS`` of them.
CHUNK, MOST_CHUNKS = 65_536, 1_024
#: ``monotonically_increasing_id`` holds the partition above so many bits and the position in it below.
POSITION_BITS = 33
#: Populations from here on are beyond NumPy's sampler.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; large populations by inversion over twelve standard deviations around the mode."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    low, high, total = max(0, n - bad), min(n, good), good + bad
    spread = 12 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5 + 64
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    first, last = int(max(low, mode - spread)), int(min(high, mode + spread))
    x = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - x) * (n - x)) - np.log((x + 1) * (bad - n + x + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(weight - weight.max()))
    return first + int(min(np.searchsorted(mass, rng.random() * mass[-1], side="right"), last - first))


def draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """``n`` draws without replacement from places of ``room``."""
    if room.sum() < LARGE:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    got, rest = np.zeros(len(room), np.int64), int(room.sum())
    for i, r in enumerate(room.tolist()):
        rest -= r
        got[i] = hypergeometric(rng, r, rest, n) if rest else n
        n -= int(got[i])
    return got


def matrix(rng: np.random.Generator, rows, columns: np.ndarray) -> np.ndarray:
    """Counts with these sums of rows and columns, as a uniform shuffle makes them."""
    room, out = np.array(columns, np.int64), np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        out[i] = draw(rng, room, int(n))
        room -= out[i]
    return out


def before(counts: np.ndarray) -> np.ndarray:
    """Sums of the rows above each."""
    return np.cumsum(counts, axis=0) - counts


def shard_sizes(n: int, shards: int) -> np.ndarray:
    return np.array([n // shards + (s < n % shards) for s in range(shards)], np.int64)


def chunk_sizes(n: int, chunk: int, most: int) -> np.ndarray:
    size = max(chunk, -(-n // most))
    return np.array([min(size, n - a) for a in range(0, n, size)], np.int64)


class Places:
    """Where rows go, worked out from the files of the matrices; made anew in each task."""

    def __init__(self, uri: str, seed: int, sizes: list[np.ndarray], group: int):
        self.uri, self.seed, self.sizes, self.group = uri, seed, sizes, group
        self.first = np.cumsum([0, *(len(s) for s in sizes)])  # number of a shard's first chunk
        self.part = lru_cache(maxsize=4)(self._part)
        self.stretch = lru_cache(maxsize=2 * len(sizes))(self._stretch)
        self.chunk = lru_cache(maxsize=4)(self._chunk)
        self.store = None

    def _row(self, name: str, i: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ``i`` of a matrix and the sums above it."""
        if self.store is None:
            self.store, self.root = open_store(self.uri)
        with self.store.open_input_file(f"{self.root}/{name}") as f:
            f.seek(16 * width * i)
            got = np.frombuffer(f.read(16 * width), "<i8")
        return got[:width], got[width:]

    def _dealt(self, counts, above, *key):
        """A permutation of the rows that ``counts`` deals, the end of each target's, and what turns a rank into a position there."""
        ends = np.cumsum(counts)
        return np.random.default_rng([self.seed, *key]).permutation(int(ends[-1])), ends, above - (ends - counts)

    def _part(self, part: int):
        return self._dealt(*self._row(f"group-{part // self.group}", part % self.group, len(self.sizes)), 1, part)

    def _stretch(self, shard: int, block: int):
        return self._dealt(*self._row(f"shard-{shard}", block, len(self.sizes[shard])), 2, shard, block)

    def _chunk(self, chunk: int) -> tuple[int, np.ndarray]:
        shard = int(np.searchsorted(self.first, chunk, side="right")) - 1
        own = chunk - self.first[shard]
        return int(self.sizes[shard][:own].sum()), np.random.default_rng([self.seed, 3, chunk]).permutation(int(self.sizes[shard][own]))

    def targets(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, number of the chunk and position in it of rows numbered by partition and position."""
        shard, spot = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for rows, part in _groups(at >> POSITION_BITS):
            order, ends, shift = self.part(part)
            rank = order[at[rows] & ((1 << POSITION_BITS) - 1)]
            shard[rows] = np.searchsorted(ends, rank, side="right")
            spot[rows] = rank + shift[shard[rows]]
        chunk, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for in_shard, s in _groups(shard):
            size = self.sizes[s][0]
            for some, block in _groups(spot[in_shard] // size):
                rows = in_shard[some]
                order, ends, shift = self.stretch(s, block)
                rank = order[spot[rows] % size]
                to = np.searchsorted(ends, rank, side="right")
                chunk[rows], place[rows] = self.first[s] + to, rank + shift[to]
        return shard, chunk, place

    def slots(self, chunk: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chunk), np.int64)
        for rows, c in _groups(chunk):
            start, order = self.chunk(c)
            out[rows] = start + order[place[rows]]
        return out


def _groups(keys: np.ndarray):
    """Row numbers of each key."""
    order = np.argsort(keys, kind="stable")
    found, starts = np.unique(keys[order], return_index=True)
    for rows, key in zip(np.split(order, starts[1:]) if len(found) else [], found.tolist(), strict=True):
        yield rows, key


def draw_matrices(scratch: Scratch, parts: DataFrame, shards: int, seed: int, chunk: int, most: int, group: int) -> list[np.ndarray]:
    """Write the matrices for ``part, n``; the sizes of each shard's chunks."""
    groups = parts.groupBy(F.floor(F.col("part") / group).alias("g")).agg(F.sum("n").alias("n")).orderBy("g").collect()  # a row for ``group`` partitions
    wanted = shard_sizes(sum(r["n"] for r in groups), shards)
    sizes = [chunk_sizes(int(n), chunk, most) for n in wanted]
    to_groups = matrix(np.random.default_rng([seed, 0]), [r["n"] for r in groups], wanted)
    given = {r["g"]: (c, a) for r, c, a in zip(groups, to_groups, before(to_groups), strict=True)}
    uri = scratch.path("matrices")
    open_store(uri, create=True)

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        g = int(rows["g"].iloc[0])
        counts = np.zeros(group, np.int64)
        counts[(rows["part"] % group).to_numpy()] = rows["n"]
        columns, above = given[g]
        own = matrix(np.random.default_rng([seed, 4, g]), counts, columns)
        store, root = open_store(uri)
        put(store, f"{root}/group-{g}", np.hstack([own, before(own) + above]).astype("<i8").tobytes())
        return pd.DataFrame({"g": [g]})

    def of_shards(batches):
        store, root = open_store(uri)
        for batch in batches:
            for s in batch["id"].tolist():
                own = matrix(np.random.default_rng([seed, 5, s]), sizes[s], sizes[s])
                put(store, f"{root}/shard-{s}", np.hstack([own, before(own)]).astype("<i8").tobytes())
            yield batch

    parts.withColumn("g", F.floor(F.col("part") / group)).groupBy("g").applyInPandas(of_group, "g long").write.format("noop").mode("overwrite").save()
    scratch.spark.range(0, shards, 1, shards).mapInPandas(of_shards, "id long").write.format("noop").mode("overwrite").save()
    return sizes


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = 1, chunk: int = CHUNK, most_chunks: int = MOST_CHUNKS, group: int = GROUP) -> DataFrame:
    """``row`` (the input's columns), ``shard``, ``chunk`` (numbered over all shards), ``slot`` (in the shard, gapless from 0); a chunk is one partition."""
    scratch = Scratch(docs.sparkSession, "shards")
    rows = scratch.keep(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "rows")
    parts = scratch.keep(rows.groupBy(F.shiftright("at", POSITION_BITS).alias("part")).agg(F.count("*").alias("n")), "parts")
    sizes = draw_matrices(scratch, parts, shards, seed, chunk, most_chunks, group)
    uri, total = scratch.path("matrices"), max(1, sum(map(len, sizes)))

    @F.pandas_udf("shard int, chunk int, place long")
    def target(batches: pd.Series) -> pd.DataFrame:
        got = _places(uri, seed, sizes, group).targets(batches.to_numpy())
        return pd.DataFrame(dict(zip(("shard", "chunk", "place"), got, strict=True)))

    @F.pandas_udf("long")
    def slot(chunk: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(_places(uri, seed, sizes, group).slots(chunk.to_numpy().astype(np.int64), place.to_numpy()))

    there = rows.select("row", target("at").alias("to")).select("row", "to.*").repartitionById(total, F.col("chunk"))
    return there.select("row", "shard", "chunk", slot("chunk", "place").alias("slot"))


_made: dict[str, Places] = {}


def _places(uri: str, seed: int, sizes, group: int) -> Places:
    """One for each shuffle in a worker; a worker that turns to another shuffle forgets the last."""
    if uri not in _made:
        _made.clear()
        _made[uri] = Places(uri, seed, sizes, group)
    return _made[uri]


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Shards as Parquet folders ``shard=N``, a file for each chunk, rows in the order of their slots; files of a shard follow each other by name."""
    there = shuffled(docs, **how)
    there.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
