"""Embedding near-dedup by a subspace bound, chunk against chunk.

Unit vectors are rotated (a fixed orthogonal matrix, so that no coordinate is special).  The product of two of them is at most the product of their first halves
plus the product of the lengths of their second halves, so one matrix product over half of the coordinates and that length, in single precision
with room for its rounding, leaves as candidates every pair that links and few others; where vectors are sorted along the first coordinate, what is too far there is not multiplied.
A candidate is a link if the cosine of the two vectors as given, in double precision, reaches the threshold.  With ``block_dims`` the rotated coordinates
are split into blocks, of which a linked pair is near in one at least, and it belongs to the first such block.

Equal vectors are one, with a weight.  Vectors are dealt to chunks, each a file of the shared folder, and tasks read two chunks at a time, so no vector is shuffled more than once and
a task holds two chunks at most, and never their links, which are added up a tile at a time.  Tasks return, per vector, the weight it is linked to, and only those links that join components;
pairs are never rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept; so do
vectors of another length than those they meet (each length is joined by itself); a null ``vec_id`` is larger than any other
and is never kept if linked to another; rows that repeat id and vector count as linked copies; an empty table gives an empty result; other
columns (labels too) are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.llm.files import open_store, put, take
from folio.llm.scratch import Scratch, partitions

NO_ID = (1 << 63) - 1
#: Vectors of a chunk, and the sides of a tile of products.
CHUNK, TILE = 32_768, 2_048
#: Chunks of fewer vectors, as long as there are no more than this, so that small tables are work for several tasks too.
SPREAD = 8
#: Room for rounding in filters, which only admit candidates; far above the error of the sums it covers.
SLACK = 1e-9
#: The same for products in single precision, a term of the sum.
ROUNDING = 4e-7


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def splits(dim: int, block_dims: int) -> list[slice]:
    """Blocks of ``block_dims`` coordinates, the last perhaps with fewer."""
    return [slice(a, min(a + block_dims, dim)) for a in range(0, dim, block_dims)]


def budgets(dim: int, block_dims: int, threshold: float) -> np.ndarray:
    share = np.array([s.stop - s.start for s in splits(dim, block_dims)]) / dim
    return share * (2 - 2 * threshold) * (1 + SLACK) + SLACK


def unpack(raws, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raws), "<f8").reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; divided by their greatest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Side:
    """Vectors prepared for one block, in the order of its first coordinate."""

    def __init__(self, x: np.ndarray, block: int, block_dims: int, threshold: float):
        dim = x.shape[1]
        u = unit(x)
        z = u @ rotation(dim)
        self.parts, self.limits = splits(dim, block_dims), budgets(dim, block_dims, threshold)
        first = z[:, self.parts[block].start]
        self.order = np.argsort(first, kind="stable")
        self.u, self.first = u[self.order], first[self.order]
        self.z = z[self.order] if len(self.parts) > 1 else None  # else the cosine decides by itself
        own = z[self.order, self.parts[block]]
        half = (own.shape[1] + 1) // 2
        square, rest, one = (own * own).sum(axis=1), np.sqrt((own[:, half:] ** 2).sum(axis=1)), np.ones(len(x))
        # left @ right.T is at least minus half of the squared distance in the block
        self.left = np.column_stack([own[:, :half], rest, square, one]).astype(np.float32)
        self.right = np.column_stack([own[:, :half], rest, -0.5 * one, -0.5 * square]).astype(np.float32)


def links_between(x: Side, y: Side, block: int, threshold: float):
    """Linked index pairs of two sides that belong to ``block``, in batches ``(a, b)``; of a side with itself, each pair once."""
    limit, same = x.limits[block], x is y
    least, r = -limit / 2 - ROUNDING * (x.left.shape[1] + 8), np.sqrt(limit)
    for lo in range(0, len(x.u), TILE):
        hi = min(lo + TILE, len(x.u))
        # beyond these the first coordinate alone is too far
        begin = lo if same else int(np.searchsorted(y.first, x.first[lo] - r, side="left"))
        end = int(np.searchsorted(y.first, x.first[hi - 1] + r, side="right"))
        for at in range(begin, end, TILE):
            product = x.left[lo:hi] @ y.right[at : min(at + TILE, end)].T
            some = np.flatnonzero(product.max(axis=1) >= least)
            if not len(some):
                continue
            a, b = np.nonzero(product[some] >= least)
            a, b = some[a] + lo, b + at
            if same:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 1 << 16):
                p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                if x.z is not None:
                    d = (x.z[p] - y.z[q]) ** 2
                    mine = d[:, x.parts[block]].sum(axis=1) <= limit
                    for e in range(block):
                        mine &= d[:, x.parts[e]].sum(axis=1) > x.limits[e]
                    p, q = p[mine], q[mine]
                hit = (x.u[p] * y.u[q]).sum(axis=1) >= threshold
                if hit.any():
                    yield x.order[p[hit]], y.order[q[hit]]


def links_of(x: np.ndarray, block: int, block_dims: int, threshold: float, role: np.ndarray):
    """Linked index pairs that belong to ``block``, in batches ``(a, b)``; roles 0 (home) meet home and guests (1), guests not each other."""
    side = Side(x, block, block_dims, threshold)
    for a, b in links_between(side, side, block, threshold):
        meet = (role[a] == 0) | (role[b] == 0)
        if meet.any():
            yield a[meet], b[meet]


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (of each index the least of its component) after the links ``a, b``."""
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while not (root[root] == root).all():
            root = root[root]


FOUND = "node long, linked long, other long"


def write_chunks(dealt: DataFrame, uri: str, parts: int) -> DataFrame:
    """``dim, sub, n`` of the files that hold the vectors of each chunk."""

    def run(batches):
        import pyarrow as pa

        store, root = open_store(uri, create=True)
        key, held = None, []

        def flush():
            node, weight = (np.concatenate([h[k] for h in held]).astype("<i8") for k in (0, 1))
            put(store, f"{root}/{key[0]}-{key[1]}", len(node).to_bytes(8, "little"), node.tobytes(), weight.tobytes(), *(r for h in held for r in h[2]))
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*key, len(node))], names=["dim", "sub", "n"])

        for batch in batches:
            dim, sub, node, weight = (batch.column(i).to_numpy() for i in range(4))
            cuts = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(sub) != 0)) + 1).tolist(), len(dim)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and key != (dim[lo], sub[lo]):
                    yield flush()
                    held = []
                key = (int(dim[lo]), int(sub[lo]))
                held.append((node[lo:hi].copy(), weight[lo:hi].copy(), batch.column(4).slice(lo, hi - lo).to_pylist()))
        if held:
            yield flush()

    return dealt.select("dim", "sub", "node", "weight", "raw").repartition(parts, "dim", "sub").sortWithinPartitions("dim", "sub").mapInArrow(run, "dim long, sub long, n long")


def join_chunks(pairs: DataFrame, uri: str, block_dims: int | None, threshold: float) -> DataFrame:
    """Per vector and pair of chunks: the weight it is linked to there, and a link into its component (null if it is the root)."""

    def run(batches):
        import pyarrow as pa

        store, root_dir = open_store(uri)

        def read(dim: int, sub: int):
            data = take(store, f"{root_dir}/{dim}-{sub}")
            n = int.from_bytes(data[:8], "little")
            ids = np.frombuffer(data, "<i8", 2 * n, 8)
            return ids[:n], ids[n:], np.frombuffer(data, "<f8", n * dim, 8 + 16 * n).reshape(n, dim)

        for batch in batches:
            for dim, p, q in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                node, w, x = read(dim, p)
                here = len(node)
                if p != q:
                    node_q, w_q, y = read(dim, q)
                    node, w = np.concatenate([node, node_q]), np.concatenate([w, w_q])
                n, root, width = np.zeros(len(node), np.int64), np.arange(len(node)), block_dims or dim
                for block in range(len(splits(dim, width))):
                    left = Side(x, block, width, threshold)
                    right = left if p == q else Side(y, block, width, threshold)
                    for a, b in links_between(left, right, block, threshold):  # links are many where vectors are dense, so each batch is added up at once
                        if p != q:
                            b = b + here
                        np.add.at(n, a, w[b])
                        np.add.at(n, b, w[a])
                        root = hook(root, a, b)
                some = np.flatnonzero(n)
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(node[root[some]], mask=root[some] == some)], names=["node", "linked", "other"])

    return pairs.select("dim", "p", "q").mapInArrow(run, FOUND)


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block_dims: int | None = None, chunk: int = CHUNK, scratch: Scratch | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    spark = vectors.sparkSession
    scratch, parts = scratch or Scratch(spark, "vectors"), partitions(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    marked = given.withColumn("good", F.coalesce(finite, F.lit(False)))
    # negative zero equals zero
    key = F.when(F.col("good"), F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)))
    rows = scratch.keep(marked.select("vec_id", key.alias("v")), "rows")
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("least_id"), F.count(F.lit(1)).alias("weight"))
    classes = classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v").cast("long"))
    classes = scratch.keep(classes, "classes")

    def to_bytes(batches):
        import pyarrow as pa

        for batch in batches:
            v = batch.column(3)
            flat, ends = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            raw = [flat[a:b].astype("<f8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(raw, pa.binary())], names=["node", "dim", "weight", "raw"])

    packed = scratch.keep(classes.select("node", "dim", "weight", "v").mapInArrow(to_bytes, "node long, dim long, weight long, raw binary"), "packed")
    counts = packed.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    few = F.least(F.lit(SPREAD), F.ceil(F.col("n") / F.lit(TILE)))
    subs = counts.select("dim", F.greatest(F.ceil(F.col("n") / F.lit(chunk)), few).cast("long").alias("subs"))
    dealt = packed.join(F.broadcast(subs), "dim").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")))  # a row for each length of vectors is sent
    uri = scratch.path("chunks")
    chunks = scratch.keep(write_chunks(dealt, uri, parts), "written")
    scratch.drop("packed")
    ends = chunks.select("dim", F.col("sub").alias("p")).join(chunks.select("dim", F.col("sub").alias("q")), "dim").where("p <= q")
    pairs = scratch.keep(ends.coalesce(1), "pairs")  # three numbers for two chunks
    found = scratch.keep(join_chunks(pairs.coalesce(1).repartition(max(1, min(pairs.count(), 8 * parts))), uri, block_dims, threshold), "found")
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    reached = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    ids = classes.join(linked, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    final = scratch.keep(ids.join(least, "component").select("v", "weight", F.coalesce("linked", F.lit(0)).alias("linked"), "component_id"), "final")
    out = rows.join(final, "v", "left")
    component = F.when(F.col("weight").isNull(), F.col("vec_id")).otherwise(F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    n = F.coalesce(F.col("linked") + F.col("weight") - 1, F.lit(0)).cast("long")
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
