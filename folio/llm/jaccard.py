"""Exact n-gram Jaccard self-join of whole texts, to connected components.

Equal shingle sets are one class.  Two sets that link share a shingle among the first ``n - ceil(percent * n / 100) + 1`` of
each in any one global order; here shingles that are frequent come last (counted over all documents in bounded summaries, which
steer the order and so the work, never the result).  Each class is listed under these shingles only.

**Set relations.**  A list is read in order of set size and cut where neighbouring sizes are too far apart to link; what
stands in one stretch is gathered with the stretch's first set, so that any two sets that could link meet in at least
one gathering, and a set is sent to a gathering once however many lists led there.  Inside a gathering (cut
into blocks by size, blocks of fitting sizes in pairs, if it is large) sets stand by size and an index list holds positions; a
set's scan jumps in each list to the range of positions whose sizes fit (index-level skipping).  **Answer-level skipping:** the overlaps that
a scan finds are kept for the last ``PIVOTS`` scanned sets.  A set that is highly similar to one of them (a smaller difference than
its own size) is not scanned: its overlaps are those of the other set, plus the lists of what it has more, minus the lists of what it
has less.  A set whose partners are all settled needs no answer at all: partners in its component need none, and others are excluded by
the kept distances, ``|d(p, x) - d(p, y)| <= d(x, y)`` where a link needs
``d(x, y) <= (|x| + |y|) * (100 - percent) / (100 + percent)``.  All in integers.

A gathering of more than ``BLOCK`` shingles is cut into blocks by size.  Each block is verified by itself together with the ``BRIDGES`` largest sets of the block
before it; after the components of these links are known, two blocks meet only with sets whose components differ.  A family of near copies,
which soon is one component, so costs work in proportion to its members; what stays quadratic are sets that share frequent shingles without linking.

Only links that join components leave a task, fewer than its sets; pairs are never rows.

Defined cases: null text counts as empty; a text without words has an empty set, links with nothing and is its own
component; fewer words than ``width`` make one shingle; a null ``doc_id`` is larger than any other and its component is null only
if no other id is reachable; rows that repeat an id are separate rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from folio.llm.components import Forest, components
from folio.llm.scratch import Scratch, partitions
from folio.llm.shingles import arrow_bytes, mix, shingle_sets
from folio.llm.tokens import release

NO_ID = (1 << 63) - 1
#: A shingle seen this often in a stretch of so many shingles is reported, and those reported this often in all are put last; at most so many.
IN_STRETCH, STRETCH, IN_ALL, FREQUENT = 2, 1 << 22, 3, 1 << 20
#: Shingles of a block, and the least a set counts, which bounds the sets of a block.
BLOCK, LEAST = 1 << 20, 1 << 9
PIVOTS = 12


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    if not len(shingles):
        return 0, 0
    a = int(np.add.reduce(mix(shingles))) & (1 << 64) - 1
    b = int(np.bitwise_xor.reduce(mix(shingles + np.uint64(0x9E3779B97F4A7C15))))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that are frequent, at most ``FREQUENT``: a bounded summary of all documents."""

    def run(batches):
        import pyarrow as pa

        release()
        held, total = [], 0

        def report():
            every = np.concatenate(held)
            held.clear()
            every.sort()  # in place: one stretch is the most that a task holds
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            n = np.diff(np.append(first, len(every)))
            got, n = every[first[n >= IN_STRETCH]], n[n >= IN_STRETCH]
            return pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for s in shingle_sets(*arrow_bytes(batch.column(0).slice(lo, 500)), width):
                    held.append(s)
                    total += len(s)
                if total >= STRETCH:
                    total = 0
                    yield report()
        if held:
            yield report()

    found = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= IN_ALL)
    table = found.orderBy(F.col("n").desc(), "h").limit(FREQUENT).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


SIGNED = "doc_id long, n long, hi long, lo long, prefix array<long>"


def signatures(docs: DataFrame, width: int, percent: int, frequent=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row its set's size and keys and, given the frequent shingles, those it is listed under; ``carry``: columns that follow."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    kinds = StructType([*StructType.fromDDL(SIGNED), *docs.select(*carry).schema])

    def run(batches):
        import pyarrow as pa

        often, counts = sent.value or (None, None)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sizes, his, los, flat, ends = [], [], [], [], [0]
                for s in shingle_sets(*arrow_bytes(part.column(1)), width):
                    n = len(s)
                    hi, lo_ = set_keys(s)
                    first = n + (-percent * n // 100) + 1 if n and often is not None else 0
                    if first and len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        s = s[np.argsort(np.where(often[at] == s, counts[at], 0), kind="stable")]
                    flat.append(s[:first])
                    sizes.append(n)
                    his.append(hi)
                    los.append(lo_)
                    ends.append(ends[-1] + first)
                values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), *part.columns[2:]],
                    names=["doc_id", "n", "hi", "lo", "prefix", *carry],
                )

    return docs.select("doc_id", "text", *carry).mapInArrow(run, kinds)


def gatherings(classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Distinct ``leader, node`` (leaders included): every two sets that share a listed shingle and fit in size are under one leader."""

    def run(batches):
        import pyarrow as pa

        last_h = last_n = leader = None
        for batch in batches:
            h, n, node = (batch.column(i).to_numpy() for i in range(3))
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])
            if last_h is not None:
                new[0] = h[0] != last_h or 100 * last_n < percent * n[0]
            group = np.cumsum(new) - 1  # -1: the stretch that the last batch began
            starts = np.append(node[new], 0)
            lead = np.where(group >= 0, starts[group], leader if leader is not None else 0)
            last_h, last_n, leader = h[-1], n[-1], lead[-1]
            other = lead != node
            pairs = np.unique(np.stack([lead[other], node[other]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["leader", "node"])

    listed = classes.where("n > 0").select(F.explode("prefix").alias("h"), "n", "node").repartition(parts, "h").sortWithinPartitions("h", "n", "node")
    pairs = listed.mapInArrow(run, "leader long, node long").distinct()
    return pairs


def links_in_block(sets: list[np.ndarray], percent: int, left: int | None = None, work: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join components among sets in order of size; with ``left``, only between the first ``left`` and the rest.

    ``work`` gets the numbers of sets scanned, of sets derived from another's answers, and of list entries read.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1] if m else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    index = np.sort(code * m + np.repeat(np.arange(m), sizes))  # lists by shingle, each by position
    low, high = 100 - percent, 100 + percent
    upto = np.searchsorted(sizes, sizes * 100 // percent, side="right")  # positions below it may fit
    forest, links = Forest(m), []
    near = np.full((PIVOTS, m), -1, np.int64)  # distances of kept sets to those that they were compared with
    kept = np.full(PIVOTS, -1, np.int64)
    n_near = 0
    work = [0, 0, 0] if work is None else work

    def overlaps(codes: np.ndarray, a: int, b: int) -> np.ndarray:
        """How many of ``codes`` each set at the positions from ``a`` to ``b`` has."""
        if a >= b or not len(codes):
            return np.zeros(max(b - a, 0), np.int64)
        lo, hi = np.searchsorted(index, codes * m + a), np.searchsorted(index, codes * m + b)
        n = hi - lo
        work[2] += int(n.sum())
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        return np.bincount(index[at] % m - a, minlength=b - a)

    for x in range(m if left is None else left):
        a, b = (x + 1 if left is None else max(left, x + 1)), int(upto[x])
        if a >= b:
            continue
        roots = forest.roots()
        open_ = roots[a:b] != roots[x]
        if not open_.any():
            continue
        total = sizes[a:b] + sizes[x]
        mine, held = code[ends[x] : ends[x + 1]], min(n_near, PIVOTS)
        if held:
            last = (n_near - 1) % PIVOTS
            if near[last, x] < 0:  # sets of the left block are compared with those of the right one only
                p = kept[last]
                near[last, x] = sizes[p] + sizes[x] - 2 * len(np.intersect1d(code[ends[p] : ends[p + 1]], mine, assume_unique=True))
            dx, dy = near[:held, x : x + 1], near[:held, a:b]
            open_ &= ~((dx >= 0) & (dy >= 0) & (high * np.abs(dx - dy) > low * total)).any(axis=0)
            if not open_.any():
                continue
        known = np.where(near[:held, x] >= 0, near[:held, x], sizes[x])
        if held and known.min() < sizes[x]:
            best = int(known.argmin())
            p = int(kept[best])
            theirs, mid = code[ends[p] : ends[p + 1]], max(a, min(b, int(upto[p])))
            more, less = np.setdiff1d(mine, theirs, assume_unique=True), np.setdiff1d(theirs, mine, assume_unique=True)
            common = (sizes[p] + sizes[a:mid] - near[best, a:mid]) // 2 + overlaps(more, a, mid) - overlaps(less, a, mid)
            common = np.concatenate([common, overlaps(mine, mid, b)])
            work[1] += 1
        else:
            common = overlaps(mine, a, b)
            work[0] += 1
        spot = n_near % PIVOTS
        near[spot] = -1
        near[spot, a:b] = total - 2 * common
        near[spot, x] = 0
        kept[spot] = x
        n_near += 1
        for y in np.flatnonzero(100 * common >= percent * (total - common)) + a:
            if forest.join(x, int(y)):
                links.append((x, int(y)))
    return links


def links(members: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """``a, b`` from rows ``leader, i, j, block, n, node, hi, lo, text``; a row whose text has other keys is another document of that id."""

    def run(batches):
        import pyarrow as pa

        release()
        key, sets, nodes, left = None, [], [], 0

        def flush():
            out = [(nodes[x], nodes[y]) for x, y in links_in_block(sets, percent, left if key[1] != key[2] else None)]
            sets.clear()
            nodes.clear()
            return out

        for batch in batches:
            got: list[tuple[int, int]] = []
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                own = shingle_sets(*arrow_bytes(part.column(8)), width)
                for leader, i, j, block, node, hi, lo_, s in zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6, 7)), own, strict=True):
                    if (leader, i, j) != key:
                        if key is not None:
                            got += flush()
                        key, left = (leader, i, j), 0
                    if nodes and nodes[-1] == node or set_keys(s) != (hi, lo_):
                        continue
                    sets.append(s)
                    nodes.append(node)
                    left += block == i
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "b"])
        if key is not None and (got := flush()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "b"])

    order = ["leader", "i", "j", "n", "node"]
    return members.select("leader", "i", "j", "block", "n", "node", "hi", "lo", "text").repartition(parts, *order[:3]).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


#: Sets of a block, its largest, that the next block of the gathering is compared with first.
BRIDGES = 4


def blocks(pairs: DataFrame, sized: DataFrame, scratch: Scratch) -> DataFrame:
    """``leader, node, n, block, last``: each gathering's sets, by size, in blocks; ``last`` counts from the block's end."""
    named = pairs.unionByName(pairs.select("leader", F.col("leader").alias("node")).distinct()).join(sized, "node")
    upto = Window.partitionBy("leader").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.withColumn("block", F.floor(F.sum(F.greatest("n", F.lit(LEAST))).over(upto) / F.lit(BLOCK)))
    return scratch.keep(placed.withColumn("last", F.row_number().over(Window.partitionBy("leader", "block").orderBy(F.col("n").desc(), F.col("node").desc()))), "placed")


def within(placed: DataFrame) -> DataFrame:
    """``leader, i, j, block, node, n``: each block by itself, with the largest sets of the block before it."""
    own = placed.select("leader", F.col("block").alias("i"), F.col("block").alias("j"), "block", "node", "n")
    after = F.col("block") + 1
    bridges = placed.where(F.col("last") <= BRIDGES).select("leader", after.alias("i"), after.alias("j"), "block", "node", "n")
    return own.unionByName(bridges.join(placed.where("block > 0").select("leader", F.col("block").alias("i")).distinct(), ["leader", "i"], "left_semi"))


def between(placed: DataFrame, reached: DataFrame, percent: int) -> DataFrame:
    """The same for pairs of blocks of fitting sizes, less what needs no comparison: sets of ``reached`` (``node, component``) that are in one component.

    Of a block that meets another of one component only, only sets of other components go there; two blocks of one and the same component do not meet.
    """
    large = placed.join(placed.where("block > 0").select("leader").distinct(), "leader", "left_semi")
    known = large.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = known.groupBy("leader", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high"))
    side = lambda name: spans.select("leader", *[F.col(c).alias(f"{name}_{c}") for c in ("block", "least", "most", "low", "high")])
    one_only = lambda name: F.when(F.col(f"{name}_low") == F.col(f"{name}_high"), F.col(f"{name}_low"))
    meet = side("i").join(side("j"), "leader").where((F.col("i_block") < F.col("j_block")) & (100 * F.col("i_most") >= percent * F.col("j_least")))
    meet = meet.where(~F.coalesce(one_only("i") == one_only("j"), F.lit(False)))
    i, j = F.col("i_block"), F.col("j_block")
    # of each pair two rows: a block and the one component of the other, if it has only one
    sent = meet.select("leader", i.alias("i"), j.alias("j"), F.explode(F.array(F.struct(i.alias("block"), one_only("j").alias("settled")), F.struct(j.alias("block"), one_only("i").alias("settled")))).alias("s"))
    sent = sent.select("leader", "i", "j", "s.block", "s.settled")
    return known.join(sent, ["leader", "block"]).where(F.col("settled").isNull() | (F.col("component") != F.col("settled"))).select("leader", "i", "j", "block", "node", "n")


KEYS = ["hi", "lo", "n"]


def _classes(rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """``hi, lo, n, component_id, stays``: a row for each distinct set; one set of each component ``stays``."""
    parts = partitions(rows.sparkSession)
    mark = F.xxhash64("text").alias("mark")
    signed = signatures(rows.select("doc_id", "text", mark), width, percent, frequent_shingles(rows, width), carry=("mark",))
    # the row that stands for a class is found again by its id and a hash of its text: ids may be null or repeat
    classes = signed.groupBy(*KEYS).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("least_id"), "mark")).alias("l"), F.first("prefix").alias("prefix"))
    classes = classes.select(*KEYS, F.col("l.least_id").alias("least_id"), F.col("l.mark").alias("mark"), "prefix")
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    pairs = scratch.keep(gatherings(classes, percent, parts), "pairs")
    slim = scratch.keep(classes.drop("prefix"), "slim")
    scratch.drop("classes")
    classes = slim
    placed = blocks(pairs, classes.select("node", "n"), scratch)
    texts = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("least_id"), mark, "text")

    def linked(members: DataFrame, name: str) -> DataFrame:
        named = scratch.keep(members.join(classes.select("node", "hi", "lo", "least_id", "mark"), "node"), f"members{name}")
        return scratch.keep(links(texts.join(named.hint("merge"), ["least_id", "mark"]), width, percent, parts), f"links{name}")

    found = linked(within(placed), "1")
    if not placed.where("block > 0").isEmpty():  # gatherings of several blocks: these meet where the first links leave anything open
        found = found.unionByName(linked(between(placed, components(found, scratch, "first"), percent), "2"))
    reached = components(found, scratch)
    ids = classes.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min(F.struct("least_id", "node")).alias("first"))
    return scratch.keep(ids.join(least, "component").select(*KEYS, "least_id", F.col("first.least_id").alias("component_id"), (F.col("node") == F.col("first.node")).alias("stays")), "final")


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; links are ``100 * common >= percent * union``."""
    rows = _rows(docs, id_col, text_col)
    final = _classes(rows, width, percent, scratch or Scratch(docs.sparkSession, "jaccard"))
    own = signatures(rows, width, percent).drop("prefix")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return own.join(final.drop("least_id", "stays"), KEYS, "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; rows without words all stay. Its columns may have any names."""
    final = _classes(_rows(docs, id_col, text_col), width, percent, scratch or Scratch(docs.sparkSession, "jaccard"))
    rows = _rows(docs, id_col, text_col, F.struct("*").alias("row"))
    own = signatures(rows, width, percent, carry=("row",)).drop("prefix")
    stay = own.join(final.where("stays").hint("merge"), KEYS).where((F.col("n") == 0) | (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("least_id")))
    # rows alike in id and set are one document; those without words stay apart
    alone = F.when(F.col("n") == 0, F.monotonically_increasing_id()).otherwise(0)
    one = stay.withColumn("alone", alone).dropDuplicates([*KEYS, "alone"])
    return one.select("row.*")
