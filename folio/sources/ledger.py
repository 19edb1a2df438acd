"""Effects that happen once: requests to the outside, and a table of their results in the shared folder.

A request has a key (an address, or a hash of what is asked).  Keys without a result are dealt to tasks by lane; a task claims its bucket, asks, and commits
results as Parquet files, those of a fifth of a second at a time, each under a name of its own and renamed when whole.  A task that runs again reads what its bucket has
committed and asks only for the rest; what is asked goes to the tasks in waves of bounded size, file by file of the written table, so a task reads no more of it at once however
much there is; an attempt whose claim another has taken over stops.  What is read afterwards, however often, is the table.  A ledger
at a path of one's own can be opened again: what has a result is not asked again, what failed is (``again=False`` keeps failures too).

Lanes bound what is asked at once: a lane asks one request after another, whatever the size of the cluster.  ``lanes`` deals a host's addresses to a fixed
number of lanes, so a host that holds a third of all addresses is spread, but never asked for more than that at once.

Defined cases: a null key is never asked and has the error ``nothing to ask``; repeated keys are asked once and share the result; an effect that raises is a result with
an error, one that takes longer than ``seconds`` has the error ``TimeoutError``; what is left at the deadline is not asked, and has the error ``DeadlineExceeded`` in this run only; an
empty table asks nothing.  A request that is in flight, or answered for
less than that fifth of a second, when its process dies is asked again (with ``flush=1`` only one in flight).
"""

from __future__ import annotations

import contextlib
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.sources.shared import settled, shared_dir

#: Results and bytes that a task holds before it commits them, and seconds that a result waits at most.
FLUSH_ROWS, FLUSH_BYTES, LINGER = 1_000, 16 << 20, 0.2
#: Files of a bucket after which its small ones are put together.
FOLD = 256
#: Bytes on disk of what a bucket is handed at once, on average; one file of the written table is not divided.
WAVE_BYTES = 24 << 20
#: Seconds between two looks at what other tasks have noted.
LOOK = 0.5


class Refused(Exception):
    """An answer that doesn't count; its text is the error."""


def lanes(address: Column, per_host: int) -> Column:
    """The host of an address, with the number of one of its lanes."""
    host = F.lower(F.regexp_extract(address, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.concat_ws("#", host, F.pmod(F.xxhash64(address), F.lit(per_host)).cast("string"))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", uri))


def _put(store, path: str, data: bytes) -> None:
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    tmp = f"{folder}/_{name}.{uuid.uuid4().hex}"  # Spark doesn't read names that begin so
    with store.open_output_stream(tmp) as out:
        out.write(data)
    store.move(tmp, path)


def _names(store, folder: str) -> list[str]:
    from pyarrow import fs

    return sorted(i.path for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file and not i.base_name.startswith("_"))


def timed(effect: Callable, seconds: float | None) -> Callable:
    """``effect`` on a thread that is left behind when it takes too long."""
    if seconds is None:
        return effect

    def run(argument):
        got: list = []

        def body():
            try:
                got.append((effect(argument), None))
            except BaseException as e:
                got.append((None, e))

        thread = threading.Thread(target=body, daemon=True)
        thread.start()
        thread.join(seconds)
        if not got:
            raise TimeoutError(f"no answer in {seconds:g} s")
        if got[0][1] is not None:
            raise got[0][1]
        return got[0][0]

    return run


class _Bucket:
    """What a task asks for: its claim, what is committed already, and results on their way."""

    def __init__(self, uri: str, run: str, schema: T.StructType, flush: int, stop: bool):
        from pyspark import TaskContext

        task = TaskContext.get()
        self.store, self.root = _open(uri)
        self.run, self.schema, self.flush_rows, self.stop = run, schema, flush, stop
        bucket = f"{run}-{task.partitionId():06d}"
        self.folder, self.claim = f"{self.root}/results/{bucket}", f"{self.root}/claims/{bucket}"
        self.attempt, self.lock, self.rows, self.held, self.made = uuid.uuid4().hex, threading.RLock(), [], 0, 0
        self.flushed, self.waiting = time.time(), None
        self.looked, self.first_error = 0.0, None
        _put(self.store, self.claim, self.attempt.encode())
        self.done = self._done()

    def _done(self) -> set[str]:
        import pyarrow.parquet as pq

        return {k for name in _names(self.store, self.folder) for k in pq.read_table(name, columns=["key"], filesystem=self.store)["key"].to_pylist()}

    def owned(self) -> None:
        with self.store.open_input_stream(self.claim) as f:
            if f.read().decode() != self.attempt:
                raise RuntimeError("another attempt of this task has taken over")

    def add(self, key: str, order, values: dict, error: str | None) -> None:
        with self.lock:
            self.rows.append({**values, "key": key, "error": error, "at": time.time()})
            self.held += sum(len(v) for v in values.values() if isinstance(v, (str, bytes)))
            if error is not None and self.stop:
                _put(self.store, f"{self.root}/stops/{self.run}/{uuid.uuid4().hex}", str(order).encode())
                self.looked = 0.0
            self.done.add(key)
            if len(self.rows) >= self.flush_rows or self.held >= FLUSH_BYTES or time.time() - self.flushed > LINGER:
                self.flush()
            elif self.waiting is None:
                self.waiting = threading.Timer(LINGER, self._late)
                self.waiting.daemon = True
                self.waiting.start()

    def _late(self) -> None:
        with self.lock:
            with contextlib.suppress(Exception):  # the next one says so
                self.flush()

    def flush(self) -> None:
        """Commit what is held as one file."""
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        with self.lock:
            if self.waiting is not None:
                self.waiting.cancel()
                self.waiting = None
            if not self.rows:
                return
            self.owned()
            out = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_pylist(self.rows, schema=to_arrow_schema(self.schema)), out)
            _put(self.store, f"{self.folder}/{self.attempt}-{self.made:06d}.parquet", out.getvalue().to_pybytes())
            self.rows, self.held, self.made, self.flushed = [], 0, self.made + 1, time.time()
            if self.made % FOLD == 0:
                self.fold()

    def fold(self) -> None:
        """Few files of this bucket instead of many small ones; what is in both for a moment is one result."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        small = [n for n in _names(self.store, self.folder) if self.store.get_file_info(n).size < FLUSH_BYTES // 2]
        while len(small) > 1:
            some, tables, size = [], [], 0
            while small and size < FLUSH_BYTES:
                some.append(small.pop())
                tables.append(pq.read_table(some[-1], filesystem=self.store))
                size += tables[-1].nbytes
            self.owned()
            out = pa.BufferOutputStream()
            pq.write_table(pa.concat_tables(tables), out)
            _put(self.store, f"{self.folder}/{self.attempt}-{self.made:06d}-folded.parquet", out.getvalue().to_pybytes())
            self.made += 1
            for name in some:
                self.store.delete_file(name)

    def beyond(self, order) -> bool:
        """Whether something before this has failed, as far as noted a moment ago."""
        if not self.stop:
            return False
        with self.lock:
            if time.time() - self.looked > LOOK:
                for name in _names(self.store, f"{self.root}/stops/{self.run}"):
                    with self.store.open_input_stream(name) as f:
                        found = f.read().decode()
                    self.first_error = found if self.first_error is None else min(self.first_error, found)
                self.looked = time.time()
            return self.first_error is not None and str(order) > self.first_error


def _waves(files: list[str], most: int) -> list[list[str]]:
    """The files in order, so many at once that they have ``most`` bytes at most, or one."""
    out, size = [], 0
    for name in sorted(files):
        store, at = _open(name)
        own = store.get_file_info(at).size
        if not out or size + own > most:
            out.append([])
            size = 0
        out[-1].append(name)
        size += own
    return out


class Ledger:
    """The results of one kind of effect, of which ``schema`` names the columns, at ``path`` (without one, a new folder among the shared ones)."""

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None):
        self.spark, self.uri = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex[:12]}"
        self.columns = T.StructType.fromDDL(schema)
        self.schema = T.StructType([*self.columns.fields, T.StructField("key", T.StringType()), T.StructField("error", T.StringType()), T.StructField("at", T.DoubleType())])
        store, root = _open(self.uri)
        store.create_dir(f"{root}/results", recursive=True)

    def rows(self) -> DataFrame:
        """All results, those of a key that was asked again too."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.uri}/results")

    def results(self) -> DataFrame:
        """``key``, the columns of the effect and ``error``: of a key's results one that went well, else the latest."""
        rows = self.rows()
        last = F.row_number().over(Window.partitionBy("key").orderBy(F.col("error").isNotNull(), F.col("at").desc()))
        return rows.withColumn("last", last).where("last = 1").select("key", *self.columns.names, "error")

    def settle(self, asked: DataFrame, effect: Callable, key: str = "key", argument: str | None = None, lane: Column | None = None, order: str | None = None, buckets: int | None = None, threads: int = 5, seconds: float | None = None, deadline: float | None = None, flush: int = FLUSH_ROWS, stop: bool = False, again: bool = True) -> DataFrame:
        """``asked`` with ``result`` (a struct of the effect's columns) and ``error``; every key has been asked when this returns.

        ``effect`` maps the argument (the key, if none is named) to a dictionary of the columns, on the executors. ``lane`` depends on the key alone, so that repeated keys meet
        in one lane, where the first is asked; ``order`` is the order within a lane, with ``stop`` or a deadline over all waves, else within one; with
        ``stop`` what comes after the first failure in that order is left out of asking as soon as tasks hear of it.
        """
        known = (self.rows().where("error IS NULL") if again else self.rows()).select("key").distinct()
        name = argument or key
        rest = [F.col(c) for c in asked.columns if c != name]
        row = F.struct(*rest) if rest else F.lit(None).cast("struct<none:int>")
        lane = lane if lane is not None else F.col(key)
        # written, since what is asked is read twice, and so that its columns are computed once
        named = asked.select(row.alias("row"), F.col(key).cast("string").alias("key"), F.col(name).alias("argument"), F.coalesce(F.col(order or key).cast("string"), F.lit("")).alias("order"), lane.cast("string").alias("lane"))
        rows = settled(named.repartitionByRange("order", "key") if stop or deadline is not None else named)
        run, uri, schema, until = uuid.uuid4().hex[:8], self.uri, self.schema, None if deadline is None else time.time() + deadline
        limited = timed(effect, seconds)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from concurrent.futures import ThreadPoolExecutor

            bucket = _Bucket(uri, run, schema, flush, stop)

            def follow(some: pd.DataFrame) -> None:
                for r in some.sort_values("order", kind="stable").itertuples(index=False):
                    if r.key in bucket.done or (until is not None and time.time() > until) or bucket.beyond(r.order):
                        continue
                    try:
                        values, error = limited(r.argument), None
                    except Refused as e:
                        values, error = {}, str(e)
                    except Exception as e:  # what cannot be had is a result too
                        values, error = {}, f"{type(e).__name__}: {e}"
                    bucket.add(r.key, r.order, values, error)

            with ThreadPoolExecutor(threads) as pool:
                for pdf in batches:
                    try:
                        list(pool.map(follow, [some for _, some in pdf.groupby("lane", sort=False, dropna=False)]))
                    finally:
                        bucket.flush()
                    yield pd.DataFrame({"n": [len(pdf)]})
            bucket.fold()

        parts = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for files in _waves(rows.inputFiles(), parts * WAVE_BYTES):
            some = self.spark.read.schema(rows.schema).parquet(*files)
            wanted = some.where("key IS NOT NULL").select("key", "order", "lane", "argument").join(known, "key", "left_anti")
            # a lane is one bucket's in every wave, where what an earlier wave has asked is known
            dealt = wanted.repartition(parts, "lane").sortWithinPartitions("order") if order else wanted.repartition(parts, "lane")
            dealt.mapInPandas(ask, "n long").write.format("noop").mode("overwrite").save()
        got = self.results().select("key", F.struct(*self.columns.names).alias("result"), "error", F.lit(True).alias("settled"))
        none = F.when(F.col("key").isNull(), "nothing to ask").when(F.col("settled").isNull(), "not asked: after a failure" if stop else "DeadlineExceeded: not asked")
        back = [F.col("argument").alias(c) if c == name else F.col("row")[c].alias(c) for c in asked.columns]
        return rows.select("row", "key", "argument").join(got, "key", "left").select(*back, "result", F.coalesce("error", none).alias("error"))
