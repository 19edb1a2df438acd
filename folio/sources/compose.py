"""One file out of ordered rows, without one task or the driver holding it.

Each task writes its range of the rows as a part below ``_parts`` beside the file, and says how many bytes that took; running sums of those, a number for each task, are the
offsets at which parts lie in the whole.  Where the file system can write at an offset (a shared folder), tasks copy their parts into place at once; elsewhere one task streams the parts
in order, a megabyte at a time.  The file appears by a rename.  A task that runs again writes a part under another name; the one that is reported counts.

Defined cases: rows with null text are left out, also between separators; empty texts count as rows; no rows make an empty file; an existing file is replaced when the new one is whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.objects import open_store
from folio.sources.shared import settled

CHUNK = 1 << 20


def _address(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def _write_parts(uri: str, separator: bytes):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        store, folder = open_store(uri)
        part, name, size, n = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                for value in batch.column(0):
                    data = (separator if n else b"") + value.as_buffer().to_pybytes()
                    out.write(data)
                    size, n = size + len(data), n + 1
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "size": [size], "n": [n]}, schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("size", pa.int64()), ("n", pa.int64())]))

    return run


def _chunks(store, at: str) -> Iterator[bytes]:
    with store.open_input_stream(at) as f:
        while data := f.read(CHUNK):
            yield data


def _place(uri: str, target: str, separator: bytes):
    """Moves parts to their offsets in a file that is there already; a part in place is marked so and deleted, so the whole and its parts are not on disk twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = open_store(uri)
        for pdf in batches:
            out = os.open(target, os.O_WRONLY)
            try:
                for name, offset in zip(pdf["name"], pdf["offset"], strict=True):
                    if store.get_file_info(f"{folder}/{name}.placed").is_file:
                        continue
                    at = int(offset)
                    if at:
                        os.pwrite(out, separator, at - len(separator))
                    for data in _chunks(store, f"{folder}/{name}"):
                        while data:
                            done = os.pwrite(out, data, at)
                            at, data = at + done, data[done:]
                    os.fsync(out)
                    store.open_output_stream(f"{folder}/{name}.placed").close()  # from here on the part isn't needed
                    store.delete_file(f"{folder}/{name}")
            finally:
                os.close(out)
            yield pdf[["name"]]

    return run


def _stream(uri: str, target: str, names: list[str], separator: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = open_store(uri)
        for pdf in batches:
            with store.open_output_stream(target) as out:
                for i, name in enumerate(names):
                    if i:
                        out.write(separator)
                    for data in _chunks(store, f"{folder}/{name}"):
                        out.write(data)
            yield pdf

    return run


def compose(rows: DataFrame, path: str, text: str = "text", separator: str = "", by_offset: bool | None = None) -> int:
    """Write the texts of ``rows``, which are in order over their partitions (as ``orderBy`` leaves them), to one file; its size in bytes."""
    spark, uri = rows.sparkSession, _address(path)
    between = separator.encode()
    store, final = open_store(uri)
    name = uuid.uuid4().hex[:12]
    base, _, last = final.rpartition("/")
    parent = uri[: -len(last)] if last else uri
    staging, whole = f"{parent}_parts-{name}", f"{base}/_parts-{name}/whole"
    own = rows.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))
    parts = [r for r in settled(own.mapInArrow(_write_parts(staging, between), "part int, name string, size long, n long")).orderBy("part").collect() if r["n"]]  # a row for each task
    offsets, total = [], 0
    for i, r in enumerate(parts):
        total += len(between) if i else 0
        offsets.append(total)
        total += r["size"]
    store.create_dir(f"{base}/_parts-{name}", recursive=True)
    if by_offset if by_offset is not None else uri.startswith("file:"):
        with open(whole, "wb") as f:
            f.truncate(total)
        if parts:
            placed = spark.createDataFrame([(r["name"], o) for r, o in zip(parts, offsets, strict=True)], "name string, offset long").repartition(len(parts))
            placed.mapInPandas(_place(staging, whole, between), "name string").write.format("noop").mode("overwrite").save()
    else:
        spark.range(1).mapInPandas(_stream(staging, whole, [r["name"] for r in parts], between), "id long").write.format("noop").mode("overwrite").save()
    store.move(whole, final)
    store.delete_dir(f"{base}/_parts-{name}")
    return total
