"""Small binary files in the shared folder, by Arrow's file systems."""

from __future__ import annotations

import re
import uuid


def open_store(uri: str, create: bool = False):
    """The file system and the folder of ``uri``; Hadoop's names of S3 (``s3a``, ``s3n``) are Arrow's ``s3``."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", uri))
    if create:
        store.create_dir(root, recursive=True)
    return store, root


def put(store, path: str, *parts: bytes) -> None:
    """Write under another name and rename, so that a file is whole or absent, and a task that runs again replaces it by the same bytes."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        for p in parts:
            f.write(p)
    store.move(tmp, path)


def take(store, path: str, missing: bool = False) -> bytes | None:
    """The bytes of a file; with ``missing``, None if there is none."""
    try:
        with store.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        if not missing:
            raise
        return None


def gone(store, path: str) -> None:
    """Delete a file that may have gone already."""
    try:
        store.delete_file(path)
    except OSError:
        if store.get_file_info(path).type.name != "NotFound":
            raise
