"""Side files that executors write to and read from the shared folder.

Mounted folders (``file:``, and ``dbfs:`` by its mount) are opened directly. Object stores go by the names that Hadoop gives their
schemes; a scheme that Arrow has no client for goes through Arrow's Hadoop client, as ``hdfs:`` does.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs


def local(path: str) -> str | None:
    """The path on a mounted file system, or None for object stores and the like."""
    url = urlparse(path)
    if url.scheme == "dbfs":
        return f"/dbfs{url.path}"
    return url.path if url.scheme == "file" else path if not url.scheme else None


#: Hadoop's schemes by the ones that Arrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it."""
    scheme, _, rest = path.partition("://")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except pa.ArrowInvalid:  # no client for the scheme
        url = urlparse(path)
        return fs.HadoopFileSystem(f"{url.scheme}://{url.netloc}", 0), url.path


def write(path: str, data: bytes) -> None:
    """Write whole or not at all; a task that runs again writes the same bytes to the same place."""
    where = local(path)
    if where is not None:
        os.makedirs(os.path.dirname(where), exist_ok=True)
        part = f"{where}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, where)
    else:
        system, at = opened(path)
        with system.open_output_stream(at) as f:
            f.write(data)


def read(path: str) -> bytes:
    where = local(path)
    if where is not None:
        with open(where, "rb") as f:
            return f.read()
    system, at = opened(path)
    with system.open_input_stream(at) as f:
        return f.read()


@lru_cache(64)
def array(path: str, dtype: str) -> np.ndarray:
    """A file as an array, memory-mapped where the file system is mounted."""
    where = local(path)
    if where is None:
        return np.frombuffer(read(path), dtype)
    return np.memmap(where, dtype, "r") if os.path.getsize(where) else np.zeros(0, dtype)
