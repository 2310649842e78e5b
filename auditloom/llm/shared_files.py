"""Binary files in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from auditloom.session import scratch_root


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of ``uri``; a bare path is a local one."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def new_folder(spark: SparkSession, name: str) -> str:
    uri = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    files, path = open_folder(uri)
    files.create_dir(path, recursive=True)
    return uri


def put(uri: str, name: str, *parts) -> str:
    """Write a new file and return its own name.

    The name is unique to the attempt. A reader learns it only from the rows of
    a task that ended well, so what a lost executor leaves is never read.
    """
    files, path = open_folder(uri)
    unique = f"{name}-{uuid.uuid4().hex[:12]}"
    with files.open_output_stream(f"{path}/{unique}") as out:
        for part in parts:
            out.write(memoryview(np.ascontiguousarray(part)).cast("B") if isinstance(part, np.ndarray) else part)
    return f"{uri}/{unique}"


def get(uri: str) -> bytes:
    files, path = open_folder(uri)
    with files.open_input_stream(path) as source:
        return source.read()


def mapped(uri: str, kind) -> np.ndarray:
    """A file of numbers, memory-mapped where the folder is mounted, else read."""
    files, path = open_folder(uri)
    if isinstance(files, pafs.LocalFileSystem):
        if not files.get_file_info(path).size:
            return np.zeros(0, kind)
        return np.memmap(path, kind, "r")
    return np.frombuffer(get(uri), kind)
