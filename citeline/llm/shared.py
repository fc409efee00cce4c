"""Sorted arrays in files of the shared folder: written by tasks, mapped into memory by workers.

A file is written under a name of the attempt and then renamed, so a task that runs twice leaves the same whole file.
Where the shared folder is no mounted path, a worker fetches a file into its own temporary folder before mapping it.
"""
from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.fs
from pyspark.sql import SparkSession

from citeline.session import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the folder named in ``spark.checkpoint.dir`` that no other run uses, with its scheme."""
    folder = scratch_path(spark, name)
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), unquote(parts.path)
    return pyarrow.fs.FileSystem.from_uri(path)


def write_bytes(folder: str, name: str, parts) -> int:
    """Writes the parts (buffers) one after another; returns the size."""
    fs, at = _place(folder)
    fs.create_dir(at, recursive=True)
    trial, size = f"{at}/.{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(trial) as out:
        for part in parts:
            size += memoryview(part).nbytes
            out.write(part)
    fs.move(trial, f"{at}/{name}")
    return size


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    write_bytes(folder, name, [np.ascontiguousarray(values)])


def open_input(folder: str, name: str):
    fs, at = _place(folder)
    return fs.open_input_file(f"{at}/{name}")


@lru_cache(maxsize=4096)
def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """The array of a file, mapped read-only."""
    fs, at = _place(folder)
    path = f"{at}/{name}"
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), f"{uuid.uuid5(uuid.NAMESPACE_URL, folder + name).hex}")
        if not os.path.exists(local):
            pyarrow.fs.copy_files(path, f"{local}.{os.getpid()}", source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
            os.rename(f"{local}.{os.getpid()}", local)
        path = local
    if os.path.getsize(path) == 0:
        return np.zeros(0, kind)
    return np.memmap(path, dtype=kind, mode="r")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the leading 32 bits, so that shards hold ascending ranges of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of ascending ``wanted`` keys in an ascending array."""
    if len(sorted_keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.searchsorted(sorted_keys, wanted)
    place[place == len(sorted_keys)] = 0
    return place, sorted_keys[place] == wanted
