"""Sorted arrays in the shared folder, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import numpy as np


def _local(path: str) -> str | None:
    """The path as this machine's file system has it, if the shared folder is mounted here."""
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def save(array: np.ndarray, path: str) -> None:
    """Write an array under the path. A task that runs again replaces the file as a whole."""
    here = _local(path)
    data = np.ascontiguousarray(array).tobytes()
    if here is None:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(inside), recursive=True)
        with store.open_output_stream(inside) as out:
            out.write(data)
        return
    os.makedirs(os.path.dirname(here), exist_ok=True)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(here), prefix=".part")
    with os.fdopen(handle, "wb") as out:
        out.write(data)
    os.replace(name, here)


def load(path: str, kind: str) -> np.ndarray:
    """The array as a memory map; empty if there is no such file. From a store that is not mounted, a worker reads the
    file into its memory and keeps the last few."""
    here = _local(path)
    return _fetched(path, kind) if here is None else _mapped(here, kind)


@lru_cache(maxsize=16)
def _fetched(path: str, kind: str) -> np.ndarray:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    if store.get_file_info(inside).type == fs.FileType.NotFound:
        return np.empty(0, dtype=kind)
    with store.open_input_file(inside) as source:
        return np.frombuffer(source.read_buffer(), dtype=kind)


@lru_cache(maxsize=256)
def _mapped(path: str, kind: str) -> np.ndarray:
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.empty(0, dtype=kind)
    return np.memmap(path, dtype=kind, mode="r")
