"""Raw arrays in the shared folder: written whole by tasks, mapped into memory by workers."""

from __future__ import annotations

import os
import uuid

import numpy as np


def _local(uri: str) -> str | None:
    """The path, where the shared folder is mounted; None for another kind of store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_array(uri: str, values: np.ndarray) -> None:
    """The file appears whole, so a task that runs again, or twice at a time, does no harm."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(inner) as f:
            f.write(values.tobytes())
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    values.tofile(part)
    os.replace(part, path)


def map_array(uri: str, kind: str) -> np.ndarray:
    """The array, mapped; from a store that can't be mapped it is read into memory."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        with store.open_input_file(inner) as f:
            return np.frombuffer(f.read(), kind)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def write_counts(uri: str, values: np.ndarray) -> None:
    """Counts in 32 bits, or in 64 where one of them needs more."""
    write_array(uri, values.astype("<u8" if len(values) and int(values.max()) >= 1 << 32 else "<u4"))


def map_counts(uri: str, n: int) -> np.ndarray:
    """The ``n`` counts that ``write_counts`` wrote."""
    data = map_array(uri, "u1")
    return data.view("<u8" if len(data) == 8 * n else "<u4") if n else np.empty(0, "<u4")
