"""Arrays of numbers as files in the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs


def squeezed(array: np.ndarray) -> bytes:
    """The bytes of an array, compressed behind their number."""
    raw = array.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def restored(data: bytes, kind: type | np.dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd") if size else b"", kind)


def place_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(path: str, array: np.ndarray) -> None:
    """An array written under its name at once; a task that runs again replaces it by the same."""
    files, at = place_of(path)
    files.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(pa.py_buffer(np.ascontiguousarray(array)))
    files.move(part, at)


def mapped(path: str, kind: type | np.dtype) -> np.ndarray:
    """An array of the folder, mapped into memory where the store is mounted, else read; empty if there is none."""
    files, at = place_of(path)
    info = files.get_file_info(at)
    if info.type == pafs.FileType.NotFound or not info.size:
        return np.zeros(0, kind)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(at, kind, "r")
    with files.open_input_file(at) as stream:
        return np.frombuffer(stream.read_buffer(), kind)
