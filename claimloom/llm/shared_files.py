"""Plain binary files in the shared folder: written whole under a final name, memory-mapped by workers.

Where the folder is a mounted file system, files are mapped in place. Elsewhere a file
is copied once a worker and unlinked as soon as it is mapped, so nothing stays behind.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def write_bytes(uri: str, parts: list) -> None:
    """Buffers, one after another, as one file. A retried task replaces the file by an equal one."""
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        for p in parts:
            f.write(p)
    system.move(part, path)


def map_bytes(uri: str) -> np.ndarray:
    """A file's bytes, memory-mapped."""
    system, path = _open(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    handle, copy = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as out, system.open_input_stream(path) as f:
        while block := f.read(1 << 22):
            out.write(block)
    whole = np.memmap(copy, np.uint8, "r")
    os.unlink(copy)
    return whole


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """The arrays, one after another, behind their lengths in bytes."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    write_bytes(uri, [head, *(memoryview(np.ascontiguousarray(a)).cast("B") if a.nbytes else b"" for a in arrays)])


def map_arrays(uri: str, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped."""
    whole = map_bytes(uri)
    sizes = whole[8 : 8 + 8 * len(kinds)].view("<i8")
    at, out = 8 + 8 * len(kinds), []
    for kind, n in zip(kinds, sizes.tolist(), strict=True):
        out.append(whole[at : at + n].view(kind))
        at += n
    return out
