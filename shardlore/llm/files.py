"""Binary files in the shared folder: written whole or not at all, memory-mapped where the folder is a mounted file system.

Elsewhere (object stores) a file is read into memory, and a worker keeps the
most recently used ones up to ``CACHE`` bytes; nothing is copied to local disks.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import numpy as np
import pyarrow.fs

#: Bytes of unmapped files that a worker keeps.
CACHE = 256 << 20
#: Hadoop's names of stores, in pyarrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
_kept: OrderedDict[str, memoryview] = OrderedDict()


def place(base: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in base and not base.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), base
    if base.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + base[5:].lstrip("/")
    scheme, _, rest = base.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def write_arrays(base: str, name: str, arrays: list[np.ndarray]) -> None:
    """The arrays one after the other, under a temporary name first: a task that runs again only replaces the file."""
    fs, root = place(base)
    fs.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).data)
    fs.move(part, f"{root}/{name}")


def map_bytes(base: str, name: str) -> np.ndarray | memoryview:
    """A file's bytes, for np.frombuffer."""
    fs, root = place(base)
    path = f"{root}/{name}"
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype=np.uint8, mode="r")
    if path in _kept:
        _kept.move_to_end(path)
        return _kept[path]
    with fs.open_input_file(path) as source:
        body = memoryview(source.read())
    while _kept and sum(map(len, _kept.values())) + len(body) > CACHE:
        _kept.popitem(last=False)
    _kept[path] = body
    return body


def map_arrays(base: str, name: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of a file, of the given types and lengths; pages are read as they are touched."""
    body, at, out = map_bytes(base, name) if any(n for _, n in kinds) else b"", 0, []
    for kind, n in kinds:
        out.append(np.frombuffer(body, kind, n, at) if n else np.zeros(0, kind))
        at += n * np.dtype(kind).itemsize
    return out
