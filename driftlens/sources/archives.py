"""Tensors in zip archives of a pickle and raw storages, read by rows: only an archive's index and the bytes asked for.

The pickle is read with a reader that knows tensors, storages and plain containers and refuses anything else. Files come
through Arrow's file systems, so paths may be local ones or URIs of any store that Arrow knows; an archive may be part of a
file. A tensor that is not stored row by row is read as far as its rows spread.
"""

from __future__ import annotations

import collections
import io
import pickle
import zipfile
from typing import NamedTuple

import numpy as np

#: Storage types of the format.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "?"}
_LOCAL_HEADER = 30  # bytes of a zip entry's own header before its name


class Tensor(NamedTuple):
    """Where a tensor lies in its archive: storage and type, first item, and size and stride of each dimension."""

    storage: str
    kind: str
    offset: int
    size: tuple
    stride: tuple

    @property
    def rows(self) -> int:
        return self.size[0] if self.size else 1


class _Unpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if module == "torch._utils" and name in ("_rebuild_tensor", "_rebuild_tensor_v2"):
            return lambda storage, offset, size, stride, *_: Tensor(*storage, offset, tuple(size), tuple(stride))
        if module in ("torch", "torch.storage") and name in STORAGES:
            return name
        raise pickle.UnpicklingError(f"not allowed: {module}.{name}")

    def persistent_load(self, pid):
        _, kind, key, *_ = pid
        return key, STORAGES[kind]


class _Span(io.RawIOBase):
    """Some bytes of an open file as a file."""

    def __init__(self, file, at: int, length: int):
        self.file, self.at, self.length, self.place = file, at, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = max(0, offset + (0, self.place, self.length)[whence])
        return self.place

    def readinto(self, buffer) -> int:
        got = self.file.read_at(max(0, min(len(buffer), self.length - self.place)), self.at + self.place)
        buffer[: len(got)] = got
        self.place += len(got)
        return len(got)


def open_path(path: str):
    """A file system and the path within it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def open_file(path: str):
    store, inside = open_path(path)
    return store.open_input_file(inside)


def read_whole(path: str) -> bytes:
    with open_file(path) as f:
        return f.read()


class Archive:
    """The archive in length bytes of an open file from byte at on, by default in all of it."""

    def __init__(self, file, at: int = 0, length: int | None = None):
        self.file, self.at = file, at
        self.zip = zipfile.ZipFile(io.BufferedReader(_Span(file, at, file.size() - at if length is None else length), 1 << 16))
        self.index = next(n for n in self.zip.namelist() if n.endswith("data.pkl"))

    def load(self):
        """What was stored, with a Tensor for each tensor."""
        return _Unpickler(io.BytesIO(self.zip.read(self.index))).load()

    def _bytes(self, storage: str, start: int, stop: int) -> bytes:
        entry = self.zip.getinfo(f"{self.index[: -len('data.pkl')]}data/{storage}")
        if entry.compress_type != zipfile.ZIP_STORED:
            return self.zip.read(entry)[start:stop]
        begin = self.at + entry.header_offset
        header = self.file.read_at(_LOCAL_HEADER, begin)
        begin += _LOCAL_HEADER + int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")
        return self.file.read_at(stop - start, begin + start)

    def rows(self, tensor: Tensor, a: int, b: int) -> np.ndarray:
        """Rows a to b of a tensor, each as a flat one."""
        kind = np.dtype(tensor.kind)
        size, stride = (tensor.size, tensor.stride) if tensor.size else ((1,), (1,))
        b = min(b, size[0])
        if a >= b or 0 in size:
            return np.zeros((max(0, b - a), int(np.prod(size[1:]))), kind)
        first = tensor.offset + a * stride[0]
        items = 1 + (b - 1 - a) * stride[0] + sum((n - 1) * s for n, s in zip(size[1:], stride[1:], strict=True))
        held = np.frombuffer(self._bytes(tensor.storage, first * kind.itemsize, (first + items) * kind.itemsize), kind)
        return np.lib.stride_tricks.as_strided(held, (b - a, *size[1:]), tuple(s * kind.itemsize for s in stride)).reshape(b - a, -1)


class Part(NamedTuple):
    """Some rows of a tensor: the archive they lie in and, where it holds more than one tensor, which."""

    path: str
    at: int
    length: int | None
    tensor: Tensor | None
    first: int
    n: int


def read_parts(parts: list[Part], a: int, b: int) -> np.ndarray:
    """Rows a to b of a tensor that lies in parts ordered by their first row."""
    held = []
    for part in parts:
        low, high = max(a, part.first), min(b, part.first + part.n)
        if low < high:
            with open_file(part.path) as f:
                archive = Archive(f, part.at, part.length)
                held.append(archive.rows(part.tensor or archive.load(), low - part.first, high - part.first))
    return np.concatenate(held) if held else np.zeros((0, 1))
