"""Random access to the bytes of a file: paths and URIs, bytes in memory, open files."""

from __future__ import annotations

import io
import os
from pathlib import Path
from typing import Protocol

from pyarrow import fs


class ByteSource(Protocol):
    """What metadata readers need."""

    name: str

    def __len__(self) -> int: ...

    def read(self, offset: int, length: int) -> bytes: ...


class MemorySource:
    """Bytes in memory, such as a file read from standard input."""

    def __init__(self, data: bytes, name: str = "<memory>"):
        self.data, self.name = bytes(data), name

    def __len__(self) -> int:
        return len(self.data)

    def read(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]

    def open(self):
        return io.BytesIO(self.data)


class FileSource:
    """A file on any file system that Arrow knows: a local path or a URI (file, s3, gs, hdfs)."""

    def __init__(self, path: str | os.PathLike):
        self.name = os.fspath(path)
        if "://" in self.name or self.name.startswith("file:"):
            uri = self.name if "://" in self.name else "file://" + self.name[5:]
            self.system, self.path = fs.FileSystem.from_uri(uri)
        else:
            self.system, self.path = fs.LocalFileSystem(), str(Path(self.name).absolute())
        info = self.system.get_file_info(self.path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.name)
        self.size = info.size

    def __len__(self) -> int:
        return self.size

    def read(self, offset: int, length: int) -> bytes:
        with self.open() as file:
            return file.read_at(length, offset)

    def open(self):
        return self.system.open_input_file(self.path)


def source(of) -> ByteSource:
    """A source from a path, URI, bytes or a source."""
    if isinstance(of, bytes | bytearray | memoryview):
        return MemorySource(bytes(of))
    return of if hasattr(of, "read") and hasattr(of, "name") and hasattr(of, "__len__") else FileSource(of)
