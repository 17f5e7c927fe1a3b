"""Sinks of bytes for the writers: in memory, or a file of a path."""

from __future__ import annotations

from typing import BinaryIO, Protocol


class ByteSink(Protocol):
    """What a writer needs: to write at a position, to go elsewhere, and to have all stored."""

    position: int

    def write(self, data: bytes) -> None: ...

    def seek(self, position: int) -> None: ...

    def flush(self) -> None: ...


class MemorySink:
    """Bytes in memory; a write behind the end leaves zeros between, one before it goes over what is there."""

    def __init__(self) -> None:
        self.held, self.position = bytearray(), 0

    def write(self, data: bytes) -> None:
        if self.position > len(self.held):
            self.held.extend(bytes(self.position - len(self.held)))
        self.held[self.position : self.position + len(data)] = data
        self.position += len(data)

    def seek(self, position: int) -> None:
        self.position = position

    def flush(self) -> None:
        pass

    def bytes(self) -> bytes:
        return bytes(self.held)


class FileSink:
    """A binary file that is open for writing."""

    def __init__(self, file: BinaryIO):
        self.file, self.position = file, file.tell()

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.position += len(data)

    def seek(self, position: int) -> None:
        self.file.seek(position)
        self.position = position

    def flush(self) -> None:
        self.file.flush()
