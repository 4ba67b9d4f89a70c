"""Files of token ids: independent zstandard frames, then a table of the documents and the seek table.

The layout is the public seekable format: any zstandard reader decompresses the whole file to the ids of all
documents, little-endian, 2 or 4 bytes each; skippable frames at the end hold what a reader needs to
fetch single documents. A document is one frame, or several if it has more than FRAME ids.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

import numpy as np

# Fixed values of the public format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

FRAME = 4_000_000
_HEAD = "<II"
_FOOT = "<IBI"
_FRAMES = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
_DOCS = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("ids", "<u8"), ("frame", "<u8"), ("start", "<u8")])


def _checksum(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open binary file; `close` writes the tables, not the file's end."""

    def __init__(self, file: BinaryIO, width: int = 2, level: int = 3):
        from zstandard import ZstdCompressor

        self.file, self.width, self.frames, self.docs = file, width, [], []
        self.packer, self.ids = ZstdCompressor(level=level), 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids), len(self.frames), self.ids))
        self.ids += len(ids)
        for at in range(0, len(ids), FRAME):
            data = ids[at : at + FRAME].astype(f"<u{self.width}").tobytes()
            packed = self.packer.compress(data)
            self.file.write(packed)
            self.frames.append((len(packed), len(data), _checksum(data)))

    def close(self) -> None:
        index = bytes([self.width]) + np.array(self.docs, _DOCS).tobytes()
        self.file.write(struct.pack(_HEAD, SKIPPABLE, len(index) + 8) + index + struct.pack("<Q", len(self.docs)))
        table = np.array(self.frames, _FRAMES).tobytes() + struct.pack(_FOOT, len(self.frames), CHECKSUMS, SEEKABLE)
        self.file.write(struct.pack(_HEAD, SEEK_TABLE, len(table)) + table)


class Reader:
    """Documents of an open binary file that can seek, each decompressed and checked when asked for."""

    def __init__(self, file: BinaryIO, size: int):
        from zstandard import ZstdDecompressor

        self.file, self.unpacker = file, ZstdDecompressor()
        count, flags, magic = struct.unpack(_FOOT, self._at(size - struct.calcsize(_FOOT), struct.calcsize(_FOOT)))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        table = size - struct.calcsize(_FOOT) - count * _FRAMES.itemsize
        self.frames = np.frombuffer(self._at(table, count * _FRAMES.itemsize), _FRAMES)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        end = table - struct.calcsize(_HEAD)
        (documents,) = struct.unpack("<Q", self._at(end - 8, 8))
        start = end - 8 - documents * _DOCS.itemsize
        self.width = self._at(start - 1, 1)[0]
        self.docs = np.frombuffer(self._at(start, documents * _DOCS.itemsize), _DOCS)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.docs)

    def doc_id(self, number: int) -> int | None:
        row = self.docs[number]
        return int(row["doc_id"]) if row["known"] else None

    def ids(self, number: int) -> np.ndarray:
        """The ids of a document, from its own frames alone."""
        left, frame, parts = int(self.docs[number]["ids"]), int(self.docs[number]["frame"]), []
        while left > 0:
            packed, size, checksum = (int(v) for v in self.frames[frame])
            data = self.unpacker.decompress(self._at(int(self.offsets[frame]), packed), max_output_size=size)
            if _checksum(data) != checksum:
                raise ValueError(f"frame {frame} is damaged")
            parts.append(np.frombuffer(data, f"<u{self.width}"))
            left -= len(parts[-1])
            frame += 1
        return np.concatenate(parts) if parts else np.empty(0, f"<u{self.width}")
