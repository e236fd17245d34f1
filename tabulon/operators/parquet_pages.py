"""The dictionary page of a column chunk of a Parquet file, read without the chunk's data."""

from __future__ import annotations

import struct

import pyarrow as pa
import pyarrow.parquet as pq

# Fixed values of the format: page types and encodings.
_DATA, _DICTIONARY, _DATA_2 = 0, 2, 3
_CODED = (2, 8)
_CODECS = {"UNCOMPRESSED": None, "SNAPPY": "snappy", "GZIP": "gzip", "BROTLI": "brotli", "ZSTD": "zstd", "LZ4": "lz4_raw", "LZ4_RAW": "lz4_raw"}


class _Compact:
    """Reads structs of Thrift's compact protocol into {field number: value}."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        b = self.data[self.at]
        self.at += 1
        return b

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            z = self.varint()
            return (z >> 1) ^ -(z & 1)
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise IndexError
            return None
        if kind in (9, 10):
            head = self.byte()
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return [self.value(head & 15) for _ in range(n)]
        if kind == 12:
            return self.struct()
        raise ValueError(kind)

    def struct(self) -> dict:
        out, field = {}, 0
        while head := self.byte():
            if head >> 4:
                field += head >> 4
            else:
                z = self.varint()
                field = (z >> 1) ^ -(z & 1)
            out[field] = self.value(head & 15)
        return out


def _header(raw: pa.NativeFile, at: int, end: int) -> tuple[dict, int]:
    """(page header, where the page's data begin); statistics may make a header long."""
    size = 256
    while True:
        raw.seek(at)
        reader = _Compact(raw.read(min(size, end - at)))
        try:
            return reader.struct(), at + reader.at
        except IndexError:
            if size >= end - at:
                raise ValueError("A page header does not end.") from None
            size *= 8


def chunk_dictionary(raw: pa.NativeFile, chunk: pq.ColumnChunkMetaData) -> list[str] | None:
    """The distinct texts of a chunk all of whose pages are coded by its dictionary; None if it has to be read.

    Only the page headers and the dictionary page are read from the file.
    """
    if not chunk.has_dictionary_page or chunk.physical_type != "BYTE_ARRAY" or chunk.compression not in _CODECS:
        return None
    at = chunk.dictionary_page_offset or chunk.data_page_offset
    end, seen, found = at + chunk.total_compressed_size, 0, None
    try:
        while at < end and seen < chunk.num_values:
            head, start = _header(raw, at, end)
            at = start + head[3]
            if head[1] == _DICTIONARY:
                raw.seek(start)
                found = _texts(raw.read(head[3]), head[2], _CODECS[chunk.compression], head[7][1])
            elif head[1] in (_DATA, _DATA_2):
                page = head[5] if head[1] == _DATA else head[8]
                if page[2 if head[1] == _DATA else 4] not in _CODED:
                    return None
                seen += page[1]
    except (KeyError, ValueError, IndexError, struct.error, UnicodeDecodeError):
        return None
    return found


def _texts(data: bytes, size: int, codec: str | None, n: int) -> list[str]:
    plain = data if codec is None else pa.decompress(data, decompressed_size=size, codec=codec, asbytes=True)
    out, at = [], 0
    for _ in range(n):
        (k,) = struct.unpack_from("<I", plain, at)
        out.append(plain[at + 4 : at + 4 + k].decode())
        at += 4 + k
    return out
