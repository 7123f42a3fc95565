"""Chunked trace containers as a Spark data source.

A container is a header (magic, version), then sections, each with a header and its
chunks; a chunk has a header and a stored or raw-LZ4 payload. The walk reads headers
only; each chunk is one input partition, so that a large section is decoded in
parallel, one chunk in memory at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values of the format
MAGIC, VERSION = b"WRPV", 10
HEADER, SECTION, CHUNK = struct.Struct("<4sI"), struct.Struct("<HHHHIIQ"), struct.Struct("<HHIQQ")
MOST_SECTIONS, MOST_CHUNKS, MOST_BYTES = 4096, 1_000_000, 1 << 30
STORED, LZ4 = 0, 1
ROLES = {(1, 0): "document", (0, 1): "counters"}


class ContainerError(ValueError):
    """A file that isn't a container, or one that is cut short or inconsistent."""


@dataclass(frozen=True)
class Chunk(InputPartition):
    path: str
    section: int
    role: str
    chunk: int
    offset: int
    stored: int
    unpacked: int
    compression: int


def walk(path: str) -> list[Chunk]:
    """The chunks of a container, from its headers."""
    out = []
    with open(path, "rb") as file:
        magic, version = HEADER.unpack(_exactly(file, HEADER.size))
        if magic != MAGIC:
            raise ContainerError(f"{path} is not a trace container")
        if version != VERSION:
            raise ContainerError(f"unsupported container version {version}")
        section = 0
        while head := file.read(SECTION.size):
            if len(head) < SECTION.size:
                raise ContainerError(f"{path} is cut short in the header of section {section}")
            if section >= MOST_SECTIONS:
                raise ContainerError(f"{path} has more than {MOST_SECTIONS} sections")
            a, b, _, _, chunks, _, size = SECTION.unpack(head)
            if chunks > MOST_CHUNKS:
                raise ContainerError(f"section {section} has more than {MOST_CHUNKS} chunks")
            total = 0
            for k in range(chunks):
                kind, _, _, stored, unpacked = CHUNK.unpack(_exactly(file, CHUNK.size))
                if max(stored, unpacked) > MOST_BYTES:
                    raise ContainerError(f"chunk {k} of section {section} is larger than {MOST_BYTES} bytes")
                if kind not in (STORED, LZ4):
                    raise ContainerError(f"chunk {k} of section {section} has compression {kind}")
                out.append(Chunk(path, section, ROLES.get((a, b), "other"), k, file.tell(), stored, unpacked, kind))
                at = file.seek(stored, 1)
                if file.seek(0, 2) < at:
                    raise ContainerError(f"{path} is cut short in section {section}")
                file.seek(at)
                total += unpacked
            if total != size:
                raise ContainerError(f"the chunks of section {section} hold {total} bytes, its header says {size}")
            section += 1
    return out


def _exactly(file, n: int) -> bytes:
    got = file.read(n)
    if len(got) < n:
        raise ContainerError("the container is cut short")
    return got


def decode(chunk: Chunk) -> bytes:
    with open(chunk.path, "rb") as file:
        file.seek(chunk.offset)
        raw = _exactly(file, chunk.stored)
    if chunk.compression == LZ4:
        raw = pa.decompress(raw, decompressed_size=chunk.unpacked, codec="lz4_raw", asbytes=True)
    if len(raw) != chunk.unpacked:
        raise ContainerError(f"chunk {chunk.chunk} of section {chunk.section} holds {len(raw)} bytes instead of {chunk.unpacked}")
    return raw


def write_container(path: str, sections: list[tuple[tuple[int, int], list[tuple[bytes, bool]]]]) -> None:
    """Write (flags, [(payload, compress)]) sections; an existing file is not replaced."""
    with open(path, "xb") as file:
        file.write(HEADER.pack(MAGIC, VERSION))
        for (a, b), chunks in sections:
            file.write(SECTION.pack(a, b, 0, 0, len(chunks), 0, sum(len(p) for p, _ in chunks)))
            for payload, compress in chunks:
                raw = pa.compress(payload, codec="lz4_raw", asbytes=True) if compress else payload
                file.write(CHUNK.pack(LZ4 if compress else STORED, 0, 0, len(raw), len(payload)) + raw)


def section_of(chunks: list[Chunk], role: str) -> int:
    """The one section of a role."""
    found = {c.section for c in chunks if c.role == role}
    if len(found) != 1:
        raise ContainerError(f"expected one section of role {role}, found {len(found)}")
    return found.pop()


class ContainerSource(DataSource):
    """``spark.read.format("trace_container").load(path)``: one row per chunk."""

    @classmethod
    def name(cls) -> str:
        return "trace_container"

    def schema(self) -> str:
        return "path string, section int, role string, chunk int, compression int, stored bigint, unpacked bigint, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Chunk]:
        return walk(self.path)

    def read(self, partition: Chunk) -> Iterator[tuple]:
        p = partition
        yield p.path, p.section, p.role, p.chunk, p.compression, p.stored, p.unpacked, decode(p)
