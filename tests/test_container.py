from __future__ import annotations

import struct

import pytest

from tracequarry.sources import container as c


def test_chunks_are_decoded_and_reassembled(spark, tmp_path):
    path = str(tmp_path / "t.bin")
    c.write_container(path, [((1, 0), [(b"protobuf", True)]), ((0, 1), [(b"LOP", False), (b"DATA\0payload" * 50, True)])])
    chunks = c.walk(path)
    assert [x.role for x in chunks] == ["document", "counters", "counters"] and c.section_of(chunks, "counters") == 1
    spark.dataSource.register(c.ContainerSource)
    rows = spark.read.format("trace_container").load(path).orderBy("section", "chunk").collect()
    assert [bytes(r["payload"]) for r in rows] == [b"protobuf", b"LOP", b"DATA\0payload" * 50]
    with pytest.raises(FileExistsError):
        c.write_container(path, [])


def test_bad_containers(tmp_path):
    path = tmp_path / "t.bin"
    for raw, said in ((b"WRPV" + struct.pack("<I", 11), "version 11"), (b"nope" + struct.pack("<I", 10), "not a trace container"), (b"WRPV", "cut short")):
        path.write_bytes(raw)
        with pytest.raises(c.ContainerError, match=said):
            c.walk(str(path))
    path.unlink()
    c.write_container(str(path), [((1, 0), [(b"abc", False)])])
    path.write_bytes(path.read_bytes()[:-1])
    with pytest.raises(c.ContainerError, match="cut short"):
        c.walk(str(path))
    with pytest.raises(c.ContainerError, match="found 0"):
        c.section_of([], "document")
