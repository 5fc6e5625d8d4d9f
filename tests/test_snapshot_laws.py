"""Digests taken in tasks, migration, and that a graph has one encoding."""

import random
import struct

import pytest

from arcwave.errors import ArcwaveError, SnapshotError
from arcwave.functions import blake3
from arcwave.graph import Graph
from arcwave.sources import snapshot as s
from test_queries import test_query_matches_sql as matches_sql

A, B = bytes(range(32)), bytes(range(32, 64))


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(11)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(2_000)]
    return Graph.from_dense_edges(spark, 900, spark.createDataFrame(pairs, "a bigint, b bigint"))


@pytest.mark.parametrize("name", ["snapshot_verified_chunks", "snapshot_migrated_edges"])
def test_matches_sql(spark, sf_dir, name):
    matches_sql(spark, sf_dir, name)


def test_parts_of_a_hash_merge_to_it():
    key = blake3.context_key("parts")
    for size in (0, 1, 1023, 1024, 1025, 2048, 4096, 4097, 9000, 16384, 20000):
        data = random.Random(size).randbytes(size)
        for step in (1, 2, 4):
            cuts = [data[k : k + step * 1024] for k in range(0, max(size, 1), step * 1024)]
            values = [blake3.material_part(x, key, k * step, len(cuts) == 1) for k, x in enumerate(cuts)]
            while len(values) > 2:
                values = [blake3.merged_parts(values[k : k + 2], key, False) for k in range(0, len(values), 2)]
            got = values[0] if len(values) == 1 else blake3.merged_parts(values, key, True)
            assert got == blake3.derive_key("parts", data)


def test_digest_in_tasks(spark, graph):
    data = s.encode_snapshot(graph, A)
    want = s.digest_snapshot(data, A, "tests")
    chunks = s.snapshot_chunks(graph, A, 333)
    assert s.digest_chunks(chunks, A, "tests") == want
    assert s.digest_chunks(chunks, A, "tests", part_chunks=2, fan=2) == want
    assert s.digest_chunks(chunks, A, "other") != want and s.digest_chunks(chunks, B, "tests") != want
    with pytest.raises(SnapshotError) as e:
        s.decode_verified_chunks(chunks, A, want[::-1], "tests")
    assert e.value.kind == "Digest"
    with pytest.raises(SnapshotError) as e:
        s.decode_verified_chunks(chunks, A, want, "tests", s.SnapshotLimits(max_bytes=100))
    assert e.value.kind == "ByteLimit"
    none = chunks.limit(0)
    assert s.digest_chunks(none, A, "tests") == s.digest_snapshot(b"", A, "tests")


def test_migration(spark, graph):
    old = s.snapshot_chunks(graph, A)
    new = s.migrate_chunks(old, A, B)
    assert s.decode_chunks(new, B).edges.exceptAll(graph.edges).isEmpty()
    joined = b"".join(bytes(r["bytes"]) for r in new.orderBy("chunk").collect())
    assert joined == s.encode_snapshot(graph, B)
    head = bytearray(s.header(0, 0, A))
    table = lambda x: spark.createDataFrame([(0, x)], "chunk bigint, bytes binary")
    for at, kind in ((0, "Magic"), (8, "Schema"), (24, "Version"), (26, "Version")):
        bad = bytearray(head)
        bad[at] ^= 1
        with pytest.raises(SnapshotError) as e:
            s.migrate_chunks(table(bad), A, B)
        assert e.value.kind == kind
    for data in (head[:79], bytearray()):
        with pytest.raises(SnapshotError):
            s.migrate_chunks(table(data), A, B)
    with pytest.raises(SnapshotError):  # a wrong profile is refused by the decoder
        s.migrate_chunks(old, B, A)
    # a later schema: its identity, its decoder
    later = bytearray(head)
    later[8:24] = b"a later schema 2"
    found = s.migrate_chunks(table(later), A, B, decoders={(b"a later schema 2", (1, 0)): lambda c, p, limits: graph})
    assert found.count() == old.count()


def test_one_encoding(spark):
    """Every prefix and every changed header is refused; a changed payload is refused, or is the encoding of what it decodes to."""
    g = Graph.from_dense_edges(spark, 4, spark.createDataFrame([(0, 1), (0, 3), (2, 1), (3, 3)], "a bigint, b bigint"))
    data = s.encode_snapshot(g, A)
    limits = s.SnapshotLimits()
    assert s.admit(data, A, limits) == (4, 4)
    for k in range(len(data)):
        with pytest.raises(SnapshotError):
            s.admit(data[:k], A, limits)
    for at in range(s.HEADER_BYTES):
        for bit in range(8):
            bad = bytearray(data)
            bad[at] ^= 1 << bit
            with pytest.raises(SnapshotError):
                s.admit(bytes(bad), A, limits)
    words = list(struct.unpack_from("<9I", data, s.HEADER_BYTES))
    taken = 0
    for at, value in ((0, 1), (1, 1), (3, 2), (4, 3), (5, 3), (6, 2), (7, 0), (8, 4)):
        changed = data[: s.HEADER_BYTES] + struct.pack("<9I", *words[:at], value, *words[at + 1 :])
        try:
            other = s.decode_snapshot(spark, changed, A)
        except ArcwaveError:
            continue
        taken += 1
        assert s.encode_snapshot(other, A) == changed
    assert 0 < taken < 8
