"""Frames, bloom filters, level arithmetic, command line, streams, data source."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark import Options, Table
from tidemark.functions import bloom
from tidemark.operators import levels, resolve
from tidemark.repl import main, run
from tidemark.sources import frames
from tidemark.sources.reader import TableSource
from tidemark.streaming.ingest import ingest


def test_frames_round_trip_and_cut():
    versions = [(b"a", 1, False, b""), (b"", 2, True, None), (b"k" * 300, 3, False, b"v" * 1000)]
    raw = b"".join(frames.frame(*v) for v in versions)
    assert frames.replay(raw) == (versions, len(raw))
    assert len(frames.frame(b"ab", 1, False, b"xyz")) == 21 + 5
    assert frames.replay(raw + b"\x01\x02\x03") == (versions, len(raw))
    bad = bytearray(raw)
    bad[len(frames.frame(*versions[0])) + 10] ^= 1
    assert frames.replay(bytes(bad))[0] == versions[:1]
    assert zlib.crc32(b"123456789") == 0xCBF43926


def test_segments_read_by_spark(spark, tmp_path):
    raw = b"".join(frames.frame(b"k%d" % i, i, i % 3 == 0, b"v") for i in range(1, 20))
    (tmp_path / "1.log").write_bytes(raw + b"torn")
    got = frames.read_segments(spark, f"file://{tmp_path}/*.log")
    assert got.count() == 19 and got.where("tombstone").count() == 6


def test_sql_crc32_is_the_same(spark):
    assert spark.sql("select crc32('123456789'), crc32('')").first() == (0xCBF43926, 0)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(10_000).select(F.format_string("key_%06d", "id").alias("key"))
    built = bloom.build(keys, "key", 10_000)
    assert built.probes == 7
    held = [b"key_%06d" % i for i in range(10_000)]
    assert built.might_contain(held).all()
    assert built.might_contain([b"key_%06d" % i for i in range(100_000, 200_000)]).mean() < 0.015
    again = bloom.Bloom.from_bytes(built.to_bytes())
    assert (again.words == built.words).all()
    for raw in (b"", built.to_bytes()[:-1], b"\x00" * 20):
        with pytest.raises(Exception):
            bloom.Bloom.from_bytes(raw)
    assert bloom.keep_possible(keys, "key", built).count() == 10_000
    assert bloom.fnv1a([b"", b"a", b"foobar"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


def test_greedy_cut_agrees_with_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(60):03d}", i, False, "v" * rng.randrange(40)) for i in range(300)]
    log = spark.createDataFrame(rows, "key string, seq long, tombstone boolean, value string").withColumn("part", F.lit(0))
    got = levels.greedy_files(log, 500, "part").orderBy("key").collect()
    cuts = levels.cut_points([(r.key, r.bytes) for r in got], 500)
    starts = [r.key for a, r in zip(got, got[1:]) if a.file != r.file]
    assert cuts == starts and got[-1].file == len(cuts)
    assert sum(r.bytes for r in got) == sum(17 + len(k) + len(v) for k, _, _, v in rows)


def test_empty_logs(spark):
    log = spark.createDataFrame([], "key string, seq long, tombstone boolean, value string")
    assert resolve.scan(log).count() == 0
    assert resolve.as_of_many(log, [1, 2]).count() == 0
    assert frames.frame_offsets(log).count() == 0
    assert resolve.first_gap(spark.createDataFrame([], "n long"), "n").first() == (0, 0)
    assert resolve.first_gap(spark.createDataFrame([(0,), (1,), (5,)], "n long"), "n").first() == (2, 1)
    assert resolve.first_gap(spark.createDataFrame([(3,)], "n long"), "n").first() == (0, 1)


def test_command_line(spark, tmp_path, capsys):
    said = []
    with Table.open(spark, f"file://{tmp_path}/t") as t:
        run(t, ["put a 1", "put b 2", "get a", "get x", "snapshot", "del a", "get a", "get a 2", "scan a z", "scan a z 2", "flush", "compact", "put a", "frob", "", "release 2", "get b x", "exit", "put c 3"], said.append)
        assert said[:7] == ["OK", "OK", "1", "(nil)", "2", "OK", "(nil)"]
        assert said[7:] == ["1", "b = 2", "(1 results)", "a = 1", "b = 2", "(2 results)", "OK", "OK", "ERR: put <key> <value>", "ERR: unknown command", "OK", said[-1]]
        assert said[-1].startswith("ERR:") and t.get(b"c") is None
    assert main([]) == 1 and "usage" in capsys.readouterr().err


def test_stream_into_a_table(spark, tmp_path):
    source = tmp_path / "in"
    for n in range(2):
        spark.createDataFrame([(f"k{i}", f"{n}", i == 3 and n == 1, 10 * n + i) for i in range(5)], "key string, value string, tombstone boolean, at long").write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("key string, value string, tombstone boolean, at long").parquet(str(source))
    with Table.open(spark, f"file://{tmp_path}/t", Options(auto_compact=False)) as t:
        for _ in range(2):  # the second run finds nothing new
            q = ingest(stream, t, f"{tmp_path}/checkpoint", order="at", availableNow=True)
            q.awaitTermination(120)
        got = {bytes(r[0]).decode(): bytes(r[1]).decode() for r in t.scan().collect()}
        assert got == {"k0": "1", "k1": "1", "k2": "1", "k4": "1"}
        assert t.versions().count() == 10


def test_data_source(spark, tmp_path):
    spark.dataSource.register(TableSource)
    path = f"file://{tmp_path}/t"
    with Table.open(spark, path, Options(target_file_size=300, auto_compact=False)) as t:
        t.write([(b"k%03d" % i, False, b"v" * 20) for i in range(60)])
        t.compact()
        t.delete(b"k007")
        t.flush()
        read = spark.read.format("tidemark").option("path", path)
        assert resolve.scan(read.load()).count() == 59
        assert read.option("key", "k007").load().count() == 2
        assert spark.read.format("tidemark").option("path", path).option("start", "k010").option("end", "k019").load().count() == 10
        assert spark.read.format("tidemark").option("path", path).option("snapshot", "5").load().count() == 5


def test_many_ranges(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(80):03d}", i + 1, rng.random() < 0.2, f"v{i}") for i in range(400)]
    log = spark.createDataFrame(rows, "key string, seq long, tombstone boolean, value string").repartition(3)
    spans = [(i, f"k{a:03d}", f"k{a + rng.randrange(-2, 30):03d}") for i, a in enumerate(rng.choices(range(80), k=25))]
    ranges = spark.createDataFrame(spans, "id long, start string, end string")
    live = {}
    for k, _, gone, v in rows:
        live[k] = None if gone else v
    want = sorted((i, k, v) for i, a, b in spans for k, v in live.items() if v is not None and a <= k <= b)
    for bound in (100, 0):
        assert sorted((r.id, r.key, r.value) for r in resolve.scan_many(log, ranges, bound=bound).collect()) == want
    assert resolve.scan_many(log, ranges.limit(0)).count() == 0


def test_workloads(spark, tmp_path):
    from tidemark import workloads

    got = workloads.run(spark, f"file://{tmp_path}/w", n=2000, scans=20, writers=(1, 2), durable=10)
    assert sorted(got) == ["conc_write_1", "conc_write_2", "rand_read_hit", "rand_read_miss", "rand_write", "scan", "seq_write"]
    assert all(v > 0 for v in got.values())
