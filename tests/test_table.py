"""The table on disk, against a dict that keeps every version."""

import os
import random
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark import Options, Snapshot, Table
from tidemark.plans import compaction, pruning
from tidemark.sources import manifest

MANUAL = Options(auto_compact=False)


class Model:
    """What reads should give."""

    def __init__(self):
        self.log, self.seq = {}, 0

    def put(self, key, value):
        self.seq += 1
        self.log.setdefault(key, []).append((self.seq, value))

    def at(self, seq=None):
        seen = {k: [v for s, v in vs if seq is None or s <= seq] for k, vs in self.log.items()}
        return sorted((k, vs[-1]) for k, vs in seen.items() if vs and vs[-1] is not None)


def rows(df):
    return [(bytes(r[0]), bytes(r[1])) for r in df.collect()]


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/t"


def test_put_get_overwrite_delete(spark, path):
    with Table.open(spark, path) as t:
        assert t.get(b"a") is None
        t.put(b"a", b"1")
        t.put(b"a", b"")
        assert t.get(b"a") == b""
        t.delete(b"a")
        t.delete(b"never")
        assert t.get(b"a") is None and t.get(b"never") is None
        t.flush()
        assert t.get(b"a") is None and t.scan().count() == 0


def test_scan_is_inclusive_ordered_and_empty_when_reversed(spark, path):
    with Table.open(spark, path) as t:
        t.write([(k, False, v) for k, v in [(b"cherry", b"3"), (b"apple", b"1"), (b"elder", b"5"), (b"banana", b"2"), (b"date", b"4")]])
        t.flush()
        assert [k for k, _ in t.each(b"banana", b"date")] == [b"banana", b"cherry", b"date"]
        assert rows(t.scan(b"date", b"banana")) == []
        assert rows(t.scan(b"zzz", b"zzz")) == []
        assert [k for k, _ in rows(t.scan())] == [b"apple", b"banana", b"cherry", b"date", b"elder"]


def test_binary_keys_sort_unsigned_and_empty_key_is_a_key(spark, path):
    keys = [b"\xff", b"", b"a\x00", b"a", b"\x7f"]
    with Table.open(spark, path) as t:
        for k in keys:
            t.put(k, b"v" + k)
        t.flush()
        t.put(b"", b"new")
        t.flush()
        assert [k for k, _ in rows(t.scan())] == sorted(keys)
        t.compact()
        assert t.get(b"") == b"new" and [k for k, _ in rows(t.scan())] == sorted(keys)


def test_snapshots_see_what_was_committed(spark, path):
    with Table.open(spark, path, MANUAL) as t:
        for k in (b"a", b"b", b"c"):
            t.put(k, b"1")
        s = t.snapshot()
        t.flush()
        t.put(b"a", b"10")
        t.delete(b"b")
        t.put(b"d", b"4")
        for step in (lambda: None, t.flush, t.compact):
            step()
            assert rows(t.scan(snapshot=s)) == [(b"a", b"1"), (b"b", b"1"), (b"c", b"1")]
            assert t.get(b"a", s) == b"1" and t.get(b"d", s) is None
            assert rows(t.scan()) == [(b"a", b"10"), (b"c", b"1"), (b"d", b"4")]


def test_collection_follows_snapshots(spark, path):
    with Table.open(spark, path, MANUAL) as t:
        t.put(b"k", b"1")
        t.flush()
        s, same = t.snapshot(), t.snapshot()
        t.put(b"k", b"2")
        t.compact()
        assert t.versions().count() == 2
        t.release(s)
        t.release(Snapshot(999))
        t.compact()
        assert t.versions().count() == 2, "an equal pin is still there"
        t.release(same)
        t.compact()
        assert t.versions().count() == 1 and t.get(b"k") == b"2"


def test_compacting_nothing_but_deletions_ends_and_empties(spark, path):
    with Table.open(spark, path, Options(compaction_trigger=2)) as t:
        for k in (b"a", b"b"):
            t.put(k, b"1")
            t.flush()
        t.delete(b"a")
        t.delete(b"b")
        t.compact()
        assert t.manifest.files == () and t.scan().count() == 0
        assert t.maintain() == 0


def test_versions_of_a_key_stay_in_one_file(spark, path):
    with Table.open(spark, path, Options(target_file_size=400, auto_compact=False)) as t:
        pins = []
        for i in range(12):
            t.write([(b"k%02d" % j, False, b"%d" % i * 20) for j in range(20)])
            pins.append(t.snapshot())
            if i % 3 == 2:
                t.flush()
        t.compact()
        files = t.manifest.files
        assert len(files) > 3
        spans = sorted((f.smallest, f.largest) for f in files)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        for i, s in enumerate(pins):
            assert t.get(b"k07", s) == b"%d" % i * 20


def test_tombstones_go_at_the_bottom_only(spark, path):
    with Table.open(spark, path, MANUAL) as t:
        t.put(b"a", b"1")
        t.put(b"z", b"1")
        t.compact()
        t.delete(b"a")
        t.flush()
        pick = compaction.due(t.manifest, Options(compaction_trigger=1))
        assert pick.level == 1 and pick.bottommost and len(pick.inputs) == 2
        t._compact(pick)
        assert t.versions().count() == 1 and t.get(b"a") is None


def test_levels_overflow_downwards_and_do_not_overlap(spark, path):
    options = Options(compaction_trigger=2, l1_max_bytes=64 * 30, level_size_multiplier=2, target_file_size=600)
    model, rng = Model(), random.Random(5)
    with Table.open(spark, path, options) as t:
        for _ in range(6):
            for _ in range(30):
                k, v = b"ml_%03d" % rng.randrange(90), b"v%d" % rng.randrange(10**6)
                t.put(k, v)
                model.put(k, v)
            t.flush()
        assert t.manifest.deepest() >= 2
        for level in range(1, 7):
            spans = sorted((f.smallest, f.largest) for f in t.manifest.level(level))
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert rows(t.scan()) == model.at()


def test_recovery_replays_acknowledged_writes(spark, path, tmp_path):
    t = Table.open(spark, path)
    t.put(b"a", b"1")
    t.flush()
    t.put(b"b", b"2")
    t.delete(b"a")
    t.close()
    with Table.open(spark, path) as t:
        assert rows(t.scan()) == [(b"b", b"2")]
        assert t.put(b"c", b"3") == 4
    # A damaged record ends the replay; what came before it stays, and the log is put aside, not lost.
    t = Table.open(spark, path)
    t.put(b"d", b"4")
    t.close()
    logs = sorted(n for n in os.listdir(tmp_path / "t/wal") if n.endswith(".log"))
    damaged = tmp_path / "t/wal" / logs[1]
    raw = bytearray(damaged.read_bytes())
    raw[-1] ^= 1
    damaged.write_bytes(raw)
    for _ in range(2):
        with Table.open(spark, path) as t:
            assert rows(t.scan()) == [(b"b", b"2")]
    assert len(list((tmp_path / "t/lost").iterdir())) == 2
    with Table.open(spark, path) as t:
        assert t.put(b"x", b"4") == 4


def test_damaged_manifest_loses_nothing(spark, path, tmp_path):
    t = Table.open(spark, path, MANUAL)
    t.put(b"a", b"1")
    t.flush()
    t.put(b"b", b"2")
    t.flush()
    t.close()
    newest = max((tmp_path / "t/manifest").glob("*.json"))
    whole, folders = newest.read_bytes(), sorted(os.listdir(tmp_path / "t/data"))
    for at in range(0, len(whole), 97):  # one wrong bit is survived, wherever it is
        assert manifest.decode(whole[:at] + bytes([whole[at] ^ 4]) + whole[at + 1 :]) == manifest.decode(whole)
    for raw in (whole + b"xyz", whole[:-5]):  # and so is a torn tail
        newest.write_bytes(raw)
        with Table.open(spark, path, MANUAL) as t:
            assert rows(t.scan()) == [(b"a", b"1"), (b"b", b"2")]
    newest.write_bytes(b"00000000 2\n{")
    with pytest.raises(manifest.Damaged):
        Table.open(spark, path, MANUAL)
    assert sorted(os.listdir(tmp_path / "t/data")) == folders
    with Table.open(spark, path, MANUAL, repair=True) as t:
        assert rows(t.scan()) == [(b"a", b"1")]
        t.put(b"c", b"3")
        t.flush()
    assert any((tmp_path / "t/lost").iterdir())
    with Table.open(spark, path, MANUAL) as t:
        assert rows(t.scan()) == [(b"a", b"1"), (b"c", b"3")]


def test_writes_beside_a_bulk_write(spark, path):
    """Every acknowledged write is there after reopening; get and scan agree; a snapshot stays what it was."""
    bulk = spark.range(3000).selectExpr("cast(format_string('b%04d', id) as binary) key", "cast('bulk' as binary) value").union(spark.range(1).selectExpr("cast('same' as binary) key", "cast('bulk' as binary) value"))
    t = Table.open(spark, path, MANUAL)
    done, seen, stop = [], [], threading.Event()

    def put():
        while not stop.is_set():
            t.write([(b"p%05d" % len(done), False, b"1"), (b"same", False, b"put")])
            done.append(1)

    def look():
        while not stop.is_set():
            s = t.snapshot()
            n = t.versions().where(f"seq <= {s.seq}").count()
            seen.append((s, n))

    threads = [threading.Thread(target=put), threading.Thread(target=look)]
    for x in threads:
        x.start()
    for _ in range(2):
        assert t.write_all(bulk) == 3001
    stop.set()
    for x in threads:
        x.join()
    assert all(t.versions().where(f"seq <= {s.seq}").count() == n for s, n in seen)
    want = rows(t.scan())
    assert dict(want)[b"same"] == t.get(b"same")
    t.close()
    with Table.open(spark, path, MANUAL) as t:
        assert rows(t.scan()) == want and len(want) == 3001 + len(done)
        assert rows(t.scan(b"p", b"q")) == [(b"p%05d" % i, b"1") for i in range(len(done))]
        assert t.get(b"same") == dict(want)[b"same"]
        assert sorted(r[0] for r in t.versions().select("seq").collect()) == list(range(1, 6002 + 2 * len(done) + 1))


def test_collected_seqs_are_not_used_again(spark, path):
    with Table.open(spark, path, MANUAL) as t:
        t.write_all(spark.createDataFrame([(bytearray(b"a"), None, True)], "key binary, value binary, tombstone boolean"))
        t.compact()
        assert t.manifest.files == ()
    with Table.open(spark, path, MANUAL) as t:
        assert t.put(b"a", b"1") == 2


def test_a_batch_is_committed_once(spark, path):
    df = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value binary")
    with Table.open(spark, path, MANUAL) as t:
        assert t.write_all(df, mark=("s", 0)) == 1
        t.put(b"a", b"2")
    with Table.open(spark, path, MANUAL) as t:  # the batch again, after a crash before its stream took note of it
        assert t.write_all(df, mark=("s", 0)) == 0
        assert t.get(b"a") == b"2"
        assert t.write_all(df, mark=("other", 0)) == 1 and t.write_all(df.limit(0), mark=("s", 1)) == 0
        assert dict(t.manifest.marks) == {"s": 1, "other": 0}


def test_torn_append_is_written_anew(spark, path, monkeypatch):
    t = Table.open(spark, path, MANUAL)
    t.put(b"a", b"1")
    real = t._open.append
    monkeypatch.setattr(t._open, "append", lambda raw: (t._open._stream.write(raw[:7]), (_ for _ in ()).throw(OSError("full"))))
    with pytest.raises(OSError):
        t.put(b"b", b"lost")
    assert real is not None and t.put(b"c", b"3") == 2
    t.close()
    with Table.open(spark, path, MANUAL) as t:
        assert rows(t.scan()) == [(b"a", b"1"), (b"c", b"3")]


def test_vacuum_leaves_readers_their_files(spark, path):
    with Table.open(spark, path, MANUAL) as t:
        t.put(b"a", b"1")
        t.flush()
        with t.reading():
            df = t.scan()
            t.put(b"b", b"2")
            t.compact()
            assert t.vacuum() == 1 and rows(df) == [(b"a", b"1")]
        assert t.vacuum() == 1 and len(rows(t.scan())) == 2


def test_many_ranges_of_a_table(spark, path):
    with Table.open(spark, path, Options(target_file_size=400, auto_compact=False)) as t:
        t.write([(b"k%03d" % i, False, b"v%d" % i) for i in range(200)])
        t.compact()
        t.delete(b"k011")
        asked = spark.createDataFrame([(1, bytearray(b"k010"), bytearray(b"k012")), (2, bytearray(b"k012"), bytearray(b"k012")), (3, bytearray(b"x"), bytearray(b"z"))], "id long, start binary, end binary")
        assert sorted((r.id, bytes(r.key)) for r in t.scan_many(asked).collect()) == [(1, b"k010"), (1, b"k012"), (2, b"k012")]
        assert len(pruning.for_ranges(t.manifest, [(b"k010", b"k012"), (b"k190", b"k191")], 1 << 60)) < len(t.manifest.files)
        none = spark.createDataFrame([(bytearray(b"zz"),)], "key binary")
        assert [tuple(r)[1:] for r in t.multi_get(none).collect()] == [("NotFound", None)]


def test_orphans_go_and_files_without_manifest_are_adopted(spark, path, tmp_path):
    t = Table.open(spark, path, MANUAL)
    t.put(b"a", b"1")
    t.flush()
    t.put(b"a", b"2")
    t.flush()
    t.close()
    os.makedirs(tmp_path / "t/data/orphan")
    (tmp_path / "t/data/orphan/part-0.parquet").write_bytes(b"x")
    (tmp_path / "t/data/x.tmp").write_bytes(b"x")
    Table.open(spark, path, MANUAL).close()
    assert not {"orphan", "x.tmp"} & set(os.listdir(tmp_path / "t/data"))
    for name in os.listdir(tmp_path / "t/manifest"):
        os.remove(tmp_path / "t/manifest" / name)
    with Table.open(spark, path, MANUAL) as t:
        assert len(t.manifest.level(0)) == 2 and t.get(b"a") == b"2"
        assert t.put(b"b", b"3") == 3


def test_manifest_survives_any_bytes():
    f = manifest.FileMeta("data/x/p.parquet", 3, 1, b"\x00\xff", b"\xff" * 300_000, 5, 100, 1, 9)
    m = manifest.Manifest(7, (f,), 4, 9, ("data/y",))
    assert manifest.decode(manifest.encode(m)) == m
    assert manifest.decode(manifest.encode(m)[:-1]) == m and manifest.decode(manifest.encode(m)[:300]) is None and manifest.decode(b"") is None


def test_bulk_writes_keep_order_and_seq(spark, path):
    with Table.open(spark, path, Options(target_file_size=2000, auto_compact=False)) as t:
        t.put(b"k0001", b"old")
        df = spark.range(5000).selectExpr("cast(format_string('k%04d', id % 1000) as binary) key", "cast(cast(id as string) as binary) value", "id % 7 = 0 as tombstone", "id").orderBy("id")
        assert t.write_all(df) == 5000
        assert t.write_all(spark.createDataFrame([], "key binary, value binary")) == 0
        expect = {}
        for i in range(5000):
            expect[b"k%04d" % (i % 1000)] = None if i % 7 == 0 else b"%d" % i
        live = sorted((k, v) for k, v in expect.items() if v is not None)
        assert rows(t.scan()) == live
        assert t.put(b"z", b"1") == 5002
        t.compact()
        assert rows(t.scan(end=b"y")) == live
        probe = spark.createDataFrame([(bytearray(b"k0000"),), (bytearray(b"nope"),), (bytearray(b"z"),)], "key binary")
        got = {bytes(r.key): r.status for r in t.multi_get(probe).collect()}
        assert got == {b"k0000": "Found" if expect[b"k0000"] else "Deleted", b"nope": "NotFound", b"z": "Found"}


def test_group_commit_loses_nothing(spark, path):
    with Table.open(spark, path, MANUAL) as t:
        def work(n):
            for i in range(50):
                t.put(b"t%d_%03d" % (n, i), b"x")

        threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
        for x in threads:
            x.start()
        for x in threads:
            x.join()
        assert t.scan().count() == 200 and t.commits <= 200
        assert sorted(r.seq for r in t.versions().select("seq").collect()) == list(range(1, 201))


def test_failed_batch_raises_and_later_ones_go_on(spark, path, monkeypatch):
    with Table.open(spark, path) as t:
        real = t.storage.appender
        monkeypatch.setattr(t.storage, "appender", lambda *a: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError):
            t.put(b"a", b"1")
        monkeypatch.setattr(t.storage, "appender", real)
        assert t.put(b"b", b"2") == 1 and t.get(b"a") is None


def test_automatic_flush_and_compaction(spark, path):
    with Table.open(spark, path, Options(flush_threshold_bytes=700, compaction_trigger=3)) as t:
        for i in range(40):
            t.put(b"key_%02d" % (i % 8), b"v%d" % i)
        assert len(t.manifest.level(0)) < 3 and t.manifest.level(1)
        assert rows(t.scan()) == [(b"key_%02d" % k, b"v%d" % (32 + k)) for k in range(8)]
        t.vacuum()
        assert len(rows(t.scan())) == 8


def test_pruning_and_cache(spark, path):
    with Table.open(spark, path, Options(target_file_size=300, auto_compact=False)) as t:
        t.write([(b"k%03d" % i, False, b"v" * 20) for i in range(100)])
        t.compact()
        m = t.manifest
        assert len(m.files) > 3 and len(pruning.for_point(m, b"k050", 1 << 60)) == 1
        assert pruning.for_point(m, b"zzz", 1 << 60) == [] and pruning.for_range(m, b"b", b"a", 1 << 60) == []
        assert len(pruning.for_range(m, b"k000", b"k010", 1 << 60)) < len(m.files)
        assert t.get(b"k050") and t.get(b"k050")
        assert (t.cache.hits, t.cache.misses) == (1, 1)


def test_a_bulk_write_is_one_write_of_level_0_however_many_files(spark, path):
    keys = spark.createDataFrame([(b"k%03d" % i,) for i in range(100)], "key binary")
    log = spark.createDataFrame([(b"k%03d" % i, b"v" * 50, i % 4 == 0) for i in range(100)], "key binary, value binary, tombstone boolean")
    with Table.open(spark, path, Options(target_file_size=1000, compaction_trigger=3)) as t:

        def deleted():
            return t.multi_get(keys).where("status = 'Deleted'").count()

        before = t.snapshot()
        t.write_all(log)
        assert len(t.manifest.level(0)) > 3 and deleted() == 25
        t.write_all(log)
        assert t.manifest.level(0) and deleted() == 25
        t.write_all(log)
        assert not t.manifest.level(0) and deleted() == 25, "a snapshot from before keeps them"
        t.release(before)
        t.compact()
        assert deleted() == 0 and t.scan().count() == 75


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_random_operations(spark, tmp_path_factory, seed):
    rng, model, pins = random.Random(seed), Model(), []
    path = f"file://{tmp_path_factory.mktemp('random')}/t"
    t = Table.open(spark, path, Options(compaction_trigger=3, target_file_size=500, l1_max_bytes=64 * 20, level_size_multiplier=2))
    for step in range(120):
        k = b"k_%02d" % rng.randrange(20)
        if rng.randrange(5) == 0:
            t.delete(k)
            model.put(k, None)
        else:
            t.put(k, b"v_%d" % step)
            model.put(k, b"v_%d" % step)
        if rng.randrange(40) == 0:
            pins.append((t.snapshot(), model.at()))
        if rng.randrange(30) == 0:
            t.flush()
        if rng.randrange(60) == 0:
            t.compact()
    assert rows(t.scan()) == model.at()
    assert all(rows(t.scan(snapshot=s)) == seen for s, seen in pins)
    t.close()
    t = Table.open(spark, path)
    assert rows(t.scan()) == model.at()
    t.close()
