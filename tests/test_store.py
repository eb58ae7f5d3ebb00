"""The store end to end: durability, snapshots, cursors, limits, compaction, crashes."""

import json
import os
import random

import pytest

from chronolith.caps import Caps
from chronolith.functions import codec
from chronolith.functions.rng import Pcg64
from chronolith.operators import checks, metrics
from chronolith.operators.checks import Outcome, fold
from chronolith.plans import workload
from chronolith.sources.store import Store, WriteBatch
from chronolith.status import Status, StoreError, status_name
from chronolith.streaming import ingest


def state(s):
    return workload.state_of(s)


def read(spark, path):
    """What another opener reads beside the writer."""
    s = Store.open(spark, path, read_only=True)
    out = state(s)
    s.close()
    return out


def test_write_sync_reopen(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.open(spark, path)
    assert s.put(b"a", b"1") == 1 and s.write(WriteBatch()) == 2 and s.put(b"", b"") == 3
    assert s.get(b"a") == b"1" and s.get(b"") == b"" and s.get(b"c") is None
    assert s.durable_seq() == 0 and s.sync() == 3 and s.sync() == 3
    s.put(b"lost", b"x")
    s.close()
    with pytest.raises(StoreError) as e:
        s.put(b"a", b"2")
    assert e.value.status is Status.INVALID_ARGUMENT
    t = Store.open(spark, path)  # the lock is let go
    assert t.durable_seq() == 3 and state(t) == {b"a": b"1", b"": b""}
    t.write(WriteBatch().delete_range(b"a", b"z").set(b"a", b"2"))
    t.sync()
    assert read(spark, path) == {b"": b"", b"a": b"2"}


def test_snapshot_survives_compaction(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    s.put(b"a", b"before")
    s.sync()
    with s.snapshot() as snap:
        s.write(WriteBatch().set(b"a", b"after").set(b"b", b"new"))
        s.sync()
        s.delete_range(None, None)
        s.put(b"c", b"3")
        s.sync()
        s.compact()
        assert snap.get(b"a") == b"before" and snap.get(b"b") is None
        assert [bytes(r["k"]) for r in snap.scan().collect()] == [b"a"]
        assert state(s) == {b"c": b"3"}
        assert s.observable() == [1, 4]
    s.compact()
    assert s.view().versions().count() == 1 and s.view().ranges().count() == 0
    assert read(spark, s.path) == {b"c": b"3"}


def test_compaction_trigger_and_unbounded_range(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"), Caps(flush_bytes=1))
    s.write(workload.apply_ops(WriteBatch(), [("S", b"k%03d" % i, b"v", None, None) for i in range(300)]))
    s.sync()
    s.compact()
    s.delete_range(b"k010", None)
    for i in range(4):
        s.put(b"n%d" % i, b"v")
        s.sync()
    assert {x.level for x in s._manifest.segments} == {1}
    assert sorted(state(s)) == [b"k%03d" % i for i in range(10)] + [b"n%d" % i for i in range(4)]
    assert s.approximate_bytes() == 10 * 5 + 4 * 3 and s.approximate_bytes(b"n", None) == 12
    m = metrics.amplification(s)
    assert m["read"] == 1.0 and m["space"] > 0 and m["write"] > 0


def test_cursor(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    for i in range(8):
        s.write(WriteBatch().set(b"k%d" % i, b"%d" % i))
    keys = [b"k%d" % i for i in range(8)]
    for n in (1, 3, 8, 100):
        c, got = s.cursor(), []
        c._page = 3
        while page := c.block(n):
            got += [k for k, _ in page]
        assert got == keys
    c = s.cursor(b"k2", b"k5")
    assert c.last() and c.key == b"k4" and c.prev() and c.key == b"k3"
    assert c.seek_lt(b"k9") and c.key == b"k4" and not c.next() and not c.valid
    assert not c.seek_lt(b"k2") and c.seek_ge(b"") and c.key == b"k2"
    assert [k for k, _ in s.cursor().block(100, reverse=True)] == keys[::-1]
    assert s.cursor(b"k5", b"k2").block(3) == []
    c = s.cursor()
    assert [k for k, _ in c.fetch(10, 7)] == [b"k0", b"k1"] and [k for k, _ in c.fetch(1, 100)] == [b"k2"]
    with pytest.raises(StoreError) as e:
        c.fetch(1, 2)
    assert e.value.status is Status.BUFFER_TOO_SMALL and c.key == b"k3" and s.pending_bytes() > 0


def test_limits(spark, tmp_path):
    cost = WriteBatch().set(b"x" * 8, b"y" * 64).record_bytes()
    assert cost == 94
    s = Store.open(spark, str(tmp_path / "s"), Caps(1000, 20_000, 10_000, 20 * cost))
    for _ in range(20):
        s.put(b"x" * 8, b"y" * 64)
    with pytest.raises(StoreError) as e:
        s.put(b"x" * 8, b"y" * 64)
    assert e.value.status is Status.BUSY and s.seq == 21
    s.sync()
    with pytest.raises(StoreError) as e:
        s.put(b"k", b"v" * 1000)
    assert e.value.status is Status.RECORD_TOO_LARGE
    assert not Caps(100, 150, 1, 0).ordered() and Caps(100, 200, 1, 0).ordered() and not Caps(100, 250, 1, 200).ordered()
    assert Caps(100, 200, 1, 0).admit(90, 150) is Status.WAL_BUFFER_FULL
    assert status_name(9) == "BUSY" and status_name(55) == "UNKNOWN"


def test_commit_log_faults(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.open(spark, path)
    for i in range(3):
        s.put(b"k%d" % i, b"v")
        s.sync()
    commits = sorted(f for f in os.listdir(f"{path}/commits") if f.endswith(".json"))
    last = f"{path}/commits/{commits[-1]}"
    text = open(last).read()
    os.remove(f"{path}/commits/.{commits[-1]}.crc") if os.path.exists(f"{path}/commits/.{commits[-1]}.crc") else None
    open(last, "w").write(text[: len(text) // 2])
    s.close()
    t = Store.open(spark, path)
    assert sorted(state(t)) == [b"k0", b"k1"]
    t.close()
    first = f"{path}/commits/{commits[0]}"
    body = json.loads(open(first).read())
    body["body"]["add"][0]["rows"] += 1
    crc = f"{path}/commits/.{commits[0]}.crc"
    os.remove(crc) if os.path.exists(crc) else None
    open(first, "w").write(json.dumps(body))
    with pytest.raises(StoreError) as e:
        Store.open(spark, path)
    assert e.value.status is Status.CORRUPTION
    os.remove(first)
    with pytest.raises(StoreError):
        Store.open(spark, path)


def test_crash_sweep(spark, tmp_path):
    groups = [[[("S", b"a", b"1", None, None)], [("D", b"a", None, None, None), ("S", b"c", b"3", None, None)]]]
    found = workload.crash_sweep(spark, str(tmp_path), groups)
    assert len(found) > 15 and [x for x in found if x[3] is not Outcome.PASS] == []
    assert {x[0] for x in found} == set(workload.MODES) and {"write_new", "rename_new", "write_frame"} <= {x[1] for x in found}


def test_crash_sweep_compaction(spark, tmp_path):
    """Every fourth sync compacts: each of its operations is killed, and refused."""
    groups = [[[("S", b"k%d" % i, b"v%d" % i, None, None)]] for i in range(3)] + [[[("R", None, None, b"k1", b"k2")], [("S", b"z", b"1", None, None)]]]
    counted = workload.FaultyFiles(spark)
    workload._run(spark, str(tmp_path / "c"), groups, counted, workload.REGIMES["compact"])
    last = [i for i, c in enumerate(counted.calls) if c == "rename_new"][-2]
    found = workload.crash_sweep(spark, str(tmp_path), groups, range(last, len(counted.calls)), ("before",), "compact")
    found += workload.crash_sweep(spark, str(tmp_path / "r"), groups, range(last, last + 2), ("refused",), "compact")
    assert len(found) >= 7 and [x for x in found if x[3] is not Outcome.PASS] == []


def test_random_workload(spark, tmp_path):
    s, batches = Store.open(spark, str(tmp_path / "s")), []
    for kind, *rest in workload.batches_of(workload.random_ops(42, 40)):
        if kind == "write":
            batches.append((s.write(workload.apply_ops(WriteBatch(), rest[0])), rest[0]))
        elif kind == "sync":
            s.sync()
    assert state(s) == fold(batches)
    s.sync()
    assert read(spark, s.path) == fold(batches)


def test_artifact(spark, tmp_path, capsys):
    from chronolith import __main__ as cli
    from chronolith.plans import artifact

    assert cli.differential(spark, str(tmp_path), 7, 25) == 0
    text = capsys.readouterr().out
    a = artifact.decode(text)
    assert a["verdict"] == "pass" and fold(a["submission"], a["watermark"]) == a["recovered"]
    body = json.loads(text)
    assert artifact.faults("{") == ["not JSON"] and "no verdict" in artifact.faults(json.dumps({k: v for k, v in body.items() if k != "verdict"}))
    for change in ({"watermark": 10**6}, {"verdict": "fine"}, {"submission": [{"kind": "S", "seq": 1, "v": "00"}]}, {"submission": [{"kind": "Q"}]}, {"provenance": {}}):
        assert artifact.faults(json.dumps(body | change))
    with pytest.raises(artifact.ArtifactFault):
        artifact.decode(json.dumps(body | {"extra": 1}))
    assert cli.amplification(spark, str(tmp_path / "amp"), 1, 100) == 0


def test_segment_faults(spark):
    v = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 1, "x"), (None, 0, 3, None), ("b", 2, 1, None), ("c", 3, 0, "y")], "k string, seq bigint, vt int, v string")
    got = {r["fault"]: r["n"] for r in checks.version_faults(v).collect()}
    assert got == {"repeated version": 1, "null key": 1, "sequence below 1": 1, "unknown type": 1, "value without bytes": 1, "deletion with bytes": 1}
    r = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", None, 3), ("c", "d", 3)], "lo string, hi string, seq bigint")
    assert {x["fault"]: x["n"] for x in checks.range_faults(r).collect()} == {"empty range": 1, "repeated range": 1}


def test_generator():
    r = Pcg64(42)
    assert [r.next() for _ in range(4)] == [6649627550597423648, 7300106876089141621, 2769834306095859105, 16257734974967078070]
    assert all(0 <= r.below(7) < 7 for _ in range(100))


def test_codecs(spark):
    r = random.Random(1)
    longs = sorted([r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(50)] + [0, -1, 1])
    assert [codec.decode_long(codec.encode_long(x)) for x in longs] == longs == [codec.decode_long(b) for b in sorted(map(codec.encode_long, longs))]
    doubles = sorted([r.uniform(-1e9, 1e9) for _ in range(50)] + [float("-inf"), -0.5, 0.0, float("inf")])
    assert [codec.decode_double(b) for b in sorted(map(codec.encode_double, doubles))] == doubles
    texts = ["", "a", "a\x00", "a\x00b", "ab", "é"]
    assert [codec.decode_text(codec.encode_text(t) + b"rest") for t in texts] == [(t, b"rest") for t in texts]
    assert sorted(map(codec.encode_text, texts)) == [codec.encode_text(t) for t in sorted(texts, key=lambda t: t.encode())]
    df = spark.createDataFrame([(x, t) for x, t in zip(longs, texts * 20, strict=False)], "x bigint, t string")
    for row in df.select("x", "t", codec.long_key(df["x"]).alias("a"), codec.text_key(df["t"]).alias("b")).collect():
        assert bytes(row["a"]) == codec.encode_long(row["x"]) and bytes(row["b"]) == codec.encode_text(row["t"])


def test_stream_ingest_is_idempotent(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    ops = spark.createDataFrame([(0, "S", b"a", b"1", None, None)], "ord bigint, kind string, k binary, v binary, lo binary, hi binary")
    assert ingest.apply_batch(s, ops, 0) == 1 and ingest.apply_batch(s, ops, 0) == 1
    s.close()
    t = Store.open(spark, s.path)
    assert ingest.apply_batch(t, ops, 0) == 1 and state(t) == {b"a": b"1"}
    ops.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
    q = ingest.start(t, stream.selectExpr("ord", "kind", "cast('b' as binary) as k", "v", "lo", "hi"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert set(state(t)) >= {b"a"}


def test_judges(spark):
    batches = [(1, [("S", b"a", b"1", None, None)]), (2, [("S", b"b", b"2", None, None)])]
    assert checks.judge_recovery(batches, 1, 2, True, 1, {b"a": b"1", b"b": b"2"})[0] is Outcome.PASS
    assert checks.judge_recovery(batches, 0, 2, True, 0, {b"a": b"1"})[0] is Outcome.VIOLATION
    assert checks.judge_recovery(batches, 1, None, False, 2, {b"a": b"1"})[0] is Outcome.VIOLATION
    assert checks.judge_cap(11, 10, True) == "void" and checks.judge_cap(10, 10, True) == "spurious" and checks.judge_busy(11, 10, False) == "missing" and checks.judge_busy(11, 0, False) == "normal"
    v = spark.createDataFrame([("a", 1, 1), ("a", 2, 0)], "k string, seq bigint, vt int")
    none = spark.createDataFrame([], "k string, seq bigint")
    bad = checks.judge_drops(v, v.where("seq = 1"), none)
    assert [bad[k].count() for k in ("phantom", "lost", "resurrected")] == [0, 0, 1]
    assert checks.judge_merge([[("a", 2)], [("a", 1), ("b", 1)]], [("a", 2), ("a", 1), ("b", 1)]) == []
    assert "order" in checks.judge_merge([[("a", 1)], [("b", 1)]], [("b", 1), ("a", 1)])
    assert not Outcome.VOID.counts() and Outcome.PASS.counts()
    with pytest.raises(ValueError):
        checks.one_regime(spark.createDataFrame([("x",), ("y",)], "regime string"))


# Readers and writers of one store


def test_readers_keep_their_files(spark, tmp_path):
    """Frames, views and cursors taken before compactions read on after them."""
    s = Store.open(spark, str(tmp_path / "s"), Caps(flush_bytes=1))
    for i in range(3):
        s.put(b"k%d" % i, b"old")
        s.sync()
    scan, view, cursor = s.scan(), s.view(), s.cursor()
    frame = view.frame().select("k")
    assert cursor.first() and cursor.key == b"k0"
    before = {x.name for x in s._manifest.segments}
    for i in range(8):
        s.delete(b"k%d" % (i % 3))
        s.put(b"n%d" % i, b"new")
        s.sync()
    assert not before & {x.name for x in s._manifest.segments}
    assert [bytes(r["k"]) for r in scan.collect()] == [b"k0", b"k1", b"k2"] == sorted(bytes(r["k"]) for r in frame.collect())
    cursor._page = 1
    assert [k for k, _ in cursor.block(9)] == [b"k0", b"k1", b"k2"] and cursor.error is Status.OK
    cursor.close()
    with pytest.raises(StoreError):
        cursor.first()
    # Without readers, what was removed long enough ago goes.
    kept = len(os.listdir(f"{s.path}/segments"))
    scan = view = frame = cursor = None
    for i in range(12):
        s.put(b"m%d" % i, b"x")
        s.sync()
    names = set(os.listdir(f"{s.path}/segments"))
    assert not before & names and kept and state(s)[b"m3"] == b"x"


def test_two_writers(spark, tmp_path):
    """A second writer is refused while the first is open, and may take over from one that is gone."""
    path = str(tmp_path / "s")
    s = Store.open(spark, path)
    s.put(b"a", b"1")
    s.sync()
    with pytest.raises(StoreError) as e:
        Store.open(spark, path)
    assert e.value.status is Status.BUSY
    reader = Store.open(spark, path, read_only=True)
    assert state(reader) == {b"a": b"1"}
    with pytest.raises(StoreError):
        reader.put(b"b", b"2")
    s.put(b"b", b"2")
    s.sync()
    assert state(s) == {b"a": b"1", b"b": b"2"} and state(reader) == {b"a": b"1"}
    reader.close()
    t = Store.open(spark, path, take_over=True)
    t.put(b"c", b"3")
    t.sync()
    s.put(b"d", b"4")
    with pytest.raises(StoreError) as e:
        s.sync()
    assert e.value.status is Status.IO_ERROR and state(t) == {b"a": b"1", b"b": b"2", b"c": b"3"}
    s.close()  # leaves the other's lock alone
    with pytest.raises(StoreError):
        Store.open(spark, path)
    t.close()
    Store.open(spark, path).close()


def test_lease_of_another_opener(spark, tmp_path):
    """A snapshot in a reader of its own keeps its versions and files through the writer's compactions."""
    path = str(tmp_path / "s")
    s = Store.open(spark, path, Caps(flush_bytes=1))
    s.put(b"a", b"1")
    s.sync()
    reader = Store.open(spark, path, read_only=True)
    snap = reader.snapshot()
    for i in range(2 * 8):
        s.put(b"a", b"%d" % (i + 2))
        s.sync()
    assert s.observable() == [1, 17] and snap.get(b"a") == b"1" and s.get(b"a") == b"17"
    snap.close()
    reader.close()
    s.compact()
    assert s.observable() == [17] and s.view().versions().count() == 1


def test_write_frame_is_admitted(spark, tmp_path):
    """A frame is charged like a batch, refused like one, and read once."""
    s = Store.open(spark, str(tmp_path / "s"), Caps(100, 1000, 1, 0))
    frame = lambda n: spark.range(1).selectExpr("id as ord", "'S' as kind", "cast('k' as binary) as k", f"cast(repeat('x', {n}) as binary) as v", "cast(null as binary) as lo", "cast(null as binary) as hi")
    with pytest.raises(StoreError) as e:
        s.write_frame(frame(10_000))
    assert e.value.status is Status.RECORD_TOO_LARGE and s.pending_bytes() == 0 and os.listdir(f"{s.path}/staged") == []
    assert s.write_frame(frame(10)) == 2 and s.pending_bytes() == WriteBatch().set(b"k", b"x" * 10).record_bytes()
    chance = spark.range(1).selectExpr("id as ord", "'S' as kind", "cast('r' as binary) as k", "cast(uuid() as binary) as v", "cast(null as binary) as lo", "cast(null as binary) as hi")
    s.write_frame(chance)
    seen = s.get(b"r")
    assert s.get(b"r") == seen and s.sync() == 3 and s.get(b"r") == seen and s.pending_bytes() == 0


def test_write_log(spark, tmp_path):
    """Many batches in one frame, each with its own sequence."""
    s = Store.open(spark, str(tmp_path / "s"))
    s.put(b"a", b"0")
    rows = [(1, 0, "S", b"a", b"1", None, None), (2, 0, "R", None, None, b"", None), (2, 1, "S", b"b", b"2", None, None), (3, 0, "D", b"b", None, None, None)]
    ops = spark.createDataFrame(rows, "seq bigint, ord bigint, kind string, k binary, v binary, lo binary, hi binary")
    assert s.write_log(ops) == 4 and state(s) == {}
    assert s.sync() == 4 and s.view().versions().count() == 4


# Flush, partial compaction and rolling


def fill(s, lo, hi, tag=b"v"):
    b = WriteBatch()
    for i in range(lo, hi):
        b.set(b"key%06d" % i, tag + b"%d:" % i + b"x" * 200)
    s.write(b)
    s.sync()


def test_small_groups_wait(spark, tmp_path):
    """Groups stay in the log's level until they hold flush_bytes; then they become one flushed segment."""
    s = Store.open(spark, str(tmp_path / "s"), Caps(flush_bytes=6000))
    levels = []
    for i in range(12):
        s.put(b"k%d" % (i % 5), b"%d" % i)
        s.sync()
        levels.append(sorted(x.level for x in s._manifest.segments))
    assert levels[0] == [-1] and levels[1] == [-1, -1] and any(0 in x for x in levels) and all(x.count(0) < 4 for x in levels)
    want = {b"k%d" % i: b"%d" % max(j for j in range(12) if j % 5 == i) for i in range(5)}
    assert state(s) == want == read(spark, s.path)


def test_partial_compaction_and_rolling(spark, tmp_path):
    """Only what overlaps of the run is merged anew; its segments are many and do not overlap; keys stay whole."""
    s = Store.open(spark, str(tmp_path / "s"), Caps(flush_bytes=1, segment_bytes=8_000))
    fill(s, 0, 2000)
    s.compact()
    run = s._manifest.level(1, "versions")
    assert len(run) >= 3 and sum(x.rows for x in run) == 2000
    ordered = sorted(run, key=lambda x: x.min_key)
    assert all(a.max_key < b.min_key for a, b in zip(ordered, ordered[1:], strict=False))
    for i in range(4):
        fill(s, 10 + 3 * i, 20 + 3 * i, b"w%d" % i)
    after = s._manifest.level(1, "versions")
    assert [x for x in s._manifest.segments if x.level != 1] == []
    left = {x.name for x in run} & {x.name for x in after}
    assert len(left) >= len(run) - 2 and s.last_compaction["consumed"] < 1500 and s.last_compaction["dropped"] > 0
    # A range that reaches beyond the new keys takes in what it covers, and hides it for good.
    fill(s, 0, 2)
    s.delete_range(b"key000300", None)
    s.sync()
    for i in range(3):
        fill(s, 2 + i, 3 + i)
    assert s._manifest.level(0, "ranges") == [] == s._manifest.level(1, "ranges")
    assert s.check() == {}
    got = state(s)
    assert sorted(got) == [b"key%06d" % i for i in range(300)] and got[b"key000013"].startswith(b"w1")
    assert read(spark, s.path) == got


def test_range_kept_for_a_snapshot(spark, tmp_path):
    """A range that a reader is below stays in the run, hides what it hid, and goes with the reader."""
    s = Store.open(spark, str(tmp_path / "s"), Caps(flush_bytes=1, segment_bytes=100_000))
    fill(s, 0, 200)
    s.compact()
    snap = s.snapshot()
    s.delete_range(b"key000010", b"key000190")
    s.sync()
    for i in range(4):
        fill(s, 200 + 50 * i, 250 + 50 * i)
    assert len(s._manifest.level(1, "ranges")) == 1
    live = [b"key%06d" % i for i in [*range(10), *range(190, 400)]]
    assert sorted(state(s)) == live and len(state(snap)) == 200
    snap.close()
    for i in range(4):
        fill(s, 400 + 50 * i, 450 + 50 * i)
    assert s._manifest.level(1, "ranges") == [] and s.view().versions().where("k >= 'key000010' and k < 'key000190'").count() == 0
    assert sorted(state(s)) == live + [b"key%06d" % i for i in range(400, 600)]


@pytest.mark.parametrize("seed", [3, 8])
def test_random_workload_compacts(spark, tmp_path, seed):
    """A random workload under small caps, with snapshots, against the fold."""
    s, batches, held = Store.open(spark, str(tmp_path / "s"), Caps(flush_bytes=1500)), [], []
    for kind, *rest in workload.batches_of(workload.random_ops(seed, 60)):
        if kind == "write":
            batches.append((s.write(workload.apply_ops(WriteBatch(), rest[0])), rest[0]))
        elif kind == "sync":
            s.sync()
        elif kind == "take":
            held.append(s.snapshot())
        elif held and len(held) > 2:
            held.pop(0).close()
    s.sync()
    s.compact()
    assert state(s) == fold(batches) and all(state(h) == fold(batches, h.seq) for h in held)
    assert read(spark, s.path) == fold(batches) and s.check() == {}


def test_checkpoints(spark, tmp_path, monkeypatch):
    """The log is cut at checkpoints; a torn one falls back to the one before; batch numbers are remembered."""
    from chronolith.sources import log

    monkeypatch.setattr(log, "CHECKPOINT_EVERY", 3)
    monkeypatch.setattr(log, "BATCHES_KEPT", 4)
    s = Store.open(spark, str(tmp_path / "s"))
    for i in range(11):
        s.put(b"k%d" % i, b"v")
        s.sync(batch_id=i)
    commits = [n for n in os.listdir(f"{s.path}/commits") if n.endswith(".json") and not n.startswith(".")]
    points = sorted(n for n in os.listdir(f"{s.path}/checkpoints") if not n.startswith("."))
    assert len(commits) <= 6 and points == ["000000000006.json", "000000000009.json"]
    want = {b"k%d" % i: b"v" for i in range(11)}
    m = s._manifest
    assert read(spark, s.path) == want and all(m.has_batch(i) for i in range(11)) and not m.has_batch(11)
    s.close()
    for n in (points[-1], f".{points[-1]}.crc"):
        if os.path.exists(f"{s.path}/checkpoints/{n}"):
            os.remove(f"{s.path}/checkpoints/{n}")
    open(f"{s.path}/checkpoints/{points[-1]}", "w").write('{"body"')
    t = Store.open(spark, s.path)
    assert state(t) == want and t._manifest.number == 11 and t._manifest.has_batch(0)


def test_segment_check(spark, tmp_path):
    """Faults of stored segments are told apart, and an opener refuses what its footers show."""
    import glob

    s = Store.open(spark, str(tmp_path / "s"), Caps(flush_bytes=1))
    fill(s, 0, 50)
    s.delete_range(b"a", b"b")
    s.sync()
    assert s.check() == {}
    seg = next(x for x in s._manifest.segments if x.kind == "versions")
    path = f"{s.path}/segments/{seg.name}"
    faults = lambda rows, schema="k binary, seq bigint, vt tinyint, v binary": (
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path), checks.segment_faults(s.files, path, seg, "k binary, seq bigint, vt tinyint, v binary")
    )[1]
    assert {"rows", "size", "least key"} <= set(faults([(b"b", 1, 1, b"x")]))
    assert {"keys not ascending", "value without bytes"} <= set(faults([(b"b", 1, 1, None), (b"a", 2, 1, b"x"), (b"a", 3, 0, None)]))
    assert "empty" in faults([]) and "schema" in faults([(b"b", 1)], "k binary, seq bigint")
    s.close()
    with pytest.raises(StoreError) as e:
        Store.open(spark, s.path)
    assert e.value.status is Status.CORRUPTION
    for f in glob.glob(f"{path}/*.parquet"):
        open(f, "wb").write(b"not parquet")
    assert any(x.startswith("unreadable") for x in checks.segment_faults(s.files, path, seg, "k binary")) and checks.segment_faults(s.files, path + "x", seg, "k binary") == ["missing"]


def test_segments_that_meet():
    from chronolith.sources.log import Segment

    seg = lambda lo, hi, kind="versions", open_=False: Segment("n", kind, 0, 1, lo.hex(), hi.hex() if hi is not None else None, 1, 1, 0, open_)
    a = seg(b"b", b"d")
    assert a.overlaps(seg(b"d", b"f")) and not a.overlaps(seg(b"d\x00", b"f")) and a.overlaps(seg(b"a", b"b"))
    assert not seg(b"a", b"b", "ranges").overlaps(a) and seg(b"a", b"b\x00", "ranges").overlaps(a) and a.overlaps(seg(b"d", b"e", "ranges"))
    assert seg(b"c", None, "ranges", True).overlaps(seg(b"z", b"zz")) and not seg(b"zzz", None, "ranges", True).overlaps(seg(b"z", b"zz"))


def test_caps_for_columns(spark):
    """The rule for whole columns is that for one write."""
    caps = Caps(100, 400, 1, 300)
    rows = [(r, b, f) for r in (1, 100, 101) for b in (0, 199, 200, 299, 300, 301, 399) for f in (0, 50)]
    df = spark.createDataFrame(rows, "r bigint, b bigint, f bigint")
    got = df.select("r", "b", "f", caps.refusal(df["r"], df["b"], df["f"]).alias("s")).collect()
    assert [x["s"] for x in got] == [int(caps.admit(r, b, f)) for r, b, f in rows]


def test_content_hash(spark):
    a = spark.createDataFrame([(b"a", b"1"), (b"b", b"2")], "k binary, v binary")
    h = lambda df: tuple(metrics.content_hash(df).first())
    assert h(a) == h(a.orderBy("v", ascending=False).repartition(3)) != h(a.limit(1)) and h(a.limit(0)) == (0, "0")
    assert h(a) != h(spark.createDataFrame([(b"a", b"2"), (b"b", b"1")], "k binary, v binary"))


def test_latest_values(spark, tmp_path):
    """The newest value per key, over micro-batches that come out of order."""
    for i, rows in enumerate([[("a", "1", 10), ("b", "2", 11)], [("a", "0", 5), ("b", "3", 12)]]):
        spark.createDataFrame(rows, "key string, value string, t bigint").selectExpr("key", "value", "timestamp_seconds(t) as time").write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("key string, value string, time timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.latest_values(stream, "key", "value", "time").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {r["key"]: r["value"] for r in spark.table("latest").collect()} == {"a": "1", "b": "3"}
