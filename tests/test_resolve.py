"""Reads and batches against a plain fold, on small fixtures and random logs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronolith.operators import batch, compaction, resolve
from chronolith.operators.checks import fold

OPS = "seq bigint, ord bigint, kind string, k binary, v binary, lo binary, hi binary"


def log_of(spark, batches):
    rows = [(seq, i, *op) for seq, ops in batches for i, op in enumerate(ops)]
    versions, ranges = batch.normalise(spark.createDataFrame(rows, OPS))
    return versions, ranges


def as_map(df):
    return {bytes(r["k"]): None if r["v"] is None else bytes(r["v"]) for r in df.collect()}


def S(k, v):
    return ("S", k, v, None, None)


def D(k):
    return ("D", k, None, None, None)


def R(lo, hi):
    return ("R", None, None, lo, hi)


CASES = {
    "set, delete": ([(1, [S(b"a", b"1")]), (2, [S(b"b", b"2")]), (3, [D(b"a")])], {b"b": b"2"}),
    "last wins": ([(1, [S(b"k", b"first"), D(b"k"), S(b"k", b"last")])], {b"k": b"last"}),
    "empty key and value": ([(1, [S(b"", b"")])], {b"": b""}),
    "half-open range": ([(1, [S(x, b"v") for x in (b"a", b"b", b"c", b"d")]), (2, [R(b"b", b"d")])], {b"a": b"v", b"d": b"v"}),
    "empty range is nothing": ([(1, [S(b"", b"0"), S(b"a", b"1")]), (2, [R(b"", b"")]), (3, [R(b"b", b"a")])], {b"": b"0", b"a": b"1"}),
    "clear all": ([(1, [S(b"", b"0"), S(b"a", b"1")]), (2, [R(None, None)])], {}),
    "range within a batch": ([(1, [S(b"old", b"o")]), (2, [S(b"early", b"e"), R(None, None), S(b"late", b"l")])], {b"late": b"l"}),
    "equal sequence does not hide": ([(1, [R(b"a", b"z"), S(b"m", b"same")])], {b"m": b"same"}),
    "start of its own range": ([(1, [S(b"a", b"0")]), (2, [R(b"a", b"z"), S(b"a", b"1")])], {b"a": b"1"}),
    "prefix order": ([(1, [S(b"a", b"1"), S(b"a\x00b", b"2"), S(b"\xff", b"3")]), (2, [R(b"a\x00", b"b")])], {b"a": b"1", b"\xff": b"3"}),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    batches, want = CASES[name]
    v, r = log_of(spark, batches)
    assert as_map(resolve.resolve(v, r)) == want == fold(batches)
    assert as_map(resolve.resolve(v, r, limit=0)) == want


def random_batches(r, n):
    keys = [b"", b"a", b"a\x00", b"b", b"c", b"cc", b"d", b"\xff"]
    out = []
    for seq in range(1, n + 1):
        ops = []
        for _ in range(r.randint(0, 5)):
            x = r.random()
            if x < 0.55:
                ops.append(S(r.choice(keys), b"%d" % r.randint(0, 99)))
            elif x < 0.75:
                ops.append(D(r.choice(keys)))
            else:
                ops.append(R(r.choice([None, *keys]), r.choice([None, *keys])))
        out.append((seq, ops))
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_logs(spark, seed):
    r = random.Random(seed)
    batches = random_batches(r, 9)
    v, ra = log_of(spark, batches)
    v, ra = v.cache(), ra.cache()
    s = r.randint(1, 9)
    assert as_map(resolve.resolve(v, ra, s)) == fold(batches, s)
    assert as_map(resolve.resolve(v, ra, s, limit=0)) == fold(batches, s)
    lo, hi = b"a\x00", b"cc"
    assert as_map(resolve.resolve(v, ra, s, lo, hi)) == {k: x for k, x in fold(batches, s).items() if lo <= k < hi}
    seen = [s, 9]
    kv, kr = compaction.kept(v, ra, seen), compaction.kept_ranges(ra, seen)
    for at in seen:
        assert as_map(resolve.resolve(kv, kr, at)) == fold(batches, at)
    v.unpersist()
    ra.unpersist()


def test_scan_seek_page(spark):
    v, r = log_of(spark, [(i + 1, [S(k, k)]) for i, k in enumerate((b"a", b"c", b"e"))])
    view = resolve.resolve(v, r).select("k", "v")
    key = lambda df: [bytes(x["k"]) for x in df.collect()]
    assert key(resolve.seek_ge(view, b"b")) == [b"c"] == key(resolve.seek_ge(view, b"c"))
    assert key(resolve.seek_ge(view, b"z")) == [] == key(resolve.seek_lt(view, b"a"))
    assert key(resolve.seek_lt(view, b"c")) == [b"a"]
    assert key(resolve.scan(v, r, reverse=True)) == [b"e", b"c", b"a"]
    assert key(resolve.page(view, 2)) == [b"a", b"c"] and key(resolve.page(view, 2, b"c")) == [b"e"]
    assert key(resolve.page(view, 2, b"e", reverse=True)) == [b"c", b"a"]
    steps = {bytes(x["k"]): (x["next_k"] and bytes(x["next_k"]), x["prev_k"] and bytes(x["prev_k"])) for x in resolve.neighbours(view).collect()}
    assert steps == {b"a": (b"c", None), b"c": (b"e", b"a"), b"e": (None, b"c")}
    assert resolve.live_bytes(view).first().asDict() == {"n_keys": 3, "live_bytes": 6}


CELLS = [
    ([("a", 9, 1), ("a", 4, 1), ("b", 7, 1)], [9], True, 2, 1),
    ([("a", 9, 1), ("a", 4, 1)], [5, 9], True, 2, 0),
    ([("a", 9, 0), ("a", 4, 1), ("b", 10, 1)], [10], True, 1, 2),
    ([("a", 9, 0), ("b", 10, 1)], [10], True, 1, 1),
    ([("a", 9, 0), ("b", 10, 1)], [10], False, 2, 0),
    ([("a", 9, 0), ("a", 4, 1), ("b", 10, 1)], [5, 10], True, 3, 0),
    ([("a", 9, 0), ("a", 4, 1)], [5, 9], True, 2, 0),
]


@pytest.mark.parametrize("rows, seen, bottom, emitted, dropped", CELLS)
def test_drop_rule(spark, rows, seen, bottom, emitted, dropped):
    v = spark.createDataFrame([(k, s, t, "v" if t else None) for k, s, t in rows], "k string, seq bigint, vt tinyint, v string")
    r = spark.createDataFrame([], "lo string, hi string, seq bigint")
    got = compaction.stats(v, r, seen, bottom).first()
    assert (got["emitted"], got["dropped"]) == (emitted, dropped)


@pytest.mark.parametrize("cells, ranges, seen, want", [
    ([("b", 4)], [("a", "c", 9)], [9], []), ([("b", 9)], [("a", "c", 4)], [9], [("b", 9)]), ([("a", 1), ("c", 2)], [("a", "c", 9)], [9], [("c", 2)]),
    ([("b", 4)], [("a", "c", 9)], [5, 9], [("b", 4)]), ([("z", 4)], [("a", "c", 9)], [9], [("z", 4)]), ([("b", 7)], [("a", "c", 9), ("a", "c", 5)], [9], []),
    ([("z", 4)], [("a", None, 9)], [9], []),
])
def test_required(spark, cells, ranges, seen, want):
    v = spark.createDataFrame([(k, s, 1, "v") for k, s in cells], "k string, seq bigint, vt tinyint, v string")
    r = spark.createDataFrame(ranges, "lo string, hi string, seq bigint")
    assert sorted((x["k"], x["seq"]) for x in compaction.required(v, r, seen).collect()) == want


def test_record_bytes(spark):
    ops = spark.createDataFrame([(1, 0, "S", b"x" * 8, b"y" * 64, None, None), (2, 0, "R", None, None, b"ab", b"abc"), (2, 1, "D", b"k", None, None, None)], OPS)
    got = {r["seq"]: (r["n_ops"], r["record_bytes"]) for r in batch.batch_bytes(ops).collect()}
    assert got == {1: (1, 94), 2: (2, 13 + 5 + 2 + 4 + 3 + 5 + 1)}
