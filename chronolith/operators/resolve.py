"""The visible map at a sequence number, and the reads on it.

Versions (k, seq, vt, v) and ranges (lo, hi, seq) are first cut to seq <= s and to the key bounds, which
reach the Parquet scan. Then the newest version of every key is taken in one aggregation, combined on the
map side, and only those rows meet the range deletions. The deletion flag is looked at last: earlier it
would bring deleted keys back.

Up to BROADCAST_RANGES range deletions are made, on the driver, into disjoint stretches of the key space with the
greatest sequence of each, in which every task looks its keys up by binary search. Beyond, keys and ranges are
dealt to slices of the key space, each swept once in key order; a range goes whole only to the slices of its ends,
and to those between as one number.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import covers, in_range

#: Range deletions up to which their stretches are sent whole to every task; stretches up to which a join does.
BROADCAST_RANGES, JOINED = 20_000, 32
#: Keys sampled for each slice to place the cuts between slices, and in all.
SAMPLE, MOST_SAMPLED = 50, 20_000


def newest(versions: DataFrame, seq=None, lo=None, hi=None) -> DataFrame:
    """(k, seq, vt, v): the newest version of each key at or below seq, in [lo, hi)."""
    v = versions.where(in_range(F.col("k"), lo, hi))
    if seq is not None:
        v = v.where(F.col("seq") <= seq)
    top = v.groupBy("k").agg(F.max_by(F.struct("seq", "vt", "v"), "seq").alias("top"))
    return top.select("k", "top.seq", "top.vt", "top.v")


def ranges_at(ranges: DataFrame, seq=None) -> DataFrame:
    return ranges if seq is None else ranges.where(F.col("seq") <= seq)


def stretches(ranges: list[tuple]) -> tuple[list, list[int]]:
    """(starts, seqs): disjoint stretches of the key space with the greatest seq of the ranges (lo, hi, seq) over
    each, 0 where there is none. seqs has one entry more: the first is that before all starts."""
    points = sorted({p for lo, hi, _ in ranges for p in (lo, hi) if p is not None})
    by_start = sorted(ranges, key=lambda r: r[0])
    live: list[tuple] = []
    starts, seqs, i = [], [0], 0
    for p in points:
        while i < len(by_start) and by_start[i][0] <= p:
            heapq.heappush(live, (-by_start[i][2], i))
            i += 1
        while live and (hi := by_start[live[0][1]][1]) is not None and hi <= p:
            heapq.heappop(live)
        top = -live[0][0] if live else 0
        if top != seqs[-1]:
            starts.append(p)
            seqs.append(top)
    return starts, seqs


def _looked_up(keys: DataFrame, starts: list, values: list[int], name: str) -> DataFrame:
    """keys with a column: the value of the stretch that holds k."""
    at = keys.columns.index("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([values[bisect_right(starts, k)] for k in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return keys.mapInArrow(run, T.StructType([*keys.schema.fields, T.StructField(name, T.LongType())]))


def cover(keys: DataFrame, ranges: DataFrame, limit: int = BROADCAST_RANGES, few: bool | None = None) -> DataFrame:
    """The rows of keys (with a column k) and c, the greatest seq of a range that holds k, 0 if none.

    few tells whether there are at most `limit` ranges; where it is not known, up to that many are read to see.
    """
    if few is not False:
        rows = [tuple(r) for r in ranges.select("lo", "hi", "seq").limit(limit + 1).collect()]
        if len(rows) <= limit:
            starts, seqs = stretches(rows)
            if not starts:
                return keys.withColumn("c", F.lit(0).cast("long"))
            if len(starts) > JOINED:
                return _looked_up(keys, starts, seqs, "c")
            kind = keys.schema["k"].dataType.simpleString()
            parts = [(a, b, c) for a, b, c in zip(starts, [*starts[1:], None], seqs[1:], strict=True) if c]
            r = keys.sparkSession.createDataFrame(parts, f"r_lo {kind}, r_hi {kind}, c bigint")
            hit = keys.join(F.broadcast(r), covers(F.col("r_lo"), F.col("r_hi"), F.col("k")), "left")
            return hit.select(*keys.columns, F.coalesce("c", F.lit(0)).cast("long").alias("c"))
    found = _swept(keys.select("k").distinct(), ranges).withColumnRenamed("k", "k_")
    return keys.join(found, F.col("k") == F.col("k_")).select(*keys.columns, "c")


def _cuts(keys: DataFrame) -> list:
    """Keys that cut the key space into about equal slices, as many as there are shuffle partitions.

    They come from a sample of bounded size, and bound nothing but the balance.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(MOST_SAMPLED, SAMPLE * n)
    marks = sorted(r["k"] for r in keys.select("k").orderBy(F.xxhash64("k")).limit(size).collect())
    step = max(1, -(-len(marks) // n))
    return sorted(set(marks[step::step]))


def _swept(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(k, c) for distinct keys, by slices of the key space."""
    cuts = _cuts(keys)
    numbers = list(range(len(cuts) + 1))
    k = _looked_up(keys.select("k"), cuts, numbers, "slice")
    first = _looked_up(ranges.select("lo", "hi", "seq", F.col("lo").alias("k")), cuts, numbers, "first")
    last = _looked_up(first.withColumn("k", F.coalesce("hi", "lo")), cuts, numbers, "last").drop("k")
    r = last.withColumn("last", F.when(F.col("hi").isNull(), F.lit(len(cuts))).otherwise(F.col("last")))
    ends = r.select("lo", "hi", "seq", F.explode(F.array_distinct(F.array("first", "last"))).alias("slice"))
    # The slices between a range's ends it covers whole: of these only the greatest seq counts.
    between = r.where("last > first + 1").select("seq", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)).alias("slice"))
    none = F.lit(None).cast(ranges.schema["lo"].dataType)
    whole = between.groupBy("slice").agg(F.max("seq").alias("seq")).select(none.alias("lo"), none.alias("hi"), "seq", "slice")
    kind = keys.schema["k"].dataType

    def sweep(_, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(zip(*(right.column(c).to_pylist() for c in ("lo", "hi", "seq")), strict=True))
        always = max((s for lo, _, s in rows if lo is None), default=0)
        starts, seqs = stretches([r for r in rows if r[0] is not None])
        c = pa.array([max(always, seqs[bisect_right(starts, x)]) for x in left.column("k").to_pylist()], pa.int64())
        return pa.table([left.column("k"), c], ["k", "c"])

    out = T.StructType([T.StructField("k", kind), T.StructField("c", T.LongType())])
    return k.groupBy("slice").cogroup(ends.unionByName(whole).groupBy("slice")).applyInArrow(sweep, out)


def resolve(versions: DataFrame, ranges: DataFrame, seq=None, lo=None, hi=None, limit: int = BROADCAST_RANGES, few_ranges: bool | None = None) -> DataFrame:
    """(k, seq, v): the visible map at seq within [lo, hi). A range hides a version only if strictly newer."""
    top = newest(versions, seq, lo, hi)
    cut = ranges_at(ranges, seq)
    if lo is not None:
        cut = cut.where(F.col("hi").isNull() | (F.col("hi") > F.lit(lo)))
    if hi is not None:
        cut = cut.where(F.col("lo") < F.lit(hi))
    return cover(top.where("vt = 1"), cut, limit, few_ranges).where("c <= seq").select("k", "seq", "v")


def get(versions: DataFrame, ranges: DataFrame, key, seq=None, few_ranges: bool | None = None) -> DataFrame:
    """The visible pair of one key, or no row."""
    v = versions.where(F.col("k") == F.lit(key))
    return resolve(v, ranges.where(covers(F.col("lo"), F.col("hi"), F.lit(key))), seq, few_ranges=few_ranges)


def multi_get(versions: DataFrame, ranges: DataFrame, keys: DataFrame, seq=None, few_ranges: bool | None = None) -> DataFrame:
    """(k, found, v) for every row of keys (column k); the versions read are only those of the keys."""
    wanted = keys.select("k").distinct()
    top = resolve(versions.join(wanted, "k", "left_semi"), ranges, seq, few_ranges=few_ranges)
    seen = top.select(F.col("k").alias("k_"), F.lit(True).alias("hit"), "v")
    return keys.select("k").join(seen, F.col("k") == F.col("k_"), "left").select("k", F.coalesce("hit", F.lit(False)).alias("found"), "v")


def scan(versions: DataFrame, ranges: DataFrame, seq=None, lo=None, hi=None, reverse: bool = False, few_ranges: bool | None = None) -> DataFrame:
    """The visible pairs of [lo, hi) in key order, or backwards."""
    view = resolve(versions, ranges, seq, lo, hi, few_ranges=few_ranges)
    return view.orderBy(F.col("k").desc() if reverse else F.col("k")).select("k", "v")


def first(view: DataFrame) -> DataFrame:
    return view.orderBy("k").limit(1)


def last(view: DataFrame) -> DataFrame:
    return view.orderBy(F.col("k").desc()).limit(1)


def seek_ge(view: DataFrame, key) -> DataFrame:
    return first(view.where(F.col("k") >= F.lit(key)))


def seek_lt(view: DataFrame, key) -> DataFrame:
    return last(view.where(F.col("k") < F.lit(key)))


def page(view: DataFrame, n: int, after=None, reverse: bool = False) -> DataFrame:
    """The next n pairs after a key (None: from the start), forwards or backwards."""
    if after is not None:
        view = view.where(F.col("k") < F.lit(after)) if reverse else view.where(F.col("k") > F.lit(after))
    return view.orderBy(F.col("k").desc() if reverse else F.col("k")).limit(n)


def neighbours(view: DataFrame) -> DataFrame:
    """(k, next_k, prev_k): where a cursor steps to from every key.

    Keys are dealt to slices of the key space by cuts that the driver holds, so every branch of the plan deals
    them alike; the first and last key of each slice tie neighbouring slices together, so no window runs over all
    keys in one task.
    """
    names = ["k", "next_k", "prev_k"]
    cuts = _cuts(view)
    keys = _looked_up(view.select("k"), cuts, list(range(len(cuts) + 1)), "part")
    inside = Window.partitionBy("part").orderBy("k")
    steps = keys.select("k", "part", F.lead("k").over(inside).alias("nx"), F.lag("k").over(inside).alias("pv"))
    edges = keys.groupBy("part").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    across = Window.orderBy("part")
    edges = edges.select(F.col("part").alias("p_"), F.lead("low").over(across).alias("after"), F.lag("high").over(across).alias("before"))
    out = steps.join(edges, F.col("part") == F.col("p_"))
    return out.select("k", F.coalesce("nx", "after").alias("next_k"), F.coalesce("pv", "before").alias("prev_k")).select(*names)


def live_bytes(view: DataFrame) -> DataFrame:
    """n_keys and the bytes of keys and values of a visible map."""
    size = F.octet_length("k") + F.coalesce(F.octet_length("v"), F.lit(0))
    return view.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("live_bytes"))


def history(versions: DataFrame, lo=None, hi=None) -> DataFrame:
    """Every version in [lo, hi), with its age rank within its key (0 newest)."""
    by_key = Window.partitionBy("k").orderBy(F.col("seq").desc())
    return versions.where(in_range(F.col("k"), lo, hi)).select("k", "seq", "vt", "v", (F.row_number().over(by_key) - 1).alias("age"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(k, change, old_v, new_v): added, removed or changed pairs between two visible maps."""
    a = old.select("k", F.col("v").alias("old_v"), F.lit(1).alias("a"))
    b = new.select("k", F.col("v").alias("new_v"), F.lit(1).alias("b"))
    j = a.join(b, "k", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("old_v").eqNullSafe(F.col("new_v")), "changed")
    return j.withColumn("change", change).where("change is not null").select("k", "change", "old_v", "new_v")
