"""Checks of recovery, dropped versions, merges and refusals, independent of the engine's own plans.

The fold below applies operations one by one to a plain dictionary; comparisons are set differences. A
verdict is one of the five outcomes, and only a pass counts as evidence.
"""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Outcome(Enum):
    PASS = "pass"
    VIOLATION = "violation"
    CHARACTERIZATION = "characterization"
    INCONCLUSIVE = "inconclusive"
    VOID = "void"

    def counts(self) -> bool:
        return self is Outcome.PASS


def fold(batches: Iterable[tuple[int, Iterable[tuple]]], upto: int | None = None) -> dict:
    """The map after all batches (seq, ops of (kind, k, v, lo, hi)) at or below a sequence."""
    state: dict = {}
    for seq, ops in sorted(batches, key=lambda b: b[0]):
        if upto is not None and seq > upto:
            break
        for kind, k, v, lo, hi in ops:
            if kind == "S":
                state[k] = v
            elif kind == "D":
                state.pop(k, None)
            else:
                for x in [x for x in state if not ((lo is not None and x < lo) or (hi is not None and not x < hi))]:
                    del state[x]
    return state


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def judge_recovery(batches: list, previous: int, in_flight: int | None, applied: bool, promised: int, recovered: dict) -> tuple[Outcome, str]:
    """A recovered state must be that of the last whole group, or of the group in flight if it took effect.

    previous and in_flight are the groups' highest sequences; promised is the highest sequence that any
    sync returned, and may not exceed what the record justifies.
    """
    allowed = [previous] + ([in_flight] if in_flight is not None and applied else [])
    if promised > max(allowed):
        return Outcome.VIOLATION, f"promised {promised}, justified {max(allowed)}"
    for s in allowed:
        if fold(batches, s) == recovered:
            return Outcome.PASS, f"state at {s}"
    at = [s for s in [0, *(b[0] for b in batches)] if fold(batches, s) == recovered]
    return Outcome.VIOLATION, f"state at {at[-1]}, inside a group" if at else "a state that no sequence had"


def judge_drops(submitted: DataFrame, survived: DataFrame, required: DataFrame) -> dict[str, DataFrame]:
    """Three frames, all empty for a sound collection: phantoms, lost versions, and resurrections.

    Versions are (k, seq, vt). A resurrection is a dropped deletion with an older surviving value.
    """
    cols = ["k", "seq"]
    gone = submitted.join(survived, cols, "left_anti").where("vt = 0").select("k", submitted["seq"].alias("del_seq"))
    older = survived.select("k", "seq").join(gone, "k").where("seq < del_seq")
    return {
        "phantom": survived.join(submitted, cols, "left_anti").select(*cols),
        "lost": required.join(survived, cols, "left_anti").select(*cols),
        "resurrected": older.select(*cols).distinct(),
    }


def judge_merge(inputs: list[list[tuple]], output: list[tuple]) -> list[str]:
    """Faults of a merged run of (k, seq, ...): order by key, newest first; nothing lost, invented or changed."""
    faults = []
    place = [(r[0], -r[1]) for r in output]
    if place != sorted(place):
        faults.append("order")
    if len(set(place)) != len(place):
        faults.append("repeated")
    want, have = {r for run in inputs for r in run}, set(output)
    faults += ["lost"] * bool(want - have) + ["invented"] * bool(have - want)
    return faults


def judge_cap(submitted: int, cap: int, refused: bool) -> str:
    """What a size limit's answer was: it must refuse exactly what exceeds it."""
    return {(True, True): "void", (True, False): "missing", (False, True): "spurious", (False, False): "normal"}[(submitted > cap, refused)]


def judge_busy(owed: int, limit: int, refused: bool) -> str:
    """The same for backpressure, which a limit of 0 turns off."""
    return {(True, True): "backpressured", (True, False): "missing", (False, True): "spurious", (False, False): "normal"}[(bool(limit) and owed > limit, refused)]


def one_regime(runs: DataFrame, regime: str = "regime") -> str:
    """The one regime of a set of runs; runs of several are never summed."""
    found = [r[0] for r in runs.select(regime).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} or more regimes: {found}")
    return found[0]


def version_faults(versions: DataFrame) -> DataFrame:
    """(fault, n): how many rows of a versions segment break each rule; no row for a rule that holds."""
    twice = versions.groupBy("k", "seq").count().where("count > 1").select(F.lit("repeated version").alias("fault"))
    rules = {
        "null key": F.col("k").isNull(), "sequence below 1": F.coalesce(F.col("seq"), F.lit(0)) < 1, "unknown type": ~F.coalesce(F.col("vt").isin(0, 1), F.lit(False)),
        "value without bytes": (F.col("vt") == 1) & F.col("v").isNull(), "deletion with bytes": (F.col("vt") == 0) & F.col("v").isNotNull(),
    }
    return _count_faults(versions, rules, twice)


def range_faults(ranges: DataFrame) -> DataFrame:
    """The same for a ranges segment."""
    twice = ranges.groupBy("lo", "seq").count().where("count > 1").select(F.lit("repeated range").alias("fault"))
    rules = {"null start": F.col("lo").isNull(), "sequence below 1": F.coalesce(F.col("seq"), F.lit(0)) < 1, "empty range": F.col("hi").isNotNull() & (F.col("hi") <= F.col("lo"))}
    return _count_faults(ranges, rules, twice)


def order_faults(segment: DataFrame, key: str, newest_first: bool = True) -> DataFrame:
    """(fault, n): rows of a segment's files that do not follow the row before, by key and then newest first."""
    in_file = Window.partitionBy("file").orderBy("row")
    place = segment.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(key).alias("key"), "seq")
    back = place.select("key", "seq", F.lag("key").over(in_file).alias("k0"), F.lag("seq").over(in_file).alias("s0"))
    bad = F.col("k0") > F.col("key")
    if newest_first:
        bad = bad | ((F.col("k0") == F.col("key")) & (F.col("s0") <= F.col("seq")))
    return back.where(bad).groupBy(F.lit("keys not ascending").alias("fault")).agg(F.count("*").alias("n"))


def segment_faults(files, path: str, segment, schema: str) -> list[str]:
    """All that is wrong with a stored segment, against its own rules and the facts in the log; none if sound."""
    spark, key = files.spark, "k" if segment.kind == "versions" else "lo"
    if not files.exists(path):
        return ["missing"]
    out = [] if files.size(path) == segment.bytes else ["size"]
    try:
        found = spark.read.option("recursiveFileLookup", "true").parquet(path)
        kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
        if kinds != dict(c.strip().split() for c in schema.split(",")):
            return [*out, "schema"]
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        rules = version_faults(rows) if key == "k" else range_faults(rows)
        order = order_faults(rows, key, newest_first=key == "k")
        out += sorted(r["fault"] for r in rules.unionByName(order).collect())
        ends = F.max("k") if key == "k" else F.max("hi")
        got = rows.agg(F.count("*").alias("n"), F.hex(F.min(key)).alias("lo"), F.hex(ends).alias("hi"), F.max("seq").alias("seq")).first()
    except Exception as e:
        return [*out, f"unreadable: {type(e).__name__}"]
    if not got["n"]:
        out.append("empty")
    facts = {"rows": (got["n"], segment.rows), "least key": (got["lo"], segment.min_key), "greatest key": (got["hi"], segment.max_key), "greatest sequence": (got["seq"], segment.max_seq)}
    return out + [name for name, (a, b) in facts.items() if a != b]


def _count_faults(rows: DataFrame, rules: dict, more: DataFrame) -> DataFrame:
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(broken).alias("fault")).unionByName(more).groupBy("fault").agg(F.count("*").alias("n"))
