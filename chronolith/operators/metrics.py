"""Sizes and amplification of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_facts(versions: DataFrame, segment: str) -> DataFrame:
    """Per segment: entries, keys, deletions, key bounds and the sequences' bounds."""
    return versions.groupBy(segment).agg(
        F.count("*").alias("entries"), F.count_if(F.col("vt") == 0).alias("deletions"), F.min("k").alias("min_k"), F.max("k").alias("max_k"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def read_amplification(store, keys: DataFrame) -> float:
    """Segments whose key bounds hold a present key, on average over the keys (column k) that are present: those
    that a point lookup consults."""
    segments = [s for s in store._manifest.segments if s.kind == "versions" and s.rows]
    within = [((F.col("k") >= F.lit(bytes.fromhex(s.min_key))) & (F.col("k") <= F.lit(bytes.fromhex(s.max_key)))).cast("int") for s in segments]
    if not within:
        return 0.0
    present = store.multi_get(keys).where("found").select(sum(within[1:], within[0]).alias("n"))
    return float(present.agg(F.avg("n")).first()[0] or 0.0)


def amplification(store) -> dict[str, float]:
    """Space (disk over live bytes), write (written over submitted), read as it is measured over all live keys, and
    the number of segments that may overlap (the most that a read consults)."""
    m = store._manifest
    live = store.approximate_bytes()
    versions = [s for s in m.segments if s.kind == "versions"]
    return {
        "space": sum(s.bytes for s in m.segments) / live if live else 0.0,
        "write": store.bytes_written / store.bytes_submitted if store.bytes_submitted else 0.0,
        "read": read_amplification(store, store.view().frame().select("k")),
        "depth": float(sum(s.level != 1 for s in versions) + any(s.level == 1 for s in versions)),
    }


def content_hash(view: DataFrame) -> DataFrame:
    """One value for a visible map, whatever its order and layout."""
    h = F.xxhash64("k", "v").cast("decimal(38,0)")
    return view.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))
