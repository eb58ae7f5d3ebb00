"""python -m chronolith sweep | differential | amplification [--seed N] [--ops N] [--regime NAME] [--dir PATH]"""

from __future__ import annotations

import argparse
import collections

from pyspark.sql import SparkSession

from .caps import Caps
from .operators import metrics
from .operators.checks import Outcome, judge_recovery
from .plans import artifact, workload
from .sources.files import scratch_dir
from .sources.store import Store, WriteBatch


def sweep(spark: SparkSession, root: str, seed: int, ops: int, regime: str = "default") -> int:
    """Fails a workload at every file operation in every way and prints a census of outcomes by kind of call."""
    groups: list[list] = [[]]
    for step in workload.batches_of(workload.random_ops(seed, ops)):
        if step[0] == "write":
            groups[-1].append(step[1])
        elif step[0] == "sync" and groups[-1]:
            groups.append([])
    found = workload.crash_sweep(spark, root, [g for g in groups if g], modes=(*workload.MODES, *workload.REFUSALS), regime=regime)
    for (when, call, outcome), n in sorted(collections.Counter((w, c, o.value) for w, c, _, o, _ in found).items()):
        print(f"{when}, {call}: {n} {outcome}")
    bad = [x for x in found if x[3] is not Outcome.PASS]
    for when, call, at, outcome, why in bad:
        print(f"  {when} {call} {at}: {outcome.value}, {why}")
    return int(bool(bad))


def differential(spark: SparkSession, root: str, seed: int, ops: int) -> int:
    """Runs a seeded workload, reopens the store and prints the record of both."""
    store, steps, batches, done, held = Store.open(spark, f"{root}/store"), [], [], 0, []
    for step in workload.batches_of(workload.random_ops(seed, ops)):
        if step[0] == "write":
            seq = store.write(workload.apply_ops(WriteBatch(), step[1]))
            batches.append((seq, step[1]))
            steps.append(("write", seq, step[1]))
        else:
            steps.append(step)
            if step[0] == "sync":
                done = store.sync()
            elif step[0] == "take":
                held.append(store.snapshot())
            elif held:
                held.pop(0).close()
    store.close()
    again = Store.open(spark, f"{root}/store")
    recovered = workload.state_of(again)
    again.close()
    verdict, _ = judge_recovery(batches, done, None, False, done, recovered)
    print(artifact.encode(seed, steps, done, recovered, verdict.value))
    return int(not verdict.counts())


def amplification(spark: SparkSession, root: str, seed: int, ops: int) -> int:
    """Overwrites a fixed set of keys and prints the store's amplification after each sync."""
    store = Store.open(spark, f"{root}/store", Caps(flush_bytes=8 << 10))
    for turn in range(max(1, ops // 100)):
        batch = WriteBatch()
        for i in range(100):
            batch.set(workload.key_of(i), b"%d:" % turn + b"x" * 512)
        store.write(batch)
        store.sync()
        print(turn, {k: round(v, 2) for k, v in metrics.amplification(store).items()})
    return 0


def main() -> int:
    args = argparse.ArgumentParser(prog="chronolith", description=__doc__)
    args.add_argument("command", choices=("sweep", "differential", "amplification"))
    args.add_argument("--seed", type=int, default=42)
    args.add_argument("--ops", type=int, default=200)
    args.add_argument("--regime", choices=sorted(workload.REGIMES), default="default")
    args.add_argument("--dir")
    a = args.parse_args()
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    root = a.dir or scratch_dir(spark)
    if a.command == "sweep":
        return sweep(spark, root, a.seed, a.ops, a.regime)
    return {"differential": differential, "amplification": amplification}[a.command](spark, root, a.seed, a.ops)


if __name__ == "__main__":
    raise SystemExit(main())
