"""Shared pieces: saved intermediate tables, connected components, null-safe document columns."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_OPEN: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of our own in local mode (tests);
    on a cluster, whose machines do not share such a folder, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIR:
            _OWN_DIR[app] = tempfile.mkdtemp(prefix="chronolith-")
        named = _OWN_DIR[app]
    return named.rstrip("/")


class Workspace:
    """Intermediate tables of one operator call, written under the shared folder.

    A written table cuts the lineage: a lost executor costs only the tasks of the running job. The folder goes
    when the application ends, or before that with the `passing_tables` block that it was made in.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ws-{uuid.uuid4().hex}"
        self.n = 0
        path, fs = self._hadoop(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OPEN.append(self)

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._ws_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that no later plan reads."""
        path, fs = self._hadoop(df._ws_path)
        fs.delete(path, True)

    def close(self) -> None:
        """Deletes all tables; no plan may read them any more."""
        path, fs = self._hadoop(self.root)
        fs.delete(path, True)
        if self in _OPEN:
            _OPEN.remove(self)

    def free(self) -> None:
        """Lets Spark's cleaner remove shuffle files that no live plan refers to.

        The first round drops the plans, the second what only they referred to; the cleaner works beside us.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.4)


@contextlib.contextmanager
def passing_tables() -> Iterator[None]:
    """Deletes, at its end, the intermediate tables of the operators called inside; their results are written by then."""
    before = list(_OPEN)
    yield
    for ws in [w for w in _OPEN if w not in before]:
        ws.close()


def own(name: str) -> str:
    """A working column's name, apart from whatever columns the caller's rows may have."""
    return f"__chronolith_{name}"


def quoted(names: list[str]) -> list[str]:
    """Column names for select, whatever characters they hold."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def placed_in_order(ws: Workspace, rows: DataFrame, order: list[Column], place: str, part: str) -> DataFrame:
    """rows with `place`, their number from 0 in the given order, and `part`, their stretch of it.

    The stretches are range partitions, written with their numbers so that those stay as they are; only one row
    a stretch comes together in a task.
    """
    cut = ws.save(rows.repartitionByRange(shuffle_partitions(ws.spark), *order).withColumn(part, F.spark_partition_id()))
    before = before_each(cut.groupBy(part).agg(F.count("*").alias("n")), [], part, "n", "base").drop("n")
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return cut.withColumn(place, inside).join(F.broadcast(before), part).withColumn(place, F.col(place) + F.col("base")).drop("base")


def before_each(rows: DataFrame, within: list[str], order: str, amount: str, total: str) -> DataFrame:
    """rows with `total`, the sum of `amount` over the rows before each, in order, of those alike in `within`."""
    back = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(total, F.coalesce(F.sum(amount).over(back), F.lit(0)).cast("long"))


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (x, root) for every node but the roots themselves.

    root is the smallest node of the component. Each round keeps for a node x only its smallest
    neighbour m and ties the other smaller neighbours to m; when every node has one parent, pointer
    jumping makes all parents roots. Rows per round never exceed the edges; nothing is collected.
    """
    e = ws.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("p")).distinct()
    )
    if e.isEmpty():
        return e.withColumnRenamed("p", "root")
    while True:
        # Not a window: the centre of a star has very many rows, which only a join may deal out.
        m = e.join(e.groupBy("x").agg(F.min("p").alias("m")), "x")
        pair = F.when(F.col("p") == F.col("m"), F.struct(F.col("x"), F.col("m").alias("p"), F.lit(False).alias("more"))).otherwise(
            F.struct(F.col("p").alias("x"), F.col("m").alias("p"), F.lit(True).alias("more"))
        )
        nxt = ws.save(m.select(pair.alias("e")).select("e.*").groupBy("x", "p").agg(F.max("more").alias("more")))
        again = not nxt.where("more").isEmpty()
        ws.drop(e)
        e = nxt
        if not again:
            break
    while True:
        a, b = e.select("x", "p"), e.select(F.col("x").alias("y"), F.col("p").alias("q"))
        nxt = ws.save(
            a.join(b, F.col("p") == F.col("y"), "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("more"))
        )
        again = not nxt.where("more").isEmpty()
        ws.drop(e)
        e = nxt
        if not again:
            return e.select("x", F.col("p").alias("root"))
