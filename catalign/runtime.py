"""Session set-up, durable stage tables and ranks that never need one big task."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest frame that one task may hold (a sort of this many narrow rows is a
# few hundred MB at most). Everything above it takes the distributed route.
SINGLE_TASK_ROWS = 1_000_000
# Distinct texts, at most, that are parsed once each; their table is small enough to be broadcast.
PARSED_ONCE = 100_000

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scopes: list[str] = []


def build_session(app: str = "catalign", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each application.

    Functions that run there are looked up by module name, and only the driver has the
    folder the package was started from.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="catalign-")) / "catalign.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for stage tables.

    Taken from ``spark.checkpoint.dir`` (or a directory set on the context).
    Only a local-mode session without one gets a temporary folder; on a cluster
    that would not be visible to other machines, so it is an error there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    configured = configured or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="catalign-")
    return _local_dirs[sc.applicationId]


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives lost executors, computes ``df`` once however
    often it is used afterwards, and gives Catalyst the true file size, so that
    a later join broadcasts the table only if it really is under
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges it otherwise.
    """
    spark = df.sparkSession
    ship(spark)
    folder = "/".join([checkpoint_root(spark), spark.sparkContext.applicationId, *_scopes[-1:]])
    path = f"{folder}/{name}-{uuid.uuid4().hex[:16]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stages_of_job(spark: SparkSession):
    """Stage tables written inside are deleted at the end; nothing built on them may be used later."""
    _scopes.append(f"job-{uuid.uuid4().hex[:16]}")
    try:
        yield
    finally:
        drop_stages(spark, _scopes.pop())


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """What runs inside sends at most ``rows`` rows (fewer if the session says so) in an Arrow batch to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_stages(spark: SparkSession, scope: str = "") -> None:
    """Delete this application's stage tables (those of one job), once nothing built on them is needed."""
    folder = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{scope}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def lookup(rows: DataFrame, dim: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join rows with a smaller keyed table whose size is only known at run time.

    The table is staged first, so whether it is broadcast is decided on its
    written size. Past the threshold the join is a sort-merge join and adaptive
    execution splits hot keys on the row side.
    """
    keys = [on] if isinstance(on, str) else on
    exact = lambda name: F.col("`" + name.replace("`", "``") + "`")
    columns = rows.columns + [c for c in dim.columns if c not in keys]
    return rows.join(stage(dim, "lookup"), on, how).select(*[exact(c) for c in columns])


def with_parsed(df: DataFrame, columns: dict[str, str], parse: Callable[[Column], Column], most: int = PARSED_ONCE) -> DataFrame:
    """Add ``parse(column)`` for text columns, ``columns`` naming the new one of each.

    Texts that repeat are parsed once each and joined back. With more than ``most`` of them (estimated) that would
    sort the whole table for every column, so each row is parsed on its own.
    """
    if not columns:
        return df
    exact = lambda name: F.col("`" + name.replace("`", "``") + "`").cast("string")
    texts = df.select(F.explode(F.array(*[exact(c) for c in columns])).alias("_text")).filter("_text IS NOT NULL")
    if texts.agg(F.approx_count_distinct("_text")).first()[0] > most:
        return df.select("*", *[parse(exact(c)).alias(out) for c, out in columns.items()])
    known = stage(spread(texts.distinct()).withColumn("_parsed", parse(F.col("_text"))), "parsed")
    for column, out in columns.items():
        own = known.withColumnsRenamed({"_text": f"_text_{out}", "_parsed": out})
        df = df.join(own, exact(column) == F.col(f"_text_{out}"), "left").drop(f"_text_{out}")
    return df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Repartition before CPU-heavy work into a fixed number of tasks.

    Adaptive execution sizes partitions by bytes and would put small rows that
    are expensive to process into a few tasks; an explicit number stays.
    """
    spark = df.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *by)


def global_rank(
    df: DataFrame,
    order: list[Column],
    out: str,
    start: int = 0,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Consecutive numbers over a total order of the whole frame.

    A small frame is numbered by one window. One of more than ``single_task_rows`` is range-partitioned;
    each range is numbered on its own and shifted by the rows before it. However low that limit is, there are
    no more ranges than shuffle partitions, unless a range would outgrow ``SINGLE_TASK_ROWS``.
    ``order`` must be unique per row.
    """
    rows = stage(df, "rank")
    total = rows.count()
    if total <= single_task_rows:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint") + F.lit(start - 1))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SINGLE_TASK_ROWS) * 2)
    ranges = max(2, min(math.ceil(total / single_task_rows) * 2, tasks))
    split = stage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        split.groupBy("_range")
        .count()
        .select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        split.join(stage(shift, "shift"), "_range")
        .withColumn(out, inside + F.col("_shift") + F.lit(start - 1))
        .drop("_range", "_shift")
    )
