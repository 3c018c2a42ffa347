"""Shared building blocks for jobs that must hold at any data size."""

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A local run may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="letterlens-")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/letterlens/{label}-{uuid.uuid4().hex}"


_stored: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, safe against
    the loss of executors. The options are those of the Parquet writer."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _stored[stored] = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, for jobs that no longer need them: all that was made of them must be stored itself.
    Otherwise they lie in the shared folder until it is cleared."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a small input that has fewer splits than there are cores. Large inputs
    have more splits than cores and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Spark deals out small files 32 to a task, however small they are.
SPLITS_PER_TASK = 32


def gather(files: DataFrame) -> DataFrame:
    """Read many small files in fewer tasks, without a shuffle: what a task costs, and what it tells the driver, does not
    depend on what it reads. There remain enough tasks for all cores, and no task reads more than SPLITS_PER_TASK splits if
    there are more of them than that."""
    splits, least = files.rdd.getNumPartitions(), 8 * files.sparkSession.sparkContext.defaultParallelism
    fewer = files.coalesce(max(least, -(-splits // SPLITS_PER_TASK)))
    # Always true. Without it, a shuffle that follows would take the place of the coalesce in the plan.
    return fewer.filter(F.spark_partition_id() >= 0)


SHUFFLED_PER_TASK = 16


def few(df: DataFrame) -> DataFrame:
    """A narrow table, to be stored, in a sixteenth of the shuffle partitions (two tasks a core at least). On a local file
    system each file costs the executor three short-lived processes, which count its memory twice while they start. Not
    for what comes out of a wide shuffle: its tasks would read sixteen partitions each."""
    return df.coalesce(_few_partitions(df.sparkSession))


def few_dealt(df: DataFrame) -> DataFrame:
    """As few, for what comes out of a wide shuffle: the tasks of that stay as they are, and the rows are dealt out once more, in
    the order of their hashes. Where Spark merges small shuffle partitions itself, the files are few already: nothing changes."""
    spark = df.sparkSession
    merges = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    few_partitions = _few_partitions(spark)
    if all(spark.conf.get(name) == "true" for name in merges) or int(spark.conf.get("spark.sql.shuffle.partitions")) <= few_partitions:
        return df
    return df.repartition(few_partitions)


def _few_partitions(spark: SparkSession) -> int:
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, -(-partitions // SHUFFLED_PER_TASK))


BROADCAST_ROWS = 1_000_000


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a large frame with a stored table of narrow rows. The table is counted: up to BROADCAST_ROWS rows every task
    gets a copy, so that the large frame stays where it is and in its order; beyond that Spark shuffles both."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def ordered_rank(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """(groups, order, name) with the 1-based place of each row within its group.

    groups + order must be unique and not null. Rows are cut into slices by range over all keys,
    so a group of any size spreads over many tasks: each row is numbered within its slice, and the
    rows in earlier slices of the same group are added. The slices are written once because both
    uses of them must see the same cut.
    """
    keys = [*groups, *order]
    sliced = materialize(
        df.select(*keys).repartitionByRange(*keys).withColumn("slice", F.spark_partition_id()), "slices"
    )
    in_slice = Window.partitionBy(*groups, "slice").orderBy(*order)
    earlier = Window.partitionBy(*groups).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*groups, "slice")
        .agg(F.count("*").alias("rows"))
        .select(*groups, "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    )
    return (
        sliced.withColumn("nth", F.row_number().over(in_slice))
        .join(offsets, [*groups, "slice"])
        .select(*keys, (F.col("before") + F.col("nth")).alias(name))
    )
