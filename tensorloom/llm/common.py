"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: ASCII white space, as a Java / Python character class body.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table under ``sf_dir`` (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``columns`` (new name = old name) by exact, case-sensitive position.

    Other columns are left behind, so their names can clash neither with each
    other nor with what an operator adds.
    """
    plain = df.toDF(*[f"c{i}_" for i in range(len(df.columns))])
    names = df.columns
    return plain.select(*[F.col(f"c{names.index(old)}_").alias(new) for new, old in columns.items()])


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer merges.

    A lambda that mentions an outer column may see that column's whole expression
    moved inside it, to run again for each element; a bound variable cannot be.
    """
    return F.transform(F.array(value), body)[0]


def trimmed(run):
    """``run`` over Arrow batches, after which a worker gives its free memory back.

    Workers are used again from stage to stage, and what a stage's batches have freed
    would stay with them beside the next stage's models.
    """

    def then_trim(batches):
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc offers it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return then_trim


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where none is set, a temporary folder serves a local master, whose threads all see
    it; on a cluster, whose machines would not, that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="tensorloom-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a number for each row that is the same however often rows are read.

    A plain scan of files is dealt into tasks the same way each time, so its rows can
    be numbered as they are read. Anything else, whose rows may come in another order
    when they are computed again, is written to a table first.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scan = all(line.lstrip(" :+-").startswith(("Project", "Filter", "Relation")) for line in plan if line.strip())
    rows = df.withColumn(name, F.monotonically_increasing_id())
    return rows if scan and df.inputFiles() else table(rows, "numbered")


#: Bytes of a table that may be broadcast; more is joined by a shuffle.
FEW = 32 << 20


def few(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its values are measured small enough."""
    fixed = [f.name for f in df.schema if not isinstance(f.dataType, StringType | BinaryType)]
    varying = [F.octet_length(c) for c in df.columns if c not in fixed]
    width = F.lit(8 * max(1, len(fixed))).cast("long")
    for size in varying:
        width = width + F.coalesce(size, F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= FEW else df


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again.

    Column pruning works on the copy, which a checkpoint does not offer. The
    folder lives as long as the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tensorloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(where)


def in_order(df: DataFrame, *keys: Column, name: str = "pos") -> DataFrame:
    """``df``, stored, with each row's place (from 0) in the order of ``keys``.

    Rows are dealt out by ranges and sorted there, so no task holds more than its share;
    what is broadcast is one number a task. ``df`` is worked out twice, to sample ranges
    and to deal it out.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id())
    rows, part = table(dealt, "in-order"), F.shiftright("at_", 33)
    sizes = rows.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part_", F.coalesce(before, F.lit(0)).alias("before_"))
    place = (F.col("at_").bitwiseAND((1 << 33) - 1) + F.col("before_")).alias(name)
    return rows.join(F.broadcast(starts), part == F.col("part_")).select(*df.columns, place)


def blocks_of(batches, keys: int):
    """Successive rows with equal values in the first ``keys`` columns, as one Arrow table each."""
    import pyarrow as pa

    now, held = None, []
    for b in batches:
        start, marks = 0, list(zip(*[b.column(k).to_pylist() for k in range(keys)], strict=True))
        for k, mark in enumerate(marks):
            if mark != now:
                if k > start:
                    held.append(b.slice(start, k - start))
                if held:
                    yield now, pa.Table.from_batches(held).combine_chunks()
                now, held, start = mark, [], k
        if len(marks) > start:
            held.append(b.slice(start))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()
