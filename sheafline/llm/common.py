"""What several operators share: intermediate tables and word expressions."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_folder

#: One or more ASCII blanks: what separates words everywhere in this package.
BLANKS = r"[\x20\x09-\x0D]+"
#: Their characters.
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a local session may name none."""
    return shared_folder(spark)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is temporary anyway
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and any executor can read it.

    Unlike a cached or locally checkpointed frame it outlives every executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing reads any more, and lets the driver drop shuffles that nothing refers to."""
    for t in tables:
        delete(t.sparkSession, t._stored_at)
        _made.remove((t.sparkSession, t._stored_at))
    SparkSession.getActiveSession()._jvm.System.gc()


#: Bytes of a batch that goes to a Python worker: bounds the memory of texts however long they are.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from now on in this session, whatever rows they hold."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """array<string> of the words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has (long); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; a stored() table is counted by its files, of others no more than one row beyond is looked at."""
    return (df if hasattr(df, "_stored_at") else df.limit(rows + 1)).count() <= rows


@contextmanager
def session_value(row: DataFrame) -> Iterator[Column]:
    """The only value of row, as a session variable: plans take it as a constant and don't print it.

    Frames made inside keep the value after the variable is gone.
    """
    spark, name = row.sparkSession, f"sheafline_{uuid.uuid4().hex}"
    spark.sql(f"DECLARE VARIABLE {name} {row.schema[0].dataType.simpleString()}")
    row.createOrReplaceTempView(name)
    try:
        spark.sql(f"SET VAR {name} = (SELECT * FROM {name})")
        yield F.expr(name)
    finally:
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = 100_000) -> DataFrame:
    """A join that broadcasts right only if it is counted to have no more than `rows` narrow rows.

    Beyond that both sides are shuffled by key, and adaptive execution splits
    the partitions of a hot key.
    """
    return left.join(F.broadcast(right) if small(right, rows) else right, on, how)


def ranked(values: DataFrame, order: list[Column], out: str, partitions: int = 200) -> DataFrame:
    """values with `out`, each row's place (long from 0) in a total order, without sorting in one task.

    Ranges are dealt out and numbered apart; only a count for each range meets
    in one place.
    """
    from pyspark.sql import Window

    dealt = stored(values.repartitionByRange(partitions, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("__range").agg(F.count("*").alias("n"))  # `partitions` rows at most
        .select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    )
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "__range").withColumn(out, F.col("__before") + place - 1).drop("__range", "__before")
