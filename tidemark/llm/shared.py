"""What the operators of this package have in common."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The six ASCII white-space characters, as a regular-expression class body.
BLANK = r"\x20\x09-\x0D"

#: Rows are handed on once their texts hold this many characters, so that a batch of very long
#: documents never stands in a worker's memory whole.
FLUSH_CHARS = 4_000_000
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


#: In a Python worker: what empties the memories that outlive a task, and whose they are.
MEMORIES: list[Callable[[], None]] = []
OWNER: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.  Only
    with a local master, where there are no other machines, a temporary one will do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a folder that they share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, place: str) -> None:
    """Delete a folder, in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def first_by_hash(ids: DataFrame, group: str, most: int) -> DataFrame:
    """The first ``most`` different rows of each group by a hash of doc_id.

    A group's size says below which hash four times as many lie (fewer rows than ``most`` are
    missed by chance only in groups that have hardly more ids); only those are told apart and
    sorted, so that no task gets a group, however large it is.  Groups are classes or languages:
    one row each, of which a model holds more itself.
    """
    span = 1 << 62
    order = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    sizes = ids.groupBy(group).agg(F.count("*").alias("_n"))
    near = ids.join(F.broadcast(sizes), group).filter((F.col("_n") <= 4 * most) | (order < F.lit(4.0 * most * span) / F.col("_n"))).drop("_n").distinct()
    return near.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(order, "doc_id"))).filter(F.col("_at") <= most).drop("_at")


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``_doc``, so that columns put beside it can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str | StructType) -> DataFrame:
    """Run a Python generator over the rows of each partition, in Arrow batches both ways.

    ``rows`` gets an iterator over the partition's rows as tuples and yields tuples in the
    order of ``schema``.  Output is flushed by the size of its strings, not by row count alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    smaller_batches(df.sparkSession)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    owner = rows.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(owner)

        def each() -> Iterator[tuple]:
            for batch in batches:
                step = 256
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held: list[tuple] = []
        size = 0
        for row in rows(each()):
            held.append(row)
            size += 64 + sum(len(x) for x in row if isinstance(x, str | bytes | list))
            if size >= FLUSH_CHARS or len(held) >= 10_000:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)
        held.clear()
        release()

    return df.mapInArrow(run, kind)


def smaller_batches(spark: SparkSession) -> None:
    """Where the session has Spark's default, take ``BATCH_ROWS`` rows to an Arrow batch: a batch
    of texts stands in memory twice, in the JVM and in the Python worker."""
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def take_over(owner: str) -> None:
    """Called in a worker as a task begins: what another operator remembered there is dropped."""
    if OWNER != [owner]:
        for clear in MEMORIES:
            clear()
        OWNER[:] = [owner]
        release()


def release() -> None:
    """Give memory that a finished task no longer uses back to the system; Spark keeps its Python
    workers for further tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def attach(left: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left", shares: int = 256) -> DataFrame:
    """Join group facts to their members however uneven the groups are.

    Groups that hold more than one part in ``shares`` of all members number fewer than
    ``shares``, so they are broadcast; the others go through a shuffle on the key, in which no
    task can get more than its small groups.  ``groups`` has one row per key with its ``size``.
    Both inputs are read more than once: cut their lineage first where that is dear.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) * shares > total)
    keys = F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot")))
    marked = left.join(keys, key, "left")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot").join(groups.filter(F.col(size) * shares <= total), key, how)
    return cold.unionByName(marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key, how))
