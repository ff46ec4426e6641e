"""What several operators need: tables, the shared folder, bounded label samples, crc32 folds."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of all contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where it is unset, a session on one machine (tests) gets a folder of its own there;
    a cluster has no folder that all its machines share but the one it names, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="brookql-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/brookql/{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of :func:`materialise`-d frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        root = f"{shared_dir(spark).rstrip('/')}/brookql/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if root.split("://")[-1].removeprefix("file:") in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give this process's freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim is not None:
        malloc_trim(0)


def trim_driver(spark: SparkSession) -> bool:
    """:func:`trim` for the driver and its JVM, whose compiler threads keep what they free; False where the JVM can't."""
    trim()
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    names, none = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"], [new_array(jvm.Object, 0), new_array(jvm.String, 0)]
    types, values = new_array(jvm.Class, 4), new_array(jvm.Object, 4)
    for k, x in enumerate([jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", *none]):
        types[k], values[k] = jvm.Class.forName(names[k]), x
    try:  # by the interface: the server's own class is closed to reflection
        invoke = jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:  # another JVM, or one before 17.0.9
        return False
    return True


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving freed memory back to the machine when a task ends: Python workers outlive their tasks."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def crc_mod(col: str, m: int):
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def label_sample(labels: DataFrame, label: str, bound: int, m: int, held_out: int) -> DataFrame:
    """At most ``bound`` (doc_id, y) rows with a 0/1 label outside the held-out fold, the smallest by a hash of the id.

    The bound makes the result fit for a broadcast: ``bound`` rows of two numbers.  An id with contradicting labels counts as 1.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod("doc_id", m) != held_out))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, text): one row for each of the ``chosen`` ids, however often it comes; of several texts that with the smallest hash."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "y", "t.text")
