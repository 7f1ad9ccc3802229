"""Sessions, shipping this package to Python workers, and shared scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings the plans are written for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palisade")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a source that has fewer splits than there are cores, dealt out to all of them, as a small file is one split and detection is work; other rows stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.isStreaming or rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


#: Rows that Spark hands to a Python worker at once: whole texts, so Spark's own 10,000 can be very large.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each Spark application, and bound their batches unless the user did."""
    import palisade

    context = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    if getattr(context, "_palisade_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="palisade-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    top = os.path.dirname(os.path.abspath(palisade.__file__))
    path = os.path.join(folder, "palisade_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, folders, names in os.walk(top):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for name in names:
                if name.endswith((".py", ".txt")):
                    full = os.path.join(base, name)
                    z.write(full, os.path.join("palisade", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._palisade_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share: spark.checkpoint.dir, or where that is unset on a single machine (tests) a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        found = getattr(spark.sparkContext, "_palisade_scratch", None)
        if not found:
            found = tempfile.mkdtemp(prefix="palisade-scratch-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            spark.sparkContext._palisade_scratch = found
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/palisade-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write rows to the shared folder and read them back: lineage ends, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    rows._palisade_path = path
    return rows


def discard(rows: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and no later step reads."""
    spark = rows.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(rows._palisade_path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now, which it does when the driver collects garbage, and give the system the memory that the driver has freed."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Have the driver's JVM hand freed memory outside its heap back to the system.

    The allocator keeps it otherwise, in every thread's arena: after some hundred plans more than
    150 MB that nobody uses.  Only JVMs on Linux offer this; others go on as they are.
    """
    context = spark.sparkContext
    lang = context._jvm.java.lang
    kinds, given = context._gateway.new_array(lang.Class, 4), context._gateway.new_array(lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = lang.Class.forName(kind)
    given[0], given[1] = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by the interface, as the bean server's own class is closed to callers
        lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JJavaError:
        pass
