"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of its own only in local mode where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = sc._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/strandloom-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: lineage ends here and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer needed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)


def trim_jvm(spark: SparkSession) -> bool:
    """Hand native memory that the driver's JVM has freed, most of it its compilers', back to the system; False where the JVM cannot (OpenJDK on Linux can from 17.0.9 on)."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind: object, *values: object) -> object:
        out = new(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    try:
        named = jvm.java.lang.Class.forName
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        # by the interface's method: the server's own class is not open to reflection
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(named, kinds)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String)))
    except Py4JError:
        return False
    return True


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, and the driver's JVM what it has freed."""
    for _ in range(2):  # Python's references go first, then the JVM's, then the cleaner works
        gc.collect()
        time.sleep(0.1)
        spark._jvm.System.gc()
        time.sleep(0.3)
    trim_jvm(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
