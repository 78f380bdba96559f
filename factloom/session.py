"""Session helpers: a tuned session for tools and tests, and tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import count

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Tables written between two collections of the driver's garbage.
TIDY_AFTER = 2

#: The JVM's own command that gives free native memory back.
TRIM = "systemTrimNativeHeap"

#: Percent of the heap that may be free after the driver was tidied; the JVM's own value, 70, keeps twice what is in use besides.
MOST_FREE = 40

_own_folders: dict[str, str] = {}
_scratch: list[str] = []
_written = count(1)


def build_session(master: str = "local[8]", app: str = "factloom", partitions: int = 8) -> SparkSession:
    """A session for tests and bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only in local mode, an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        folder = tempfile.mkdtemp(prefix="factloom-")
        _own_folders[app] = folder
        _scratch.append(folder)
        spark.sparkContext.setCheckpointDir(folder)
    return _own_folders[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it is removed when the process ends, as far as the session still runs then."""
    path = f"{shared_folder(spark)}/factloom-{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage with a table in the shared folder: it outlives executors."""
    spark = df.sparkSession
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def keep(df: DataFrame, path: str) -> DataFrame:
    """:func:`materialize` for one of many tables: the driver is tidied after every few."""
    kept = materialize(df, path)
    tidy_at_times(df.sparkSession)
    return kept


def tidy_at_times(spark: SparkSession) -> None:
    """To be called once for each table written: every few times the driver is tidied."""
    if next(_written) % TIDY_AFTER == 0:
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect its garbage and to give free memory back to the system.

    After many small jobs that is mostly plans; the heap shrinks again, and shuffle files and broadcasts of finished jobs are removed, for
    which Spark's own cleaner waits half an hour. What the compilers of the JVM have freed stays in the arenas of malloc, some hundred MB after
    a few hundred jobs, until it is trimmed.
    """
    collect(spark)
    trim(spark)


def collect(spark: SparkSession) -> None:
    """Collect the driver's garbage; for the time of this the heap may keep MOST_FREE percent free at most, where the JVM has such a setting."""
    before = _ask(spark, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio")
    usual = before and before.get("value")
    lower = usual and int(usual) > MOST_FREE
    if lower:
        _ask(spark, "HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", str(MOST_FREE))
    try:
        spark._jvm.System.gc()
    finally:
        if lower:
            _ask(spark, "HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", usual)


def trim(spark: SparkSession) -> str | None:
    """What the driver's JVM says of trimming its native heap; null where it can't, as without glibc or before Java 17."""
    return _ask(spark, "DiagnosticCommand", TRIM)


def _ask(spark: SparkSession, bean: str, operation: str, *texts: str):
    """The answer of one of the beans that the driver's JVM is managed with; null where it has no such bean, operation or setting."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # by reflection on the public interface: the beans' own classes are not open to py4j
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation
        if texts:
            given[2], given[3] = new_array(jvm.java.lang.Object, len(texts)), new_array(jvm.java.lang.String, len(texts))
            for k, text in enumerate(texts):
                given[2][k], given[3][k] = text, "java.lang.String"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return None


def spread_out(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly Python work, if the scan has fewer parts than there are cores; else as it is.

    Large tables have more parts than cores and are never shuffled by this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _clean() -> None:
    """Remove scratch tables through the file system that holds them; local ones also without a session."""
    spark = SparkSession.getActiveSession()
    for path in _scratch:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session is gone
            spark = None
            if "://" not in path or path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(_clean)
