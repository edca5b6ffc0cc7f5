"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import atexit
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC timestamps (rendered review ids and month
# bounds must not depend on the host zone), AQE for runtime re-planning
# (broadcast of small derived tables, partition coalescing, skew splits) and
# no web UI.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "100",
}
def local_driver_memory(cap_gb: int = 12) -> str:
    """Heap for a local-mode driver: half of the machine's (or container's)
    memory, at least 2 GB and at most ``cap_gb``."""
    total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    try:
        with open("/sys/fs/cgroup/memory.max") as f:
            limit = f.read().strip()
        if limit.isdigit():
            total = min(total, int(limit))
    except OSError:
        pass
    gb = max(2, min(cap_gb, int(total / 2 / (1 << 30))))
    return f"{gb}g"


def get_spark(
    master: str | None = None,
    app_name: str = "modelgate",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the engine's required settings.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", local_driver_memory())
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in conf.items():
        if not key.startswith("spark.ui") and not key.startswith("spark.driver"):
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf of an already running session
                pass
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names in
    ``spark.checkpoint.dir``. It must be on storage that all executors share,
    so that what is written there survives the loss of any of them; the library
    never falls back to a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


_EXPIRING: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder under the checkpoint folder. Tables in it
    may feed DataFrames that are still in use, so they live as long as the
    application and are deleted when it ends."""
    folder = os.path.join(checkpoint_dir(spark), "modelgate", spark.sparkContext.applicationId)
    if folder not in _EXPIRING:
        _EXPIRING.add(folder)

        def expire() -> None:
            try:
                files, path = _file_system(spark, folder)
                files.delete(path, True)
            except Exception:  # noqa: BLE001 - the JVM may be gone; the folder's retention policy is next
                pass

        atexit.register(expire)
    return folder


def folder_state(spark: SparkSession, path: str) -> int:
    """A number that changes when files directly under ``path`` (or the
    folders there) are written: from the file system's listing, no data is read."""
    files, target = _file_system(spark, path)
    found = [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(target)]
    return hash(tuple(sorted(found)))


def cut_lineage(df: DataFrame, spark: SparkSession | None = None, name: str = "cut") -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the shared
    checkpoint folder and reading it back.

    One job computes the rows once (an eager ``Dataset.checkpoint`` would run
    the plan twice: once to count, once to write the checkpoint files). The
    table lives on shared storage, so a lost executor only costs a re-read;
    never a machine-local or in-memory-only checkpoint.
    """
    import uuid

    spark = spark or df.sparkSession
    path = os.path.join(scratch_folder(spark), name, uuid.uuid4().hex)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    table._modelgate_path = path
    return table


def drop_table(*tables: DataFrame) -> None:
    """Delete tables made by ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        files, path = _file_system(table.sparkSession, table._modelgate_path)
        files.delete(path, True)


def scale_conf(
    input_bytes: int,
    total_cores: int,
    target_partition_bytes: int = 256 << 20,
    max_shuffle_partitions: int = 32_768,
) -> dict[str, str]:
    """Partition settings for a run over ``input_bytes`` of parquet on
    ``total_cores`` executor cores.

    Scan splits are ``target_partition_bytes`` so a task's input fits in
    executor memory. Shuffle partitions assume the shuffled bytes are about a
    quarter of the scanned bytes (column pruning, map-side combining), i.e.
    one partition per ~1 GB of input, at least two waves of the cluster and
    at most ``max_shuffle_partitions`` (beyond that the map x reduce block
    count dominates; AQE splits skewed partitions instead). AQE coalesces the small shuffles of model-level steps
    and splits skewed join partitions above 4x the target.
    """
    wanted = -(-input_bytes // (4 * target_partition_bytes))
    partitions = min(max_shuffle_partitions, max(2 * total_cores, wanted))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths``, folders included, from the
    file system's own summary: no Spark job, nothing is read."""
    total = 0
    for path in paths:
        files, target = _file_system(spark, path)
        total += int(files.getContentSummary(target).getLength())
    return total


#: Input a shuffle partition of a registered query stands for, and the most that
#: runtime coalescing joins again. Compressed shuffle bytes become many times as
#: many once a task holds them as rows (sorts of typed rows: about 20 times).
PARTITION_INPUT_BYTES = 32 << 20
ADVISORY_BYTES = 16 << 20


def _bytes_of(text: str) -> int:
    """A size as Spark writes it (``64MB``, ``128m``, ``1024``) in bytes."""
    digits = text.strip().lower().rstrip("bkmgt")
    unit = text.strip().lower()[len(digits) :].rstrip("b")
    return int(digits) * 1024 ** " kmgt".index(unit or " ")


def size_shuffle_partitions(spark: SparkSession, paths: list[str]) -> int:
    """Raise ``spark.sql.shuffle.partitions`` to one per ``PARTITION_INPUT_BYTES``
    of the input under ``paths`` (two waves of the cluster at least, up to
    ``scale_conf``'s largest number), so that what a task holds does not grow
    with the input; a larger value set by the cluster is kept. Runtime
    coalescing is held to ``ADVISORY_BYTES``. Returns the setting in effect."""
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext on a remote session
        cores = int(spark.conf.get("spark.default.parallelism", "8"))
    wanted = int(scale_conf(input_bytes(spark, paths), cores, PARTITION_INPUT_BYTES // 4)["spark.sql.shuffle.partitions"])
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > current:
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if _bytes_of(spark.conf.get(advisory)) > ADVISORY_BYTES:
        spark.conf.set(advisory, str(ADVISORY_BYTES))
    return max(wanted, current)


@contextmanager
def finer_shuffles(spark: SparkSession, times: int, most: int = 32_768) -> Iterator[None]:
    """What is run inside deals its shuffles to ``times`` as many partitions (``most``,
    if the session has fewer), and joins again as much less at runtime: for steps whose
    tasks hold many wide rows."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(n) for n in names]
    partitions = int(before[0])
    spark.conf.set(names[0], str(max(partitions, min(most, partitions * times))))
    spark.conf.set(names[1], str(max(1 << 20, _bytes_of(before[1]) // times)))
    try:
        yield
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
