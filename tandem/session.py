"""Session helpers: a local session for tests/bench, and the shared landing folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Conf keys the operators rely on.
_REQUIRED_CONF = {
    # json.loads keeps the last of duplicate object keys; variant parsing must too.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tandem") -> SparkSession:
    """Session for tests and the bench. Clusters build their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # one session runs many distinct plans (tests, bench): keep their
        # generated classes instead of recompiling after 100 entries
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for k, v in _REQUIRED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_conf(spark: SparkSession) -> None:
    """Set the runtime SQL confs the reply parser depends on (idempotent)."""
    for k, v in _REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a micro-batch uploads what it changed, not a snapshot of all state
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def state_conf(spark: SparkSession) -> dict[str, str]:
    """Streaming state in RocksDB on the executors' disks, with changelog checkpoints.

    Sets what the session leaves open. A session that names another provider
    keeps it in local mode; on a cluster it is refused, because state that grows
    with the corpus does not fit the executors' heap. Returns the settings in force.
    """
    for k, v in _STATE.items():
        have = spark.conf.get(k, None)
        default = have is None or have.endswith("HDFSBackedStateStoreProvider") or (k.endswith("enabled") and have == "false")
        if default and not _named(spark, k):
            spark.conf.set(k, v)
        elif k.endswith("providerClass") and have != v and not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError(f"streaming dedup needs the RocksDB state store, {k} is {have}")
    return {k: spark.conf.get(k) for k in _STATE}


def _named(spark: SparkSession, key: str) -> bool:
    """Whether the cluster's own configuration names this setting."""
    return spark.sparkContext.getConf().contains(key)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session (tests, bench) with the
    setting unset gets a scratch folder of its own; a cluster must name a
    shared folder, because landed tables must survive executor loss.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. an object-store path)")
        root = tempfile.mkdtemp(prefix="tandem-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def landing_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for one landed table of this application."""
    return f"{_landing_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _landing_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/tandem/{spark.sparkContext.applicationId}"


def clear_landed(spark: SparkSession) -> None:
    """Delete all tables that this application landed. Frames that read them are lazy, so
    call this once their results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_landing_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder/file exists, through Hadoop's FileSystem (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))
