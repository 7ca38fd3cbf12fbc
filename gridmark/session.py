"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "gridmark", master: str | None = None, shuffle_partitions: int | None = None,
                **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE with skew splitting)."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the folder on a cluster.  Only a local session that names
    none gets a folder of its own; elsewhere a machine-local folder would not survive the
    loss of an executor, so a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("iterative operators need spark.checkpoint.dir set to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is started inside; a started stream keeps them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Bytes in a join for a byte in a file: pixel tables take 2 down to 0.1 bytes a row in Parquet and 130 in a hashed relation.
EXPANSION = "1024"


#: Bytes in memory for a byte in a shuffle: a pixel row takes 15 to 30 bytes there, some hundreds in the sorts of a window.
SHUFFLE_EXPANSION = 16
#: Least partition that adaptive execution makes of small ones; some ten thousand pixel rows.
LEAST_PARTITION = 256 << 10


def expect_expansion(spark: SparkSession) -> None:
    """Have joins and tasks planned from sizes in memory, not from those of compressed files and shuffles.

    Otherwise a table of millions of pixels stays below the broadcast limit and is built whole on the
    driver, and adaptive execution puts pixels into as few tasks as there are cores, whose memory grows with
    the table.  Sides that turn out small are still broadcast, by adaptive execution, from their measured
    sizes.  A factor the session sets itself stays; its partition size is divided once.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1.0:
        spark.conf.set(key, EXPANSION)
    key, least = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if spark.conf.get("spark.gridmark.partitionSize", None) != str(size):
        size = max(size // SHUFFLE_EXPANSION, LEAST_PARTITION)
        spark.conf.set(key, str(size))
        spark.conf.set(least, str(LEAST_PARTITION))
        spark.conf.set("spark.gridmark.partitionSize", str(size))


#: Bytes of a batch that passes between Spark and a Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have rows of whole texts pass to Python workers in batches of a few MB, as each is there in several copies.

    The default counts 10 000 rows or 64 MB.  The setting stays with the session, since what a plan
    returns is written later; a smaller one of the session's own stays as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def store(df: DataFrame, purpose: str = "cut") -> DataFrame:
    """Write ``df`` once as Parquet beside the checkpoints and read it back.

    The returned frame has a short plan and real file sizes, so joins over it are planned from
    measured statistics, and it survives the loss of an executor.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """Truncate the plan of a loop; see :func:`store` and :func:`expect_expansion`."""
    expect_expansion(df.sparkSession)
    return store(df)


#: Folders written inside each open :func:`scratch`, innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end, also after a failure, every folder that :func:`shared_folder` named inside.

    The function it gives keeps the folders that a frame reads; they then belong to the scratch
    around it, if there is one.  Whatever leaves the block must be such a frame or read none.
    """
    made, kept = [], set()
    _open.append(made)

    def keep(df: DataFrame) -> DataFrame:
        files = df.inputFiles()
        kept.update(f for f in made if any(_plain(x).startswith(_plain(f) + "/") for x in files))
        return df

    try:
        yield keep
    finally:
        _open.remove(made)
        _delete(spark, [f for f in made if f not in kept])
        if _open:
            _open[-1].extend(f for f in made if f in kept)


def _plain(place: str) -> str:
    """A path without what different writers put before it."""
    return "/" + place.split(":", 1)[-1].lstrip("/")


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for name in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`store` returned and that nothing reads any more."""
    _delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder beside the checkpoints, visible to every executor."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(folder)
    return folder
