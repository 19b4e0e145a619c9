"""Session defaults, size-checked broadcasts, stored tables, and the package on the workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted below this many rows; override
#: with ``spark.assayer.broadcast.maxRows``.
DEFAULT_BROADCAST_ROWS = 200_000
#: Nor above this many bytes; override with ``spark.assayer.broadcast.maxBytes``.
DEFAULT_BROADCAST_BYTES = 64 << 20

#: Tasks for every core or split of a table that is dealt evenly.
SPREAD = 4
#: Rows of such a table that one task gets, at most, about.
TASK_ROWS = 100_000


def build_session(app_name: str = "assayer", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written against.

    On a cluster the submitting job supplies its own session; nothing below is
    required for correctness except UTC, which the queries assume.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def broadcast_row_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.assayer.broadcast.maxRows", str(DEFAULT_BROADCAST_ROWS)))


def broadcast_byte_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.assayer.broadcast.maxBytes", str(DEFAULT_BROADCAST_BYTES)))


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts by length, nested columns by that of their JSON."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind in ("array", "map", "struct"):
            size = F.octet_length(F.to_json(F.struct(column)))
        elif kind in ("string", "binary"):
            size = F.octet_length(column)
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(1)).cast("bigint")
    return total


def fits_broadcast(df: DataFrame) -> bool:
    """Read just far enough to know whether ``df`` is under the limits of rows and bytes."""
    limit = broadcast_row_limit(df.sparkSession)
    read = df.limit(limit + 1)
    rows, size = read.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return rows <= limit and (size or 0) <= broadcast_byte_limit(df.sparkSession)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors see.

    Only a single-process session, as in tests, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='assayer-shared-')}"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder and the application's own."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back.

    What is read more than once is so computed once, without a cache that someone
    must release; a lost executor costs the rerun of its tasks alone.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(
    big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner", salt: int = 16
) -> DataFrame:
    """Equi-join a large side to a side that is usually small.

    Under the row limit the small side is broadcast and the large side is not
    shuffled. Over it, the join shuffles on the keys plus a salt, so that a key
    holding a third of the large side is spread over ``salt`` tasks; the small
    side is replicated once per salt.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(small):
        return big.join(F.broadcast(small), keys, how)
    salted_big = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salt)))
    # Row hashes, unlike rand(), give a retried task the same salts.
    salted_small = small.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint")))
    )
    return salted_big.join(salted_small, [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a table evenly over ``SPREAD`` tasks for every core or split.

    The number of splits tells nothing: a split holds the row groups that begin in it, so
    a table with few row groups fills few of its splits, however large it is. Rows go by
    the hash of ``keys``: more than one where the first may repeat or be null, and only
    columns that the queries need, as all of them are read. The rows are counted, so that
    a task, and what it holds in memory, does not grow with the table.
    """
    splits = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(max(SPREAD * splits, -(-df.count() // TASK_ROWS)), *keys)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import what the driver's functions refer to. On a cluster they have
    neither the driver's working folder nor its ``sys.path``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="assayer-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
