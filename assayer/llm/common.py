"""What the operators share: stored intermediates, shared folders, safe columns.

Intermediates are written once as Parquet under the folder that the cluster
names in ``spark.checkpoint.dir``. A lost executor then costs one task's rerun
and never a changed result: whatever is read twice was written once.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` wins, then the context's own checkpoint folder. Only
    a single-process session, as in tests, gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (known := context.getCheckpointDir()):
        folder = known
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='assayer-shared-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of one step, below the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns' names cannot clash."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def text_digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, null counting as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def without(docs: DataFrame, dropped: DataFrame, on: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose keys are not in ``dropped``; all columns stay as they are.

    ``on`` maps columns of ``dropped`` to expressions over ``docs``. Null keys
    are equal to one another.
    """
    names = {name: f"__drop_{uuid.uuid4().hex[:8]}_{name}" for name in on}
    gone = dropped.select(*[F.col(name).alias(new) for name, new in names.items()])
    condition = None
    for name, key in on.items():
        equal = key.eqNullSafe(gone[names[name]])
        condition = equal if condition is None else condition & equal
    return docs.join(gone, condition, "left_anti")


def open_folder(uri: str):
    """A pyarrow file system and the path in it, for use inside tasks."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
