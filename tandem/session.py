"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_JOB: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def build_session(app: str = "tandem", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local master may
    run without it; there a folder in the warehouse is used and remembered.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged-{uuid.uuid4().hex}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches; none there is no fault."""
    place, store = _place(spark, path)
    store.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store that Spark reaches."""
    place, store = _place(spark, path)
    return [found.getPath().getName() for found in store.listStatus(place)] if store.exists(place) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: under another name first, then renamed."""
    place, store = _place(spark, path)
    draft, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(draft, place):
        raise OSError(f"{path} was not written")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file that ``write_text`` wrote."""
    place, store = _place(spark, path)
    source = store.open(place)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


@contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, every table staged inside; write or collect what is wanted before."""
    paths: list[str] = []
    token = _JOB.set(paths)
    try:
        yield
    finally:
        _JOB.reset(token)
        for path in paths:
            remove(spark, path)
            if (name := path.rpartition("/")[2]).startswith("token_blocks_"):
                spark.sql(f"DROP TABLE IF EXISTS {name.rpartition('-')[0]}")


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no one else uses; it goes with the job it is made in."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if (paths := _JOB.get()) is not None:
        paths.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result no longer depends on recomputing ``df``: lost executors re-read
    files, and calls to outside functions are not repeated.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
