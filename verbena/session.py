"""Spark sessions for this engine, and shipping its code to executors."""

from __future__ import annotations

import io
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))

#: Settings that the engine counts on; a session that has its own keeps them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "verbena", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package as a zip, once for each Spark context, so that workers need no shared source folder."""
    sc = spark.sparkContext
    if getattr(sc, "_verbena_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(PACKAGE):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    place = os.path.join(tempfile.mkdtemp(), "verbena_package.zip")
    with open(place, "wb") as out:  # the driver's own folder: Spark serves the file to the executors
        out.write(buffer.getvalue())
    sc.addPyFile(place)
    sc._verbena_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of its own only where none is set and the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = getattr(spark.sparkContext, "_verbena_own_folder", None)
        if own is None:
            own = spark.sparkContext._verbena_own_folder = "file://" + tempfile.mkdtemp(prefix="verbena-")
        named = own
    return named.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again.

    A lost executor then costs a reread, not the plan above. release() removes the folder when its readers are done; what is
    still there when the driver's JVM ends goes then.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/verbena-{name}-{uuid.uuid4().hex}"
    df.write.parquet(place, compression=compression)
    path, files = _hadoop(spark, place)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(place)
    out._verbena_place = place
    for s in _open():
        s.frames.append(out)
    return out


def _hadoop(spark: SparkSession, place: str):  # noqa: ANN202
    """The place as a path, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


_threads = threading.local()


def _open() -> list[Scratch]:
    """The scratches that this thread is in."""
    if not hasattr(_threads, "scratches"):
        _threads.scratches = []
    return _threads.scratches


class Scratch:
    """Removes, at its end, what its thread has made by written() inside it, but for what keep() is given: no lazy result may still need the rest.

    What other threads write meanwhile is theirs.
    """

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __enter__(self) -> Scratch:
        _open().append(self)
        return self

    def __exit__(self, *error: object) -> None:
        _open().remove(self)
        release(*(f for f in self.frames if not any(f is k for k in self.kept)))


def release(*frames: DataFrame) -> None:
    """Remove the files behind frames from written(). Only call it when nothing that is still to run reads them."""
    for df in frames:
        place = getattr(df, "_verbena_place", None)
        if place:
            path, files = _hadoop(df.sparkSession, place)
            files.delete(path, True)
            files.cancelDeleteOnExit(path)
            df._verbena_place = None
