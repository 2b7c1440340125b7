"""Files of a collection as a Spark data source that commits in two steps.

    df.write.format("verbena_store").mode("append").save(place)        # sha256, name, content, about (JSON, may be null)
    spark.read.format("verbena_store").load(place)

Each task writes its files, their sidecars and a list of them into a folder of its own below the job's, which nobody reads yet. The commit writes one small
file that names the lists of the tasks that won; from then on all files of the job are there, before it none is. The driver makes the job's folder and an
abort takes it away; a task makes no folder above its own, so one that still runs then fails and leaves nothing. What a lost driver leaves is never named,
and sweep() removes it. Tasks that run twice have folders of their own. The driver gets
the path of one list from each task, and rows are read back a list to a partition, so nothing of the files goes through it.
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "verbena_store"


def _system(place: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(place if "://" in place or place.startswith("file:") else f"file://{place}")


def _put(system: fs.FileSystem, path: str, data: bytes, below: str | None = None) -> None:
    """below: a folder above the file that must be there; those between are made one by one, as making all at once would bring it back."""
    folder = posixpath.dirname(path)
    if below is None:
        system.create_dir(folder, recursive=True)
    else:
        at = below
        for part in posixpath.relpath(folder, below).split("/"):
            at = f"{at}/{part}"
            system.create_dir(at, recursive=False)
    with system.open_output_stream(path) as out:
        out.write(data)


def _get(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def _committed(system: fs.FileSystem, root: str) -> dict[str, list[str]]:
    """The lists of each committed job."""
    found = system.get_file_info(fs.FileSelector(f"{root}/jobs", allow_not_found=True))
    return {f.base_name.removesuffix(".json"): json.loads(_get(system, f.path)) for f in found if f.base_name.endswith(".json")}


@dataclass
class Written(WriterCommitMessage):
    listed: str | None


class StoreWriter(DataSourceWriter):
    def __init__(self, place: str):
        self.place, self.job = place, uuid.uuid4().hex
        system, root = _system(place)
        system.create_dir(f"{root}/files/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> Written:
        system, root = _system(self.place)
        job = f"{root}/files/{self.job}"
        own = f"files/{self.job}/{uuid.uuid4().hex}"
        listed = []
        for row in iterator:
            at = f"{own}/{row.sha256[:2]}/{row.sha256[:12]}-{row.name}"
            _put(system, f"{root}/{at}", bytes(row.content), below=job)
            if row.about is not None:
                _put(system, f"{root}/{at}.json", row.about.encode(), below=job)
            listed.append({"sha256": row.sha256, "name": row.name, "path": at, "size": len(row.content)})
        if not listed:
            return Written(None)
        _put(system, f"{root}/{own}/list.jsonl", "\n".join(map(json.dumps, listed)).encode(), below=job)
        return Written(f"{own}/list.jsonl")

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.place)
        lists = sorted(m.listed for m in messages if m is not None and m.listed)
        _put(system, f"{root}/aside/{self.job}", json.dumps(lists).encode())
        system.create_dir(f"{root}/jobs", recursive=True)
        system.move(f"{root}/aside/{self.job}", f"{root}/jobs/{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.place)
        own = f"{root}/files/{self.job}"
        if system.get_file_info(own).type == fs.FileType.NotFound:
            return
        gone = f"{own}-aborted"  # no task knows this name, so nothing comes in while it is removed
        try:
            system.move(own, gone)
        except OSError:  # a store of objects has no folders to move
            gone = own
        system.delete_dir(gone)


class StoreReader(DataSourceReader):
    def __init__(self, place: str):
        self.place = place

    def partitions(self) -> list[InputPartition]:
        system, root = _system(self.place)
        return [InputPartition(x) for lists in _committed(system, root).values() for x in lists] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        system, root = _system(self.place)
        for line in _get(system, f"{root}/{partition.value}").decode().splitlines():
            f = json.loads(line)
            yield f["sha256"], f["name"], f["path"], f["size"], _get(system, f"{root}/{f['path']}")


class Store(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "sha256 string, name string, path string, size bigint, content binary"

    def reader(self, schema) -> StoreReader:  # noqa: ANN001
        return StoreReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> StoreWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("a store only grows: mode append")
        return StoreWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session. Its classes go to workers whole, so that the driver's own worker, which has no files sent to executors, has them, too."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Store)


def sweep(place: str) -> int:
    """Remove the folders of jobs that were never committed; only while no job writes. How many there were."""
    system, root = _system(place)
    known = set(_committed(system, root))
    left = [f for f in system.get_file_info(fs.FileSelector(f"{root}/files", allow_not_found=True)) if f.base_name not in known]
    for f in left:
        system.delete_dir(f.path)
    return len(left)
