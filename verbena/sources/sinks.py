"""Where results go: tables by language and category, sidecars, logs, and a write-once store of contents by hash."""

from __future__ import annotations

import hashlib
import os
import re
import stat
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders of the store.
CATEGORIES = ("text", "documents", "audio", "video", "images", "archives", "metadata", "other")


def write_resources(resources: DataFrame, place: str) -> None:
    """Contents and facts of resources as Parquet by language and category; Spark's commit makes a task's files appear at once or not at all."""
    resources.write.mode("append").partitionBy("language_id", "category").parquet(place)


def append_log(rows: DataFrame, place: str) -> None:
    """Rows as JSON lines, added to what is there."""
    rows.write.mode("append").json(place)


def write_json_texts(rows: DataFrame, place: str, column: str = "json") -> None:
    """A JSON text a line: sidecars, exports of profiles, manifests of lookups."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(place)


def lookup_manifest(results: DataFrame) -> DataFrame:
    """session_id, json: the links to look up by hand of each session."""
    item = F.struct("provider", "title", "url", "query")
    return results.where("kind = 'lookup'").groupBy("session_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("json"))


def metadata_records(results: DataFrame) -> DataFrame:
    """name, json: made-up files for catalogue results that have none."""
    name = F.concat(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit(".metadata.json"))
    return results.where("n_files = 0").select(name.alias("name"), F.to_json(F.struct(F.lit(True).alias("synthetic"), "provider", "title", "url")).alias("json"))


class Layout:
    """Where everything of a collection lies below its root, on a user's own disk."""

    SHARED = ("config", "catalogues", "search-engines", "database", "languages", "cache", "temp", "logs")
    OF_A_LANGUAGE = ("extracted", "metadata", "manifests")

    def __init__(self, root: str):
        self.root = root

    def shared(self, name: str) -> str:
        if name not in self.SHARED:
            raise ValueError(f"unknown folder {name}")
        return os.path.join(self.root, name)

    def of(self, language_id: str, name: str = "", category: str = "") -> str:
        """A language's folder, one of its own folders, or that of a category of its resources."""
        if category and category not in CATEGORIES:
            raise ValueError(f"unknown category {category}")
        below = os.path.join("resources", category) if category else name
        return os.path.join(self.shared("languages"), language_id, below).rstrip("/")

    def ensure(self, language_id: str | None = None) -> None:
        """Make the folders that are not there yet."""
        wanted = [self.shared(n) for n in self.SHARED]
        if language_id:
            wanted += [self.of(language_id, n) for n in self.OF_A_LANGUAGE] + [self.of(language_id, category=c) for c in CATEGORIES]
        for folder in wanted:
            os.makedirs(folder, exist_ok=True)


class ContentStore:
    """Files of a user's own disk, kept once under their hash. For single machines; tables on a cluster go through write_resources()."""

    def __init__(self, root: str):
        self.root = root

    def store(self, source: str, folder: str, mode: str = "copy") -> tuple[str, str, int]:
        """path, sha256, size. copy and move write beside the target, then rename, read-only; reference keeps the file where it is."""
        if mode not in ("copy", "move", "reference"):
            raise ValueError(f"unknown mode {mode}")
        digest, size = hashlib.sha256(), 0
        if mode == "reference":
            with open(source, "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
                    size += len(block)
            return source, digest.hexdigest(), size
        target = os.path.join(self.root, folder)
        os.makedirs(target, exist_ok=True)
        with open(source, "rb") as f, tempfile.NamedTemporaryFile(dir=target, delete=False) as out:
            while block := f.read(1 << 20):
                digest.update(block)
                size += len(block)
                out.write(block)
            out.flush()
            os.fsync(out.fileno())
        sha = digest.hexdigest()
        name = re.sub(r"[^\w.\- ]+", "_", os.path.basename(source)).strip("._ ").replace(" ", "_") or "file"
        path = os.path.join(target, f"{sha[:12]}-{name}"[:160])
        os.replace(out.name, path)
        os.chmod(path, stat.S_IRUSR | stat.S_IRGRP | stat.S_IROTH)
        if mode == "move":
            os.remove(source)
        return path, sha, size

    @staticmethod
    def verify(path: str, sha: str) -> bool:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest() == sha


def verified(resources: DataFrame) -> DataFrame:
    """resources (sha256, content) with intact: whether the bytes still are what the hash says."""
    return resources.withColumn("intact", F.sha2("content", 256) == F.col("sha256"))
