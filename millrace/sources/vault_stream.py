"""A vault as a streaming source: notes that are new or changed are rows, and so are those that are gone.

An offset names a listing: the notes with their sizes and times, kept as a file beside
the checkpoint. A batch is the difference of two listings, so a restart from a checkpoint
goes on where it stopped, and what was deleted while nothing ran is seen too.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.sources.files import SKIP_DIRS

#: Notes that one task reads.
NOTES = 200


class _Notes(InputPartition):
    def __init__(self, changed: list[tuple[str, int]], gone: list[str], at: int) -> None:
        self.changed, self.gone, self.at = changed, gone, at


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that pyarrow knows (local, HDFS, S3, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def listed(vault: str, skip: tuple[str, ...] = SKIP_DIRS) -> dict[str, list[int]]:
    """Notes of a vault by their path in it: size and time of change in nanoseconds. Skipped folders are matched in the vault, case folded."""
    system, root = _open(vault)
    out = {}
    for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        rel = x.path[len(root) :].lstrip("/") if x.path.startswith(root) else x.path
        if x.type == fs.FileType.File and rel.lower().endswith(".md") and not any(p.lower() in skip for p in rel.split("/")[:-1]):
            out[rel] = [x.size, x.mtime_ns or 0]
    return out


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.vault, self.kept = options["path"].rstrip("/"), options["listings"].rstrip("/")
        self.skip = tuple(json.loads(options["skip"])) if "skip" in options else SKIP_DIRS

    def initialOffset(self) -> dict:
        return {"listing": "", "number": 0}

    def _load(self, name: str) -> dict[str, list[int]]:
        if not name:
            return {}
        system, root = _open(self.kept)
        with system.open_input_stream(f"{root}/{name}.json") as f:
            return json.loads(f.read())

    def latestOffset(self) -> dict:
        data = json.dumps(listed(self.vault, self.skip), sort_keys=True).encode()
        name = hashlib.sha256(data).hexdigest()
        system, root = _open(self.kept)
        system.create_dir(root, recursive=True)
        if system.get_file_info(f"{root}/{name}.json").type == fs.FileType.NotFound:
            with system.open_output_stream(f"{root}/{name}.tmp") as f:
                f.write(data)
            system.move(f"{root}/{name}.tmp", f"{root}/{name}.json")  # whole or not there
        return {"listing": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        was, now = self._load(start["listing"]), self._load(end["listing"])
        changed = sorted((rel, found[1]) for rel, found in now.items() if was.get(rel) != found)
        gone = sorted(was.keys() - now.keys())
        at = max((t for _, t in now.values()), default=0)
        parts: list[InputPartition] = [_Notes(changed[i : i + NOTES], [], at) for i in range(0, len(changed), NOTES)]
        parts += [_Notes([], gone[i : i + NOTES], at) for i in range(0, len(gone), NOTES)]
        return parts or [_Notes([], [], at)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, root = _open(self.vault)
        for rel, at in partition.changed:
            try:
                with system.open_input_stream(f"{root}/{rel}") as f:
                    text = f.read().decode("utf-8", "replace")
            except FileNotFoundError:  # gone since it was listed: the next listing says so
                continue
            yield f"obsidian:{rel}", rel, text, at, False
        for rel in partition.gone:
            yield f"obsidian:{rel}", rel, None, partition.at, True

    def commit(self, end: dict) -> None:
        pass


class VaultSource(DataSource):
    """format("vault"); options: path (the vault), listings (a shared folder, kept with the checkpoint), skip (JSON list of folders)."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "source_id string, rel string, content string, at long, deleted boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def read_vault_stream(spark: SparkSession, vault: str, listings: str) -> DataFrame:
    """The notes of a vault as a stream (source_id, rel, content, at, deleted), for sync.stream_sync or stateful.change_events."""
    spark.dataSource.register(VaultSource)
    return spark.readStream.format("vault").option("path", vault).option("listings", listings).load()
