"""Changes of a source tree as a stream: created, written, renamed and removed files, by comparing listings.

A Python data source lists the tree at each batch and compares it with the listing before, which lies in a state folder under a
number; the number is the stream's offset. What a batch brought can be told again from the two listings, so a query that is started
again with its checkpoint goes on where it was, and finds what happened to the tree in the meantime. Of the tree a listing holds
paths, times and sizes, and nothing of what is in the files.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.merge import Versions
from ..plans import index
from ..sources.walk import SKIPPED

Listing = dict[str, list[int]]


def listing(root: str) -> Listing:
    """Time and size of every file below root, without the folders that are skipped; a tree that is not there is empty."""
    files, at = fs.FileSystem.from_uri(root)
    at = at.rstrip("/")
    found = files.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    rows = ((x.path[len(at) + 1 :], x) for x in found if x.type == fs.FileType.File)
    return {path: [x.mtime_ns or 0, x.size] for path, x in rows if not set(path.split("/")) & set(SKIPPED)}


def changes(before: Listing, now: Listing) -> list[tuple[str, str]]:
    """Path and kind of what differs, by path. A path that is gone was renamed if a single new one has its time and size."""
    new = defaultdict(list)
    for path in now.keys() - before.keys():
        new[tuple(now[path])].append(path)
    gone = before.keys() - now.keys()
    alike = defaultdict(int)
    for path in gone:
        alike[tuple(before[path])] += 1
    kinds = {path: "rename" if len(new[tuple(before[path])]) == 1 == alike[tuple(before[path])] else "remove" for path in gone}
    kinds |= {path: "create" for path in now.keys() - before.keys()}
    kinds |= {path: "write" for path in now.keys() & before.keys() if now[path] != before[path]}
    return sorted(kinds.items())


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.state, self.empty = options["root"], options["state"].rstrip("/"), options.get("from", "now") == "nothing"

    def _files(self, number: int) -> tuple[fs.FileSystem, str]:
        files, at = fs.FileSystem.from_uri(self.state)
        files.create_dir(at, recursive=True)
        return files, f"{at}/{number}.json"

    def _keep(self, number: int, now: Listing) -> dict:
        files, at = self._files(number)
        held = {"at": datetime.now(UTC).isoformat(), "files": now}
        with files.open_output_stream(f"{at}.new") as out:
            out.write(json.dumps(held).encode())
        files.move(f"{at}.new", at)
        return held

    def _held(self, number: int) -> dict:
        files, at = self._files(number)
        with files.open_input_stream(at) as given:
            return json.loads(given.read())

    def _events(self, number: int) -> Iterator[tuple]:
        """What the listing of that number brought."""
        held = self._held(number)
        at = datetime.fromisoformat(held["at"])
        return iter([(path, kind, at, number << 32 | k) for k, (path, kind) in enumerate(changes(self._held(number - 1)["files"], held["files"]))])

    def initialOffset(self) -> dict:
        self._keep(0, {} if self.empty else listing(self.root))
        return {"listing": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        number, now = start["listing"], listing(self.root)
        if not changes(self._held(number)["files"], now):
            return iter([]), start
        self._keep(number + 1, now)
        return self._events(number + 1), {"listing": number + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return (event for k in range(start["listing"], end["listing"]) for event in self._events(k + 1))

    def commit(self, end: dict) -> None:
        """Listings before the committed one are not asked for again."""
        number = end["listing"] - 1
        while number >= 0:
            files, at = self._files(number)
            if files.get_file_info(at).type != fs.FileType.File:
                return
            files.delete_file(at)
            number -= 1


class TreeChanges(DataSource):
    """Options: root, state (a folder of this stream's own), from (now, or nothing: the files that are there count as created)."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return "path string, kind string, ts timestamp, event_id long"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def tree_changes(spark: SparkSession, root: str, project: str, state: str, whole: bool = False) -> DataFrame:
    """A stream of the changes below root: project, path, kind, ts, event_id. whole: what is there at the start is created.

    Root and state are URIs; state belongs to this stream alone, as its checkpoint does.
    """
    spark.dataSource.register(TreeChanges)
    found = spark.readStream.format("tree_changes").option("root", root).option("state", state).option("from", "nothing" if whole else "now").load()
    return found.select(F.lit(project).alias("project"), "path", "kind", "ts", "event_id")


def follow(spark: SparkSession, root: str, project: str, store: Versions, state: str, checkpoint: str, every: str = "500 milliseconds"):
    """A running query that brings the store up to date with a tree: what changed within `every` is one run of the index over those paths.

    A batch that is told again after a restart finds hashes as they are and changes nothing.
    """

    def publish(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").distinct().collect()]  # of one interval
        if paths:
            index.index(spark, root, store, project, f"watch-{number}", only=sorted(paths))

    found = tree_changes(spark, root, project, state)
    return found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(publish).start()
