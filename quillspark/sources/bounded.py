"""Bounded discovery (A02): a walk in pages with a restartable cursor, a limit of entries a page and a deadline, as a stream source.

The cursor is the stack of open directories with how many of their names, in order, were looked at. A page reads names only; size and time of
a file are read for the page's files, by the tasks. Tasks and driver see the same folder.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, size_bytes long, modified_ns long, page int, issue string"
DEPTH, ENTRIES, FILES = 256, 1000, 256


@dataclass
class Files(InputPartition):
    """Files of a page, whose sizes a task reads, and issues that the walk met."""

    root: str
    page: int
    files: list[str]
    issues: list[tuple[str, str]]


def valid(root: str, stack: list) -> bool:
    """Whether a cursor stays below its root and within the depth limit; one that came from outside may not."""
    return len(stack) <= DEPTH and all(isinstance(p, str) and isinstance(n, int) and n >= 0 and not os.path.isabs(p) and ".." not in p.split("/") for p, n in stack)


def walk(root: str, stack: list, most: int, late: Callable[[], bool] = lambda: False, keep: Callable[[str], bool] = lambda name: True, skip: Callable[[str], bool] = lambda name: False) -> tuple[list[str], list[tuple[str, str]], list, int]:
    """(files, issues, next stack, entries seen) of one page: at most `most` entries are looked at, and after the first none past the deadline.

    Names are taken in order, so that a page that is read again is the same. Links are never followed. A directory that
    can't be read counts as an entry and is an issue, and the walk goes on without it.
    """
    if not valid(root, stack):
        raise ValueError("invalid discovery cursor")
    stack, files, issues, seen = [list(p) for p in stack], [], [], 0
    while stack and seen < most and not (seen and late()):
        folder, offset = stack[-1]
        try:
            if os.path.islink(os.path.join(root, folder)):
                raise OSError("directory is a link now")
            with os.scandir(os.path.join(root, folder)) as entries:
                names = sorted(entries, key=lambda e: e.name)
        except OSError as e:
            issues.append((folder, f"walk: {type(e).__name__}"))
            seen += 1
            stack.pop()
            continue
        if offset >= len(names):
            stack.pop()
            continue
        for entry in names[offset:]:
            if seen >= most or seen and late():
                break
            stack[-1][1] += 1
            seen += 1
            path = f"{folder}/{entry.name}".lstrip("/")
            if skip(entry.name.lower()):
                continue
            if entry.is_symlink():
                issues.append((path, "link_excluded"))
            elif entry.is_dir(follow_symlinks=False):
                if len(stack) >= DEPTH:
                    issues.append((path, "depth_limit"))
                else:
                    stack.append([path, 0])
                    break
            elif entry.is_file(follow_symlinks=False) and keep(entry.name.lower()):
                files.append(path)
    while stack and _done(root, stack[-1]):
        stack.pop()
    return files, issues, stack, seen


def _done(root: str, place: list) -> bool:
    try:
        return place[1] >= len(os.listdir(os.path.join(root, place[0])))
    except OSError:
        return False  # the next page tells of it


class Settings:
    """Options of the source: path, maxEntries, deadlineSeconds (of a page), extensions and ignore (names, comma-separated)."""

    def __init__(self, options: dict) -> None:
        self.root = os.path.realpath(options["path"])
        self.most, self.seconds = int(options.get("maxentries", ENTRIES)), float(options.get("deadlineseconds", "inf"))
        listed = lambda name: [x.strip().lower() for x in options.get(name, "").split(",") if x.strip()]
        self.extensions, self.ignored = listed("extensions"), listed("ignore")

    def page(self, stack: list, most: int | None = None) -> tuple[list[str], list[tuple[str, str]], list, int]:
        """A page from a cursor on; with a number of entries it is that of a page that was cut before, and no clock counts."""
        end = time.monotonic() + self.seconds
        late = lambda: most is None and time.monotonic() >= end
        keep = lambda name: not self.extensions or name.endswith(tuple(self.extensions))
        return walk(self.root, stack, self.most if most is None else most, late, keep, lambda name: any(fnmatch(name, p) for p in self.ignored))


def dealt(root: str, number: int, files: list[str], issues: list[tuple[str, str]]) -> list[Files]:
    return [Files(root, number, files[i : i + FILES], issues if i == 0 else []) for i in range(0, max(len(files), bool(issues)), FILES)]


def sized(part: Files) -> Iterator[pa.RecordBatch]:
    rows = []
    for name in part.files:
        try:
            s = os.stat(os.path.join(part.root, name), follow_symlinks=False)
            rows.append((name, s.st_size, s.st_mtime_ns, part.page, None))
        except OSError as e:
            rows.append((name, None, None, part.page, f"metadata: {type(e).__name__}"))
    rows += [(name, None, None, part.page, issue) for name, issue in part.issues]
    if rows:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "size_bytes", "modified_ns", "page", "issue"])


class PagedFiles(DataSourceStreamReader):
    """A page a batch. The offset holds the cursor and how many entries were seen, so a restart goes on from the last page.

    A page is planned from its offsets alone: as many entries from the cursor as it has. A page that its deadline cut short, or that
    more pages follow, says so in a row with the issue `incomplete`.
    """

    def __init__(self, settings: Settings) -> None:
        self.settings, self.now = settings, None

    def initialOffset(self) -> dict:
        return {"page": 0, "stack": [["", 0]], "seen": 0, "late": False}

    def latestOffset(self) -> dict:
        self.now = self.now or self.initialOffset()
        if self.now["stack"]:
            _, _, stack, seen = self.settings.page(self.now["stack"])
            self.now = {"page": self.now["page"] + 1, "stack": stack, "seen": self.now["seen"] + seen, "late": bool(stack) and seen < self.settings.most}
        return self.now

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.commit(end)
        files, issues, _, _ = self.settings.page(start["stack"], end["seen"] - start["seen"])
        if end["stack"]:
            issues.append(("", "incomplete: deadline" if end["late"] else "incomplete: more pages follow"))
        return dealt(self.settings.root, end["page"], files, issues)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return sized(partition)

    def commit(self, end: dict) -> None:
        if self.now is None or self.now["page"] < end["page"]:
            self.now = end


class WholeFiles(DataSourceReader):
    """All pages in one batch."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def partitions(self) -> Sequence[InputPartition]:
        out, stack, number, end = [], [["", 0]], 0, time.monotonic() + self.settings.seconds
        while stack:
            number += 1
            files, issues, stack, _ = self.settings.page(stack)
            late = bool(stack) and time.monotonic() >= end
            out += dealt(self.settings.root, number, files, [*issues, ("", "incomplete: deadline")] if late else issues)
            if late:
                break
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return sized(partition)


class BoundedFiles(DataSource):
    """spark.read.format("bounded_files") and spark.readStream.format("bounded_files")."""

    @classmethod
    def name(cls) -> str:
        return "bounded_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WholeFiles:
        return WholeFiles(Settings(self.options))

    def streamReader(self, schema) -> PagedFiles:
        return PagedFiles(Settings(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoundedFiles)
