"""A directory tree as a table: a Python data source that walks without following links."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path binary, parent_path binary, file_kind tinyint, mode int, uid bigint, gid bigint, mtime_sec bigint, mtime_nsec int, size bigint, rdev bigint, inode bigint, device bigint, link_target binary"


class Branch(InputPartition):
    def __init__(self, path: bytes, deep: bool):
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    """One partition per directory below the root, and one for the root itself.

    The root is the empty path. Excluded paths (absolute, exact) are left out with what they hold; with ``one_device`` a
    directory on another device is told, its contents are not. Names are in byte order."""

    def __init__(self, root: str, excludes: list[str], one_device: bool):
        self.root, self.one_device = os.fsencode(os.path.abspath(root)), one_device
        self.excludes = {os.fsencode(os.path.normpath(x)) for x in excludes if x}

    def partitions(self) -> list[Branch]:
        device = os.lstat(self.root).st_dev
        kids = [e.path for e in self._entries(self.root) if e.is_dir(follow_symlinks=False) and not self._stops(e.path, device)]
        return [Branch(self.root, False), *(Branch(p, True) for p in kids)]

    def _entries(self, path: bytes) -> list[os.DirEntry]:
        with os.scandir(path) as it:
            return sorted((e for e in it if e.path not in self.excludes), key=lambda e: e.name)

    def _stops(self, path: bytes, device: int) -> bool:
        return self.one_device and os.lstat(path).st_dev != device

    def _row(self, path: bytes) -> tuple:
        s = os.lstat(path)
        kind = 1 if stat.S_ISREG(s.st_mode) else 2 if stat.S_ISDIR(s.st_mode) else 3 if stat.S_ISLNK(s.st_mode) else 5
        rel = path[len(self.root) :].lstrip(b"/")
        sec, nsec = divmod(s.st_mtime_ns, 10**9)
        return (rel, rel.rpartition(b"/")[0], kind, s.st_mode, s.st_uid, s.st_gid, sec, nsec, s.st_size if kind == 1 else 0, s.st_rdev, s.st_ino, s.st_dev, os.readlink(path) if kind == 3 else b"")

    def read(self, partition: Branch) -> Iterator[tuple]:
        device = os.lstat(self.root).st_dev
        if not partition.deep:
            yield self._row(self.root)
            yield from (self._row(e.path) for e in self._entries(self.root))
            return
        waiting = [partition.path]
        while waiting:
            inner = []
            for e in self._entries(waiting.pop()):
                yield self._row(e.path)
                if e.is_dir(follow_symlinks=False) and not self._stops(e.path, device):
                    inner.append(e.path)
            waiting += reversed(inner)


class FileTree(DataSource):
    """``spark.dataSource.register(FileTree)``, then ``spark.read.format("filetree").option("excludes", "/a:/b").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        return TreeReader(o["path"], o.get("excludes", "").split(":"), o.get("one_device", "true") == "true")
