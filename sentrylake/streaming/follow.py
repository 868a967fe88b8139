"""Following text files that grow, rotate and are truncated, as a stream of lines.

Spark's file streams take a file once; a log goes on.  Here an offset says, for
each file, up to which byte it has been taken.  A file is known by its inode and
its first line, not by its name: one that is renamed goes on where it was, one
that is truncated and written anew starts from its beginning.  Only whole lines
are taken, so an offset always lies behind a line end.  What is new in a batch is
cut into ranges that executors read; the driver only lists files and looks for
their last line end.

The files must be in a folder that the driver and all executors mount at one
path (local files, NFS); stores whose objects cannot grow need no following, and
``read_lines`` takes them.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "line string, file string, start long"
#: Bytes that a task reads at most, but for the rest of its last line.
RANGE_BYTES = 32 << 20
#: Bytes of the first line by which a file is known, and bytes that are read at once.
HEAD, STEP = 4_096, 1 << 16


def local_path(path: str) -> str:
    """The mounted path of ``path``; other schemes than file: are refused."""
    scheme, found, rest = path.partition(":")
    if found and scheme == "file":
        return "/" + rest.lstrip("/")
    if found and "/" not in scheme and len(scheme) > 1:
        raise ValueError(f"files of {scheme}: do not grow; use read_lines")
    return path


def listed(path: str) -> list[str]:
    """The files that a folder, a pattern or a file's name means, without hidden ones."""
    names = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
    return sorted(f for f in names if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))


def identity(f) -> str | None:
    """Inode and first line of an open file; None until its first line has an end."""
    f.seek(0)
    head = f.read(HEAD)
    line, end, _ = head.partition(b"\n")
    if not end and len(head) < HEAD:
        return None
    return f"{os.fstat(f.fileno()).st_ino}:{zlib.crc32(line):08x}"


def whole_lines(f) -> int:
    """The byte behind the last line end of an open file."""
    end = f.seek(0, os.SEEK_END)
    while end:
        begin = max(0, end - STEP)
        f.seek(begin)
        if (at := f.read(end - begin).rfind(b"\n")) >= 0:
            return begin + at + 1
        end = begin
    return 0


class LineRange(InputPartition):
    """Bytes of one file, from behind a line end to behind a line end."""

    def __init__(self, key: str, name: str, begin: int, end: int) -> None:
        super().__init__(None)
        self.key, self.name, self.begin, self.end = key, name, begin, end


class FollowReader(DataSourceStreamReader):
    def __init__(self, path: str, from_start: bool, range_bytes: int, fail_on_loss: bool) -> None:
        self.path, self.from_start, self.range_bytes, self.fail_on_loss = path, from_start, range_bytes, fail_on_loss

    def _sizes(self) -> dict:
        out = {}
        for name in listed(self.path):
            try:
                with open(name, "rb") as f:
                    key = identity(f)
                    if key is not None:
                        out[key] = {"file": name, "end": whole_lines(f)}
            except FileNotFoundError:
                # it was renamed meanwhile, and is found under its new name
                continue
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {} if self.from_start else self._sizes()}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": self._sizes()}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        out = []
        for key, at in sorted(end["files"].items()):
            begin = start["files"].get(key, {"end": 0})["end"]
            # the same first line, but shorter: it was written anew
            begin = begin if begin <= at["end"] else 0
            out += [LineRange(key, at["file"], b, min(b + self.range_bytes, at["end"])) for b in range(begin, at["end"], self.range_bytes)]
        return out

    def _open(self, part: LineRange):
        """The range's file by its identity, wherever it has been renamed to."""
        folder = os.path.dirname(part.name)
        for name in [part.name, *sorted(os.path.join(folder, n) for n in os.listdir(folder))]:
            try:
                f = open(name, "rb")  # noqa: SIM115
            except (FileNotFoundError, IsADirectoryError, PermissionError):
                continue
            if identity(f) == part.key:
                return f
            f.close()
        if self.fail_on_loss:
            raise FileNotFoundError(f"{part.name} has gone before bytes {part.begin} to {part.end} were read")
        return None

    def read(self, partition: LineRange) -> Iterator[tuple]:
        f = self._open(partition)
        if f is None:
            return
        with f:
            at = partition.begin
            if at:
                # a line belongs to the range in which it begins
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            f.seek(at)
            while at < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield line[:-1].removesuffix(b"\r").decode("utf-8", "replace"), partition.name, at
                at += len(line)


class FollowedFiles(DataSource):
    """Format ``followed_lines``: options path, fromStart (true), rangeBytes, failOnDataLoss (true)."""

    @classmethod
    def name(cls) -> str:
        return "followed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:  # noqa: N802
        flag = lambda name: self.options.get(name, "true").lower() == "true"
        return FollowReader(local_path(self.options["path"]), flag("fromStart"), int(self.options.get("rangeBytes", RANGE_BYTES)), flag("failOnDataLoss"))


def follow_lines(spark: SparkSession, path: str, from_start: bool = True, range_bytes: int = RANGE_BYTES, fail_on_loss: bool = True) -> DataFrame:
    """(line, file, start) of a folder, a pattern or a file that goes on being written, as a stream.

    from_start=False leaves out what is there when the query first starts.  A
    restart from the query's checkpoint loses no line and takes none twice.
    A file that rotates must keep its inode (renamed, not copied) and stay
    in the folder until it has been read to its end; if it is gone before,
    the query fails, or goes on without it if ``fail_on_loss`` is false.
    """
    spark.dataSource.register(FollowedFiles)
    options = {"path": path, "fromStart": str(from_start), "rangeBytes": str(range_bytes), "failOnDataLoss": str(fail_on_loss)}
    return spark.readStream.format("followed_lines").options(**options).load()
