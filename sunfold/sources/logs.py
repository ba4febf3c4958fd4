"""Log files that grow, as a stream of lines: a data source with a byte offset for each file.

Every line is read once, when it has ended, however often its file grew meanwhile and wherever the stream stopped and began again.
Offsets are in the stream's checkpoint. A file that has become shorter was begun anew and is read from its start. Files may be
wherever pyarrow reads, if driver and executors reach them by the same path; pieces of large files are tasks of their own.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_PIECE = 64 << 20  # bytes that a task reads
_LOOK = 64 << 10  # bytes that are looked through at once for a line's end


@dataclass
class Piece(InputPartition):
    """The lines that begin at low or later and before high, in a part of the file that ends with a line."""

    file: str
    low: int
    high: int


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def whole_lines(files: fs.FileSystem, file: str, size: int) -> int:
    """Where the last line ends that has ended within the first size bytes; 0 if none has."""
    with files.open_input_file(file) as f:
        at = size
        while at > 0:
            low = max(0, at - _LOOK)
            end = f.read_at(at - low, low).rfind(b"\n")
            if end >= 0:
                return low + end + 1
            at = low
    return 0


class LogLines(DataSource):
    """Format `growing_lines`: (file, at, value), at the place of the line's first byte. Options: path, and glob for files' names."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  the interface's name
        return LogReader(self.options["path"], self.options.get("glob", "*.log"), int(self.options.get("piece", _PIECE)))


class LogReader(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str, piece: int):
        self.folder, self.glob, self.piece = folder, glob, piece

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """For each file the end of its last whole line."""
        files, folder = _opened(self.folder)
        found = files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return {f.path: whole_lines(files, f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for file, high in sorted(end.items()):
            low = start.get(file, 0)
            low = low if low <= high else 0
            out += [Piece(file, at, min(high, at + self.piece)) for at in range(low, high, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        files, _ = _opened(self.folder)
        with files.open_input_file(partition.file) as f:
            at = partition.low
            if at > 0 and f.read_at(1, at - 1) != b"\n":  # a line of the piece before runs into this one
                f.seek(at)
                at += len(_line(f))
            f.seek(at)
            while at < partition.high:
                line = _line(f)
                if not line:
                    break
                yield partition.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


def _line(f) -> bytes:
    """The bytes up to the next line's end, which are few for a log."""
    begin, out = f.tell(), b""
    while b"\n" not in out:
        more = f.read(_LOOK)
        if not more:
            break
        out += more
    end = out.find(b"\n") + 1 or len(out)
    f.seek(begin + end)
    return out[:end]


def growing_lines(spark: SparkSession, folder: str, glob: str = "*.log", **options) -> DataFrame:
    """A stream of the lines (file, at, value) of files under folder, old ones and those to come."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("growing_lines").options(glob=glob, **options).load(folder)
