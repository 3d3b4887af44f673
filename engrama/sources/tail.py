"""JSON Lines files that others append to, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT, SCHEMA = "engrama_tail", "file string, place long, value string"
#: Bytes of a part of a file that one task reads, and of a step in search of a line's end.
SPLIT, STEP = 16 << 20, 1 << 16


class Part(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: bool):
        self.file, self.start, self.end, self.first = file, start, end, first


class TailReader(DataSourceStreamReader):
    """Offsets are bytes per file, always just behind a line's end: a line that is cut off is not there yet, and comes whole with a later batch."""

    def __init__(self, path: str, split: int):
        self.fs, self.path = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.split = split

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> list[fs.FileInfo]:
        top = self.fs.get_file_info(self.path)
        if top.type == fs.FileType.Directory:
            return sorted((i for i in self.fs.get_file_info(fs.FileSelector(self.path)) if i.type == fs.FileType.File and i.base_name[:1] not in "._"), key=lambda i: i.path)
        return [top] if top.type == fs.FileType.File else []

    def _complete(self, info: fs.FileInfo) -> int:
        """Where the file's last whole line ends."""
        with self.fs.open_input_file(info.path) as f:
            end = f.size()
            while end > 0:
                start = max(0, end - STEP)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def latestOffset(self) -> dict:
        return {i.path: self._complete(i) for i in self._files()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """Each file's new bytes in parts; a part has the lines that begin in it. A file that has become shorter was replaced, and is read from its start."""
        out = []
        for file, upto in sorted(end.items()):
            since = start.get(file, 0)
            since = since if since <= upto else 0
            out += [Part(file, at, min(at + self.split, upto), at == since) for at in range(since, upto, self.split)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(partition.file) as f:
            at = partition.start
            if not partition.first:  # the line that begins before belongs to the part before
                f.seek(at - 1)
                while (chunk := f.read(STEP)) and (cut := chunk.find(b"\n")) < 0:
                    at += len(chunk)
                at += cut if chunk else 0
            f.seek(at)
            held, base, lines = b"", at, []
            while base < partition.end and (chunk := f.read(STEP)):
                held, at = held + chunk, 0
                while (cut := held.find(b"\n", at)) >= 0 and base < partition.end:
                    lines.append((partition.file, base, held[at:cut].decode("utf-8", "replace").removesuffix("\r")))
                    base, at = base + cut + 1 - at, cut + 1
                held = held[at:]
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines, strict=True)], ["file", "place", "value"])
                    lines = []

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("split", SPLIT)))


def tail(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """A stream of the lines of a file, or of the files of a folder, that others append to: file, place (the line's first byte), value, and bad, whether it is not a JSON object. Each line comes once, a restart from a checkpoint included; empty lines are left out."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format(FORMAT).option("path", path).option("split", str(split)).load().where("value <> ''")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    return lines.withColumn("bad", ~F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))
