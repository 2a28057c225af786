"""Archives of sound and text: a data source that reads members in order, one partition an archive."""

from __future__ import annotations

import glob
import os
import tarfile
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "archive string, pos bigint, member string, stem string, kind string, content binary"


class _Archive(InputPartition):
    def __init__(self, parts: list[str]) -> None:
        self.parts = parts


class _Joined:
    """Files read one after the other as one stream, unpacked on the way if they are gzip."""

    def __init__(self, parts: list[str]) -> None:
        self.parts, self.file, self.held = iter(parts), None, b""
        first = open(parts[0], "rb").read(2) if parts else b""  # noqa: SIM115
        self.unpack = zlib.decompressobj(31) if first == b"\x1f\x8b" else None

    def _raw(self) -> bytes:
        while True:
            if self.file is None:
                path = next(self.parts, None)
                if path is None:
                    return b""
                self.file = open(path, "rb")  # noqa: SIM115
            block = self.file.read(1 << 20)
            if block:
                return block
            self.file.close()
            self.file = None

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            block = self._raw()
            if not block:
                break
            if self.unpack is None:
                self.held += block
                continue
            self.held += self.unpack.decompress(block)
            while self.unpack.eof and self.unpack.unused_data:
                rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
                self.held += self.unpack.decompress(rest)
        out, self.held = self.held[:n], self.held[n:]
        return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], options.get("split", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(self.path)) if not os.path.isfile(self.path) else [self.path]
        if self.split:  # one archive that was cut into files
            return [_Archive(files)] if files else []
        return [_Archive([f]) for f in files] or [_Archive([])]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        if not partition.parts:
            return
        name = os.path.basename(partition.parts[0])
        with tarfile.open(fileobj=_Joined(partition.parts), mode="r|") as tar:
            for pos, m in enumerate(tar):
                base = os.path.basename(m.name)
                if not m.isfile() or base.startswith("._"):
                    continue
                stem, _, kind = base.rpartition(".")
                yield name, pos, m.name, stem, kind.lower(), tar.extractfile(m).read()


class ArchiveSource(DataSource):
    """``spark.read.format("klangsieb_archive").load("….tar.gz")``: files of tar archives in their order.

    Option ``split`` reads all matching files as the parts of one archive.
    """

    @classmethod
    def name(cls) -> str:
        return "klangsieb_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(ArchiveSource)


def paired(members):
    """Sound members with the text member of the same stem that came before them: (archive, stem, text, content)."""
    from pyspark.sql import functions as F

    text = members.where(F.col("kind").isin("txt", "json")).select("archive", "stem", F.col("pos").alias("text_pos"), F.decode("content", "UTF-8").alias("text"))
    sound = members.where("kind = 'wav'").select("archive", "stem", "pos", "content")
    return sound.join(text, ["archive", "stem"]).where("text_pos < pos").groupBy("archive", "stem").agg(F.max_by("text", "text_pos").alias("text"), F.first("content").alias("content"))
