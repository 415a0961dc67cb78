"""Archives with bounds on what they may unpack to."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an archive, of all entries together, entries, and bytes that one may unpack to for each packed one.
MOST_PACKED, MOST_UNPACKED, MOST_ENTRIES, MOST_RATIO = 512 << 20, 2 << 30, 1000, 1000
SCHEMA = "path string, entry string, size long, crc long, content binary, error string"


def entries(data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """(name, size, crc, content) of the files of an archive; ValueError names the bound or rule that is broken."""
    if len(data) > MOST_PACKED:
        raise ValueError("archive too large")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not an archive") from e
    infos = archive.infolist()
    if len(infos) > MOST_ENTRIES:
        raise ValueError("too many entries")
    if sum(i.file_size for i in infos) > MOST_UNPACKED:
        raise ValueError("unpacks to too much")
    for info in infos:
        path = PurePosixPath(info.filename.replace("\\", "/"))
        if path.is_absolute() or ".." in path.parts or ":" in path.parts[0] if path.parts else True:
            raise ValueError(f"unsafe path {info.filename!r}")
        if info.file_size > MOST_RATIO * max(1, info.compress_size):
            raise ValueError(f"ratio of {info.filename!r}")
        if info.flag_bits & 1:
            raise ValueError(f"{info.filename!r} is encrypted")
        if not info.is_dir():
            try:
                content = archive.read(info)  # the CRC is checked on the way
            except (zipfile.BadZipFile, EOFError, OSError) as e:
                raise ValueError(f"damaged entry {info.filename!r}") from e
            yield info.filename, info.file_size, info.CRC, content


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, entry, size, crc, content of archives; one that breaks a rule gives a single row with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(name, *e, None) for e in entries(data)]
                except ValueError as e:
                    rows = [(name, None, None, None, None, str(e))]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
