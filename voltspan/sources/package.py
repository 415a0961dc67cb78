"""Reference packages: archives with a workbook, a manifest in JSON and a log for each of up to three analyses.

The scan is a data source with a partition for each entry of each archive, so a task reads one entry by its place and never a whole
archive. An archive within an archive is opened once; one level deeper is an issue. What is wrong with a package is told by rows
of `issues`, all of it at once, and nothing of one package stops another. Folders may be anything that Arrow's file systems open.
"""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voltspan.sources.archive import MOST_ENTRIES, MOST_RATIO, MOST_UNPACKED
from voltspan.sources.workbook import cells

SCHEMA = "archive string, entry string, size long, content binary, issue string, detail string"
#: Fixed values of the package format.
ANALYSES = {"LF": "LOAD_FLOW", "N1": "N1_CONTINGENCY", "SC": "SHORT_CIRCUIT"}
VERSION = "PF-GA-REF-1.0"
SHARED = ["studyCase", "studyTime", "modelHash", "scenarioHash", "topologyHash", "project", "pfVersion"]
METHOD = ["requestedMethod", "effectiveMethod", "methodVerificationStatus"]
SIDECAR = 16 << 20


class _Entry(InputPartition):
    def __init__(self, path: str, names: tuple[str, ...], issue: str | None = None, detail: str | None = None):
        self.path, self.names, self.issue, self.detail = path, names, issue, detail


def _checked(archive: zipfile.ZipFile) -> Iterator[zipfile.ZipInfo]:
    """Files of an archive; ValueError names the bound or rule that is broken."""
    infos = archive.infolist()
    if len(infos) > MOST_ENTRIES:
        raise ValueError("too many entries")
    if sum(i.file_size for i in infos) > MOST_UNPACKED:
        raise ValueError("unpacks to too much")
    for i in infos:
        path = PurePosixPath(i.filename.replace("\\", "/"))
        if not path.parts or path.is_absolute() or ".." in path.parts or ":" in path.parts[0]:
            raise ValueError("unsafe path")
        if i.file_size > MOST_RATIO * max(1, i.compress_size):
            raise ValueError("ratio")
        if i.flag_bits & 1:
            raise ValueError("encrypted")
        if path.suffix.lower() in (".json", ".log") and i.file_size > SIDECAR:
            raise ValueError("sidecar or log too large")
        if not i.is_dir():
            yield i


def _opened(system: fs.FileSystem, path: str):
    """A file to seek in; small ones are read at once, as Arrow's files refuse places before their start."""
    f = system.open_input_file(path)
    return io.BytesIO(f.read()) if f.size() < 1 << 16 else f


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (fs.LocalFileSystem(), self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        out: list[InputPartition] = []
        for name in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip")):
            try:
                with _opened(system, name) as f, zipfile.ZipFile(f) as archive:
                    mine = []
                    for info in _checked(archive):
                        if info.filename.lower().endswith(".zip"):
                            with zipfile.ZipFile(io.BytesIO(archive.read(info))) as inner:
                                mine += [_Entry(name, (info.filename, i.filename)) for i in _checked(inner)]
                        else:
                            mine.append(_Entry(name, (info.filename,)))
                out += mine or [_Entry(name, (), "SOURCE_SCHEMA_MISMATCH", "empty archive")]
            except (zipfile.BadZipFile, EOFError, OSError) as e:
                out.append(_Entry(name, (), "UNSAFE_ARCHIVE", f"not an archive or damaged: {type(e).__name__}"))
            except ValueError as e:
                out.append(_Entry(name, (), "UNSAFE_ARCHIVE", str(e)))
        return out or [_Entry("", ())]  # a scan has at least one partition

    def read(self, part: _Entry) -> Iterator[tuple]:
        if part.issue:
            yield part.path, None, None, None, part.issue, part.detail
            return
        if not part.names:
            return
        entry = "!".join(part.names)
        if len(part.names) > 1 and part.names[-1].lower().endswith(".zip"):
            yield part.path, entry, None, None, "UNSAFE_ARCHIVE", "archives nested too deep"
            return
        system, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (fs.LocalFileSystem(), "")
        try:
            with _opened(system, part.path) as f:
                source = f
                for name in part.names:
                    data = zipfile.ZipFile(source).read(name)  # the CRC is checked on the way
                    source = io.BytesIO(data)
            yield part.path, entry, len(data), data, None, None
        except (zipfile.BadZipFile, EOFError, OSError) as e:
            yield part.path, entry, None, None, "UNSAFE_ARCHIVE", f"damaged entry: {type(e).__name__}"


class PackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voltspan_package"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA: the entries of the archives under path; an archive or entry that can't be read has a row with the issue."""
    spark.dataSource.register(PackageSource)
    return spark.read.format("voltspan_package").load(path)


def manifests(entries: DataFrame) -> DataFrame:
    """archive, base, row, col, text, error: the manifest sheets' cells of the workbooks, a workbook that can't be read with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, base, data in zip(*(b.column(c).to_pylist() for c in ("archive", "base", "content")), strict=True):
                try:
                    rows = [(archive, base, row, col, text, None) for _, row, col, _, text, *_ in cells(data, "Analysis_Manifest_Raw")]
                except (ValueError, KeyError, SyntaxError, zipfile.BadZipFile) as e:
                    rows = [(archive, base, None, None, None, type(e).__name__)]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "base", "row", "col", "text", "error"])

    return entries.select("archive", "base", "content").mapInArrow(run, "archive string, base string, row int, col int, text string, error string")


def issues(entries: DataFrame) -> DataFrame:
    """archive, kind, detail of all that is wrong with the packages of read_packages; a package without a row is good. entries should
    be a table, as it is read for each rule."""
    base = F.element_at(F.split("entry", r"[\\/!]"), -1)
    files = entries.where("issue is null").select("archive", base.alias("base"), F.lower(F.regexp_extract(base, r"\.(\w+)$", 1)).alias("ext"), "size", "content")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "")
    wrong = lambda rows, kind, detail: rows.select("archive", F.lit(kind).alias("kind"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    out = [entries.where("issue is not null").select("archive", F.col("issue").alias("kind"), "detail")]
    count = files.groupBy("archive").agg(F.count("*").alias("n"), F.count_distinct("base").alias("bases"), F.count_if(~F.col("ext").isin("xlsx", "json", "log")).alias("odd"))
    out.append(wrong(count.where("n not in (3, 9)"), "SOURCE_SCHEMA_MISMATCH", "three files an analysis are required"))
    out.append(wrong(count.where("bases < n or odd > 0"), "SOURCE_SCHEMA_MISMATCH", "duplicate basename or unsupported file"))
    fields = ", ".join(f"{f}: string" for f in [*SHARED, *METHOD])
    raw = F.from_json(text, f"struct<analysisType: string, schemaVersion: string, identity: struct<{fields}>, workbook: struct<file: string, sha256: string, sizeBytes: long>>")
    parsed = files.where("ext = 'json'").select("archive", "base", F.try_parse_json(text).alias("any"), raw.alias("raw"))
    sidecars = parsed.select("archive", "base", "any", F.col("raw.analysisType").alias("analysis"), F.col("raw.schemaVersion").alias("version"), F.col("raw.identity").alias("identity"), F.col("raw.workbook").alias("book"))
    out.append(wrong(sidecars.where("any is null"), "INVALID_JSON", F.col("base")))
    sidecars = sidecars.where("any is not null")
    known = F.coalesce(F.col("analysis").isin(*ANALYSES) & (F.col("version") == VERSION), F.lit(False))
    out.append(wrong(sidecars.where(~known), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("unknown analysis: "), "base")))
    sidecars = sidecars.where(known)
    out.append(wrong(sidecars.groupBy("archive", "analysis").count().where("count > 1"), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("duplicate analysis: "), "analysis")))
    mark = lambda a: F.when(text.rlike(rf"GUI_EVENT \| {'' if a == 'LF' else a + '_'}RUN_STARTED(?:\s|$)"), a)
    logs = files.where("ext = 'log'").select("archive", "base", F.array_compact(F.array(*map(mark, ANALYSES))).alias("marks"), F.regexp_extract(text, r"\bStudyCase=([^\r\n]*?)\s+StudyTime=", 1).alias("case"))
    out.append(wrong(logs.where("size(marks) <> 1"), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("unidentified log: "), "base")))
    logs = logs.where("size(marks) = 1").select("archive", F.col("marks")[0].alias("analysis"), "case")
    out.append(wrong(logs.groupBy("archive", "analysis").count().where("count > 1"), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("duplicate log: "), "analysis")))
    lacking = sidecars.select("archive", "analysis").join(logs, ["archive", "analysis"], "left_anti").unionByName(logs.select("archive", "analysis").join(sidecars, ["archive", "analysis"], "left_anti"))
    out.append(wrong(lacking.distinct(), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("missing artifacts: "), "analysis")))
    filled = functools.reduce(Column.__and__, [F.coalesce(F.col(f"identity.{f}") != "", F.lit(False)) for f in SHARED])
    listed = F.coalesce(F.col("book.file").isNotNull() & F.col("book.sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False))
    out.append(wrong(sidecars.where(~(filled & listed)), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("identity or workbook manifest: "), "analysis")))
    sidecars = sidecars.where(listed)
    books = files.where("ext = 'xlsx'").select("archive", "base", "size", F.sha2("content", 256).alias("hash"))
    claim = sidecars.select("archive", "analysis", "identity", F.col("book.file").alias("base"), F.lower("book.sha256").alias("sha"), F.col("book.sizeBytes").alias("bytes"))
    out.append(wrong(claim.join(books, ["archive", "base"], "left_anti"), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("missing workbook: "), "analysis")))
    out.append(wrong(claim.groupBy("archive", "base").count().where("count > 1"), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("workbook of two analyses: "), "base")))
    out.append(wrong(claim.join(books, ["archive", "base"]).where("hash <> sha or size <> coalesce(bytes, -1)"), "WORKBOOK_HASH_MISMATCH", F.col("analysis")))
    out.append(wrong(claim.join(logs, ["archive", "analysis"]).where(~F.col("case").eqNullSafe(F.col("identity.studyCase"))), "BENCHMARK_IDENTITY_MISMATCH", F.concat(F.lit("log study case: "), "analysis")))
    apart = [F.when(F.count_distinct(F.coalesce(f"identity.{f}", F.lit(""))) > 1, f) for f in SHARED]
    mixed = claim.groupBy("archive").agg(F.array_compact(F.array(*apart)).alias("fields")).where("size(fields) > 0")
    out.append(wrong(mixed, "BENCHMARK_IDENTITY_MISMATCH", F.concat(F.lit("mixed: "), F.array_join("fields", ","))))
    # The manifest sheet: its first row has the fields, the second one their values.
    sheet = manifests(files.where("ext = 'xlsx'"))
    out.append(wrong(sheet.where("error is not null"), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("workbook: "), "base")))
    sheet = sheet.where("error is null")
    rows = sheet.groupBy("archive", "base").agg(F.count_distinct("row").alias("n"))
    out.append(wrong(books.join(rows, ["archive", "base"], "left").where("coalesce(n, 0) <> 2"), "SOURCE_SCHEMA_MISMATCH", F.concat(F.lit("manifest rows: "), "base")))
    head = sheet.where("row = 1").select("archive", "base", "col", F.col("text").alias("field"))
    values = head.join(sheet.where("row = 2").select("archive", "base", "col", "text"), ["archive", "base", "col"]).groupBy("archive", "base").agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("given"))
    both = claim.join(values, ["archive", "base"])
    named = F.create_map(*[F.lit(x) for pair in ANALYSES.items() for x in pair])
    other = F.array_compact(F.array(*[F.when(~F.coalesce(F.element_at("given", F.lit(f)) == F.col(f"identity.{f}"), F.lit(False)), f) for f in [*SHARED, *METHOD]], F.when(~F.coalesce(F.element_at("given", F.lit("analysisType")).isin(F.col("analysis"), named[F.col("analysis")]), F.lit(False)), "analysisType")))
    out.append(wrong(both.select("archive", "analysis", other.alias("fields")).where("size(fields) > 0"), "BENCHMARK_IDENTITY_MISMATCH", F.concat(F.lit("workbook "), "analysis", F.lit(": "), F.array_join("fields", ","))))
    return functools.reduce(DataFrame.unionByName, out)
