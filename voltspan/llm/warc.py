"""Web archives: pages are written as WARC records, read back, and indexed by an external merge.

1. Payloads are counted by hash; of equal ones the record of the largest page_id is the response, others are revisits that
   refer to it. Pages are dealt by payload, a frequent one over several tasks, into archives of about ARCHIVE bytes.
2. Each archive is a sequence of gzip members, one a record, so that a record can be read alone by offset and length. They go
   through Spark's own text writer, whose commit drops what a lost or repeated task has left; its line end stands for the last
   byte of a member, which is zero. So any store that Spark writes to can hold them.
3. Tasks read whole archives, check length and digest of each payload, and write the captures that they have met, in order of
   URL key, time and place, as a run.
4. Runs are exchanged by ranges of that order (whole keys with time and place, so that a frequent URL is split as well); each
   range merges its slices with a loser tree, and counts of the ranges give each capture its position in the whole order and
   its number in the URL's history.

A null html is an empty payload, and a null url has an empty URL key. A null page_id comes before all others; if equal payloads
have no page_id at all, each is a response. Rows with the same payload and page_id are of one kind: responses, if it is the
largest. Control characters and spaces in a url are percent-encoded. Pages have no time of capture, so a record's date is
page_id seconds after 2020, in turns of 2 ** 30, unless a column ts is given. Payloads may hold anything, also the
text of a record. An empty table gives no archive and an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltspan.llm._io import checkpoint_dir, materialise, partitions, tidy
from voltspan.llm._skew import join_counted

#: Bytes of payload in an archive, and captures in a range of the index, about.
ARCHIVE, RANGE = 16 << 20, 200_000
LEVEL = 4
_PIECE = 1 << 16
_START = datetime.datetime(2020, 1, 1)
CAPTURE = "archive string, offset long, length long, url_key string, ts long, url string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
INDEX = [c.split()[0] for c in CAPTURE.split(", ")][:-1]
_ORDER = ["url_key", "ts", "archive", "offset"]
_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def base32(digest: Column) -> Column:
    """Base 32 of a SHA-1 digest in hex: five bytes are eight letters."""
    eight = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query; without scheme, www, user, usual ports and fragment."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url, re.S)
    if not m:
        return url
    host = re.sub(r":(80|443)?$", "", m[1].rpartition("@")[2].lower())
    name, port = (host.rpartition(":")[::2]) if re.search(r":\d+$", host) else (host, "")
    labels = re.sub(r"^www\d*\.", "", name).split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def member(data: bytes) -> bytes:
    """One gzip member, followed by an empty one if its last byte is not zero."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out if out[-1] == 0 else out + member(b"")


def record(page_id: int | None, url: str | None, ts: int | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record as bytes; a revisit has the answer's head alone, whose Content-Length is that of the payload."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    date = (_START + datetime.timedelta(seconds=ts or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that holds anything."""
    at, view = 0, memoryview(data)
    while at < len(view):
        d, start, parts = zlib.decompressobj(31), at, []
        while not d.eof:
            piece = view[at : at + _PIECE]
            if not len(piece):
                raise ValueError("archive ends within a record")
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        if content := b"".join(parts):
            yield start, at - start, content


def parse(content: bytes) -> dict:
    """url, ts, page_id, payload_bytes, payload_digest, record_type, refers_to and html of a record; a damaged one raises."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(field["content-length"])
    block = rest[:length]
    if not version.startswith("WARC/") or len(block) < length or rest[length:] != b"\r\n\r\n":
        raise ValueError("record is cut or has another length than it says")
    answer, _, payload = block.partition(b"\r\n\r\n")
    digest, revisit = field["warc-payload-digest"].removeprefix("sha1:"), field["warc-type"] == "revisit"
    size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", answer)[1])
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload does not have its digest")
    number = lambda k: int(field[k]) if k in field else None
    ts = int((datetime.datetime.strptime(field["warc-date"], "%Y-%m-%dT%H:%M:%SZ") - _START).total_seconds())
    return {"url": field.get("warc-target-uri"), "ts": ts, "page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": field["warc-type"], "refers_to": number("x-refers-to-page-id"), "html": None if revisit else payload}


def write(pages: DataFrame, path: str, least: int = 0) -> str:
    """Write pages (page_id, url, html) as archives under path; payloads from `least` bytes on may become revisits."""
    ts = F.col("ts").cast("timestamp").cast("long") - int(_START.replace(tzinfo=datetime.UTC).timestamp()) if "ts" in pages.columns else F.pmod(F.col("page_id").cast("long"), F.lit(1 << 30))
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", ts.alias("ts"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload.cast("binary"), 256).alias("key"))
    groups = materialise(rows.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("_n"), F.max("size").alias("each")), "warc-payloads")
    total, size = groups.agg(F.sum("_n"), F.sum(F.col("each") * F.col("_n"))).first()
    parts = max(partitions(pages.sparkSession), -(-(size or 0) // ARCHIVE))
    of = join_counted(rows, groups.select("key", "last", "_n"), "key", "page_id", "_n", total or 0, parts=parts)
    revisit = (F.col("size") >= least) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    of = of.select("page_id", "url", "ts", F.when(~revisit, F.col("payload").cast("binary")).alias("payload"), "size", base32(F.sha1(F.col("payload").cast("binary"))).alias("digest"), F.when(revisit, F.col("last")).alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                page_id, url, ts, payload, size, digest, refers_to = (c[i].as_py() for c in b.columns)
                # The writer adds the last byte.
                out = member(record(page_id, url, ts, payload or b"", size, digest, refers_to, payload is None))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["value"])

    of.mapInArrow(tidy(records), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return path


def captures(spark: SparkSession, path: str, html: bool = True) -> DataFrame:
    """CAPTURE rows of all archives under path; html: with the payloads of responses."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                archive = b.column("path")[i].as_py().rpartition("/")[2]
                data, rows, held = b.column("content")[i].as_py(), [], 0
                for offset, length, content in members(data):
                    row = parse(content)
                    rows.append(row | {"archive": archive, "offset": offset, "length": length, "url_key": url_key(row["url"] or ""), "html": row["html"].decode("utf-8", "replace") if html and row["html"] is not None else None})
                    held += len(content) if html else 1
                    if len(rows) >= 5_000 or held >= ARCHIVE:
                        yield pa.RecordBatch.from_pylist(rows, _schema(CAPTURE))
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, _schema(CAPTURE))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tidy(read), CAPTURE)


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in text.split(", "))])


class LoserTree:
    """Merges sorted runs of keys: each inner node keeps the loser of its match, so that a step costs one match a level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.key: list[tuple | None] = [r[0] if r else None for r in runs] + [None] * (self.size - len(runs))
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.key[i], self.key[j]
        return b is None or a is not None and (a, i) < (b, j)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        i, j = self._build(2 * node), self._build(2 * node + 1)
        winner, self.loser[node] = (i, j) if self._beats(i, j) else (j, i)
        return winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in the run) in order."""
        while self.key[i := self.winner] is not None:
            yield i, self.at[i]
            self.at[i] += 1
            self.key[i] = self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None
            node = (i + self.size) // 2
            while node:
                if self._beats(self.loser[node], i):
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.winner = i


def index(found: DataFrame) -> DataFrame:
    """INDEX columns, position in the order of URL key, time and place, and nth: the capture's number in its URL's history."""
    spark = found.sparkSession
    # In a task rows are numbered from its part on, so that the number also tells the run.
    runs = materialise(found.select(*INDEX).sortWithinPartitions(*_ORDER).withColumn("seq", F.monotonically_increasing_id()), "warc-runs")
    kinds = ", ".join(c for c in CAPTURE.split(", ") if c.split()[0] in INDEX)
    parts = max(partitions(spark), -(-runs.count() // RANGE))
    dealt = runs.repartitionByRange(parts, *_ORDER).sortWithinPartitions("seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        keys = list(zip(*(table.column(c).to_pylist() for c in _ORDER), strict=True))
        run = [s >> 33 for s in table.column("seq").to_pylist()]
        edges = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]
        slices = [keys[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        order, nth, last = [], [], None
        for r, place in LoserTree(slices):
            at = edges[r] + place
            nth.append(nth[-1] + 1 if keys[at][0] == last else 1)
            last = keys[at][0]
            order.append(at)
        out = table.select(INDEX).take(pa.array(order)).append_column("place", pa.array(range(len(order)), pa.int64())).append_column("nth", pa.array(nth, pa.int64()))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    merged = dealt.mapInArrow(tidy(merge), f"{kinds}, place long, nth long").withColumn("part", F.spark_partition_id())
    merged = materialise(merged, "warc-index")
    # One row a range: where it begins in the whole order, and how many captures of its first URL came before.
    ends = merged.groupBy("part").agg(F.count("*").alias("n"), F.min_by("url_key", "place").alias("first"), F.max_by("url_key", "place").alias("last"), F.max_by("nth", "place").alias("of_last")).orderBy("part").collect()
    start, url, before, rows = 0, None, 0, []
    for e in ends:
        carried = before if e["first"] == url else 0
        rows.append((e.part, start, e["first"], carried))
        start, before, url = start + e.n, e.of_last + (carried if e["first"] == e["last"] else 0), e["last"]
    of = F.broadcast(spark.createDataFrame(rows, "part int, start long, first string, carried long"))
    nth = F.col("nth") + F.when(F.col("url_key") == F.col("first"), F.col("carried")).otherwise(0)
    return merged.join(of, "part").select(*INDEX, (F.col("start") + F.col("place")).alias("position"), nth.alias("nth"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """The index of archives that are written for pages, in a folder of their own, and read back."""
    spark = pages.sparkSession
    path = write(pages, f"{checkpoint_dir(spark)}/voltspan/warc-{uuid.uuid4().hex}", least)
    return index(captures(spark, path, html=False))
