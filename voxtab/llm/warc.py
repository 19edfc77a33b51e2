"""WARC archives of pages: written with segmented records, read back and put together.

A page becomes a `response` record whose block is an HTTP message with chunked transfer framing.
Blocks above `segment` bytes are cut: the first part is the record, the others are `continuation`
records that name it as their origin, with their number and, in the last one, the total length.
Pages with equal payloads of at least `least` bytes become `revisit` records of the one with the
smallest page_id.

Reading groups continuations by origin, orders them by number, checks the total length, decodes
the framing and checks the payload's digest. Only segmented records are shuffled for that.

Archives are text files to Spark, whose lines end with the two line ends that close a record. So
Spark's own writer commits them, on any file system that it knows, and a lost executor leaves
no half-written archive.
"""

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm.common import cut
from voxtab.llm.ngram_join import TABLE, fixed_table

# Bytes of a block that a record holds at most, and records of an archive; bytes of a chunk of the
# transfer framing; fewest payload bytes that are worth a revisit.
SEGMENT, RECORDS, CHUNK, LEAST = 16 << 10, 4096, 4 << 10, 100
# Compressed bytes of an archive that are expanded at once.
READ_BYTES = 1 << 20

# Line ends and names of the formats.
END = b"\r\n"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
FRAMED = HTTP + b"Transfer-Encoding: chunked\r\n\r\n"


def fields(**named) -> bytes:
    """Header lines, those without a value left out; characters that would end a line go."""
    lines = [VERSION]
    for name, value in named.items():
        if value is not None:
            text = str(value).replace("\r", "%0D").replace("\n", "%0A")
            lines.append(f"{name.replace('_', '-')}: {text}".encode())
    return END.join(lines) + END + END


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for a in range(0, len(payload), size):
        piece = payload[a : a + size]
        parts += [f"{len(piece):x}".encode(), END, piece, END]
    return b"".join([*parts, b"0", END, END])


class Dechunker:
    """Payload of an HTTP message, from parts of it cut anywhere. Digest and size are kept up as the
    parts come."""

    def __init__(self, keep: bool = True):
        self.keep = keep
        self.held, self.headers, self.framed = b"", None, False
        self.left = 0  # bytes of the present chunk; -1: its line end is due
        self.done, self.error = False, None
        self.parts: list[bytes] = []
        self.size, self.digest = 0, hashlib.sha256()

    def _take(self, data: bytes) -> None:
        if self.keep:
            self.parts.append(data)
        self.size += len(data)
        self.digest.update(data)

    def feed(self, data: bytes) -> None:
        self.held += data
        if self.headers is None:
            stop = self.held.find(END + END)
            if stop < 0:
                return
            lines = self.held[:stop].split(END)
            pairs = (line.partition(b":") for line in lines[1:])
            self.headers = {n.strip().lower(): v.strip() for n, _, v in pairs}
            self.framed = self.headers.get(b"transfer-encoding", b"").lower() == b"chunked"
            self.held = self.held[stop + 4 :]
        if not self.framed:
            self._take(self.held)
            self.held = b""
            return
        at = 0
        while self.error is None and at < len(self.held):
            if self.done:
                break  # trailers are of no use here
            if self.left > 0:
                piece = self.held[at : at + self.left]
                self._take(piece)
                at += len(piece)
                self.left = self.left - len(piece) or -1
                continue
            stop = self.held.find(END, at)
            if stop < 0:
                break
            line = self.held[at:stop]
            at = stop + 2
            if self.left == -1:
                self.error = "framing" if line else None
                self.left = 0
                continue
            try:
                self.left = int(line.partition(b";")[0], 16)
            except ValueError:
                self.error = "framing"
            self.done = self.left == 0
        self.held = self.held[at:]

    def finish(self) -> str | None:
        """What is wrong with the message, if anything."""
        if self.headers is None:
            return "header"
        if self.framed and not self.done:
            return self.error or "framing"
        return self.error


def first_pages(pages: DataFrame, least: int) -> DataFrame:
    """digest, first, first_url of the payloads that several pages share."""
    shared = pages.where(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")
    )
    return shared.where("n > 1 and first is not null").drop("n")


def bucket_of(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(TABLE))


def shared_marks(groups: DataFrame) -> np.ndarray:
    marks = groups.select(bucket_of(F.col("digest")).alias("bucket"), F.lit(1).alias("value"))
    return fixed_table(marks)


ROWS = "page_id long, url string, digest string, size long, html binary"


def write_archives(
    pages: DataFrame, folder: str, segment: int = SEGMENT, records: int = RECORDS,
    least: int = LEAST, compression: str = "gzip", date: datetime | None = None,
) -> None:
    """Write the pages (page_id, url, html) as WARC archives in a new folder.

    A null html is empty; a null url leaves its field out. A row without an id never is what
    others revisit; rows that repeat the smallest id are responses all. Rows are told apart by
    record ids, so repeated ones stay. Other columns are not looked at; an empty table makes
    an archive without records.

    Pages whose payload nobody shares are written where they are read. A table of fixed size
    tells them (where it fills up, more pages take the other way): the others meet the
    first of their payload in a join.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    )
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    groups = cut(first_pages(rows.select("page_id", "url", "digest", "size"), least))
    marks = rows.sparkSession.sparkContext.broadcast(shared_marks(groups).tobytes())
    order = ["page_id", "url", "html", "digest"]

    def split(shared: bool):
        def run(batches):
            table = np.frombuffer(marks.value, np.uint8)
            for batch in batches:
                hit = table[batch.column("bucket").to_numpy()] > 0
                yield batch.filter(pa.array(hit == shared)).select(order)

        return run

    marked = rows.select(*order, bucket_of(F.col("digest")).alias("bucket"), "size")
    kinds = "page_id long, url string, html binary, digest string"
    alone = marked.mapInArrow(split(False), kinds)
    alone = alone.withColumns({"first": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    shared = marked.mapInArrow(split(True), kinds)
    shared = shared.join(groups, "digest", "left").withColumn(
        "first", F.when((F.length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )
    # A revisit needs no payload.
    shared = shared.withColumn("html", F.when(F.col("first").isNull(), F.col("html")))
    names = [*order, "first", "first_url"]
    both = alone.select(*names).unionByName(shared.select(*names))
    run_id, day = uuid.uuid4(), (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0

        def new_id() -> str:
            nonlocal number
            number += 1
            return f"<urn:uuid:{uuid.uuid5(run_id, f'{task}:{number}')}>"

        for batch in batches:
            made, size = [], 0
            for page_id, url, html, digest, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = new_id()
                common = {
                    "WARC_Record_ID": name, "WARC_Date": day, "WARC_Target_URI": url,
                    "Content_Type": "application/http; msgtype=response", "Page_Id": page_id,
                    "WARC_Payload_Digest": f"sha256:{digest}",
                }
                if first is not None:
                    block = HTTP + END
                    made.append(fields(
                        WARC_Type="revisit", **common, WARC_Profile=PROFILE, WARC_Refers_To_Target_URI=first_url,
                        Refers_To_Page_Id=first, Content_Length=len(block),
                    ) + block)
                    continue
                block = FRAMED + chunked(html)
                parts = [block[a : a + segment] for a in range(0, len(block), segment)]
                made.append(fields(
                    WARC_Type="response", **common, WARC_Segment_Number=1 if len(parts) > 1 else None,
                    Content_Length=len(parts[0]),
                ) + parts[0])
                for k, part in enumerate(parts[1:], 2):
                    made.append(fields(
                        WARC_Type="continuation", WARC_Record_ID=new_id(), WARC_Date=day, WARC_Target_URI=url,
                        WARC_Segment_Origin_ID=name, WARC_Segment_Number=k,
                        WARC_Segment_Total_Length=len(block) if k == len(parts) else None,
                        Content_Length=len(part),
                    ) + part)
                size += len(block)
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])
                    made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    made = both.mapInArrow(records_of, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.options(
        lineSep=(END + END).decode(), maxRecordsPerFile=records, compression=compression
    ).text(folder)


def expanded(content: bytes) -> Iterator[bytes]:
    """The bytes of an archive, plain or compressed as a whole or record by record."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = content
    while rest:
        engine = zlib.decompressobj(31)
        at = 0
        while at < len(rest) and not engine.eof:
            data = engine.decompress(rest[at : at + READ_BYTES])
            at += READ_BYTES
            if data:
                yield data
        rest = engine.unused_data + rest[at:] if engine.eof else b""


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields, block and fault of each record of an archive. Reading ends at the first record
    that is not whole."""
    held, at, source = b"", 0, expanded(content)

    def more() -> bool:
        nonlocal held, at
        data = next(source, None)
        if data is None:
            return False
        held, at = held[at:] + data, 0
        return True

    while True:
        while held[at : at + 2] == END:
            at += 2
        stop = held.find(END + END, at)
        if stop < 0:
            if more():
                continue
            if held[at:].strip(END):
                yield {}, held[at:], "header"
            return
        lines = held[at:stop].decode(errors="replace").split("\r\n")
        named = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        named = {name.lower(): value for name, value in named.items()}
        length = named.get("content-length", "")
        if not lines[0].startswith("WARC/") or not length.isdigit():
            yield named, b"", "header"
            return
        at = stop + 4
        while len(held) - at < int(length):
            if not more():
                yield named, held[at:], "cut off"
                return
        yield named, held[at : at + int(length)], None
        at += int(length)


RECORD = (
    "kind string, page_id long, url string, digest string, refers_to long, origin string, "
    "number long, total long, block binary, fault string"
)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row a record of the archives in a folder. An archive is read by one task, expanded bit by
    bit; it must be below 2 GB as it is stored."""
    names = [part.split()[0] for part in RECORD.split(",")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]

    def number(text: str | None) -> int | None:
        return int(text) if text and text.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, size = [], 0
                for named, block, fault in parsed(content):
                    origin = named.get("warc-segment-origin-id")
                    if origin is None and "warc-segment-number" in named:
                        origin = named.get("warc-record-id")
                    rows.append((
                        named.get("warc-type"), number(named.get("page-id")), named.get("warc-target-uri"),
                        (named.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                        number(named.get("refers-to-page-id")), origin, number(named.get("warc-segment-number")),
                        number(named.get("warc-segment-total-length")), block, fault,
                    ))
                    size += len(block) + 500
                    if size > 4 * READ_BYTES:
                        yield emit(rows)
                        rows, size = [], 0
                if rows:
                    yield emit(rows)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, RECORD)


PAGE = (
    "kind string, page_id long, url string, digest string, refers_to long, segments long, "
    "payload binary, payload_bytes long, payload_digest string, fault string"
)


def assembled(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """From records, those of one origin after each other by number: a row for each whole one."""
    names = [part.split()[0] for part in PAGE.split(",")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def closed(rows: list[dict], work: Dechunker, length: int, fault: str | None) -> tuple:
        head, last = rows[0], rows[-1]
        if fault is None and head["origin"] is not None:
            if head["number"] != 1:
                fault = "no first segment"
            elif last["total"] is None:
                fault = "no last segment"
            elif last["total"] != length:
                fault = "total length"
        fault = fault or work.finish()
        body = head["kind"] != "revisit"
        found = work.digest.hexdigest()
        if fault is None and body and head["digest"] not in (None, found):
            fault = "digest"
        return (
            head["kind"], head["page_id"], head["url"], head["digest"], head["refers_to"], len(rows),
            b"".join(work.parts) if body and payloads else None, work.size if body else None, found if body else None, fault,
        )

    def emit(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
        )

    held: list[dict] = []
    work, length, fault = Dechunker(payloads), 0, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            block = row.pop("block")
            if held and (row["origin"] is None or row["origin"] != held[0]["origin"]):
                out.append(closed(held, work, length, fault))
                held, work, length, fault = [], Dechunker(payloads), 0, None
            if held and row["number"] == held[-1]["number"]:
                continue  # the same segment again
            if held and row["number"] != held[-1]["number"] + 1:
                fault = fault or "missing segment"
            fault = fault or row["fault"]
            held.append(row)
            length += len(block)
            work.feed(block)
        if out:
            yield emit(out)
    if held:
        yield emit([closed(held, work, length, fault)])


def read_pages(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row a page of the archives in a folder: kind, page_id, url, digest (as the record has it),
    refers_to, segments, payload (null unless `payloads`), payload_bytes, payload_digest, fault.

    `fault` says what is wrong with a record and is null for good ones: header, cut off, framing,
    digest, total length, or a segment that is missing. Records of other types give no rows. A
    revisit has no payload of its own; see `resolved`."""
    records = read_records(spark, folder)
    records = records.where(F.col("fault").isNotNull() | F.col("kind").isin("response", "revisit", "continuation"))
    # Segments without a number cannot be placed: they are records of their own.
    apart = F.col("origin").isNotNull() & F.col("number").isNotNull()
    whole = records.where(~apart).withColumn("origin", F.lit(None).cast("string"))
    segments = records.where(apart).repartition("origin").sortWithinPartitions("origin", "number")
    put_together = partial(assembled, payloads=payloads)
    return whole.mapInArrow(put_together, PAGE).unionByName(segments.mapInArrow(put_together, PAGE))


def resolved(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, fault: revisits take size
    and digest from the response that they name, `unresolved` if there is none."""
    own = pages.select("page_id", "kind", "digest", "refers_to", "payload_bytes", "payload_digest", "fault")
    responses = own.where((F.col("kind") == "response") & F.col("fault").isNull())
    names = responses.groupBy(F.col("payload_digest").alias("digest"), F.col("page_id").alias("refers_to")).agg(
        F.max("payload_bytes").alias("theirs")
    )
    revisits = own.where(F.col("kind").eqNullSafe("revisit")).join(names, ["digest", "refers_to"], "left")
    revisits = revisits.select(
        "page_id", F.col("theirs").alias("payload_bytes"),
        F.when(F.col("theirs").isNotNull(), F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
        F.coalesce("fault", F.when(F.col("theirs").isNull(), "unresolved")).alias("fault"),
    )
    others = own.where(~F.col("kind").eqNullSafe("revisit")).select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), "fault",
    )
    return others.unionByName(revisits)
