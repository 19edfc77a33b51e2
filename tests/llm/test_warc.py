import gzip
import hashlib
import random

import pytest

from voxtab.llm import warc as W
from voxtab.llm.common import table
from voxtab.llm.queries import QUERIES
from voxtab.session import run_folder

SCHEMA = "page_id long, url string, html string"


def sha(text) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def plain_rule(rows) -> list[tuple]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row."""
    firsts: dict = {}
    for page_id, _, html in rows:
        size = len((html or "").encode())
        if size >= 100 and page_id is not None:
            firsts[html] = min(firsts.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        first = firsts.get(html)
        again = first is not None and page_id != first
        size = len((html or "").encode())
        out.append((page_id, size, sha(html), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def there_and_back(spark, df, **options):
    folder = run_folder(spark, "warc-test")
    W.write_archives(df, folder, **options)
    return folder, W.read_pages(spark, folder)


def digests(pages) -> list[tuple]:
    rows = W.resolved(pages).collect()
    assert all(r["fault"] is None for r in rows)
    return sorted(((r[0], r[1], r[2], r[3], r[4]) for r in rows), key=str)


@pytest.mark.parametrize("options", [{}, {"segment": 64}, {"segment": 1000, "records": 3, "compression": "none"}])
def test_there_and_back(spark, options):
    rng = random.Random(2)
    texts = ["é" * 60, "", None, "tiny", "x" * 99, "x" * 100, "a\r\n\r\nWARC/1.1\r\nb" * 90, "0\r\n\r\n" * 400, "ü" * 70_000]
    rows = [(k, f"http://h/{k}", rng.choice(texts)) for k in range(60)]
    rows += [(None, None, "n" * 200), (None, "u", "n" * 200), (None, "http://h\nx", texts[0]), (3, "twice", "t" * 300), (3, "twice", "t" * 300), (4, "t", "t" * 300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    _, pages = there_and_back(spark, df.withColumn("digest", df.url).withColumn("first", df.url), **options)
    assert digests(pages) == plain_rule(rows)
    responses = [r for r in pages.collect() if r["kind"] == "response"]
    assert sorted(r["payload"].decode() for r in responses) == sorted(
        (html or "") for (p, _, html), (_, _, _, kind, _) in zip(
            sorted(rows, key=lambda r: str((r[0], len((r[2] or "").encode()), sha(r[2])))),
            sorted(plain_rule(rows), key=lambda r: str(r[:3])), strict=True,
        ) if kind == "response"
    )
    if options.get("segment") == 64:
        assert max(r["segments"] for r in responses) > 1000


def test_empty_table(spark):
    _, pages = there_and_back(spark, spark.createDataFrame([], SCHEMA))
    assert pages.collect() == []


def test_archives_are_warc(spark):
    rows = [(1, "http://a/", "page " * 50), (2, "http://b/", "page " * 50)]
    folder, _ = there_and_back(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), segment=200)
    files = spark.read.format("binaryFile").load(folder).select("content").collect()
    text = b"".join(gzip.decompress(bytes(r[0])) for r in files).decode()
    records = text.split("WARC/1.1\r\n")[1:]
    kinds = [r.split("\r\n")[0] for r in records]
    assert kinds.count("WARC-Type: response") == 1 and kinds.count("WARC-Type: revisit") == 1
    assert kinds.count("WARC-Type: continuation") == 1
    assert all(r.endswith("\r\n\r\n") for r in records)
    assert sum("WARC-Segment-Total-Length: " in r for r in records) == 1
    assert "Transfer-Encoding: chunked" in text


def record(kind, block: bytes, **named) -> bytes:
    return W.fields(WARC_Type=kind, **named, Content_Length=len(block)) + block + b"\r\n\r\n"


def read(spark, tmp_path, name: str, content: bytes):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "a.warc").write_bytes(content)
    return W.read_pages(spark, str(folder)).collect()


def test_broken_archives(spark, tmp_path):
    block = W.FRAMED + W.chunked(b"hello " * 40, 50)
    cut = [block[:90], block[90:200], block[200:]]
    name = {"WARC_Record_ID": "<urn:o>", "Page_Id": 1, "WARC_Payload_Digest": "sha256:" + sha("hello " * 40)}
    more = {"WARC_Segment_Origin_ID": "<urn:o>"}
    total = {"WARC_Segment_Total_Length": len(block)}
    parts = [
        record("response", cut[0], **name, WARC_Segment_Number=1),
        record("continuation", cut[1], **more, WARC_Segment_Number=2),
        record("continuation", cut[2], **more, WARC_Segment_Number=3, **total),
    ]

    def fault(label, *pieces):
        return [(r["fault"], r["payload_bytes"]) for r in read(spark, tmp_path, label, b"".join(pieces))]

    info = record("warcinfo", b"software: x")
    assert fault("whole", info, *parts) == [(None, 240)]
    assert fault("order", parts[2], parts[0], info, parts[1]) == [(None, 240)]
    assert fault("twice", *parts, parts[1]) == [(None, 240)]
    assert fault("gap", parts[0], parts[2])[0][0] == "missing segment"
    assert fault("headless", *parts[1:])[0][0] == "no first segment"
    assert fault("open", *parts[:2])[0][0] == "no last segment"
    wrong = record("continuation", cut[2], **more, WARC_Segment_Number=3, WARC_Segment_Total_Length=7)
    assert fault("total", *parts[:2], wrong)[0][0] == "total length"
    assert fault("bytes", record("response", block, **name | {"WARC_Payload_Digest": "sha256:" + sha("x")}))[0][0] == "digest"
    assert fault("framing", record("response", W.FRAMED + b"5\r\nhello--3\r\n", **name))[0][0] == "framing"
    assert fault("unchunked", record("response", W.HTTP + b"\r\nplain body")) == [(None, 10)]
    assert fault("members", gzip.compress(info), gzip.compress(b"".join(parts))) == [(None, 240)]
    assert fault("cut", parts[0], record("response", b"x" * 50)[:-30])[-1][0] is not None
    assert fault("noise", b"not an archive\r\n\r\n")[0][0] == "header"
    lone = record("revisit", W.HTTP + b"\r\n", Page_Id=5, Refers_To_Page_Id=9, WARC_Payload_Digest="sha256:aa")
    folder = tmp_path / "lone"
    folder.mkdir()
    (folder / "a.warc").write_bytes(lone)
    assert [r["fault"] for r in W.resolved(W.read_pages(spark, str(folder))).collect()] == ["unresolved"]


def test_query_against_the_plain_rule(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    found = sorted((tuple(r)[:5] for r in QUERIES["op11_warc"](spark, sf).collect()), key=str)
    assert found == plain_rule(rows)
