"""WARC archives whose records are compressed one by one with a shared dictionary.

An archive is a ``.warc.zst`` file.  It opens with a skippable frame that holds
a Zstandard dictionary built from the archive's own records; each record then
is a frame of its own, compressed with that dictionary, so any record can be
read without those before it.  Archives hold about ``ARCHIVE`` bytes of payload
(one page at least), and each is one row and one file of Spark's text writer:
its commit protocol decides which attempt of a task counts, on any file system.
The writer's line end is an empty skippable frame, which readers pass over.

Of pages with equal payloads of at least ``least`` bytes the one with the
largest id is a ``response``; the others are ``revisit`` records that name it
and carry no payload.

Defined results: a null or empty payload is a response without a body; a null
id is smaller than any other; rows that share both the largest id and the
payload are all responses; a null url has no target line, and its control
characters and spaces are percent-encoded; an archive whose records are too
few or too alike for a dictionary has none; a damaged record is an error;
other columns, whatever their names, are not archived; no pages, no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldmark.llm.order import written
from foldmark.operators.lookup import LevelTable, lookup
from foldmark.session import scratch_path

# Bytes of payload after which an archive is closed.
ARCHIVE = 8_000_000
DICTIONARY = 64 * 1024
LEVEL = 3

# fixed values of the formats
FRAME, SKIPPABLE, DICTIONARY_FRAME = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", SKIPPABLE, 0)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"


# -- records -------------------------------------------------------------------

def escaped(url: str) -> str:
    """Without characters that would end or split a header line."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def record(page: int | None, url: str | None, payload: bytes, sha1: bytes, refers: int | None,
           date: str) -> bytes:
    """One record; with ``refers`` it is a revisit without its payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + END + END)
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    if refers is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
             "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + END + END


def fields(lines: list[bytes]) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode()
            for k, _, v in (line.partition(b":") for line in lines)}


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def parsed(data: bytes) -> dict:
    """The fields of one record; a payload that does not fit its digest is an error."""
    head, _, rest = data.partition(END + END)
    lines = head.split(END)
    at = fields(lines[1:])
    block = rest[:int(at["content-length"])]
    if not lines[0].startswith(b"WARC/") or rest[len(block):] != END + END:
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(END + END)
    size = int(fields(http.split(END)[1:])["content-length"])
    digest = base64.b32decode(at["warc-payload-digest"].removeprefix("sha1:"))
    whole = at["warc-type"] == "response"
    if whole and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"record {at['warc-record-id']} is damaged")
    return {"page_id": page_of(at["warc-record-id"]), "url": at.get("warc-target-uri"),
            "record_type": at["warc-type"], "payload_bytes": size, "payload_digest": digest.hex(),
            "refers_to": page_of(at["warc-refers-to"]) if not whole else None,
            "payload": payload if whole else None}


# -- archives ------------------------------------------------------------------

def dictionary_of(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """Built from all records given; none where they hold too little to learn."""
    try:
        # segments of 400 bytes found by strings of 8
        return zstandard.train_dictionary(size, records, k=400, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], size: int = DICTIONARY, level: int = LEVEL) -> bytes:
    """The dictionary's frame, then a frame for each record."""
    shared = dictionary_of(records, size)
    out = []
    if shared is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(shared.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at ``at`` ends, found without decompressing."""
    magic = struct.unpack_from("<I", data, at)[0]
    if magic & ~0xF == SKIPPABLE:
        return at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if magic != FRAME:
        raise ValueError("not a Zstandard frame")
    header = data[at:at + 18]
    end = at + zstandard.frame_header_size(header)
    last = False
    while not last:
        block = int.from_bytes(data[end:end + 3], "little")
        last, kind = bool(block & 1), block >> 1 & 3
        end += 3 + (1 if kind == 1 else block >> 3)     # a run is stored as one byte
        if end > len(data):
            raise ValueError("an archive ends within a frame")
    return end + (4 if zstandard.get_frame_parameters(header).has_checksum else 0)


def records_in(data: bytes) -> Iterator[bytes]:
    """All records of an archive, in order."""
    at, press = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic == DICTIONARY_FRAME and at == 0:
            inner = data[at + 8:end]
            if inner.startswith(struct.pack("<I", FRAME)):
                inner = zstandard.ZstdDecompressor().decompress(inner)
            press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(inner))
        elif magic == FRAME:
            yield press.decompress(data[at:end])
        at = end


# -- Spark ---------------------------------------------------------------------

def elected(pages: DataFrame, least: int = 1000, key: str = "page_id", url: str = "url",
            text: str = "html") -> DataFrame:
    """(_id, _url, _payload, _refers): ``_refers`` names the response of a revisit.

    Copies are counted by digest before anything is joined; groups of two and
    more are looked up by a join that spreads a hot group.
    """
    payload = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("_id"),
                        F.col(f"`{url}`").cast("string").alias("_url"), payload.alias("_payload"))
    same = F.when(F.octet_length("_payload") >= least, F.sha2(F.col("_payload"), 256))
    groups = (rows.select("_id", same.alias("_same")).filter("_same IS NOT NULL").groupBy("_same")
              .agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_copies"))
              .filter("_copies > 1"))
    groups = written(groups, "warc-groups")
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("_copies").alias("rows")).first()
    levels = LevelTable(groups, ("_same",), size["n"], size["rows"] or 0, 64 * size["n"])
    if not size["n"]:
        return rows.withColumn("_refers", F.lit(None).cast("long"))
    found = lookup(rows, levels, [same], {"_last": "_refers"}, F.col("_id"))
    return found.withColumn("_refers", F.when(~F.col("_id").eqNullSafe(F.col("_refers")),
                                              F.col("_refers")))


def write_archives(pages: DataFrame, path: str, least: int = 1000, key: str = "page_id",
                   url: str = "url", text: str = "html", date: str = "1970-01-01T00:00:00Z",
                   limit: int = ARCHIVE) -> str:
    """One record per page, in archives below ``path``."""
    def packed(batches):
        held, size = [], 0
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("_id", "_url", "_refers")]
            payloads = b.column("_payload").cast(
                pa.large_binary() if pa.types.is_large_string(b.column("_payload").type)
                else pa.binary())
            for i, (page, at, refers) in enumerate(zip(*columns)):
                body = payloads[i].as_py()
                held.append(record(page, at, body, hashlib.sha1(body).digest(), refers, date))
                size += len(body)
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)])], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)])], ["value"])

    rows = elected(pages, least, key, url, text).mapInArrow(packed, "value binary")
    (rows.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
     .option("lineSep", EMPTY_FRAME.decode()).text(path))
    return path


PAGE = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long")
KINDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
         "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(),
         "payload": pa.binary()}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; the payload of a revisit is null."""
    names = [n for n in KINDS if with_payload or n != "payload"]

    def made(batches):
        for b in batches:
            for data in b.column("content"):
                rows: dict[str, list] = {n: [] for n in names}
                for r in map(parsed, records_in(data.as_py())):
                    for n in names:
                        rows[n].append(r[n])
                yield pa.RecordBatch.from_arrays([pa.array(rows[n], KINDS[n]) for n in names], names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(made, PAGE + (", payload binary" if with_payload else ""))


def archive_report(pages: DataFrame) -> DataFrame:
    """What the archives of all pages hold, once written and read back."""
    spark = pages.sparkSession
    path = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
