"""WARC records in ZIP archives: written by tasks into the shared folder, read back by ranges without extraction.

An archive is a ZIP file with two stored (uncompressed) members: ``archive/data.warc.gz``, a warcinfo record and then the pages'
records, each a gzip member of its own, and ``indexes/index.cdx``, one line a page's record with its place in the WARC member.
A response holds a short HTTP header and the page; a revisit has the profile of equal payload digests and names the URN of the
page that it refers to. Archives are written with ZIP64
sizes, so they may pass 4 GiB. Each task writes one archive under a name of its own attempt; only names that successful
tasks return are read, so files of lost attempts do no harm.

The reader parses the end record, the ZIP64 locator and end record if there are, and the central directory with ZIP64
extra fields, takes the members' data from their local headers, and reads the index alone. The index is cut into runs of
records, which are dealt over all tasks, and each task reads its ranges only.

Of records with equal payloads of at least ``MIN_BYTES`` bytes, those of the smallest page_id are responses and the others
revisits of it, without a payload of their own. A null html is an empty payload. Repeated rows of the smallest page_id are
responses each. A null page_id counts as larger than any. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import checkpoint, remove, scratch

MIN_BYTES, RUN_RECORDS, TAIL = 100, 256, 22 + (1 << 16)
#: Fixed parts of records: the HTTP header of a payload and the profile of a revisit.
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"

#: Fixed layouts of the ZIP format (little-endian), after their four-byte signatures.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_FIELDS, LOCATOR_FIELDS, END64_FIELDS = "<4H2LH", "<LQL", "<Q2H2L4Q"
CENTRAL_FIELDS, LOCAL_FIELDS = "<6H3L5H2L", "<5H3L2H"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file's store and its place there. Local folders come as ``/x``, ``file:/x`` or ``file:///x``."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def _page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _compressed(head: list[str], block: bytes) -> bytes:
    """A WARC record with an id of its own, as a gzip member."""
    head = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", *head, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _info() -> bytes:
    return _compressed(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The record of a page. One without a url has the page's URN as its target."""
    uri = " ".join((url or "").split()).encode("utf-8", "replace").decode() or _page_urn(page_id)
    head = [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Page: {_page_urn(page_id)}"]
    if refers_to is None:
        return _compressed(["WARC-Type: response", *head], HTTP_HEAD + payload)
    return _compressed(["WARC-Type: revisit", f"WARC-Profile: {SAME_PAYLOAD}", f"Refers-To-Page: {_page_urn(refers_to)}", *head], HTTP_HEAD)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one compressed record."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, partitions: int | None = None) -> DataFrame:
    """path, records: the archives of all rows of ``pages`` (page_id, url, html), written into ``folder``."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    #: Payloads that come more than once; the counting is combined before rows are dealt by digest.
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keys.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).distinct()
    again = again.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first_id")
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        path = f"{folder}/{uuid.uuid4().hex}.zip"
        fs, place = _open(path)
        info = _info()
        index, at = [], len(info)
        with fs.open_output_stream(place) as raw, zipfile.ZipFile(_Unseekable(raw), "w", zipfile.ZIP_STORED) as out:
            with out.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True) as member:
                member.write(info)
                while head is not None:
                    for page_id, url, payload, digest, refers_to in zip(*(head.column(k).to_pylist() for k in range(5)), strict=True):
                        data = _record(page_id, url, payload, digest, refers_to)
                        member.write(data)
                        index.append(f"{at} {len(data)}\n")
                        at += len(data)
                    head = next(batches, None)
            with out.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as member:
                for line in index:
                    member.write(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], ["path", "records"])

    return checkpoint(joined.select("page_id", "url", "payload", "digest", "first_id").mapInArrow(run, "path string, records long"))


class _Unseekable(io.RawIOBase):
    """What zipfile needs of a stream that can only be written on."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        if not self.out.closed:
            self.out.flush()


def _wide(extra: bytes, values: list[int], marks: list[int]) -> list[int]:
    """Values of a central entry, those at their mark taken from the ZIP64 extra field in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == 1:
            inner, place = extra[at + 4 : at + 4 + size], 0
            for k, mark in enumerate(marks):
                if values[k] == mark:
                    (values[k],) = struct.unpack_from("<Q" if mark > 0xFFFF else "<L", inner, place)
                    place += 8 if mark > 0xFFFF else 4
        at += 4 + size
    return values


def members(file: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """method, data offset and stored size of each member of a ZIP file."""
    size = file.size()
    start = max(0, size - TAIL - 20)
    file.seek(start)
    tail = file.read(size - start)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    *_, count, _, offset, _ = struct.unpack_from(END_FIELDS, tail, end + 4)
    length = struct.unpack_from(END_FIELDS, tail, end + 4)[4]
    if tail[max(0, end - 20) : end][:4] == LOCATOR64:
        _, place, _ = struct.unpack_from(LOCATOR_FIELDS, tail, end - 16)
        file.seek(place)
        record = file.read(56)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        *_, count, length, offset = struct.unpack_from(END64_FIELDS, record, 4)
    file.seek(offset)
    directory = file.read(length)
    found, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        _, _, _, method, _, _, _, stored, full, n_name, n_extra, n_note, _, _, _, local = struct.unpack_from(CENTRAL_FIELDS, directory, at + 4)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        full, stored, local = _wide(extra, [full, stored, local], [0xFFFFFFFF] * 3)
        file.seek(local)
        head = file.read(30)
        if head[:4] != LOCAL:
            raise ValueError("no local header where the directory points")
        a, b = struct.unpack_from(LOCAL_FIELDS, head, 4)[8:]
        found[name] = (method, local + 30 + a + b, stored)
        at += 46 + n_name + n_extra + n_note
    return found


def read_archives(archives: DataFrame, run_records: int = RUN_RECORDS) -> DataFrame:
    """One row a record of the archives (path): page_id, url, record_type, refers_to, digest (as the record says), payload."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = _open(path)
                with fs.open_input_file(place) as file:
                    found = members(file)
                    if any(found[m][0] for m in (WARC_MEMBER, INDEX_MEMBER)):
                        raise ValueError(f"{path}: only stored members can be read by ranges")
                    _, at, size = found[INDEX_MEMBER]
                    file.seek(at)
                    entries = [tuple(map(int, line.split())) for line in file.read(size).splitlines()]
                base = found[WARC_MEMBER][1]
                runs = [entries[k : k + run_records] for k in range(0, len(entries), run_records)]
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int64())]
                columns = [[path] * len(runs), [base + r[0][0] for r in runs], [[n for _, n in r] for r in runs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "lengths"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, place = _open(path)
                rows = []
                with fs.open_input_file(place) as file:
                    file.seek(start)
                    for n in lengths:
                        h, payload = parse_record(file.read(n))
                        ident = lambda key: (lambda v: int(v) if v else None)(h.get(key, "").removeprefix("urn:page:"))  # noqa: B023, E731
                        rows.append((ident("page"), h["warc-target-uri"], h["warc-type"], ident("refers-to-page"), h["warc-payload-digest"].removeprefix("sha256:"), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = archives.select("path").repartition(parts).mapInArrow(plan, "path string, start long, lengths array<long>")
    schema = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"
    return runs.repartition(parts).mapInArrow(fetch, schema)


def verified(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from records as read: of a response from the payload itself,
    of a revisit from the response that it refers to, whose digest must be the one that the revisit names."""
    seen = F.sha2("payload", 256)
    broken = F.raise_error(F.concat(F.lit("payload and digest differ: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    rows = records.select("page_id", "record_type", "refers_to", "digest", F.when((F.col("record_type") == "revisit") | (seen == F.col("digest")), F.octet_length("payload").cast("long")).otherwise(broken.cast("long")).alias("n"))
    rows = checkpoint(rows)
    answers = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("p"), F.col("digest").alias("d")).agg(F.max("n").alias("n_full"))
    revisits = rows.where("record_type = 'revisit'").join(answers, (F.col("refers_to") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    full = F.coalesce("n_full", F.raise_error(F.lit("a revisit refers to no response")).cast("long"))
    out = lambda n: [F.col("page_id"), n.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("record_type"), F.col("refers_to")]
    return rows.where("record_type = 'response'").select(*out(F.col("n"))).unionByName(revisits.select(*out(full)))


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write all pages to archives in a new folder of the shared one, read them back, and delete them."""
    folder = scratch(pages.sparkSession, "warc")
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    #: The archives have been read whole when this is there; what is left to do works on digests that are written.
    out = verified(read_archives(write_archives(pages, folder, min_bytes)))
    remove(pages.sparkSession, folder)
    return out
