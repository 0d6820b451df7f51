"""WARC archives compressed with Zstandard: one frame a record, a shared dictionary.

An archive begins with a skippable frame that holds the dictionary of all its other
frames.  Each of those is one record: version line, header fields, an empty line, the
block, and two line breaks.  A response's block is an HTTP head and the payload; a
revisit's block is the HTTP head alone, which still states the payload's length, and
its header names the response that has the payload.

The reader walks the frames of an archive by their block headers, decodes them one by
one and checks what it finds: lengths of frame, block and payload, required fields,
payload digests, and what a revisit refers to.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from supplyloom.llm.files import qualified, write_file
from supplyloom.llm.sampling import slices
from supplyloom.sources.storage import fresh_path

SUFFIX = ".warc.zst"
#: Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are never revisits.
LEAST_SHARED = 100
#: Pages (about, at most) and bytes of each page that the dictionary is trained on, and its size.
TRAIN_PAGES, TRAIN_BYTES, DICTIONARY_BYTES = 500, 16_384, 32_768
#: A task closes an archive and opens the next at so many bytes of records.
BYTES_PER_ARCHIVE = 64_000_000
#: The tables have no time of capture.
DATE = "1970-01-01T00:00:00Z"


class DamagedArchive(ValueError):
    """An archive that breaks the format; says where."""


@dataclass
class Record:
    kind: str
    fields: dict[str, str]
    block: bytes
    offset: int = 0
    payload: bytes | None = None
    payload_bytes: int = 0


def record_bytes(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"{VERSION}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def record_uri(page: int | None, row: int) -> str:
    """The record id of a page: its number and that of its row, which may repeat a page."""
    return f"<urn:x-page:{'' if page is None else page}:{row}>"


def page_record(page: int | None, row: int, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit where ``refers_to`` names another record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_uri(page, row), "WARC-Date": DATE}
    if url is not None:
        # Spaces, line breaks and all else that may not stand in a field are escaped.
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    fields |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        fields |= {"WARC-Profile": IDENTICAL_PAYLOAD, "WARC-Refers-To": refers_to}
    return record_bytes(fields, http + payload if refers_to is None else http)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or none (empty) where the samples are too few for one."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s], k=1000, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(maxsize=8)
def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class ArchiveWriter:
    """Collects the frames of one archive."""

    def __init__(self, dictionary: bytes = b"", level: int = 3):
        options = {"dict_data": _dictionary(dictionary)} if dictionary else {}
        self._frame = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True, **options).compress
        self.frames = [struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary]
        self.records = self.held = 0
        name = f"<urn:uuid:{uuid.uuid4()}>"
        self._add({"WARC-Type": "warcinfo", "WARC-Record-ID": name, "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")

    def _add(self, fields: dict[str, str], block: bytes) -> None:
        self.frames.append(self._frame(record_bytes(fields, block)))

    def page(self, *what) -> None:
        made = page_record(*what)
        self.frames.append(self._frame(made))
        self.records += 1
        self.held += len(made)

    def data(self) -> bytes:
        return b"".join(self.frames)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its headers alone."""
    try:
        size = zstandard.frame_header_size(data[at : at + 18])
        checksum = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
    except zstandard.ZstdError as error:
        raise DamagedArchive(f"no frame at byte {at}: {error}") from None
    at += size
    last = False
    while not last:
        if at + 3 > len(data):
            raise DamagedArchive(f"the archive ends inside a frame at byte {at}")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, length = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else length)
    at += 4 if checksum else 0
    if at > len(data):
        raise DamagedArchive("the archive ends inside a frame")
    return at


def _leading_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """(dictionary, place of the first record) of an archive."""
    if len(data) < 8 or int.from_bytes(data[:4], "little") != SKIPPABLE_DICTIONARY:
        return None, 0
    end = 8 + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise DamagedArchive("the archive ends inside its dictionary")
    held = bytes(data[8:end])
    if held.startswith(ZSTD_FRAME):  # a dictionary may be compressed itself
        held = zstandard.ZstdDecompressor().decompress(held)
    return _dictionary(held), end


def parse_record(raw: bytes, offset: int) -> Record:
    """One record, checked: header lines, required fields, and all lengths."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise DamagedArchive(f"no record head at byte {offset}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name.lower() in fields:
            raise DamagedArchive(f"bad header line at byte {offset}: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(needed):
            raise DamagedArchive(f"no {needed} at byte {offset}")
    if not fields["content-length"].isdigit():
        raise DamagedArchive(f"bad content-length at byte {offset}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise DamagedArchive(f"the block at byte {offset} is not {size} bytes long")
    made = Record(fields["warc-type"], fields, rest[:size], offset)
    if made.kind in ("response", "revisit"):
        _check_page(made)
    return made


def _check_page(made: Record) -> None:
    http, mark, payload = made.block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?mi)^content-length: *(\d+)\r?$", http)
    digest = made.fields.get("warc-payload-digest", "")
    if not mark or not http.startswith(b"HTTP/") or not stated or not re.fullmatch("sha256:[0-9a-f]{64}", digest):
        raise DamagedArchive(f"no HTTP head or payload digest at byte {made.offset}")
    made.payload_bytes = int(stated[1])
    if made.kind == "response":
        if len(payload) != made.payload_bytes or hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise DamagedArchive(f"the payload at byte {made.offset} is not the one that its header states")
        made.payload = payload
    elif payload or made.fields.get("warc-profile") != IDENTICAL_PAYLOAD or not made.fields.get("warc-refers-to"):
        raise DamagedArchive(f"the revisit at byte {made.offset} has a payload or refers to nothing")


def read_archive(data: bytes) -> Iterator[Record]:
    """All records of an archive in their order; holds one decoded record at a time."""
    view = memoryview(data)
    dictionary, at = _leading_dictionary(view)
    decode = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {})).decompress
    while at < len(view):
        end = frame_end(view, at)
        size = zstandard.frame_content_size(view[at : at + 18])
        if size < 0:
            raise DamagedArchive(f"the frame at byte {at} does not state its length")
        try:
            raw = decode(view[at:end])
        except zstandard.ZstdError as error:
            raise DamagedArchive(f"the frame at byte {at} can't be decoded: {error}") from None
        if len(raw) != size:
            raise DamagedArchive(f"the frame at byte {at} is not {size} bytes long")
        yield parse_record(raw, at)
        at = end


MANIFEST = "file string, records long, bytes long"


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_shared: int = LEAST_SHARED,
    bytes_per_archive: int = BYTES_PER_ARCHIVE,
) -> DataFrame:
    """Write one record per row and return the manifest: file, records, bytes.

    Of the rows with equal payloads (by SHA-256) of at least ``least_shared`` bytes, the
    one with the smallest id is a response and the others are revisits of it; ids that
    are null come last, and of rows that repeat the id one is the response.  All other
    rows are responses.  A task holds the records of one archive, or one longer record.
    Archives carry names of their own per attempt; the manifest, stored in the folder
    too, lists those that count.
    """
    spark = pages.sparkSession
    target = qualified(spark, folder)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"row": F.monotonically_increasing_id(), "digest": F.sha2("payload", 256)})
    # Stored once, since both readers must see the same row numbers; pages pack well.
    stored = fresh_path(spark, "warc-pages")
    keyed.write.option("compression", "zstd").parquet(stored)
    keyed = spark.read.schema(keyed.schema).parquet(stored)
    order = F.struct(F.col("page_id").isNull().alias("null"), F.col("page_id").alias("page"), F.col("row").alias("row"))
    shared = keyed.filter(F.length("payload") >= least_shared).groupBy(F.col("digest").alias("_digest"))
    # Only payloads with copies are looked up; most pages have none.
    heads = shared.agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marked = keyed.join(heads, F.col("digest") == F.col("_digest"), "left")
    known = marked.select("page_id", "row", "url", "payload", "digest", F.col("head.page").alias("head_page"), F.col("head.row").alias("head_row"))
    # One page in so many, by hash, so no task sends more than its share.
    share = max(1, -(-keyed.count() // TRAIN_PAGES))
    sample = keyed.filter((F.pmod(F.xxhash64("row"), F.lit(share)) == 0) & (F.length("payload") > 0))
    dictionary = train([bytes(r[0]) for r in sample.select(F.substring("payload", 1, TRAIN_BYTES)).collect()])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: ArchiveWriter) -> pa.RecordBatch:
            data, name = held.data(), f"{uuid.uuid4().hex}{SUFFIX}"
            write_file(target, name, data)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([held.records], pa.int64()), pa.array([len(data)], pa.int64())], names=["file", "records", "bytes"]
            )

        held = ArchiveWriter(dictionary)
        for batch in (part for whole in batches for part in slices(whole, 3)):
            page, row, url, _, digest, head_page, head_row = (None if k == 3 else c.to_pylist() for k, c in enumerate(batch.columns))
            for k, data in enumerate(batch.column(3)):
                original = None if head_row[k] is None or head_row[k] == row[k] else record_uri(head_page[k], head_row[k])
                held.page(page[k], row[k], url[k], data.as_py(), digest[k], original)
                if held.held >= bytes_per_archive:
                    yield close(held)
                    held = ArchiveWriter(dictionary)
        if held.records:
            yield close(held)

    known.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORDS = "file string, offset long, record_id string, record_type string, refers_to_record string, target_uri string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Response and revisit records of the archives that the manifest lists.

    Columns: file, offset, record_id, record_type, refers_to_record, target_uri,
    payload_bytes, payload_digest (of the payload itself for a response, as its header
    states for a revisit) and payload (null for a revisit, or if not asked for).  A
    listed archive that is damaged raises; what a lost task left is passed over.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, held = [], 0
                for r in read_archive(data.as_buffer()):
                    if r.kind not in ("response", "revisit"):
                        continue
                    get = r.fields.get
                    out.append((name, r.offset, get("warc-record-id"), r.kind, get("warc-refers-to"), get("warc-target-uri"), r.payload_bytes, get("warc-payload-digest")[7:], r.payload if payloads else None))
                    held += len(r.payload or b"") if payloads else 0
                    if len(out) >= 5_000 or held >= 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select(F.col("file").alias("_file"))
    # What no manifest row names is never decoded.
    return files.join(listed, F.col("file") == F.col("_file"), "left_semi").mapInArrow(read, RECORDS)


def dangling_revisits(records: DataFrame) -> DataFrame:
    """Revisits whose response is missing or has another payload."""
    held = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")
    )
    asked = records.filter("record_type = 'revisit'").join(held, F.col("refers_to_record") == F.col("_id"), "left")
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    return asked.filter(~F.coalesce(same, F.lit(False))).drop("_id", "_digest", "_bytes")


def warc_digest(pages: DataFrame, **options) -> DataFrame:
    """Write the archives of a table to the shared folder and read them back.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.
    A null payload is empty, a null url is left out, repeated rows are records of
    their own, an empty table gives no archive and no rows, and columns beside the
    three named are not read.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    manifest = write_archives(pages, folder, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d*):\d+>$", 1).try_cast("long")
    return read_archives(spark, folder, payloads=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_record").alias("refers_to")
    )
