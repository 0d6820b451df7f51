"""Binary token files: Simple-8b coded ids with a document index.

Layout of a file, all integers little-endian: the magic bytes, then eight 64-bit
counts (version, block size, documents, ids, blocks, words, escapes, null document
ids), then document ids (int64), document lengths, word offsets by block, escape
offsets by block, words, escapes and the places of null document ids (all 64-bit),
then a 32-bit checksum of everything before it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from supplyloom.llm import simple8b
from supplyloom.llm.files import qualified, write_file
from supplyloom.llm.sampling import slices
from supplyloom.llm.tokens import CHARS_AT_ONCE, with_ends, word_encoder
from supplyloom.sources.storage import fresh_path

MAGIC = b"S8BTOK\x01\x00"
SUFFIX = ".s8b"
#: A task closes a file and opens the next at so many ids.
IDS_PER_FILE = 4_000_000
BLOCK = 1024


def pack_file(ids: list[int | None], lengths: np.ndarray | list[int], values: np.ndarray, block: int = BLOCK) -> bytes:
    """The bytes of one file; null ids are marked and stored as 0."""
    coded = simple8b.encode(values, block)
    nulls = np.array([i is None for i in ids], dtype=np.uint8)
    head = np.array(
        [1, block, len(ids), coded.n, len(coded.word_offsets) - 1, len(coded.words), len(coded.escapes), int(nulls.sum())],
        dtype="<u8",
    )
    body = b"".join(
        [
            MAGIC,
            head.tobytes(),
            np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
            np.asarray(lengths).astype("<u8").tobytes(),
            coded.word_offsets.astype("<u8").tobytes(),
            coded.escape_offsets.astype("<u8").tobytes(),
            coded.words.astype("<u8").tobytes(),
            coded.escapes.astype("<u8").tobytes(),
            np.flatnonzero(nulls).astype("<u8").tobytes(),
        ]
    )
    return body + zlib.crc32(body).to_bytes(4, "little")


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, simple8b.Coded]:
    """(document ids, lengths, coded ids) of a file; a damaged one raises."""
    if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a whole token file")
    head = np.frombuffer(data, dtype="<u8", count=8, offset=8).astype(np.int64)
    _, block, docs, n, blocks, words, escapes, nulls = head.tolist()
    at = 8 + 64

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, dtype=kind, count=count, offset=at)
        at += 8 * count
        return out

    ids: list[int | None] = take(docs, "<i8").tolist()
    lengths = take(docs, "<u8").astype(np.int64)
    word_offsets = take(blocks + 1, "<u8").astype(np.int64)
    escape_offsets = take(blocks + 1, "<u8").astype(np.int64)
    coded = simple8b.Coded(n, block, take(words, "<u8"), word_offsets, take(escapes, "<u8"), escape_offsets)
    for k in take(nulls, "<u8").tolist():
        ids[k] = None
    return ids, lengths, coded


MANIFEST = "file string, part int, piece int, docs long, ids long, bytes long"


def write_token_files(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids_per_file: int = IDS_PER_FILE,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending id order.

    Rows are range-partitioned by id, then by text and place, so the files of part p
    hold no larger ids than those of part p + 1; nulls come first, and rows that repeat
    an id follow each other, over several parts if they are many.  A null or empty text is the end id alone.  A task holds no more
    than one file's ids, or one document's.  Files carry names of their own per
    attempt; those of attempts that count are listed in the manifest, which is
    stored in the folder too and returned.
    """
    spark = df.sparkSession
    target = qualified(spark, folder)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = word_encoder(tokenizer)
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held, piece = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, piece
            data = pack_file(ids, np.concatenate(lengths), np.concatenate(values))
            name = f"part-{part:06d}-{piece:05d}-{uuid.uuid4().hex}{SUFFIX}"
            write_file(target, name, data)
            row = pa.RecordBatch.from_pylist(
                [{"file": name, "part": part, "piece": piece, "docs": len(ids), "ids": held, "bytes": len(data)}],
                schema=pa.schema(
                    [("file", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]
                ),
            )
            ids.clear(), lengths.clear(), values.clear()
            held, piece = 0, piece + 1
            return row

        for batch in (some for whole in batches for some in slices(whole, 1, CHARS_AT_ONCE)):
            docs = batch.column(0).to_pylist()
            made, size = with_ends(*encoder.batch(batch.column(1)), end_id)
            ends = np.cumsum(size)
            a = 0
            while a < len(docs):
                # A file ends with the text that fills it.
                begin = int(ends[a] - size[a])
                b = min(len(docs), int(np.searchsorted(ends, begin + ids_per_file - held)) + 1)
                ids += docs[a:b]
                lengths.append(size[a:b])
                values.append(made[begin : ends[b - 1]])
                held += int(ends[b - 1]) - begin
                a = b
                if held >= ids_per_file:
                    yield close()
        if ids:
            yield close()

    # Rows that share an id are dealt by their text and place, so a hot id is no hot task.
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text"), F.col("_row")]
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
    ordered.mapInArrow(encode, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


DECODED = "file string, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decode all files that the manifest lists: one row per document.

    ``start`` counts the ids of all documents before it.  The ids before a file
    are summed from the manifest: within its part, and over the parts before it.
    A listed file that is damaged raises; what a lost task left is passed over.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    inside = Window.partitionBy("part").orderBy("piece")
    parts = manifest.groupBy(F.col("part").alias("_part")).agg(F.sum("ids").alias("_sum"))
    earlier = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    local = manifest.select(
        F.col("file").alias("_file"), "part", (F.sum("ids").over(inside) - F.col("ids")).alias("_inside")
    )
    bases = local.join(earlier, F.col("part") == F.col("_part")).select(
        "_file", (F.col("_inside") + F.col("_before")).alias("_base")
    )

    decoded = pa.schema(
        [("file", pa.string()), *((c, pa.int64()) for c in ("place", "doc_id", "start", "n_tokens", "ids_crc32"))]
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    ids, lengths, coded = unpack_file(data.as_py())
                except ValueError:
                    # Whether it counts is known after the join with the manifest.
                    damaged = {"file": name, "place": -1, "doc_id": None, "start": 0, "n_tokens": 0, "ids_crc32": 0}
                    yield pa.RecordBatch.from_pylist([damaged], schema=decoded)
                    continue
                values = simple8b.decode_ids(coded)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(ids), pa.string()),
                        pa.array(np.arange(len(ids))),
                        pa.array(ids, pa.int64()),
                        pa.array(starts),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{SUFFIX}")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )
    rows = files.mapInArrow(decode, DECODED)
    damage = F.raise_error(F.concat(F.lit("damaged token file "), F.col("_file"))).cast("boolean")
    listed = rows.join(bases, F.col("file") == F.col("_file"))
    # The condition reads both sides, so it stays behind the join.
    return listed.filter(F.when((F.col("place") < 0) & (F.col("_base") >= 0), damage).otherwise(True)).select(
        "doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digest(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of a table to the shared folder and read them back."""
    spark = df.sparkSession
    folder = fresh_path(spark, "tokens")
    write_token_files(df, folder, tokenizer, end_id)
    return read_token_files(spark, folder)
