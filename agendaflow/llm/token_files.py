"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import bounded_batches, released
from .tokens import default_tokenizer_path, encoder

END_ID = 0
#: Bytes of text that one range of ids, so one file, is to hold, and the most files, beyond which they grow.
FILE_BYTES = 24 << 20
MOST_FILES = 100_000
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(16 << 20),
    "orc.encoding.strategy": "SPEED",
    "compression": "lz4",
}


def _list_array(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """ORC files of (doc_id, part, start_in_part, n_tokens, ids) by ranges of ascending doc_id; a part is a
    range, in one file or, under a limit of records a file, in several.

    Whole texts are dealt by ranges of doc_id before they are encoded, so ids are never shuffled. Null
    text encodes as empty; a null doc_id sorts first; rows that repeat a doc_id stay together in any
    order of their own. An empty table makes an empty file.
    """
    tokenizer = tokenizer or default_tokenizer_path()
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, min(MOST_FILES, int(np.ceil(size / file_bytes))))
    ordered = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                ids, at = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(before + at[:-1]), pa.array(np.diff(at)), _list_array(ids, at)],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                before += int(at[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    files = ordered.mapInArrow(released(encode), f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids array<int>")
    with bounded_batches(docs.sparkSession):
        files.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files.

    Stripes are read in parallel. The offset of each part is a running sum over one row a part, of which
    there are at most MOST_FILES; only the counts are read for it.
    """
    table = spark.read.schema(spark.read.orc(path).schema).orc(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # parts are numbered in the order of the ranges
    before = parts.select("part", F.expr("coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)").alias("before"))
    return table.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The stored rows of some ids; the filter reaches the ORC reader, which skips stripes and row groups
    by their statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_crc32(table: DataFrame, ids: str = "ids", out: str = "ids_crc32") -> DataFrame:
    """``table`` without ``ids`` and with the unsigned CRC-32 of them as little-endian 32-bit integers."""
    rest = [f for f in table.schema.fields if f.name != ids]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{out}` long"])

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch[ids]
            flat = np.asarray(col.values).astype("<u4", copy=False)
            at = np.asarray(col.offsets).tolist()
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in rest), pa.array(sums, pa.int64())], [*(f.name for f in rest), out])

    return table.mapInArrow(released(crc), schema)
