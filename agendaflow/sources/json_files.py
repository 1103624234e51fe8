"""JSON documents of any size: written in order as one valid document, read in parallel at top-level entries."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.window import Window

#: Bytes that one task reads of a document, and that are copied at once.
CHUNK_BYTES, COPY_BYTES = 16 << 20, 8 << 20


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)


class Parts(WriterCommitMessage):
    """What a task wrote: its number, and (group, file, elements) in order."""

    def __init__(self, number: int, parts: list[tuple[tuple, str, int]]):
        self.number, self.parts = number, parts


class DocumentWriter(DataSourceWriter):
    """Tasks write their elements as parts; the commit strings the parts of each document together, in the
    order of the tasks, and puts it in place. Tasks that fail or run twice leave parts that are not in
    any document and go with the folder. A document is copied in pieces and never held."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.by = [c for c in options.get("by", "").split(",") if c]
        self.head, self.separator, self.tail = (options.get(k, d).encode() for k, d in (("head", "[\n"), ("separator", ",\n"), ("tail", "\n]\n")))
        self.name = options.get("name", "document.json")
        self.work = f"{self.path}/_parts-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Parts:
        store, _ = _store(self.path)
        work, task = _store(self.work)[1], TaskContext.get()
        parts, out, group, n = [], None, None, 0
        store.create_dir(work)
        for r in rows:
            own = tuple(r[c] for c in self.by)
            if out is None or own != group:
                if out is not None:
                    out.close()
                    parts[-1] = (*parts[-1][:2], n)
                file = f"part-{task.partitionId()}-{task.taskAttemptId()}-{len(parts)}"
                out, group, n = store.open_output_stream(f"{work}/{file}"), own, 0
                parts.append((own, file, 0))
            out.write((self.separator if n else b"") + r["value"].encode())
            n += 1
        if out is not None:
            out.close()
            parts[-1] = (*parts[-1][:2], n)
        return Parts(task.partitionId(), parts)

    def _folder(self, base: str, group: tuple) -> str:
        name = lambda v: "__HIVE_DEFAULT_PARTITION__" if v is None else "".join(c if c.isalnum() or c in " -_.," else f"%{ord(c):02X}" for c in str(v))
        return "/".join([base, *(f"{c}={name(v)}" for c, v in zip(self.by, group))])

    def commit(self, messages: list[Parts]) -> None:
        store, base = _store(self.path)
        work = _store(self.work)[1]
        documents: dict[tuple, list[str]] = {} if self.by else {(): []}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.number):
            for group, file, _ in m.parts:
                documents.setdefault(group, []).append(file)
        store.create_dir(work)
        for k, (group, files) in enumerate(documents.items()):
            whole = f"{work}/whole-{k}"
            with store.open_output_stream(whole) as out:
                out.write(self.head)
                for j, file in enumerate(files):
                    out.write(self.separator if j else b"")
                    with store.open_input_stream(f"{work}/{file}") as part:
                        while piece := part.read(COPY_BYTES):
                            out.write(piece)
                out.write(self.tail)
            folder = self._folder(base, group)
            at = f"{folder}/{self.name}"
            if not self.overwrite and store.get_file_info(at).type != arrow_fs.FileType.NotFound:
                store.delete_dir(work)
                raise FileExistsError(at)
            store.create_dir(folder)
            store.move(whole, at)
        store.delete_dir(work)

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        work = _store(self.work)[1]
        if store.get_file_info(work).type != arrow_fs.FileType.NotFound:
            store.delete_dir(work)


class JsonDocuments(DataSource):
    """``json_document``: rows of JSON texts (column ``value``) as one document, or one for each value of the
    columns ``by``. Options: path, by, head, separator, tail, name."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), schema.names, overwrite)


def write_document(rows: DataFrame, path: str, *order, by: tuple[str, ...] = (), overwrite: bool = True, **options: str) -> None:
    """``value`` of the rows, in the order of the columns ``order``, as one JSON array in ``<path>/document.json``,
    or with ``by`` as one below ``<path>/<column>=<value>/`` for each value. ``head``, ``separator`` and ``tail``
    make other documents; no rows make an empty one without ``by``.

    Rows are sorted by ranges, so a document of any size is written by many tasks; nulls are left out.
    """
    rows.sparkSession.dataSource.register(JsonDocuments)
    chosen = rows.where("value IS NOT NULL").sort(*by, *order).select(*by, "value")
    chosen.write.format("json_document").mode("overwrite" if overwrite else "append").options(path=path, by=",".join(by), **options).save()


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Which bytes are quotes that begin or end a string: those after an even number of backslashes, of which
    ``before`` stand at the end of what comes before."""
    quotes = np.flatnonzero(data == 34)
    other = np.maximum.accumulate(np.where(data != 92, np.arange(len(data)), -1)) if len(data) else np.zeros(0, int)
    last = other[quotes - 1]  # of the bytes before each quote the last that is no backslash
    run = np.where(quotes == 0, before, np.where(last < 0, quotes + before, quotes - 1 - last))
    out = np.zeros(len(data), bool)
    out[quotes[run % 2 == 0]] = True
    return out


def _levels(data: np.ndarray) -> np.ndarray:
    return ((data == 123) | (data == 91)).astype(np.int64) - ((data == 125) | (data == 93))


def _read(file, start: int, n: int) -> np.ndarray:
    file.seek(start)
    return np.frombuffer(file.read(n), np.uint8)


def _backslashes(file, at: int) -> int:
    """How many backslashes end right before ``at``."""
    n = 0
    while at - n > 0:
        data = _read(file, max(0, at - n - 4096), min(4096, at - n))
        other = np.flatnonzero(data != 92)
        if len(other):
            return n + len(data) - 1 - int(other[-1])
        n += len(data)
    return n


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk: whether it has an odd number of quotes, and how far levels rise if it starts outside
    of a string and if inside."""
    for batch in batches:
        rows = []
        for path, start, n in zip(*(batch[c].to_pylist() for c in ("path", "start", "bytes"))):
            store, at = _store(path)
            with store.open_input_file(at) as file:
                data, back = _read(file, start, n), _backslashes(file, start)
            odd = np.cumsum(_quotes(data, back)) % 2
            levels = _levels(data)
            rows.append((int(odd[-1]) if len(odd) else 0, int(levels[odd == 0].sum()), int(levels[odd == 1].sum())))
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch["path"], batch["start"], batch["bytes"], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "start", "bytes", "odd", "outside", "inside"])


def _marks(data: np.ndarray, back: int, inside: int, level: int) -> tuple[list[int], int, int]:
    """Where top-level entries begin or end: after the bracket that opens a document, at commas of its own
    level, at the bracket that closes it; and whether the bytes end in a string, and at which level."""
    outside = (np.cumsum(_quotes(data, back)) + inside) % 2 == 0
    rise = np.where(outside, _levels(data), 0)
    depth = level + np.cumsum(rise)
    marks = outside & (((data == 44) & (depth == 1)) | ((rise > 0) & (depth == 1)) | ((rise < 0) & (depth == 0)))
    return np.flatnonzero(marks).tolist(), int(not outside[-1]), int(depth[-1])


def _entries(piece: int):
    """The texts of the entries that begin in each chunk; the last is read on, ``piece`` bytes at a time."""

    def texts(file, start: int, n: int, inside: int, level: int) -> Iterator[str]:
        data, back, own, held = _read(file, start, n), _backslashes(file, start), True, None
        while len(data):
            marks, inside, level = _marks(data, back, inside, level)
            at = 0
            for k in marks:
                if held is not None:
                    if text := (held + data[at:k].tobytes()).decode().strip():
                        yield text
                    if not own:
                        return
                at, held = k + 1, None if data[k] in (125, 93) else b""
            if held is None:
                return
            held += data[at:].tobytes()
            start, own = start + len(data), False
            back = _backslashes(file, start)
            data = _read(file, start, piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *chunk in zip(*(batch[c].to_pylist() for c in ("path", "start", "bytes", "in_string", "level"))):
                store, at = _store(path)
                with store.open_input_file(at) as file:
                    some, size = [], 0
                    for text in texts(file, *chunk):
                        some.append(text)
                        size += len(text)
                        if size > COPY_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["value"])
                            some, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["value"])

    return run


def top_level_texts(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The texts of the top-level entries of JSON documents, objects or arrays: ``value``. ``path`` is a file, or
    a folder of ``.json`` files.

    A document is cut into chunks of bytes. A first pass tells for each chunk whether quotes are odd and how
    brackets balance if it starts inside of a string or outside; running sums over the chunks then tell how each
    one starts. A second pass reads the entries that begin in each chunk, the last of them to its end. So one
    document is read by as many tasks as it has chunks, and none is held.
    """
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.is_file else [f for f in store.get_file_info(arrow_fs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(".json") and "/_" not in f.path[len(at) :]]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    sizes = spark.createDataFrame([(prefix + f.path, f.size) for f in files], "path string, size long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(chunk).cast("long")))
    chunks = sizes.where("size > 0").select("path", "size", starts.alias("start")).select("path", "start", F.least(F.lit(chunk).cast("long"), F.col("size") - F.col("start")).alias("bytes"))
    tasks = max(1, sum(-(-f.size // chunk) for f in files))
    chunks = chunks.repartition(tasks, "path", "start")
    seen = chunks.mapInArrow(_summaries, "path string, start long, bytes long, odd int, outside long, inside long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = seen.withColumn("in_string", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    state = state.withColumn("rise", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    state = state.withColumn("level", F.coalesce(F.sum("rise").over(before), F.lit(0))).select("path", "start", "bytes", "in_string", "level")
    return state.repartition(tasks, "path", "start").mapInArrow(_entries(chunk), "value string")


def read_large_map(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """key and value of the entries of JSON objects, in many tasks each: strings as they are, other values as
    their JSON text, null for null. Keys that a document repeats give a row each."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for batch in batches:
            keys, values = [], []
            for text in batch["value"].to_pylist():
                key, end = decoder.raw_decode(text)
                value = text[end:].lstrip()[1:].strip()
                keys.append(key)
                values.append(json.loads(value) if value.startswith('"') else None if value == "null" else value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])

    return top_level_texts(spark, path, chunk).mapInArrow(split, "key string, value string")


def read_large_array(spark: SparkSession, path: str, schema: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The elements of JSON arrays as rows of a schema (DDL), in many tasks each."""
    return top_level_texts(spark, path, chunk).select(F.from_json("value", schema).alias("e")).select("e.*")
