"""Token ids in Arrow IPC files of fixed-size-list batches.

A shard holds the ids of a range of documents, cut into sequences of equal length with a mask that is false on the last
sequence's padding. Batches have a fixed number of sequences, so a position's batch and place follow by division, and a
memory-mapped reader gets it without copying or reading what lies before. Where documents start is kept in an index file
beside the shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.ordering import bucket_bounds, bucket_of
from tessella.llm.tokens import task_encoder, vocabulary_path
from tessella.runtime import shared_path

LENGTH, BATCH, END_ID = 2048, 256, 2
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def id_type(ids: int) -> pa.DataType:
    """The narrowest unsigned type for a vocabulary of so many ids."""
    return pa.uint16() if ids <= 1 << 16 else pa.uint32()


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; Hadoop's names for object stores are taken too."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfss"}.get(scheme, scheme) + mark + rest if mark else folder)


class ShardWriter:
    """Writes one shard and its index under temporary names; close() gives them their own, so a repeated task can't leave halves."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int = LENGTH, batch: int = BATCH):
        self.files, root = file_system(folder)
        self.files.create_dir(root, recursive=True)
        self.path, self.index_path = f"{root}/{name}.arrow", f"{root}/{name}.index.arrow"
        self.mark, self.kind, self.length, self.batch = f".{uuid.uuid4().hex}.tmp", kind, length, batch
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.streams = [self.files.open_output_stream(p + self.mark) for p in (self.path, self.index_path)]
        self.data, self.index = pa.ipc.new_file(self.streams[0], self.schema), pa.ipc.new_file(self.streams[1], INDEX)
        self.waiting, self.waits, self.rows, self.total = [], 0, [], 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """A document's ids, 32 bits each."""
        n = len(raw) // 4
        self.rows.append((doc_id, self.total, n))
        self.total += n
        self.waiting.append(raw)
        self.waits += n
        if self.waits >= self.length * self.batch:
            self._flush(False)
        if len(self.rows) >= 50_000:
            self._flush_index()

    def _flush(self, end: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype=np.uint32).astype(self.kind.to_pandas_dtype())
        step = self.length * self.batch
        whole = len(ids) if end else len(ids) // step * step
        for at in range(0, whole, step):
            part = ids[at : min(at + step, whole)]
            padded = np.zeros(-(-len(part) // self.length) * self.length, dtype=part.dtype)
            padded[: len(part)] = part
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, np.arange(len(padded)) < len(part))]
            self.data.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.waiting = [ids[whole:].astype(np.uint32).tobytes()]
        self.waits = len(ids) - whole

    def _flush_index(self) -> None:
        columns = [pa.array(c, type=pa.int64()) for c in zip(*self.rows, strict=True)]
        self.index.write_batch(pa.RecordBatch.from_arrays(columns, schema=INDEX))
        self.rows = []

    def close(self) -> None:
        self._flush(True)
        if self.rows:
            self._flush_index()
        for w in (self.data, self.index, *self.streams):
            w.close()
        for p in (self.path, self.index_path):
            self.files.move(p + self.mark, p)


    def discard(self) -> None:
        """Remove what a failed task has written."""
        for w in self.streams:
            w.close()
        for p in (self.path, self.index_path):
            if self.files.get_file_info(p + self.mark).type != fs.FileType.NotFound:
                self.files.delete_file(p + self.mark)


class ShardReader:
    """Random access to a shard: sequences, masks and any run of ids, by reference to the mapped file where it is local."""

    def __init__(self, folder: str, name: str):
        files, root = file_system(folder)
        local = isinstance(files, fs.LocalFileSystem)
        opened = pa.memory_map if local else files.open_input_file
        self.data = pa.ipc.open_file(opened(f"{root}/{name}.arrow"))
        self.index = pa.ipc.open_file(opened(f"{root}/{name}.index.arrow"))
        self.length = self.data.schema.field("ids").type.list_size
        self.batch = self.data.get_batch(0).num_rows if self.data.num_record_batches else 1
        self.at, self.held = -1, None

    def _ids(self, batch: int) -> np.ndarray:
        if batch != self.at:
            self.at, self.held = batch, self.data.get_batch(batch)
        return self.held.column(0).values.to_numpy()

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(i // self.batch)
        lo = i % self.batch * self.length
        mask = self.held.column(1).values.slice(lo, self.length).to_numpy(zero_copy_only=False)
        return ids[lo : lo + self.length], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        step, parts = self.batch * self.length, []
        while n > 0:
            ids = self._ids(start // step)[start % step : start % step + n]
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for i in range(self.index.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.index.get_batch(i).columns), strict=True)


def write_sequences(docs: DataFrame, folder: str, end_id: int = END_ID, vocabulary: str | None = None, length: int = LENGTH) -> list[tuple[str, int]]:
    """Write the ids of all texts, each followed by ``end_id``, in ascending doc_id order; (shard, ids) in that order.

    Null ids come first, ties by text; null and empty texts are their end id alone; very long texts are written whole, over
    as many sequences as it takes; repeated rows are documents of their own; an empty table gives no shard; other columns,
    whatever their names, are ignored. Ids are integers. The
    returned list has one entry for each shuffle partition, whatever the number of documents.
    """
    bounds, path = bucket_bounds(docs), vocabulary_path(vocabulary)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), bucket_of("doc_id", bounds).alias("bucket"))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")

    end = np.array([end_id], dtype=np.uint32).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer, now = [], None, None
        try:
            with task_encoder(path) as encoding:
                kind = id_type(encoding.tokenizer.get_vocab_size())
                for batch in batches:
                    for doc_id, text, bucket in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("bucket").to_pylist(), strict=True):
                        if bucket != now:
                            if writer:
                                writer.close()
                                done.append((now, writer.total))
                            writer, now = ShardWriter(folder, f"shard-{bucket:06d}", kind, length), bucket
                        writer.add(doc_id, encoding.raw(text.as_py()) + end)
            if writer:
                writer.close()
                done.append((now, writer.total))
        except BaseException:
            if writer:
                writer.discard()
            raise
        yield pa.RecordBatch.from_pydict({"bucket": [b for b, _ in done], "n": [n for _, n in done]}, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int64())]))

    return [(f"shard-{r.bucket:06d}", r.n) for r in sorted(dealt.mapInArrow(write, "bucket int, n long").collect())]


def read_documents(spark, folder: str, shards: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    before, rows = 0, []
    for name, n in shards:
        rows.append((name, before))
        before += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        schema = pa.schema([(c, pa.int64()) for c in names])
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard, out = ShardReader(folder, name), []
                for doc_id, start, n in shard.documents():
                    out.append((doc_id, base + start, n, zlib.crc32(shard.tokens(start, n).astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    table = spark.createDataFrame(rows, "name string, before long").repartition(max(1, len(rows)))
    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_arrow_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "sequences")
    shards = write_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_documents(spark, folder, shards)
