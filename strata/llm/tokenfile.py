"""Token ids in binary shards: one id array, and the document boundaries as an Elias-Fano code.

A shard holds the ids of its documents one after the other, as unsigned little-endian integers of 16
bits if the vocabulary allows and else 32; then the Elias-Fano codes of the documents' ends in the
array and of their ids (ascending; null ids come last and are only counted); then a footer:

    8 bytes  magic STRATOK1
    4 bytes  bytes an id
    4 bytes  documents without an id
    8 bytes  place of the codes in the file
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .eliasfano import EliasFano
from .encoding import encoder
from .store import column, folder, saved

_FOOT = struct.Struct("<8sIIQ")
MAGIC = b"STRATOK1"
#: Text in one shard, about.
SHARD_BYTES = 64 << 20


def text_bytes(docs: DataFrame) -> int:
    """Spark's estimate of the table's size; needs no job."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return min(int(str(size)), 1 << 60)


def partitions(docs: DataFrame, most: int = SHARD_BYTES) -> int:
    """Partitions so that each has about ``most`` bytes, and no fewer than the session's own number."""
    known = text_bytes(docs)
    wanted = known // most + 1 if known < 1 << 50 else 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class ShardWriter:
    """Writes one shard under a name of its own; only a shard that a manifest names counts, so lost or repeated tasks leave no wrong data."""

    def __init__(self, path: str, width: int):
        self.fs, self.name = _filesystem(path)
        self.out = self.fs.open_output_stream(self.name)
        self.width, self.ends, self.ids, self.nulls, self.tokens = width, [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document: its ids as 32-bit integers."""
        self.out.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.tokens += len(ids) // 4
        self.ends.append(self.tokens)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> tuple[int, int]:
        self.out.write(EliasFano.of(np.array(self.ends, np.int64)).to_bytes() + EliasFano.of(np.array(self.ids, np.int64)).to_bytes())
        self.out.write(_FOOT.pack(MAGIC, self.width, self.nulls, self.tokens * self.width))
        self.out.close()
        return len(self.ends), self.tokens


class Shard:
    """Reads a shard: ``ends`` and ``ids`` as Elias-Fano codes, and ids by document."""

    def __init__(self, path: str):
        files, name = _filesystem(path)
        with files.open_input_file(name) as file:
            self.data = file.read()
        magic, self.width, self.nulls, at = _FOOT.unpack_from(self.data, len(self.data) - _FOOT.size)
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        self.ends, place = EliasFano.from_bytes(self.data, at)
        self.ids, _ = EliasFano.from_bytes(self.data, place)
        self.tokens = np.frombuffer(self.data, "<u2" if self.width == 2 else "<u4", at // self.width)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i of the shard."""
        return self.tokens[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", to: str | None = None) -> DataFrame:
    """Encodes all documents into shards in ascending id order and returns the manifest.

    The manifest has one row a shard: (shard, path, base, documents, tokens); ``base`` counts the tokens
    of all shards before.  Null texts are empty; null ids come last; rows with one id are ordered by
    their texts' hashes, and equal rows each have their place.  An empty table gives no shard.
    """
    spark = docs.sparkSession
    to = to or folder(spark, "tokens")
    rows = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode, writer, path = TaskContext.get().partitionId(), encoder(tokenizer, end_id), None, ""
        for batch in batches:
            ids, texts = batch.columns
            for lo in range(0, len(ids), 64):
                for doc_id, text in zip(ids.slice(lo, 64).to_pylist(), texts.slice(lo, 64).to_pylist(), strict=True):
                    if writer is None:
                        path = f"{to}/{shard:08d}-{uuid.uuid4().hex}.tok"
                        _filesystem(to)[0].create_dir(_filesystem(to)[1], recursive=True)
                        writer = ShardWriter(path, encode.width)
                    writer.add(doc_id, encode.encode(text))
        if writer is not None:
            documents, tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "documents": [documents], "tokens": [tokens]})

    made = saved(rows.mapInArrow(run, "shard long, path string, documents long, tokens long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def read(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: (doc_id, start, n_tokens, ids_crc32); start counts the tokens of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                ends = shard.ends.all()
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(shard.tokens[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = pa.concat_arrays([pa.array(shard.ids.all(), pa.int64()), pa.nulls(shard.nulls, pa.int64())])
                yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "base").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
