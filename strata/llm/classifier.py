"""Quality scores: random-indexing word vectors pooled per document, and a small network on them.

Every word has a sparse random index vector; a word's vector is the sum of the index vectors of the words
around it, over the whole corpus.  Words are hashed to a fixed number of rows, and so is the shape of each
word (its runs of lower case, upper case, digits and symbols), so the sums have a fixed size and are added
up by partition and then by block.  A document is the mean of its words' vectors, of its different words'
vectors and of its shapes', with three numbers on length and repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import _CLASS, _sigmoid, every_fifth
from .store import column
from .textkit import mix64, ngrams, segment_hashes, slice_batches, spans, word_hashes

ROWS, SHAPES, SIZE, NONZERO, WINDOW = 1 << 14, 1 << 10, 32, 4, 2
HIDDEN = 32
#: Labelled documents that the network is fitted on, at most: the lowest hashes of the ids.
TRAIN_ROWS = 8000
THRESHOLD = 0.3
_BLOCK = 1 << 10
#: Partial sums of a block that are added up in one task.
FAN_IN = 64


def index_vectors() -> np.ndarray:
    """The sparse random vectors of all rows: NONZERO places of +1 or -1."""
    rows = np.arange(ROWS, dtype=np.uint64)
    out = np.zeros((ROWS, SIZE), np.int16)
    for k in range(NONZERO):
        draw = mix64(rows * np.uint64(NONZERO) + np.uint64(k))
        np.add.at(out, (rows.astype(np.int64), (draw % np.uint64(SIZE)).astype(np.int64)), np.where(draw >> np.uint64(63), 1, -1).astype(np.int16))
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their rows, the rows of their shapes, and each document's first word (n + 1)."""
    starts, ends, first = spans(data, offsets)
    hashes = word_hashes(data, starts)
    row = (hashes >> np.uint64(50)).astype(np.int64)
    shape = np.zeros(len(starts), np.int64)
    if len(starts):
        kind = _CLASS[data]
        change = np.ones(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[starts] = True
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        runs = np.flatnonzero(change & (np.cumsum(inside[:-1]) > 0))
        code = mix64(np.arange(256, dtype=np.uint64) + np.uint64(991))
        shape = (mix64(segment_hashes(code, kind[runs], np.searchsorted(runs, starts))) >> np.uint64(54)).astype(np.int64)
    return hashes, row, shape, first


def contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors of all rows of words and shapes, from the whole corpus; their size doesn't depend on it.  Null and empty texts add nothing, repeated rows count each time, no text at all gives zeros."""
    total = ROWS + SHAPES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, sums = index_vectors(), np.zeros((total, SIZE), np.int64)
        for batch in batches:
            for _, data, offsets in slice_batches(batch, "text"):
                _, row, shape, first = tokens(data, offsets)
                if not len(row):
                    continue
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                own, around = index[row], np.zeros((len(row), SIZE), np.int16)
                for k in range(1, WINDOW + 1):
                    same = (doc[k:] == doc[:-k])[:, None]
                    around[k:] += own[:-k] * same
                    around[:-k] += own[k:] * same
                for target in (row, shape + ROWS):
                    order = np.argsort(target, kind="stable")
                    sorted_ = target[order]
                    at = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
                    sums[sorted_[at]] += np.add.reduceat(around[order], at, axis=0, dtype=np.int64)
        part = TaskContext.get().partitionId()
        blocks = range(0, total, _BLOCK)
        yield pa.RecordBatch.from_pydict({"block": list(blocks), "part": [part] * len(blocks), "sums": [sums[b : b + _BLOCK].tobytes() for b in blocks]}, schema=pa.schema([("block", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sums"))
        return table.slice(0, 1).set_column(table.schema.get_field_index("sums"), "sums", pa.array([total.tobytes()], pa.binary()))

    schema = "block int, part int, sums binary"
    texts = docs.select(column(text_col).alias("text"))
    parts, many = texts.mapInArrow(gather, schema), texts.rdd.getNumPartitions()
    while many > 1:  # at most FAN_IN blocks come together in a task
        many = -(-many // FAN_IN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(many))).groupBy("block", "part").applyInArrow(add, schema)
    found = parts.collect()
    sums = np.zeros((total, SIZE))
    for block, _, raw in found:
        sums[block : block + _BLOCK] = np.frombuffer(raw, np.int64).reshape(-1, SIZE)
    sums -= np.abs(sums).sum(1, keepdims=True) / max(np.abs(sums).sum(), 1) * sums.sum(0, keepdims=True)
    norm = np.sqrt((sums * sums).sum(1, keepdims=True))
    return (sums / (norm + 20.0)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A row of inputs for each document; a text without words has zeros."""
    n = len(offsets) - 1
    hashes, row, shape, first = tokens(data, offsets)
    counts = np.diff(first)
    out = np.zeros((n, 3 * SIZE + 3), np.float32)
    if not len(row):
        return out
    doc = np.repeat(np.arange(n), counts)
    some = np.flatnonzero(counts)

    def mean(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        size = np.bincount(of, minlength=n)[some]
        at = np.searchsorted(of, some)
        return np.add.reduceat(vectors[rows], at, axis=0) / size[:, None]

    kinds = np.unique(doc * ROWS + row)
    out[some, :SIZE] = mean(row, doc)
    out[some, SIZE : 2 * SIZE] = mean(kinds % ROWS, kinds // ROWS)
    out[some, 2 * SIZE : 3 * SIZE] = mean(shape + ROWS, doc)
    grams, at = ngrams(hashes, first, 3)
    of = np.repeat(np.arange(n), np.diff(at)).astype(np.uint64)
    different = np.unique((of << np.uint64(40)) | (grams >> np.uint64(24)))
    windows = np.bincount((different >> np.uint64(40)).astype(np.int64), minlength=n)
    out[:, -3] = np.log1p(counts)
    out[some, -2] = np.bincount(kinds // ROWS, minlength=n)[some] / counts[some]
    out[some, -1] = windows[some] / np.diff(at)[some]
    return out


@dataclass
class Network:
    """Inputs scaled, a tanh layer, a linear layer, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def fit(x: np.ndarray, label: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the cross-entropy with four fifths of the rows of each label; the temperature has the least cross-entropy on the others."""
    rng = np.random.default_rng(seed)
    own, held = (np.flatnonzero(x) for x in every_fifth(label, rng.permutation(len(x))))
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z, y = np.clip((x - mean) / scale, -8, 8).astype(np.float64), label.astype(np.float64)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        shuffled = rng.permutation(own)
        for lo in range(0, len(shuffled), 64):
            i = shuffled[lo : lo + 64]
            h = np.tanh(z[i] @ p[0] + p[1])
            error = (_sigmoid(h @ p[2] + p[3]) - y[i]) / len(i)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [z[i].T @ back + decay * p[0], back.sum(0), h.T @ error + decay * p[2], error.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit = net.logits(x[held])
    loss = lambda temperature: float(np.mean(np.logaddexp(0, logit / temperature) - y[held] * logit / temperature))
    net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model is fitted on: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(column(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Network | None:
    """Fits the network on at most ``rows`` labelled documents that aren't held out; None without both labels.

    Labels other than 0 and 1 and null ids don't count, a null text is empty; repeated ids count each time.
    """
    chosen = labels.where(column(label_col).isin(0, 1) & column(id_col).isNotNull() & ~held_out(id_col)).select(column(id_col).alias("labelled"), column(label_col).cast("int").alias("label")).orderBy(F.xxhash64("labelled"), "labelled", "label").limit(rows)
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("text", F.xxhash64("id").alias("place"), "label")
    shipped = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slice_batches(batch, "text"):
                x = pooled(data, offsets, shipped.value)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["place", "label", "x"])

    found = sample.mapInArrow(run, "place long, label int, x binary").orderBy("place", "x").limit(rows).toArrow()
    label = found.column("label").to_numpy().astype(int)
    if len(set(label.tolist())) < 2:
        return None
    return fit(np.stack([np.frombuffer(r, np.float32) for r in found.column("x").to_pylist()]), label)


def score(docs: DataFrame, net: Network | None, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.  Null and empty texts are scored with inputs of zero; without a network every score is 0.5."""
    shipped = docs.sparkSession.sparkContext.broadcast((net, vectors))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shipped.value
        for batch in batches:
            for part, data, offsets in slice_batches(batch, "text"):
                p = own.probabilities(pooled(data, offsets, table)) if own else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p.astype(np.float64)), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(column(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
