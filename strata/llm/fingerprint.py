"""Document fingerprints by consistent weighted sampling.

A document is its words with their counts as weights.  For every sample each word draws r and c from a
Gamma(2, 1) and beta from a uniform distribution, all by its hash; with t = floor(ln(weight) / r + beta)
and ln y = r (t - beta) the word with the least ln c - ln y - r and its t are the sample.  Two documents
agree in a sample with the probability sum(min) / sum(max) of their weights, the generalised Jaccard
similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .store import column, saved
from .textkit import mix64, spans, word_hashes
from .tokenfile import partitions

SAMPLES = 96
#: Words whose draws a worker process keeps.
CACHE = 40_000
#: Words drawn for at once.
BLOCK = 2048
#: Text that is worked on at once.
CHUNK = 300_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Sampler:
    """Fingerprints as arrays of 16-bit codes, one a sample; the draws of the first words seen are kept."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.stream = mix64(np.arange(1, samples + 1, dtype=np.uint64))
        self.words = np.zeros(0, np.uint64)  # ascending, and where each one's draws are kept
        self.slots = np.zeros(0, np.int64)
        self.kept = np.empty((3, CACHE, samples), np.float32)

    def draws(self, hashes: np.ndarray) -> np.ndarray:
        """r, beta and ln c of each word and sample, from two 64-bit hashes."""
        part = lambda x, shift, bits: ((x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32) * np.float32(2.0**-bits) + np.float32(2.0 ** -(bits + 1))
        out = np.empty((3, len(hashes), self.samples), np.float32)
        one = mix64(hashes[:, None] ^ self.stream)
        out[0] = np.maximum(-np.log(part(one, 0, 24) * part(one, 24, 24)), np.float32(1e-6))
        out[1] = part(one, 48, 16)
        two = mix64(one + _GOLD)
        out[2] = np.log(np.maximum(-np.log(part(two, 0, 24) * part(two, 24, 24)), np.float32(1e-30)))
        return out

    def table(self, words: np.ndarray) -> np.ndarray:
        """Draws of all words given, ascending."""
        out = np.empty((3, len(words), self.samples), np.float32)
        old = np.zeros(len(words), bool)
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            old = self.words[place] == words
            out[:, old] = self.kept[:, self.slots[place[old]]]
        new = np.flatnonzero(~old)
        for lo in range(0, len(new), BLOCK):
            out[:, new[lo : lo + BLOCK]] = self.draws(words[new[lo : lo + BLOCK]])
        room, first = min(len(new), CACHE - len(self.words)), len(self.words)
        if room > 0:
            self.kept[:, first : first + room] = out[:, new[:room]]
            merged, slots = np.concatenate((self.words, words[new[:room]])), np.concatenate((self.slots, np.arange(first, first + room)))
            order = np.argsort(merged)
            self.words, self.slots = merged[order], slots[order]
        return out

    def codes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each text, and whether it has a word; without one all codes are 0."""
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, _, first = spans(data, offsets)
        out = np.zeros((len(texts), self.samples), np.uint16)
        counts = np.diff(first)
        if not len(starts):
            return out, counts > 0
        words, place = np.unique(word_hashes(data, starts), return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), counts)
        term, weight = np.unique(doc * len(words) + place, return_counts=True)
        doc, term = term // len(words), term % len(words)
        draws = self.table(words)
        plain = draws[2] + draws[0] * (draws[1] - 1)  # of weight 1: t is 0
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i in np.flatnonzero(counts):
            own, heavy = term[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]
            value = plain[own]
            more = np.flatnonzero(heavy > 1)
            step = np.floor(np.log(heavy[more].astype(np.float32))[:, None] / draws[0][own[more]] + draws[1][own[more]])
            value[more] = draws[2][own[more]] - draws[0][own[more]] * (step - draws[1][own[more]] + 1)
            best = value.argmin(0)
            t = np.zeros((len(own), self.samples), np.float32) if len(more) else None
            chosen = words[own[best]]
            if t is not None:
                t[more] = step
                chosen = chosen + t[best, np.arange(self.samples)].astype(np.int64).view(np.uint64) * _GOLD
            out[i] = (mix64(chosen ^ self.stream) >> np.uint64(48)).astype(np.uint16)
        return out, counts > 0


def likeness(a: np.ndarray, a_has: np.ndarray, b: np.ndarray, b_has: np.ndarray) -> np.ndarray:
    """Shares of equal codes; of two texts without words 1, of one such text and another 0."""
    return np.where(a_has & b_has, (a == b).mean(1), (a_has == b_has).astype(float))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the next one's beginning."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_sampler: dict[int, Sampler] = {}


def _compare(ids: list, texts: list[str], samples: int) -> dict[str, list]:
    """Rows for all documents but the last, each with the one after it; hashes and codes as bytes."""
    sampler = _sampler.setdefault(samples, Sampler(samples))
    changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
    codes, has = sampler.codes([*(t.encode() for t in texts), *changed])
    n = len(texts)
    own, own_has, new, new_has = codes[:n], has[:n], codes[n:], has[n:]
    write = lambda codes: [row.astype(">u2").tobytes() for row in codes]
    return {"doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t).digest() for t in changed], "fingerprint": write(own[:-1]), "edited_fingerprint": write(new), "near_edited": likeness(own[:-1], own_has[:-1], new, new_has).tolist(), "near_next": likeness(own[:-1], own_has[:-1], own[1:], own_has[1:]).tolist()}


COLUMNS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    The next document is that of the next lower id, after the last the first; null ids come last, and
    rows of one id are ordered by their texts' hashes, equal rows standing side by side.  Null text is
    empty.  Ids may be of any type that Spark orders.  A text without words has an all-zero fingerprint.  One document is its own next; an empty
    table gives no rows.

    The texts are dealt out once, by ranges of ids.  Only the first and last text of each range go on
    to meet their neighbours in other ranges.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(docs, 32 << 20), *order).sortWithinPartitions(*order)
    edge = f"doc_id {kind}, {COLUMNS}, role int, range int, text string"

    def batch_of(rows: dict[str, list], role: int, part: int, texts: list | None = None) -> pa.RecordBatch:
        n = len(rows["doc_id"])
        blank = {name: [None] * n for name in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        return pa.RecordBatch.from_pydict(blank | rows | {"role": [role] * n, "range": [part] * n, "text": texts or [None] * n}, schema=schema)

    fields = [("doc_id", to_arrow_type(docs.schema[id_col].dataType)), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("role", pa.int32()), ("range", pa.int32()), ("text", pa.string())]
    schema = pa.schema(fields)
    final = pa.schema(fields[:7])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, texts, size, began = TaskContext.get().partitionId(), [], [], 0, False
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                own = batch.slice(lo, 32)
                ids += own.column(0).to_pylist()
                texts += own.column(1).to_pylist()
                if not began:
                    began = True
                    yield batch_of({"doc_id": ids[:1]}, 1, part, texts[:1])
                size += own.column(1).nbytes
                if size >= CHUNK and len(ids) > 1:
                    yield batch_of(_compare(ids, texts, samples), 0, part)
                    ids, texts, size = ids[-1:], texts[-1:], 0
        if len(ids) > 1:
            yield batch_of(_compare(ids, texts, samples), 0, part)
        if ids:
            yield batch_of({"doc_id": ids[-1:]}, 2, part, texts[-1:])

    made = saved(rows.mapInArrow(run, edge), "fingerprints")
    heads = made.where("role = 1").select("range", F.col("text").alias("following"))
    ranges = heads.select("range").withColumn("after", F.lead("range").over(Window.orderBy("range")))
    ranges = ranges.withColumn("after", F.coalesce("after", F.min("range").over(Window.partitionBy())))
    tails = made.where("role = 2").select("range", "doc_id", "text").join(ranges, "range")
    tails = tails.join(heads.withColumnRenamed("range", "after"), "after").select("doc_id", "text", "following")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict(_compare([doc_id, None], [text, following], samples), schema=final)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out = made.where("role = 0").select(*names).unionByName(tails.mapInArrow(meet, f"doc_id {kind}, {COLUMNS}"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in names[2:5]})
