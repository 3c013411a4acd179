"""Quality rules: exact text statistics, then a hashed n-gram logistic regression with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import column
from .textkit import buffers, mix64, ngrams, segment_hashes, slice_batches, slices, spans, word_hashes

#: Labelled documents that the model is fitted on, at most: the lowest hashes of the ids.
TRAIN_ROWS = 2000
BITS = 18
#: A document is kept from this calibrated probability of good quality on.
THRESHOLD = 0.3
FAILED_WORDS, FAILED_REPEATS = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLASS = np.zeros(256, np.uint8)  # character classes: lower case, upper case, digit, other bytes of letters, and each symbol its own
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 1
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = _c


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _twice(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have an equal key in their document."""
    mixed = mix64(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    sorted_ = mixed[order]
    same = sorted_[1:] == sorted_[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return flag


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    starts, ends, first = spans(data, offsets)
    hashes = word_hashes(data, starts)
    n_docs, counts = len(offsets) - 1, np.diff(first)
    out = {"n_words": counts.astype(np.int64), "n_symbols": _per_doc(_SYMBOL[data], offsets)}
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    letters = np.concatenate(([0], np.cumsum(heads[ends] - heads[starts])))
    out["word_chars"] = letters[first[1:]] - letters[first[:-1]]
    # Lines that hold a word, by all their bytes.
    begin = np.unique(np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1)))
    begin = begin[begin < len(data)]
    dup = np.zeros(n_docs, np.int64)
    if len(begin):
        stop = np.concatenate((begin[1:], [len(data)]))
        # The bytes of a line with their places in it; its end, a \\n or the text's, doesn't count.
        code = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))
        code[10] = 0
        sums = segment_hashes(code, data, begin)
        size = stop - begin - (data[stop - 1] == 10)
        doc = np.searchsorted(offsets, begin, "right") - 1
        worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
        key = mix64(mix64(sums + size.astype(np.uint64)) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[worded]
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        dup = np.bincount(doc[worded][again], minlength=n_docs)
    out["n_dup_lines"] = dup.astype(np.int64)
    repeat = np.zeros(n_docs, np.int64)
    if len(hashes):
        windows, at = ngrams(hashes, first, 3)
        size, whole = np.diff(at), counts >= 3
        doc = np.repeat(np.arange(n_docs), size)
        use = whole[doc]
        flag = np.zeros(len(windows), bool)
        flag[use] = _twice(windows[use], doc[use])
        place = np.arange(len(windows)) - np.repeat(at[:-1], size) + np.repeat(first[:-1], size)
        covered = np.zeros(len(hashes) + 2, bool)
        for j in range(3):
            covered[place[flag] + j] = True
        repeat = _per_doc(covered[: len(hashes)], first)
    out["n_repeat_words"] = repeat
    return out


def features(data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams: (feature, document, value).

    Words, word pairs, triples of bytes and of character classes each add up to 1 a document; a text
    without words has none.  Two more features are the shares of words in repeated word triples and of
    repeated lines, the n-grams that say something only by occurring again.
    """
    found = statistics(data, offsets) if found is None else found
    starts, _, first = spans(data, offsets)
    n_docs = len(offsets) - 1
    doc, index, value = [], [], []

    def add(hashes: np.ndarray, of: np.ndarray, kind: int) -> None:
        total = np.bincount(of, minlength=n_docs)
        index.append((mix64(hashes + np.uint64(kind)) >> np.uint64(64 - BITS)).astype(np.int64))
        doc.append(of)
        value.append(1.0 / total[of])

    hashes = word_hashes(data, starts)
    for k in (1, 2):
        grams, at = ngrams(hashes, first, k)
        add(grams, np.repeat(np.arange(n_docs), np.diff(at)), k)
    if len(data) >= 3:
        of = np.repeat(np.arange(n_docs), np.diff(offsets))
        kind = _CLASS[data].astype(np.uint64)
        inside = of[2:] == of[:-2]
        add(((kind[:-2] << np.uint64(16)) | (kind[1:-1] << np.uint64(8)) | kind[2:])[inside], of[2:][inside], 3)
        raw = data.astype(np.uint64)
        add(((raw[:-2] << np.uint64(16)) | (raw[1:-1] << np.uint64(8)) | raw[2:])[inside], of[2:][inside], 4)
    some = np.arange(n_docs)
    for kind, many in ((0, found["n_repeat_words"] / np.maximum(found["n_words"], 1)), (1, found["n_dup_lines"] / (1.0 + np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1, minlength=n_docs)))):
        doc.append(some)
        index.append(np.full(n_docs, kind))
        value.append(many)
    return np.concatenate(index), np.concatenate(doc), np.concatenate(value)


@dataclass
class Model:
    """Weights of the hashed features, their bias, and Platt's slope and intercept."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    intercept: float = 0.0

    def margins(self, data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray] | None = None) -> np.ndarray:
        index, doc, value = features(data, offsets, found)
        return np.bincount(doc, self.weights[index] * value, minlength=len(offsets) - 1) + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray] | None = None) -> np.ndarray:
        return _sigmoid(self.slope * self.margins(data, offsets, found) + self.intercept)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept of calibrated probabilities, by damped Newton steps on smoothed labels."""
    good, bad = label.sum(), (1 - label).sum()
    goal = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(margin.std()), 1e-9)
    x = np.stack([margin / scale, np.ones_like(margin)], 1)

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - goal * z).sum() + 1e-3 * t @ t)

    theta, now = np.zeros(2), loss(np.zeros(2))
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - goal) + 2e-3 * theta)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > now:
            size /= 2
        theta = theta - size * step
        before, now = now, loss(theta)
        if before - now < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def every_fifth(label: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to fit on and rows to calibrate on, at every size: each label's first, sixth, ... row in ``order`` is one of the latter.

    A label with a single row has it on both sides, as neither does without.
    """
    held = np.zeros(len(label), bool)
    alone = np.zeros(len(label), bool)
    for kind in (0, 1):
        own = order[label[order] == kind]
        held[own[::5]] = True
        alone[own[: len(own) == 1]] = True
    return ~held | alone, held


def fit(texts: pa.Array, label: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Logistic regression by Adagrad with classes of equal weight, calibrated on every fifth row of each label, which the weights don't see."""
    data, offsets = buffers(texts)
    parts, n = [], len(label)
    for lo, hi in slices(offsets):
        i, d, v = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        both, where = np.unique((d << BITS) | i, return_inverse=True)
        parts.append(((both & ((1 << BITS) - 1)).astype(np.int32), ((both >> BITS) + lo).astype(np.int32), np.bincount(where, v).astype(np.float32)))
    index, doc, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    value *= np.float32(30.0)  # one step size suits small relative frequencies
    del parts
    own, tune = every_fifth(label, np.arange(n))
    label = label.astype(np.float64)
    share = max(1.0, (label * own).sum()), max(1.0, ((1 - label) * own).sum())
    weight = own * np.where(label > 0, 0.5 / share[0], 0.5 / share[1])
    w, b, g2, b2 = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(steps):
        margin = np.bincount(doc, w[index] * value, minlength=n) + b
        error = weight * (_sigmoid(margin) - label)
        grad = np.bincount(index, error[doc] * value, minlength=1 << BITS) + decay * w
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
        b2 += error.sum() ** 2
        b -= rate * error.sum() / np.sqrt(b2)
    margin = np.bincount(doc, w[index] * value, minlength=n) + b
    return Model((w * 30.0).astype(np.float64), b, *platt(margin[tune], label[tune]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model | None:
    """Fits the model on at most ``rows`` labelled documents, the lowest hashes of their ids; None without both labels.

    Labels other than 0 and 1 and null ids don't count, a null text is empty.  Where labels or documents
    repeat an id, all its pairs count, up to ``rows``.
    """
    chosen = labels.where(column(label_col).isin(0, 1) & column(id_col).isNotNull()).select(column(id_col).alias("labelled"), column(label_col).cast("int").alias("label")).orderBy(F.xxhash64("labelled"), "labelled", "label").limit(rows)
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("id", "text", "label")
    table = sample.orderBy(F.xxhash64("id"), "id", "text", "label").limit(rows).toArrow()
    label = table.column("label").to_numpy().astype(int)
    if len(set(label.tolist())) < 2:
        return None
    return fit(table.column("text"), label)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Statistics and verdict of every document beside the columns ``keep`` (default: all).

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and probability;
    of columns with these names in docs, the new ones stay.  Null and empty text has no words, fails the
    base rule and has the model's bias as margin.  Without a model the base rule alone decides.  Equal rows
    have equal verdicts; an empty table gives no rows.
    """
    added = [*COLUMNS, "base_failed", "kept", "probability"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(column(text_col).alias("judged"), *[column(c).alias(f"own{i}") for i, c in enumerate(names)])
    made = {c: T.LongType() for c in COLUMNS} | {"base_failed": T.BooleanType(), "kept": T.BooleanType(), "probability": T.DoubleType()}
    schema = T.StructType([docs.schema[docs.columns.index(c)] for c in names] + [T.StructField(c, made[c]) for c in added])
    shipped = docs.sparkSession.sparkContext.broadcast(model) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value if shipped else None
        for batch in batches:
            for part, data, offsets in slice_batches(batch, "judged"):
                found = statistics(data, offsets)
                n = found["n_words"]
                failed = (n < FAILED_WORDS) | (100 * found["n_repeat_words"] > FAILED_REPEATS * n)
                p = own.probabilities(data, offsets, found) if own else np.ones(len(n))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(found[c]) for c in COLUMNS), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], names=[*names, *added])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns, whatever their names; equal rows go or stay together, null texts go."""
    shipped = docs.sparkSession.sparkContext.broadcast(model) if model else None
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value if shipped else None
        for batch in batches:
            for part, data, offsets in slice_batches(batch, f"own{at}"):
                found = statistics(data, offsets)
                n = found["n_words"]
                good = (n >= FAILED_WORDS) & (100 * found["n_repeat_words"] <= FAILED_REPEATS * n)
                if own:
                    good &= own.probabilities(data, offsets, found) >= threshold
                yield part.filter(pa.array(good)).rename_columns(names)

    return docs.toDF(*[f"own{i}" for i in range(len(names))]).mapInArrow(run, docs.schema)
