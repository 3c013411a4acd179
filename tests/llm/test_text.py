import collections
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import classifier, linededup, quality, textkit

TEXT = st.text(alphabet="ab é\n\t|*A.1", max_size=60)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8))
def test_statistics(texts):
    data, offsets = textkit.buffers(pa.array(texts, pa.string()))
    got = quality.statistics(data, offsets)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[c][i]) for c in names) for i in range(len(texts))] == [brute(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_hashes_depend_on_words_alone(texts):
    data, offsets = textkit.buffers(pa.array(texts))
    starts, ends, first = textkit.spans(data, offsets)
    hashes, raw = textkit.word_hashes(data, starts), data.tobytes()
    named = collections.defaultdict(set)
    for a, b, h in zip(starts, ends, hashes.tolist(), strict=True):
        named[raw[a:b]].add(h)
    assert all(len(v) == 1 for v in named.values()) and len({next(iter(v)) for v in named.values()}) == len(named)
    assert [first[i + 1] - first[i] for i in range(len(texts))] == [len(WORD.findall(t)) for t in texts]
    grams, at = textkit.ngrams(hashes, first, 3)
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        assert at[i + 1] - at[i] == (len(words) - 2 if len(words) >= 3 else min(1, len(words)))


def corpus(spark, n=300):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(200)] + ["the"] * 60 + ["of"] * 40
    rows = []
    for i in range(n):
        words = [vocabulary[k] for k in rng.integers(0, len(vocabulary), 80)]
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{w}***" if bad and rng.random() < 0.7 else w for w in words), int(not bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "quality")


def test_quality_rules(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (None, "a b c"), (None, "a b c")], "doc_id long, text string")
    got = quality.judge(docs.unionByName(extra).selectExpr("*", "'x' AS kept"), model).collect()
    right = sum(r.kept == (r.doc_id % 4 != 0) for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert len(got) == 304 and right >= 297
    assert all(r.base_failed and not r.kept for r in got if r.doc_id is None or r.doc_id >= 1000)
    kept = quality.accepted(docs.selectExpr("*", "7 AS probability"), model)
    assert kept.columns == ["doc_id", "text", "probability"] and kept.count() == sum(r.kept for r in got)
    assert quality.train(docs, labels.limit(0)) is None
    assert quality.judge(docs.limit(0), model).count() == 0
    assert quality.accepted(docs, None).count() == 300


def test_calibration():
    rng = np.random.default_rng(0)
    margin = rng.normal(0, 3, 4000)
    label = (rng.random(4000) < 1 / (1 + np.exp(-(0.7 * margin - 0.4)))).astype(float)
    slope, intercept = quality.platt(margin, label)
    assert abs(slope - 0.7) < 0.1 and abs(intercept + 0.4) < 0.15


def test_classifier(spark):
    docs, labels = corpus(spark, 600)
    vectors = classifier.contexts(docs)
    net = classifier.train(docs, labels, vectors)
    extra = spark.createDataFrame([(None, None), (5000, "")], "doc_id long, text string")
    got = classifier.score(docs.unionByName(extra), net, vectors).collect()
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 60 and sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    assert len(got) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert classifier.train(docs, labels.limit(0), vectors) is None
    assert {r.score for r in classifier.score(docs.limit(3), None, vectors).collect()} == {0.5}
    empty = classifier.contexts(docs.limit(0))
    assert classifier.score(docs.limit(0), None, empty).count() == 0


def test_line_dedup(spark):
    line, other = "this line stands on many different sites", "this line stands on only two of the sites"
    rows = [(3, f"a\n{line}\nb", "s1"), (1, f"{line}\n{line}", "s2"), (2, f"x\n{line}", None), (4, None, "s1"), (5, "", "s1"), (6, other, "s1"), (7, other, "s2"), (8, "short", "s1"), (9, "short", "s2"), (10, "short", "s3"), (2, f"x\n{line}", None), (None, "alone", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS line", "'p' AS pos")
    got = linededup.deduplicated(docs, removed_col="removed")
    found = sorted(((r.doc_id, r.text, r.removed) for r in got.collect()), key=str)
    want = [(3, "a\nb", 1), (1, line, 1), (2, "x", 1), (2, "x", 1), (4, None, 0), (5, "", 0), (6, other, 0), (7, other, 0), (8, "short", 0), (9, "short", 0), (10, "short", 0), (None, "alone", 0)]
    assert found == sorted(want, key=str)
    assert got.columns == [*docs.columns, "removed"]
    assert linededup.deduplicated(docs.limit(0)).count() == 0


def test_line_dedup_many_sites(spark):
    """Lines on more sites than the near-threshold band reaches are decided by their sketches."""
    rows = [(i, f"line number {k} stands on its own number of sites", f"s{i}") for i in range(30) for k in range(1, 31) if i < k]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.groupBy("doc_id", "source").agg({"text": "collect_list"}).selectExpr("doc_id", "source", "array_join(sort_array(`collect_list(text)`), '\n') AS text")
    gone = linededup.boilerplate(docs, min_sites=20)
    assert gone.count() == 11
