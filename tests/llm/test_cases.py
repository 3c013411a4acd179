"""What every operator owes: columns of any name, ids of any type, ties, long texts; and the registered queries."""

import collections
import hashlib
import math
import os
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strata.llm import classifier, encoding, fingerprint, linededup, mixing, neardup, packing, pii, quality, queries, store, textkit, urls
from tests.llm.test_pairs import brute_classes
from tests.llm.test_pii import PATTERNS, brute, valid
from tests.llm.test_text import brute as brute_statistics

SF = "/root/testdata/sf0.001"
HELD = pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")
NAMES = ["again", "copies", "digest", "gone", "spans", "text_hash", "judged", "Key", "keys", "uid", "class_id", "root", "terms", "copy", "mass", "bucket", "line", "pos", "first", "__hash", "__id", "__text", "a.b", "tick`ed"]
LINE = "this line stands on the pages of all the many sites"


def clashing(spark):
    rows = [(i, f"w{i} " + " ".join(f"v{i * 31 + k}" for k in range(60)) + f"\n{LINE}\nme{i}@x.org", f"s{i % 4}", *[f"{n}{i}" for n in NAMES]) for i in range(12)]
    rows += [(20, rows[3][1], "s9", *[f"{n}20" for n in NAMES]), (None, None, None, *[None] * len(NAMES))]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n.replace('`', '``')}` string" for n in NAMES]]))


@pytest.mark.parametrize("name", ["lines", "mix", "near", "pii", "quality", "judge"])
def test_no_column_of_the_user_changes(spark, name):
    docs = clashing(spark)
    out = {
        "lines": lambda: linededup.deduplicated(docs),
        "mix": lambda: mixing.mixed(docs),
        "near": lambda: neardup.deduplicated(docs),
        "pii": lambda: pii.sanitised(docs),
        "quality": lambda: quality.accepted(docs, None),
        "judge": lambda: quality.judge(docs, None).select(*[store.column(c) for c in docs.columns]),
    }[name]()
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows
    for r in rows:
        own = list(r)
        if own[0] is None:
            assert own[3:] == [None] * len(NAMES)
        else:
            assert own[3:] == [f"{n}{own[0]}" for n in NAMES]


def test_a_line_stands_once_among_rows_of_one_id(spark):
    rows = [(1, f"one\n{LINE}", "s1"), (1, f"two\n{LINE}", "s2"), (None, f"three\n{LINE}", "s3"), (None, f"four\n{LINE}", "s1"), (2, f"five\n{LINE}", "s4")]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string"), removed_col="removed").collect()
    assert sum(LINE in r.text for r in got) == 1 and sum(r.removed for r in got) == 4
    kept = min((r for r in rows if r[0] is None), key=lambda r: hashlib.md5(r[1].encode()).hexdigest())
    assert [r.text for r in got if LINE in r.text] == [kept[1]]


def test_short_lines_need_more_sites(spark):
    rows = [(i, f"body {i}\nMore.\n  \n-", f"s{i}") for i in range(linededup.SHORT_SITES)] + [(100 + i, f"Less.\ntext {i}", f"s{i}") for i in range(linededup.SHORT_SITES - 1)]
    got = {r.doc_id: r.text for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == rows[0][1] and got[1] == "body 1\n  "
    assert all(got[100 + i] == f"Less.\ntext {i}" for i in range(linededup.SHORT_SITES - 1))


@pytest.mark.parametrize(("kind", "ids"), [("smallint", [3, 1, 2]), ("string", ["c", "a", "b"]), ("binary", [b"c", b"a", b"b"]), ("date", None), ("decimal(20,0)", None)])
def test_fingerprints_of_any_id(spark, kind, ids):
    import datetime as dt
    from decimal import Decimal

    ids = ids or {"date": [dt.date(2020, 1, d) for d in (3, 1, 2)], "decimal(20,0)": [Decimal(10**18 + d) for d in (3, 1, 2)]}[kind]
    docs = spark.createDataFrame(list(zip(ids, ["the text of c " * 9, "abcdef", "ghijkl"], strict=True)), f"doc_id {kind}, text string")
    got = {(bytes(r.doc_id) if kind == "binary" else r.doc_id): r for r in fingerprint.fingerprints(docs).collect()}
    assert set(got) == set(ids) and got[ids[2]].edited_sha256 == hashlib.sha256(b"ghijab").hexdigest()


LONG = " ".join(f"word{(i * i) % 9001}" for i in range(150_000))


def test_texts_of_more_than_a_slice(spark):
    assert len(LONG) > 2 * textkit.SLICE_BYTES
    data, offsets = textkit.buffers(pa.array(["short one", LONG, None]))
    found = quality.statistics(data, offsets)
    assert tuple(int(found[c][1]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(LONG)
    other = LONG[:-40] + " another end"
    rows = [(1, LONG), (2, other), (3, "short one"), (4, LONG + " jo@x.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert {r.class_id for r in neardup.classes(docs).where("doc_id <> 3").collect()} == {1}
    prints = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1].n_chars == len(LONG) and prints[2].near_next > 0.9
    assert {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written(F.col("base")).alias("s")).collect()}[4] == f"email:{len(LONG) + 1}:{len(LONG) + 9}"
    pieces = packing.pack(docs.where("doc_id = 1"), queries.tokenizer("word_bpe_49k.json")).collect()
    encode = encoding.Encoder(queries.tokenizer("word_bpe_49k.json"), 1)
    assert sum(r.length for r in pieces) == len(encode.whole(LONG)) // 4 + 1
    assert mixing.mix(docs).where("doc_id = 1").first()["size"] == 150_000


WIDE = st.text(alphabet=st.one_of(st.characters(min_codepoint=0x400, max_codepoint=0x4FF), st.characters(min_codepoint=0x3041, max_codepoint=0x30FF), st.characters(min_codepoint=0x4E00, max_codepoint=0x4FFF), st.characters(min_codepoint=0xAC00, max_codepoint=0xADFF), st.characters(min_codepoint=0x2010, max_codepoint=0x205E), st.sampled_from(" aZ9'.\n\t́")), max_size=40)
ENCODERS: dict = {}


@settings(max_examples=150, deadline=None)
@given(WIDE, st.sampled_from(["word_bpe_49k.json", "byte_bpe_50k.json"]))
def test_ids_of_other_scripts_are_the_library_s(text, name):
    if name not in ENCODERS:
        ENCODERS[name] = encoding.Encoder(queries.tokenizer(name), None)
    assert ENCODERS[name].encode(text) == ENCODERS[name].whole(text)


def test_another_normalizer_goes_to_the_library(tmp_path):
    import json

    with open(queries.tokenizer("word_bpe_49k.json"), encoding="utf-8") as file:
        made = json.load(file)
    made["normalizer"]["normalizers"][1]["content"] = "x"
    (tmp_path / "other.json").write_text(json.dumps(made))
    encode = encoding.Encoder(str(tmp_path / "other.json"), None)
    assert encode.pattern is None and encode.encode("a b") == encode.whole("a b")
    assert encoding.Encoder(queries.tokenizer("word_bpe_49k.json"), None).pattern is not None


def test_calibration_rows_are_split_at_every_size():
    for n in (2, 3, 9, 49, 50, 200):
        label = (np.arange(n) % 3 == 0).astype(int)
        own, held = quality.every_fifth(label, np.arange(n))
        assert {0, 1} <= set(label[own]) and {0, 1} <= set(label[held])
        for k in (0, 1):
            if (label == k).sum() > 1:
                assert not (own & held)[label == k].any() and held[label == k].sum() == -(-(label == k).sum() // 5)


def test_template_texts_do_not_hide_links(spark, monkeypatch):
    """Many texts of one template share every bucket without being alike; the few that are must be found."""
    monkeypatch.setattr(neardup, "GROUP", 4)
    rng = random.Random(3)
    template = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(45)])) for i in range(50)]
    for i in range(50, 62):
        words = rows[i - 50][1].split()
        words[rng.randrange(125, len(words))] = "changed"
        rows.append((i, " ".join(words)))
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = collections.defaultdict(set)
    for r in got:
        have[r.class_id].add(r.doc_id)
    want = {frozenset(rows[i][0] for i in members) for members in brute_classes(rows).values()}
    assert {frozenset(v) for v in have.values()} == want and any(len(w) == 2 for w in want)


def test_recall_of_pairs_near_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.9: at least nine in ten, measured here as all."""
    rows, pairs = [], 0
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(104)]
        changed = list(words)
        changed[20] = changed[60] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        a, b = ({tuple(w[i : i + 5]) for i in range(100)} for w in (words, changed))
        assert 0.8 <= len(a & b) / len(a | b) < 0.83
        pairs += 1
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).where("class_size = 2").count()
    assert got >= 2 * 0.9 * pairs


# Terms that give entities away, by a plain reading of the definitions.


def groups(rank, value):
    digits = re.sub("[^0-9]", "", value)
    return {0: value.rpartition("@")[2], 1: ".".join(value.split(".")[:2]), 2: digits[:6], 3: digits[:5], 4: ""}[rank]


def secret(text):
    bits = sum(n * math.log2(len(text) / n) for n in collections.Counter(text).values())
    return bool(re.search("[A-Za-z][0-9]+[A-Za-z]", text)) and bits >= pii.SECRET_BITS


def brute_terms(rows):
    documents = {(i is None, i, t) for i, t in rows}
    occurs, contexts, shared, holders = collections.defaultdict(set), collections.defaultdict(lambda: collections.defaultdict(set)), collections.defaultdict(set), collections.defaultdict(set)
    all_contexts = collections.defaultdict(set)
    for d in documents:
        text = d[2] or ""
        for term in {m.lower() for m in re.findall(r"[^\W\d_]{4,}", text)}:
            occurs[term].add(d)
        found = [(rank, m) for rank, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text, re.A) if valid([*PATTERNS][rank], m.group())]
        found += [(4, m) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", text) if secret(m.group())]
        for rank, m in found:
            left = [x.lower() for x in re.findall(r"[^\W\d_]{4,}", text[: m.start()])][-5:][::-1]
            right = [x.lower() for x in re.findall(r"[^\W\d_]{4,}", text[m.end() :])][:5]
            for e in (("value", rank, m.group().lower()), ("group", rank, groups(rank, m.group().lower()))):
                holders[e].add(d)
                all_contexts[e].add((*left, "|", *right))
                for term in {*left, *right}:
                    contexts[e][term].add((*left, "|", *right))
                    shared[e, term].add(d)
    told = set()
    for e, by_term in contexts.items():
        needed = min(3, max(2, len(all_contexts[e])))
        own = math.log2(len(documents) / len(holders[e]))
        for term, seen in by_term.items():
            share = min(len(shared[e, term]) / len(occurs[term]), 1.0)
            gain = math.log2(share * len(documents) / len(holders[e]))
            if own > 1.0 and len(seen) >= needed and -math.log2(share) <= 1.0 and gain > 1e-12 and gain >= 0.5 * own - 1e-12:
                told.add(term)
    return told


def test_terms_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("mar", "tol", "ben", "sil") for b in ("ka", "do", "ri") for c in ("nes", "vel")] + ["from", "with", "that", "were"] * 8
    entities = ["jo@x.org", "kim@x.org", "al@z.org", "10.1.2.3", "10.1.9.9", "+49 30 1234567890", "4111 1111 1111 1111", "key9ab8cd7ef6gh5ij4kl3mn2"]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(3, 25))]
        if rng.random() < 0.4:
            which = rng.randrange(len(entities))
            text.insert(rng.randint(0, len(text)), entities[which])
            text.insert(rng.randint(0, len(text)), f"told{'abcdefgh'[which]}")
        rows.append((i, " ".join(text)))
    rows += [rows[4]] * 3 + [(None, rows[7][1]), (None, rows[7][1]), (500, None), (501, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    told = brute_terms(rows)
    assert told
    got = pii.find(frame).select("doc_id", "spans").collect()
    assert len(got) == len(rows)
    found = {s.text.lower() for r in got for s in r.spans if s.rank == pii.TERM}
    assert found == told
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        text = texts[r.doc_id][0]
        assert all(text[s.start : s.end] == s.text for s in r.spans)
        want = sum(w.lower() in told for w in re.findall(r"[^\W\d_]+", text))
        assert sum(s.rank == pii.TERM for s in r.spans) == want


def test_secrets_and_very_common_entities(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(i, f"some text number{i} token = \"{token[i:] + token[:i]}\" {w}") for i, w in enumerate(("alpha", "bravo", "delta"))]
    rows += [(10 + i, f"ordinary words of page{i} and thanbleshaningtionnthorse here") for i in range(20)] + [(40, "the token is lost")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")).collect()}
    assert "secret:" in got[0].spans and got[0].base == "" and got[10].spans == ""
    assert got[40].spans == "term:4:9"
    # An address that most documents have is given away by no word.
    rows = [(i, f"write to info@x.org for help{'abcdefghij'[i % 10]} about page") for i in range(30)] + [(50, "about page")]
    told = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("exists(spans, s -> s.rank = 5)").count()
    assert told == 0


def test_context_vectors_against_a_plain_loop(spark):
    texts = ["a b c d a", "x", "", None, "b B1 c\n d"]
    got = classifier.contexts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    index, sums = classifier.index_vectors(), np.zeros((classifier.ROWS + classifier.SHAPES, classifier.SIZE))
    for t in texts:
        data, offsets = textkit.buffers(pa.array([t or ""]))
        _, row, shape, _ = classifier.tokens(data, offsets)
        for i in range(len(row)):
            around = sum((index[row[j]].astype(float) for j in range(max(0, i - 2), min(len(row), i + 3)) if j != i), np.zeros(classifier.SIZE))
            sums[row[i]] += around
            sums[classifier.ROWS + shape[i]] += around
    sums -= np.abs(sums).sum(1, keepdims=True) / max(np.abs(sums).sum(), 1) * sums.sum(0, keepdims=True)
    want = sums / (np.sqrt((sums * sums).sum(1, keepdims=True)) + 20)
    assert np.allclose(got, want, atol=1e-5)


def test_short_pieces_share_sequences(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else "a b") for i in range(3000)], "doc_id long, text string").repartition(2)
    got = packing.pack(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    tokens, sequences = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert len(got) == 3000 and sequences <= tokens / 2048 + 3


def test_vocabulary_from_a_table(spark, monkeypatch):
    rows = [("Casino", 2.0), ("casino", None), ("cheap", 0.5), ("pills", None), (None, 3.0), ("", 1.0)]
    terms = spark.createDataFrame(rows, "term string, weight double")
    assert urls.vocabulary(terms) == (("casino",), ("cheap", "pills"))
    monkeypatch.setattr(urls, "MOST_TERMS", 2)
    with pytest.raises(ValueError):
        urls.vocabulary(terms)


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        store.shared_folder(types.SimpleNamespace(conf=conf, sparkContext=context))


# The registered queries on the smallest tables, as the contracts have them.


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@HELD
def test_op1(spark, documents):
    got = queries.op1_mix_sources(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents)
    taken, target = collections.Counter(), {}
    for r in got:
        assert r.size == len(words(documents[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        taken[documents[r.doc_id].source] += r.taken
        target[documents[r.doc_id].source] = r.target
    biggest = max(r.size for r in got)
    assert all(abs(taken[s] - t) <= biggest for s, t in target.items())
    assert sorted(queries.op1_mix_sources(spark, SF).collect()) == sorted(got)


@HELD
def test_op4_op5_op7(spark, documents):
    order = sorted(documents, reverse=True)
    prints = {r.doc_id: r for r in queries.op4_fingerprints(spark, SF).collect()}
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        text = fingerprint.edited(documents[i].text or "", documents[following].text or "")
        assert prints[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and prints[i].n_chars == len(documents[i].text or "")
    encode = encoding.Encoder(queries.tokenizer("word_bpe_49k.json"), 1)
    pieces = collections.defaultdict(list)
    for r in queries.op5_pack(spark, SF).collect():
        pieces[r.doc_id].append(r)
    for i, own in pieces.items():
        ids, at = encode.whole(documents[i].text or "") + encode.end, 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)]) and r.doc_tokens == len(ids) // 4
            at += r.length
        assert at == len(ids) // 4
    assert set(pieces) == set(documents)
    library, start = encoding.Encoder(queries.tokenizer("byte_bpe_50k.json"), 2), 0
    read = {r.doc_id: r for r in queries.op7_token_files(spark, SF).collect()}
    for i in sorted(documents):
        ids = library.whole(documents[i].text or "") + library.end
        assert (read[i].start, read[i].n_tokens, read[i].ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


@HELD
def test_op8_op9(spark, documents):
    got = queries.op8_quality_rules(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for r in got.collect():
        want = brute_statistics(documents[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    for r in queries.op9_quality_classifier(spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


@HELD
def test_op10(spark, documents):
    got = queries.op10_pii(spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        base = brute(documents[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        counts = collections.Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in counts] == [s for s in base.split(",") if s] and r.n_spans == len(spans)
