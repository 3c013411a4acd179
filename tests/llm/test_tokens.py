import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import packing, tokenfile
from strata.llm.eliasfano import EliasFano
from strata.llm.encoding import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = {"word_bpe_49k.json": 1, "byte_bpe_50k.json": 2}
ODD = ["", "  a  b\n\n c", "it's don't 'll x's IT'S", "<|endoftext|> a<|endoftext|>b", "a b c", "É é x́ ́y", "İstanbul ΑΣ Σ", "tab\t\tx\r\n y \n", "   ", "a" * 100 + " " + "b" * 5000, "中文 字 1234 12a", "a\u0085b\x1cc", "​zero", "ﬁ ½ ²", "_a_ __ b_1 a1_b", "«é» „x“ … –", "ªº µ ß ÿ ŉ ǆ", "한국어 カタカナ", "Привет Ёж", "a\x0bb\x0cc", "emoji 😀!"]


@pytest.fixture(scope="module", params=[(f, s) for f in FILES for s in (False, True)])
def encoder(request):
    return Encoder(public_tokenizers.path(request.param[0]), FILES[request.param[0]], request.param[1])


def test_known_patterns(encoder):
    assert encoder.pattern is not None


def test_odd_texts(encoder):
    for text in ODD:
        assert encoder.encode(text) == encoder.whole(text) + encoder.end
    assert encoder.encode(None) == encoder.end


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("ab'st \n\t.1é_"), st.characters(max_codepoint=0x3FF)), max_size=30))
def test_any_text(encoder, text):
    assert encoder.encode(text) == encoder.whole(text) + encoder.end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.integers(-(1 << 50), 1 << 50))
def test_elias_fano(gaps, low):
    values = np.cumsum(np.array([low, *gaps], np.int64))
    code, end = EliasFano.from_bytes(b"xx" + EliasFano.of(values).to_bytes() + b"y", 2)
    assert code.all().tolist() == values.tolist() and end == 2 + len(EliasFano.of(values).to_bytes())
    for i in range(0, len(values), 7):
        assert code.select(i) == values[i]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 30, 100_000))
    assert len(EliasFano.of(values).to_bytes()) * 8 < 100_000 * (2.3 + np.log2((1 << 30) / 100_000) + 32 / 256)


ROWS = [(5, "five words are in here"), (1, None), (9, ""), (3, "three"), (3, "three"), (None, "no id"), (2, "x " * 3000), (7, "The quick brown fox. " * 30)]


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS shard").repartition(3)
    manifest = tokenfile.write(docs, path, to=f"{tmp_path}/shards")
    got = tokenfile.read(manifest).collect()
    library, want, start = Encoder(path, 2), {}, 0
    for r in tokenfile.read(manifest).orderBy("start").collect():
        assert r.start == start
        start += r.n_tokens
        want.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    expect: dict = {}
    for i, text in ROWS:
        raw = library.whole(text or "") + library.end
        expect.setdefault(i, []).append((len(raw) // 4, zlib.crc32(raw)))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted(v) for k, v in expect.items()} and len(got) == len(ROWS)
    ids = [r.doc_id for r in tokenfile.read(manifest).orderBy("start").collect()]
    assert ids == [1, 2, 3, 3, 5, 7, 9, None]
    shard = tokenfile.Shard(manifest.orderBy("shard").first().path)
    assert shard.document(0).tolist() == [2] and shard.width == 2
    assert tokenfile.read(tokenfile.write(docs.limit(0), path)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=17, max_size=17))
def test_plan_covers_every_order(demand):
    demand = np.array([0, *demand[1:]])
    done = np.zeros(17, np.int64)
    for pattern, times in packing.plan(demand):
        assert times > 0 and (pattern * np.arange(17)).sum() <= 16
        done += pattern * times
    assert (done >= demand).all()
    least = -(-int((demand * np.arange(17)).sum()) // 16)
    assert sum(t for _, t in packing.plan(demand)) <= least * 1.5 + 3


def test_plan_is_tight():
    demand = np.random.default_rng(2).integers(0, 2000, 257)
    demand[0] = 0
    sequences = sum(times for _, times in packing.plan(demand))
    assert sequences * 256 <= (demand * np.arange(257)).sum() * 1.02


def test_pack(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(3)
    rows = ROWS + [(100 + i, "word " * int(rng.integers(1, 700))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS part").repartition(4)
    got = packing.pack(docs, path, keep_ids=True).collect()
    library, held = Encoder(path, 1), {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for cut in held.values():
        cut.sort()
        assert cut[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(cut, cut[1:])) and sum(n for _, n in cut) <= 2048
    total = 0
    for i, text in rows:
        raw = library.whole(text or "") + library.end
        total += len(raw) // 4
        if i is not None and i != 3:
            own = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == i)
            assert b"".join(b for _, b in own) == raw and {r.doc_tokens for r in got if r.doc_id == i} == {len(raw) // 4}
    assert sum(r.length for r in got) == total and len(held) <= total / 2048 * 1.05 + 2
    assert packing.pack(docs.limit(0), path).count() == 0
