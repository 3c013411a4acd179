import collections
import hashlib

import numpy as np
import pytest

from strata.llm import fingerprint, neardup, probminhash
from strata.llm.components import components


def shingles(text, k=5):
    words = (text or "").split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_classes(rows):
    """Least id of the connected component of each row, over all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups


def copies(seed=0):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 3000)}"
    rows, next_id = [], 0
    for size in (1, 1, 1, 2, 3, 8, 40):
        base = [word() for _ in range(int(rng.integers(60, 200)))]
        for _ in range(size):
            text = [word() if rng.random() < 0.015 else w for w in base]
            rows.append((next_id, " ".join(text)))
            next_id += 1
    passage = " ".join(word() for _ in range(40))
    for _ in range(25):
        rows.append((next_id, passage + " " + " ".join(word() for _ in range(int(rng.integers(5, 60))))))
        next_id += 1
    rows += [(next_id, rows[5][1].replace(" ", "\n")), (next_id + 1, None), (next_id + 2, ""), (next_id + 3, " \n"), (next_id + 4, "short text"), (next_id + 5, "short  text"), (next_id + 6, "short"), (None, rows[7][1]), (None, "only here " * 9), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_classes_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "GROUP", 4)
    rows = copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS keys").repartition(3)
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows)
    have = collections.defaultdict(list)
    for r in got:
        have[r.class_id].append(r)
    want = collections.Counter()
    for members in brute_classes(rows).values():
        ids = [rows[i][0] for i in members]
        want[min((i for i in ids if i is not None), default=None), tuple(sorted(ids, key=str))] += 1
    found = collections.Counter((k, tuple(sorted((r.doc_id for r in v), key=str))) for k, v in have.items())
    assert found == want
    assert all(sum(r.keep for r in v) == 1 and {r.class_size for r in v} == {len(v)} for v in have.values())
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(have)
    assert neardup.classes(docs.limit(0)).count() == 0 and neardup.deduplicated(docs.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    a, b = np.sort(ids[:45]), np.sort(ids[15:])
    wa = dict(zip(a.tolist(), rng.integers(1, 5, 45).tolist(), strict=True))
    wb = dict(zip(b.tolist(), rng.integers(1, 5, 45).tolist(), strict=True))
    want = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in {*wa, *wb}) for i in wa if i in wb)
    got = []
    for salt in range(30):
        shift = np.uint64(salt * 0x9E3779B9)
        both = np.concatenate((a, b)) ^ shift
        s = probminhash.signatures(both, np.array([*wa.values(), *wb.values()], float), np.array([0, 45, 90]), 256)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.02


def test_signature_of_few_and_none():
    s = probminhash.signatures(np.array([5, 6, 7], np.uint64), np.ones(3), np.array([0, 0, 1, 3]), 64)
    assert not s[0].any() and (s[1] == 5).all() and set(s[2].tolist()) == {6, 7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (150, 300), (7, 7), (500, 400)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {(i, 0) for i in range(61)} | {(i, 100) for i in (100, 150, 200, 300)} | {(400, 400), (500, 400)} | {(1000 + i, 1000) for i in range(50)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def generalised(a, b):
    a, b = collections.Counter(a.split()), collections.Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{int(rng.zipf(1.3)) % 500}"
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(1, 200))))) for i in range(150)]
    rows += [(200, "é" * 7), (201, ""), (202, None), (203, " \n"), (204, rows[3][1]), (None, "last of all"), (205, "same"), (205, "same"), (206, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS role", "'x' AS fingerprint").repartition(5)
    got = fingerprint.fingerprints(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_id, errors = {r.doc_id: r for r in got}, []
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u, r = t or "", u or "", by_id[i]
        edited = fingerprint.edited(t, u)
        assert r.n_chars == len(t)
        if i != 205:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t.split() and edited.split() and i != 205:
            errors.append(r.near_edited - generalised(t, edited))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1
    assert by_id[3].fingerprint == by_id[204].fingerprint and len(by_id[3].fingerprint) == 4 * fingerprint.SAMPLES
    assert by_id[202].near_next == 1.0 and set(by_id[201].fingerprint) == {"0"}
    single = fingerprint.fingerprints(docs.where("doc_id = 3")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_the_weights_do():
    sampler = fingerprint.Sampler(512)
    rng = np.random.default_rng(9)
    for _ in range(8):
        a = [f"t{i}" for i in range(30) for _ in range(int(rng.integers(0, 5)))]
        b = [f"t{i}" for i in range(30) for _ in range(int(rng.integers(0, 5)))]
        codes, has = sampler.codes([" ".join(a).encode(), " ".join(b).encode()])
        assert has.all() and abs((codes[0] == codes[1]).mean() - generalised(" ".join(a), " ".join(b))) < 0.09


def test_repeated_passages_count_once(spark):
    """Pairs of set similarity 0.82, of which one text has half of the other 30 times."""
    rows = []
    for k in range(150):
        words = [f"p{k}w{i}" for i in range(104)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:54] * 30 + words[54:96] + [f"p{k}v{i}" for i in range(8)]))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.class_size != 2 for r in got) == 0 and all(r.class_id == r.doc_id // 2 * 2 for r in got)
