import random
import re

from pyspark.sql import functions as F

from strata.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "", re.A) if valid(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


ODD = ["", None, "a@b.c_d@e.f", "x.y@z.w 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "😀é a+b@c.d é 4111 1111 1111 1111, 4111-1111-1111-1112 +1 (555) 010-9999", "+1 2345678901+49 30 123456-78 +", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "@@ a@b a@.c a@b..c 9999999999999999999999.1.1.1", "9" * 50_000 + "@x.y " + "1 " * 8000, "a" * 200_000 + "@", "4" * 16 + " 5500005555555559 378282246310005"]


def spans(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "'s' AS spans")
    return pii.find(frame).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")).collect()


def test_base_against_python(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("a1.9@+- ()_b\n4é") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]
    got = spans(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.base == brute(texts[4 if r.doc_id is None else r.doc_id])
    assert spans(spark, []) == []


def test_terms_that_give_an_entity_away(spark):
    places = ["paris", "london", "rome", "berlin", "oslo"]
    names = ["alpha", "bravo", "delta", "gamma", "omega"]
    rows = [(i, f"{names[i]} Blenkinsop wrote to jo@x.org from {places[i]}") for i in range(5)]
    rows += [(10 + i, f"somebody wrote text number {i} from home") for i in range(20)] + [(40, "Mr Blenkinsop was here")]
    # Copies of one text are one context, so their words aren't tied to the address.
    rows += [(50 + i, "unusual words around kim@y.org stand together") for i in range(6)]
    got = {r.doc_id: r.spans for r in spans(spark, rows)}
    assert got[40] == "term:3:13" and got[0] == "term:6:16,email:26:34"
    assert got[10] == "" and all(got[50 + i] == "email:21:30" for i in range(6))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    clean = {r.doc_id: r.text for r in pii.sanitised(frame).collect()}
    assert clean[40] == "Mr  was here" and clean[50] == "unusual words around [EMAIL] stand together" and clean[10] == rows[5][1]


def test_terms_of_an_entity_with_two_contexts(spark):
    rows = [(1, "Blenkinsop wrote to jo@x.org from paris"), (2, "when Blenkinsop told jo@x.org about rome"), (3, "Mr Blenkinsop was here")]
    rows += [(4, "Quibbleton uses kim@y.org daily"), (5, "uses daily")]
    # Of three contexts two aren't all.
    rows += [(6, "Farthingale called al@z.org once"), (7, "Farthingale called al@z.org twice"), (8, "nobody called al@z.org ever")]
    got = {r.doc_id: r.spans for r in spans(spark, rows)}
    assert got[1] == "term:0:10,email:20:28" and got[3] == "term:3:13"
    assert got[4] == "email:16:25" and got[5] == ""
    assert got[6] == "term:12:18,email:19:27" and got[8] == "term:7:13,email:14:22"


def test_context_is_not_cut_by_distance(spark):
    gap = "1 a " * 200
    rows = [(1, f"Blenkinsop {gap}jo@x.org {gap}Quibbleton"), (2, f"Blenkinsop {gap}about jo@x.org {gap}Quibbleton")]
    # The edge of a window of 200 characters would leave "inds" of the first word.
    rows += [(i, f"kinds {'b' * 194} kim@y.org {word}") for i, word in ((3, "once"), (4, "twice"))] + [(5, "inds")]
    got = {r.doc_id: r.spans for r in spans(spark, rows)}
    assert got[1] == f"term:0:10,email:{11 + len(gap)}:{19 + len(gap)},term:{20 + 2 * len(gap)}:{30 + 2 * len(gap)}"
    assert got[5] == ""


def test_repeated_rows_and_null_ids_count_as_documents_once(spark):
    rows = [(1, "Blenkinsop wrote to jo@x.org from paris")] * 3 + [(2, "when Blenkinsop told jo@x.org about rome")] * 3
    rows += [(None, "Quibbleton called al@z.org once"), (None, "later Quibbleton heard al@z.org twice"), (3, "Mr Blenkinsop met Quibbleton")]
    got = {r.doc_id: r.spans for r in spans(spark, rows)}
    assert got[3] == "term:3:13,term:18:28"
