"""Personal data: patterns with checks, then terms that give protected entities away; DataFrame functions alone.

Information-theoretic sanitisation.  Protected are the values that the patterns find, secrets (strings of
so much information that no word has it), and groups of them: the addresses of one domain, of one
network, the numbers of one issuer or area, secrets as such.  Over the whole corpus an entity e that is in
the share P(e) of the documents has -log2 P(e) bits of information, and a term t that occurs with it
leaves -log2 P(e | t) of these unknown, where P(e | t) is the share of t's documents in which t stands close
to e; the rest, the pointwise mutual information, is what t discloses.  A term that leaves no more
than ``most_bits``, that discloses ``least_share`` of e's information or more, and that was seen in enough
different contexts of e is a span too, wherever it occurs: in ``min_contexts`` of them, or, if e has
fewer, in all it has, which must be two or more, as a single context ties no word to e rather than to
its text.  An entity with ``most_bits`` or less is common knowledge, which no term discloses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import attached, column, saved

#: The kinds of the contract, then those that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET, TERM = 4, 5
#: The patterns of the contract.  A match may begin only where a run of its characters begins or where the
#: last match ended, and repetitions don't give back: the same matches, in time that is linear in the text.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A term is a run of so many letters or more; a context is so many of them on either side of an entity.
_TERM = r"\p{L}{4,}"
CONTEXT = 5
MIN_CONTEXTS, MOST_BITS, LEAST_SHARE = 3, 1.0, 0.5
#: A secret is an unbroken run of so many characters with a digit between letters and so many bits by its own letters' frequencies.
_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
SECRET_BITS = 60.0
_SPAN = "array<struct<start:int,rank:int,end:int,text:string>>"


def _bind(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: Column | str, rank: int, ok=None) -> Column:
    """All leftmost non-overlapping matches as (start, rank, end, text) in code points, those that fail ``ok`` dropped."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.split(text, regex, -1).alias("parts"), F.regexp_extract_all(text, regex, F.lit(0)).alias("found"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["parts"])
        end = start + F.length(pair["found"])
        one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), pair["found"].alias("text"))
        grown = F.concat(acc["out"], F.array(one))
        # Only what passes is added, as adding copies what is there: a text may have very many runs of digits.
        return F.struct(end.alias("at"), (F.when(ok(pair["found"]), grown).otherwise(acc["out"]) if ok else grown).alias("out"))

    def place(s: Column) -> Column:
        pairs = F.arrays_zip(F.slice(s["parts"], 1, F.size(s["found"])).alias("parts"), s["found"].alias("found"))
        return F.aggregate(pairs, empty, step, lambda acc: acc["out"])

    return _bind(both, place)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ip_ok(text: Column) -> Column:
    small = lambda p: (F.length(p) <= 3) & (F.when(p == "", 0).otherwise(F.substring(p, 1, 3).cast("int")) <= 255)
    return F.forall(F.split(text, "[.]"), lambda p: _bind(F.ltrim(p, F.lit("0")), small))


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _card_ok(text: Column) -> Column:
    return _bind(_digits(text), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))


def _phone_ok(text: Column) -> Column:
    return F.length(_digits(text)).between(10, 15)


def entities(text: Column) -> Column:
    """The base spans of a text, by start, then kind.  Patterns are only tried on texts that hold a character they need."""
    none = F.array().cast(_SPAN)
    digit = text.rlike("[0-9]")
    tried = [
        F.when(text.contains("@"), _matches(text, _EMAIL, 0)).otherwise(none),
        F.when(digit, _matches(text, _IP, 1, _ip_ok)).otherwise(none),
        F.when(digit, _matches(text, _CARD, 2, _card_ok)).otherwise(none),
        F.when(text.contains("+"), _matches(text, _PHONE, 3, _phone_ok)).otherwise(none),
    ]
    return F.array_sort(F.concat(*tried))


def _information(text: Column) -> Column:
    """Bits of a string under the frequencies of its own characters."""
    size = F.length(text).cast("double")

    def add(acc: Column, letter: Column) -> Column:
        n = size - F.length(F.replace(text, letter, F.lit("")))
        return acc + F.when(letter == "", 0.0).otherwise(n * F.log2(size / n))

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add)


def secrets(text: Column) -> Column:
    """Keys, tokens and hashes, as spans."""
    ok = lambda t: t.rlike("[A-Za-z][0-9]+[A-Za-z]") & (_information(t) >= SECRET_BITS)
    return F.when(text.rlike("[A-Za-z][0-9]+[A-Za-z]"), _matches(text, _SECRET, SECRET, ok)).otherwise(F.array().cast(_SPAN))


def _entities_of(span: Column) -> Column:
    """The protected entities that a span is an occurrence of: its value and the group it belongs to."""
    value, rank = F.lower(span["text"]), span["rank"]
    group = (
        F.when(rank == 0, F.substring_index(value, "@", -1))
        .when(rank == 1, F.substring_index(value, ".", 2))
        .when(rank == 2, F.substring(_digits(value), 1, 6))
        .when(rank == 3, F.substring(_digits(value), 1, 5))
        .otherwise(F.lit(""))
    )
    return F.array(F.xxhash64(F.lit("value"), rank, value), F.xxhash64(F.lit("group"), rank, group))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["end"])), ",")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _nearest(window: Column, whole: Column, text: Column) -> Column:
    """The terms of the window if it is the whole text or has more than a context, as one may be cut at its edge; else of the text."""
    return _bind(_terms(window), lambda terms: F.when(whole | (F.size(terms) > CONTEXT), terms).otherwise(_terms(text)))


def _document() -> Column:
    """A hash that rows of equal id and text share, null ids among them."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_hash")


def _words(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term) of the different terms of every document."""
    return docs.select("doc_id", "text_hash", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))


def disclosing_terms(found: DataFrame, docs: DataFrame, min_contexts: int = MIN_CONTEXTS, most_bits: float = MOST_BITS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(term, bits, pmi, shared) of the terms to hide.

    ``found`` has the documents with spans, as (doc_id, text_hash, text, protected), ``docs`` all, as
    (doc_id, text_hash, text).  Copies of a context count once, towards ``min_contexts`` and for the contexts
    of an entity, and rows that agree in id and text are one document wherever documents are counted.
    """
    around = found.select("doc_id", "text_hash", "text", F.explode("protected").alias("s"))
    start, end, text = F.col("s.start"), F.col("s.end"), F.col("text")
    left = _nearest(F.substring(text, F.greatest(start - 199, F.lit(1)), F.least(start, F.lit(200))), start <= 200, F.substring(text, F.lit(1), start))
    left = F.slice(F.reverse(left), 1, CONTEXT)
    right = F.slice(_nearest(F.substring(text, end + 1, F.lit(200)), F.length(text) - end <= 200, F.substring(text, end + 1, F.length(text))), 1, CONTEXT)
    around = around.select("doc_id", "text_hash", _entities_of(F.col("s")).alias("entities"), F.concat(left, right).alias("terms"))
    around = around.select(_document().alias("document"), F.explode("entities").alias("entity"), F.xxhash64("terms").alias("context"), "terms")
    # Saved, as are the tables joined below, so that a very frequent entity or term is dealt over several tasks.
    needed = around.groupBy("entity").agg(F.least(F.lit(min_contexts), F.greatest(F.lit(2), F.count_distinct("context"))).alias("needed"), F.count_distinct("document").alias("with_entity"))
    needed = saved(needed, "pii-entities")
    around = around.select("document", "entity", "context", F.explode(F.array_distinct("terms")).alias("term"))
    pairs = around.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("document").alias("shared"))
    pairs = saved(pairs.join(needed, "entity").where("contexts >= needed").drop("needed"), "pii-pairs")
    # Documents of every term of the corpus, added up before the shuffle; what repeated rows add goes again.
    again = saved(docs.groupBy(_document().alias("document")).agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "pii-again")
    again = docs.withColumn("document", _document()).join(again, "document").dropDuplicates(["document"])
    each = F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")
    words = docs.select(F.lit(1).cast("long").alias("times"), each).union(again.select(1 - F.col("many"), each))
    counts = words.groupBy(F.xxhash64("term").alias("hash")).agg(F.sum("times").alias("documents"))
    counts = counts.join(pairs.select("term", F.xxhash64("term").alias("hash")).distinct(), "hash").drop("hash")
    total = docs.agg(F.count_distinct(_document()).alias("total"))
    share = F.least(F.col("shared") / F.col("documents"), F.lit(1.0))
    scored = pairs.join(counts, "term").join(F.broadcast(total))  # one row
    scored = scored.select("term", (-F.log2(share)).alias("bits"), F.log2(share * F.col("total") / F.col("with_entity")).alias("pmi"), F.log2(F.col("total") / F.col("with_entity")).alias("own"), "shared")
    told = scored.where((F.col("own") > most_bits) & (F.col("bits") <= most_bits) & (F.col("pmi") > 0) & (F.col("pmi") >= least_share * F.col("own")))
    return told.groupBy("term").agg(F.min("bits").alias("bits"), F.max("pmi").alias("pmi"), F.max("shared").alias("shared"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = MIN_CONTEXTS, most_bits: float = MOST_BITS, least_share: float = LEAST_SHARE) -> DataFrame:
    """All spans of every document: (doc_id, text_hash, base, spans), arrays of (start, rank, end, text).

    Null and empty texts have none.  Rows that agree in id and text each have their row, with the same
    spans; null ids are allowed, and an empty table gives no rows.  Spans of different kinds may overlap.
    """
    rows = docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("text_hash"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    base = rows.select("*", entities(F.col("text")).alias("base"), secrets(F.col("text")).alias("secrets"))
    with_spans = base.where((F.size("base") > 0) | (F.size("secrets") > 0)).select("doc_id", "text_hash", "text", "base", F.array_sort(F.concat("base", "secrets")).alias("protected"))
    with_spans = saved(with_spans.distinct(), "pii-found")
    told = saved(disclosing_terms(with_spans, rows, min_contexts, most_bits, least_share).select("term"), "pii-told")
    key = ["doc_id", "text_hash"]
    renamed = lambda d, *c: d.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), *c)
    out = _left(rows.select(*key), renamed(with_spans, "base", "protected"))
    if told.isEmpty():
        return out.withColumnRenamed("protected", "spans")
    # Documents with such a term, saved, so that Spark knows how few they are and leaves the other texts where they lie.
    hit = saved(_words(rows).join(told, "term", "left_semi").groupBy(*key).agg(F.sort_array(F.collect_set("term")).alias("terms")), "pii-hit")
    texts = rows.join(renamed(hit, "terms"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    terms = saved(texts.select(*key, _matches(F.col("text"), pattern, TERM).alias("extra")).distinct(), "pii-terms")
    out = _left(out, renamed(terms, "extra"))
    return out.select("doc_id", "text_hash", "base", F.array_sort(F.concat("protected", "extra")).alias("spans"))


def _left(rows: DataFrame, more: DataFrame) -> DataFrame:
    """rows with the array columns of ``more`` that go with their id and text, or empty ones."""
    names = more.columns[2:]
    joined = rows.join(more.hint("shuffle_hash"), rows["doc_id"].eqNullSafe(more["__id"]) & (rows["text_hash"] == more["__hash"]), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(c), F.array().cast(_SPAN)).alias(c) for c in names])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with personal data and secrets generalised to their kind, as [EMAIL], and terms removed.

    All rows and columns stay, whatever their names; only the text changes.  Of overlapping spans the
    first decides.  Null texts stay null, rows that agree in id and text change alike.
    """
    spans = find(docs, id_col, text_col, **how).select("doc_id", "text_hash", "spans").where(F.size("spans") > 0).distinct()
    rows, names = attached(docs, {"doc_id": column(id_col), "text_hash": F.xxhash64(column(text_col))}, spans)
    label = F.array(*[F.lit(f"[{k.upper()}]" if k != "term" else "") for k in KINDS])
    text, own = column(text_col), column(names["spans"])

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(label, s["rank"]))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    done = F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.select(*[F.when(own.isNull(), text).otherwise(done).alias(c) if c == text_col else column(c) for c in docs.columns])
