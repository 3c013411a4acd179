"""The registered queries of the text operators, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, fingerprint, linededup, mixing, neardup, packing, pii, quality, tokenfile, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each row.  Rows equal in id, source and text have a row each with the same result; null text has size 0, a null source is the last source."""
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    plan = plan.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every row; nulls, empty texts and repeated rows as in ``neardup.classes``."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "tree_links", "keep")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row; null urls have an empty host and path and no rule."""
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row in descending order of ids, null ids last, rows of one id by their texts; null text is empty."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece; null text has its end id alone, repeated rows are packed each by itself."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its text without boilerplate lines; null texts stay null, null sources are one site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.deduplicated(docs, removed_col="removed").drop("source")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as read back from the files, null ids last, null text as the end id alone; rows of one id are ordered by their texts."""
    return tokenfile.read(tokenfile.write(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row; null and empty texts fail the base rule."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=("doc_id",))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every row; null and empty texts have the score of an all-zero input, a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    vectors = classifier.contexts(docs)
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels"), vectors), vectors)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans of every document; n_secret and n_term count those that the method adds, n_spans all.  Repeated rows and null ids each have their row."""
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda spans, rank: F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
    base = [count("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    more = [count("spans", pii.SECRET).alias("n_secret"), count("spans", pii.TERM).alias("n_term"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *base, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"), *more)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _count_terms(terms: tuple[str, ...]) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms)


OP3_SQL = f"""
WITH rest AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS tail
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(tail, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(tail, '/') > 0 THEN substr(tail, strpos(tail, '/')) ELSE '' END AS path
  FROM rest),
ruled AS (
  SELECT *, '.' || host AS dotted,
    CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    {_count_terms(urls.STRICT)} AS strict_hits,
    {_count_terms(urls.SOFT)} AS soft_hits
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits
FROM ruled
"""


OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, md5(text) AS digest, coalesce('s' || source, 'null') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
placed AS (
  SELECT *, {{'n': doc_id IS NOT NULL, 'd': coalesce(doc_id, 0), 't': digest, 'p': pos}} AS place FROM lines),
counted AS (
  SELECT line, min(place) AS first FROM placed WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line
  HAVING count(DISTINCT site) >= CASE WHEN length(trim(line)) < {linededup.MIN_CHARS} THEN {linededup.SHORT_SITES} ELSE {linededup.MIN_SITES} END),
kept AS (
  SELECT l.doc_id, l.digest, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.line IS NULL OR c.first = l.place) AS text,
    count(*) FILTER (WHERE c.line IS NOT NULL AND c.first <> l.place) AS removed
  FROM placed l LEFT JOIN counted c ON l.line = c.line GROUP BY l.doc_id, l.digest)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(k.removed, 0) AS removed
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(d.text) = k.digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op6_line_dedup": OP6_SQL}
