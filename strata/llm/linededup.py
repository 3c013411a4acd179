"""Cross-site line deduplication by distinct-site spread, with DataFrame functions alone.

Every line's hash gathers a HyperLogLog sketch of the sites it stands on; sketches are built on the map
side and merged.  A line whose estimate is well above the threshold is boilerplate, one well below isn't,
and those near it get an exact count of their sites.  A boilerplate line stays where it stands first and
goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import attached, column, fresh, saved

#: A line of at least so many characters, blanks at its ends not counted, that stands on so many sites is boilerplate.
MIN_CHARS, MIN_SITES = 20, 3
#: A shorter line, if it holds a word, repeats by chance more easily: it must stand on so many sites.
SHORT_SITES = 10
#: 2 ** LG_K registers a sketch at most; its relative error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
ERRORS = 5


def _digest(text: Column) -> Column:
    """16 bytes that tell texts apart and order them, the same in any SQL; null has its own."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(line, short, site, doc_id, digest, pos) of all lines with a word; a null site is a site."""
    rows = docs.select(column(id_col).alias("doc_id"), _digest(column(text_col)).alias("digest"), F.xxhash64(column(site_col).isNull(), column(site_col)).alias("site"), F.split(column(text_col), "\n").alias("lines"))
    rows = rows.select("doc_id", "digest", "site", F.posexplode("lines").alias("pos", "text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(F.xxhash64("text").alias("line"), (F.length(F.trim("text")) < min_chars).alias("short"), "site", "doc_id", "digest", "pos")


def _place() -> Column:
    """Where a line stands: the least id (null first), of its texts the one of the least digest, the first line."""
    return F.struct("doc_id", "digest", "pos")


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_chars: int = MIN_CHARS, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES) -> DataFrame:
    """(line, first) of every boilerplate line: its 64-bit hash, and the (doc_id, digest of the text, pos) where it stands first.

    Null texts have no lines, a null site is a site of its own, ties of id go by the texts' digests; an
    empty table has no boilerplate.
    """
    lines = _lines(docs, id_col, text_col, site_col, min_chars)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times"), F.first("short").alias("short"))
    least = F.when(F.col("short"), F.lit(short_sites)).otherwise(F.lit(min_sites))
    spread = spread.withColumn("least", least).where(F.col("times") >= F.col("least")).select("line", "first", "least", F.hll_sketch_estimate("sketch").alias("sites"))
    error = F.col("least") * (ERRORS * 1.04 / 2 ** (LG_K / 2)) + 0.5
    spread = saved(spread.where(F.col("sites") >= F.col("least") - error), "line-spread")
    near = F.col("sites") <= F.col("least") + error
    close = spread.where(near).select("line", "least")
    sites = lines.join(close.select("line"), "line", "left_semi").select("line", "site").distinct()
    exact = sites.groupBy("line").agg(F.count(F.lit(1)).alias("exact")).join(close, "line").where(F.col("exact") >= F.col("least")).select("line")
    return spread.where(~near).select("line", "first").unionByName(spread.where(near).join(exact, "line").select("line", "first"))


def _kept(text: Column, gone: Column) -> Column:
    """The text without the lines at the places ``gone``; the lines are split once."""
    bound = F.array(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")))
    keep = lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: F.get(s["lines"], i))
    return F.transform(bound, lambda s: F.array_join(keep(s), "\n"))[0]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_chars: int = MIN_CHARS, min_sites: int = MIN_SITES, short_sites: int = SHORT_SITES, removed_col: str | None = None) -> DataFrame:
    """The documents with boilerplate lines removed but where each stands first, by id (null first), digest of the text and place.

    All rows and columns stay, whatever their names; only the text changes, and may become empty.  Null
    texts stay null.  Rows that agree in id and text lose the same lines; of rows that agree in id alone one
    keeps a line.  ``removed_col`` names a column to add for the number of lines removed.
    """
    bad = boilerplate(docs, id_col, text_col, site_col, min_chars, min_sites, short_sites)
    found = _lines(docs, id_col, text_col, site_col, min_chars).join(bad, "line").where(~_place().eqNullSafe(F.col("first")))
    gone = found.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("gone"))
    (digest,) = fresh(docs, "digest")
    text = column(text_col)
    rows, names = attached(docs.withColumn(digest, _digest(text)), {"doc_id": column(id_col), "digest": column(digest)}, gone)
    places = column(names["gone"])
    out = [F.when(places.isNull(), text).otherwise(_kept(text, places)).alias(text_col) if c == text_col else column(c) for c in docs.columns]
    if removed_col:
        out.append(F.coalesce(F.size(places), F.lit(0)).cast("long").alias(removed_col))
    return rows.select(*out)
