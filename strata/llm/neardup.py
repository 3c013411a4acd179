"""Near duplicates: ProbMinHash signatures in bands, exact verification, connected components.

Texts of the same words are one node.  All shingles weigh the same in the signatures, so that registers
agree as often as the sets are similar.  Two nodes that agree in a band are candidates; they are linked if
the exact Jaccard similarity of their sets of five-word shingles is 0.8 or more.  In each bucket all
nodes are first compared with one of them, so that a bucket of copies becomes one component in linear
work; after that only nodes of different components are compared, in blocks of bounded size, all of
them.  Where more than a block of a bucket's nodes is unconnected (texts of one template, say), only those
are compared that have one of their rarest shingles in common, which loses no link.  Nothing of a bucket
is capped or skipped but pairs that are already connected, and a block gives no more links than join
its components.  Shingles are compared by 32 bits of their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .probminhash import band_keys, distinct, signatures
from .store import attached, column, dropped, fresh, saved
from .textkit import ngrams, slice_batches, spans, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 agrees in one of the bands with probability 0.99997, one of 0.7 with 0.992, one of 0.4 with 0.24.
BANDS, ROWS = 26, 5
GROUP = 256


def _profiles(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), F.xxhash64(column(text_col)).alias("text_hash"))
    schema = f"doc_id {kind}, text_hash long, uid long, digest binary, n long, signature binary, keys array<long>, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, offsets in slice_batches(batch, "text"):
                starts, _, first = spans(data, offsets)
                grams, at = ngrams(word_hashes(data, starts), first, words)
                sets, _, at = distinct(grams, at)
                signature = signatures(sets, np.ones(len(sets)), at, bands * rows)
                keys = band_keys(signature, bands, rows).view(np.int64)
                some = np.diff(at) > 0
                raw, n = data.tobytes(), len(offsets) - 1
                digests = [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                short = (sets >> np.uint64(32)).astype(np.uint32)
                shingles = [np.unique(short[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                sizes = np.where(some, bands, 0)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.arange(uid, uid + n)), pa.array(digests, pa.binary()), pa.array([len(x) // 4 for x in shingles], pa.int64()), pa.array([x.tobytes() for x in (signature >> np.uint64(48)).astype(np.uint16)], pa.binary()), listed, pa.array(shingles, pa.binary())],
                    names=["doc_id", "text_hash", "uid", "digest", "n", "signature", "keys", "shingles"],
                )
                uid += n

    return source.mapInArrow(run, schema)


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets are similar.  Pairs are dealt by a and, where a has many, by blocks of b."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("blocks"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").alias("block"), F.col("b").alias("node"))
    centers = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node"))
    rows = members.union(centers).join(sets, "node").select("a", "block", "node", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        center = table.column("a")[0].as_py()
        nodes, raw = table.column("node").to_pylist(), table.column("shingles")
        own = np.frombuffer(raw[nodes.index(center)].as_py(), np.uint32)
        linked = []
        for node, other in zip(nodes, raw, strict=True):
            if node != center:
                b = np.frombuffer(other.as_buffer(), np.uint32)
                both = len(np.intersect1d(own, b, assume_unique=True))
                if both >= similarity * (len(own) + len(b) - both) - 1e-9:
                    linked.append(node)
        return pa.table({"a": pa.array([center] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return rows.groupBy("a", "block").applyInArrow(compare, "a long, b long")


def _close(table: pa.Table, bands: int, rows: int, similarity: float) -> pa.Table:
    """The rows of one block that have a partner on its other side: in another component, of similar size, and in no earlier band together."""
    side, node, root, n = (table.column(c).to_numpy() for c in ("side", "node", "root", "n"))
    codes = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(node), bands * rows)
    band = table.column("band")[0].as_py()
    early = codes[:, : band * rows].reshape(len(node), band, rows)
    few, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    use = np.zeros(len(node), bool)
    for x in few:
        y = every[root[every] != root[x]]
        y = y[np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x])]
        if band and len(y):
            y = y[~(early[y] == early[x]).all(2).any(1)]
        if len(y):
            use[x] = True
            use[y] = True
    return table.select(["key", "i", "j", "side", "node", "root"]).filter(pa.array(use))


def _connect(table: pa.Table, similarity: float) -> pa.Table:
    """Links of similar sets between the two sides of a block, as many as join different components.

    Intersections are counted over an index of the one side's shingles.
    """
    side, node, root = (table.column(c).to_numpy() for c in ("side", "node", "root"))
    raw = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("shingles")]
    few, every = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1)
    sizes = np.array([len(raw[y]) for y in every])
    owner = np.repeat(np.arange(len(every)), sizes)
    shingle = np.concatenate([raw[y] for y in every]) if len(every) else np.zeros(0, np.uint32)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    out: list[tuple[int, int]] = []
    for x in few:
        lo, hi = np.searchsorted(shingle, raw[x], "left"), np.searchsorted(shingle, raw[x], "right")
        many = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        both = np.bincount(owner[at], minlength=len(every))
        for k in np.flatnonzero((both >= similarity * (len(raw[x]) + sizes - both) - 1e-9) & (root[every] != root[x])).tolist():
            y = int(every[k])
            a, b = find(int(root[x])), find(int(root[y]))
            if a != b:
                parent[a] = b
                out.append((int(node[x]), int(node[y])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _components(links: DataFrame) -> DataFrame:
    found = components(links)
    out = saved(found, "components")
    dropped(found)
    return out


def _blocks(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """What of each bucket (key, band, node, root) isn't in its largest component, against all of it, in blocks of bounded size."""
    shares = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"))
    split = shares.groupBy("key").agg(F.sum("many").alias("all"), F.max(F.struct("many", "root")).alias("most")).where("all > most.many")
    split = saved(split.select("key", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.many")) / GROUP).alias("few_blocks"), F.ceil(F.col("all") / (4 * GROUP)).alias("all_blocks")), "split")
    members = rooted.join(split, "key").join(sets.select("node", "n", "signature"), "node")
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    few = members.where("root <> main").withColumn("i", F.pmod(F.xxhash64("node"), "few_blocks")).withColumn("j", F.explode(upto("all_blocks"))).withColumn("side", F.lit(0))
    every = members.withColumn("j", F.pmod(F.xxhash64("node"), "all_blocks")).withColumn("i", F.explode(upto("few_blocks"))).withColumn("side", F.lit(1))
    return few.unionByName(every).select("key", "band", "i", "j", "side", "node", "root", "n", "signature")


def _rare(rooted: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Splits the buckets with many nodes outside their largest component by the shingles that tell these apart.

    Returns the other buckets, in place of these ones a bucket (key, band, node, root) for each shingle
    that several of their nodes have among their rarest, and the tables to drop later.  With all shingles in one order, two sets of n
    shingles or more can't reach the similarity without one in common among the first n - ceil(similarity n) + 1
    of each, so no link is lost; in the order from rare to common few sets have these in common unless they are
    alike, however much of a template they share.
    """
    shares = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many")).groupBy("key").agg(F.sum("many").alias("all"), F.max("many").alias("most"))
    wide = saved(shares.where((F.col("all") - F.col("most") > GROUP) & (F.col("all") > 4 * GROUP)).select("key"), "wide")
    if wide.isEmpty():
        return rooted, rooted.limit(0), [wide]
    nodes = rooted.join(wide, "key", "left_semi").select("node", "root").distinct()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = batch.slice(lo, 256)
                raw = [np.frombuffer(x.as_buffer(), np.uint32) for x in own.column(3)]
                sizes = np.array([len(x) for x in raw])
                many = np.repeat(np.arange(own.num_rows), sizes)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(many)) for c in own.columns[:3]] + [pa.array(np.concatenate(raw).astype(np.int64))], names=["node", "root", "n", "shingle"])

    each = saved(nodes.join(sets.select("node", "n", "shingles"), "node").select("node", "root", "n", "shingles").mapInArrow(listed, "node long, root long, n long, shingle long"), "wide-shingles")
    often = saved(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")), "wide-counts")
    order = Window.partitionBy("node").orderBy("often", "shingle")
    first = each.join(often, "shingle").withColumn("place", F.row_number().over(order))
    first = first.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & (F.col("often") > 1))
    keys = first.select(F.xxhash64(F.lit("rare"), "shingle").alias("key"), F.lit(0).alias("band"), "node", "root")
    return rooted.join(wide, "key", "left_anti").select("key", "band", "node", "root"), keys, [wide, each, often]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: (doc_id, text_hash, uid, class_id, class_size, tree_links, keep).

    class_id is the least id of the class, tree_links the number of links that its text has among those
    that were found before the class was whole: enough to hold it together, not all there are.  keep is
    true for one row of each class, the one of the least id.  Texts of fewer words than a shingle are one
    shingle; those without a word, null among them, are one class.  A class without any id has a null
    class_id.  Repeated rows each have their row; one of them at most is kept.  An empty table gives no rows.
    """
    rows_of = saved(_profiles(docs, id_col, text_col, words, bands, rows), "profiles")
    nodes = saved(rows_of.groupBy("digest").agg(F.min("uid").alias("node")), "nodes")
    exploded = rows_of.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi").select("uid", "n", F.posexplode("keys").alias("band", "key"))
    # The first node of a bucket in an order of its own, so that a node meets different ones in its buckets.
    order = F.col("uid").bitwiseXOR(F.col("key"))
    buckets = exploded.groupBy("key").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    buckets = saved(buckets.select("key", F.col("first").bitwiseXOR(F.col("key")).alias("center")), "centers")
    inside = saved(exploded.join(buckets, "key").select("key", "band", "center", F.col("uid").alias("node"), "n"), "buckets")
    sets = rows_of.join(inside.select(F.col("node").alias("uid")).distinct(), "uid", "left_semi").select(F.col("uid").alias("node"), "n", "signature", "shingles")
    sets = saved(sets, "shingles")
    slim = saved(rows_of.select("doc_id", "text_hash", "uid", "digest"), "documents")
    dropped(rows_of)  # what is read from here on has been written
    # Each bucket against its first node.
    size = sets.select(F.col("node").alias("center"), F.col("n").alias("center_n"))
    star = inside.where("node <> center").select("center", "node", "n").distinct().join(size, "center")
    alike = F.least("n", "center_n") >= similarity * F.greatest("n", "center_n")
    stars = saved(_verify(star.where(alike).select(F.col("center").alias("a"), F.col("node").alias("b")), sets.select("node", "shingles"), similarity), "links")
    known = _components(stars)
    # Then across components.
    rooted = inside.select("key", "band", "node").join(known, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    rooted = saved(rooted, "rooted")
    dropped(inside)
    dropped(known)
    usual, rare, used = _rare(rooted, sets, similarity)

    def close(table: pa.Table) -> pa.Table:
        return _close(table, bands, rows, similarity)

    def connect(table: pa.Table) -> pa.Table:
        return _connect(table, similarity)

    blocks = _blocks(usual.unionByName(rare), sets)
    near = saved(blocks.groupBy("key", "i", "j").applyInArrow(close, "key long, i long, j long, side int, node long, root long"), "near")
    more = near.join(sets.select("node", "shingles"), "node").groupBy("key", "i", "j").applyInArrow(connect, "a long, b long")
    links = saved(stars.union(more), "links")
    for done in (stars, rooted, near, sets, buckets, *used):
        dropped(done)
    known = _components(links)
    # Back to the documents.  Both sides of a join on a text or a class are saved, so that a very frequent one is dealt over several tasks.
    degrees = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degrees = degrees.select(F.col("a").alias("node")).union(degrees.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("tree_links"))
    roots = nodes.join(known, "node", "left").join(degrees, "node", "left").select("digest", F.coalesce("root", "node").alias("root"), F.coalesce("tree_links", F.lit(0).cast("long")).alias("tree_links"))
    roots = saved(roots, "roots")
    for done in (nodes, known, links):
        dropped(done)
    placed = saved(slim.join(roots, "digest").drop("digest"), "placed")
    first = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"))
    first = saved(first.select("root", "class_id", "class_size", F.col("first.uid").alias("first")), "classes")
    dropped(slim)
    dropped(roots)
    return placed.join(first, "root").select("doc_id", "text_hash", "uid", "class_id", "class_size", "tree_links", (F.col("uid") == F.col("first")).alias("keep"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with one row of each class, the one of the least id (null last); all columns kept, whatever their names.

    Of repeated rows one stays; texts without a word are one class; an empty table stays empty.
    """
    keep = classes(docs, id_col, text_col, **how).where("keep").select("doc_id", "text_hash")
    (again,) = fresh(docs, "again")
    rows, _ = attached(docs, {"doc_id": column(id_col), "text_hash": F.xxhash64(column(text_col))}, keep, "left_semi")
    order = Window.partitionBy(column(id_col), F.xxhash64(column(text_col))).orderBy(F.lit(1))
    return rows.withColumn(again, F.row_number().over(order)).where(column(again) == 1).drop(again)
