"""MinHash near-duplicate groups by one-permutation hashing.

One hash of each shingle gives both its bin and its value; empty bins borrow from a bin that a fixed random sequence of their
own finds (optimal densification), so that every bin agrees with the Jaccard similarity of two sets. Four bins make a
band; equal bands share a bucket. At similarity 0.75 two sets miss all 32 bands with a chance of about 5 in a million.

Texts with equal sets are one class first, so copies are never paired. In each bucket the classes are paired with a hub
alone (a star): the member whose buckets hold most classes, which is the one most like the others. Pairs are confirmed on
full sets. Where classes that meet in a bucket are still in different components, a hub may have been too far from two similar members. These
classes go through an exact set-similarity join, which loses no link between them:
cross: a shingle that stands in one component alone can't link two. It comes first in the order of shingles, the others follow by how many
sets have them;
prefix: two similar sets of different components have a shingle in common among the first n - need + 1 of each (need: percent of n), so a set with fewer
than `need` cross shingles is out, which ends the matter for texts that share boilerplate and little else;
a shingle in the prefixes of at most FEW sets gives pairs, which are confirmed; one in more gives pairs of blocks of BLOCK sets, and a task counts the common
shingles of two blocks as a matrix product and returns only links.

Joins on sets, on buckets and on the shingles of prefixes take the largest ones apart: those with one row in SHARES or more. There are at most SHARES of them, so
what they meet is broadcast, and no task gets such a group whole.

Null doc_ids and texts without words stand alone (component_id is their own doc_id); rows with one doc_id count as one
document, each with the links of its own text; texts of any length are read whole; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import CHUNK_BYTES, batches_by_bytes, cut, drop, flat, texts
from ledgerline.llm.components import components
from ledgerline.llm.shingles import mix, shingle_sets, similar

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
BLOCK = 256
FEW = 16
SHARES = 1_024
EDGES = (np.arange(BINS, dtype=np.uint64)) << np.uint64(64 - BINS.bit_length() + 1)


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """Row a, column i: the bin that empty bin i tries at its attempt a."""
    return np.random.default_rng(11).integers(0, BINS, (64 * BINS, BINS))


def bands(shingles: np.ndarray) -> np.ndarray:
    """The band hashes of a sorted set that is not empty."""
    at = np.append(np.searchsorted(shingles, EDGES), len(shingles))
    there = at[1:] > at[:-1]
    value = np.zeros(BINS, np.uint64)
    value[there] = shingles[at[:-1][there]]
    empty = np.flatnonzero(~there)
    lo, step = 0, 16
    while len(empty):
        tries = _donors()[lo : lo + step, empty]
        if not len(tries):  # never seen; the next bin that has a value
            filled = np.flatnonzero(there)
            value[empty] = value[filled[np.searchsorted(filled, empty) % len(filled)]]
            break
        good = there[tries]
        hit = good.any(axis=0)
        value[empty[hit]] = value[tries[good.argmax(axis=0), np.arange(len(empty))][hit]]
        empty, lo, step = empty[~hit], lo + step, step * 4
    weight = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((value.reshape(BANDS, ROWS) * weight).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits of the whole set; null for an empty one) and bands."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", 4 * CHUNK_BYTES):
            sets = shingle_sets(*flat(batch.column("text")), k)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            found = [bands(s).view(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands"])

    return texts(docs).mapInArrow(work, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def confirm(pairs: DataFrame, whole: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of doc_ids whose texts (whole: doc_id, text) are similar on full sets. v, not u, may stand in very many."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "u_text", 4 * CHUNK_BYTES):
            left = shingle_sets(*flat(batch.column("u_text")), k)
            texts_ = batch.column("v_text").dictionary_encode()  # by text, as rows may share a doc_id with different texts
            right = shingle_sets(*flat(texts_.dictionary), k)
            yield batch.select(["u", "v"]).filter(pa.array([similar(s, right[x], percent) for s, x in zip(left, texts_.indices.to_pylist(), strict=True)], pa.bool_()))

    u = pairs.join(whole.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text")), "u")
    return u.join(whole.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text")), "v").select("u", "v", "u_text", "v_text").mapInArrow(work, "u long, v long").distinct()


def hot_keys(table: DataFrame, key: str, n: str, rows: int) -> list:
    """The keys of `table` with a share of 1 / SHARES or more of `rows` rows, by their counts `n`: at most SHARES."""
    return [r[key] for r in table.filter(F.col(n) * SHARES >= rows).select(key).distinct().collect()]


def on_key(rows: DataFrame, table: DataFrame, hot: list, key: str = "bucket") -> DataFrame:
    """Inner join of `rows` with `table`, which has one row per key; those of the `hot` keys, at most SHARES, are broadcast."""
    if not hot:
        return rows.join(table, key)
    large = F.col(key).isin(hot)
    return rows.filter(~large).join(table.filter(~large), key).union(rows.filter(large).join(F.broadcast(table.filter(large)), key))


def stars(members: DataFrame, hot: list[int]) -> DataFrame:
    """Pairs (u, v) of each class with its buckets' hubs; members: bucket, node, size (classes in the bucket)."""
    crowds = members.withColumn("crowd", F.sum("size").over(Window.partitionBy("node")))  # a node has BANDS rows at most
    best = crowds.groupBy("bucket").agg((-F.max(F.struct("crowd", (-F.col("node")).alias("first")))["first"]).alias("hub"))
    return on_key(members, best, hot).filter("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()


def unsettled(members: DataFrame, hot: list[int]) -> DataFrame:
    """node, component of the members (bucket, node, component) of buckets that hold several components."""
    several = members.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("bucket")
    return on_key(members, several, hot).select("node", "component").distinct()


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of `a` has in common with each set of `b`."""
    number = lambda sets: np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    count = np.zeros((len(a), len(b)), np.float32)
    of_a, of_b = number(a), number(b)
    for lo in range(0, len(both), 8_192):
        part = both[lo : lo + 8_192]
        sides = []
        for values, rows, n in ((flat_a, of_a, len(a)), (flat_b, of_b, len(b))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            side = np.zeros((n, len(part)), np.float32)
            side[rows[hit], at[hit]] = 1
            sides.append(side)
        count += sides[0] @ sides[1].T
    return count.astype(np.int64)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, component, key, size, shingle of the shingles in each set's prefix; sets: node, component, key, size, shingles."""
    rows = sets.select("node", "component", "key", "size", F.explode("shingles").alias("shingle"))
    cross = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("shingle", "n")
    own = Window.partitionBy("node", "key")
    ranked = rows.join(cross, "shingle").withColumn("r", F.row_number().over(own.orderBy("n", "shingle"))).withColumn("c", F.count("*").over(own))
    return ranked.filter(f"r <= c - ceil({percent} * size / 100) + 1").select("node", "component", "key", "size", "shingle")


def rest_links(live: DataFrame, whole: DataFrame, k: int, percent: int) -> DataFrame:
    """All links (u, v) between different components of the classes `live` (node, component)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text", 4 * CHUNK_BYTES):
            sets = shingle_sets(*flat(batch.column("text")), k)
            keys = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            values = [s.view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("component"), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["node", "component", "key", "size", "shingles"])

    texts_ = live.join(whole.select(F.col("doc_id").alias("node"), "text"), "node").select("node", "component", "text")
    sets = cut(texts_.mapInArrow(read, "node long, component long, key long, size long, shingles array<long>").dropDuplicates(["node", "key"]), "sets")
    first = cut(prefixes(sets, percent), "prefixes")
    posts = cut(first.groupBy("shingle").agg(F.count("*").alias("f"), F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("shingle", "f"), "posts")
    first = on_key(first, posts, hot_keys(posts, "shingle", "f", first.count()), "shingle")

    few = first.filter(F.col("f") <= FEW)
    other = few.select("shingle", F.col("node").alias("v"), F.col("component").alias("with"), F.col("size").alias("other"))
    close = f"component < with and 100 * least(size, other) >= {percent} * greatest(size, other)"
    pairs = few.join(other, "shingle").filter(close).select(F.col("node").alias("u"), "v").distinct()
    found = confirm(pairs, whole, k, percent)

    many = first.filter(F.col("f") > FEW)
    # A set's block is a part of those that have the same most frequent shingle, as these are the likeliest to meet.
    home = many.groupBy("node", "key").agg(F.max(F.struct("f", "shingle")).alias("home"))
    block = F.struct(F.col("home.shingle").alias("home"), F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("home.f") / BLOCK)).alias("part"))
    home = cut(home.select("node", "key", block.alias("block")), "homes")
    if home.isEmpty():
        return found
    posted = many.join(home, ["node", "key"]).select("shingle", "block").distinct()
    meeting = posted.withColumnRenamed("block", "lo").join(posted.withColumnRenamed("block", "hi"), "shingle").filter("lo <= hi").select("lo", "hi").distinct()
    dealt = sets.join(home, ["node", "key"])
    low = meeting.join(dealt.withColumnRenamed("block", "lo"), "lo").withColumn("side", F.lit(0))
    high = meeting.join(dealt.withColumnRenamed("block", "hi"), "hi").withColumn("side", F.lit(1))

    def compare(table: pa.Table) -> pa.Table:
        ids, component, size, side = (table.column(c).to_numpy() for c in ("node", "component", "size", "side"))
        shingles = [np.asarray(x.values).view(np.uint64) for x in table.column("shingles")]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        both = common_counts([shingles[i] for i in a], [shingles[i] for i in b])
        linked = (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)) & (component[a][:, None] != component[b][None, :])
        i, j = np.nonzero(linked)
        u, v = ids[a[i]], ids[b[j]]
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    columns = ["lo", "hi", "side", "node", "component", "size", "shingles"]
    return found.union(low.select(columns).union(high.select(columns)).groupBy("lo", "hi").applyInArrow(compare, "u long, v long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (it is the smallest) per row."""
    sketch = cut(sketches(docs, k), "sketches")
    there = sketch.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets have equal bands.
    heads = there.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    shared = heads.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(heads.join(shared, "bucket"), "buckets")
    rows = members.count()
    hot = hot_keys(members, "bucket", "size", rows)
    whole = cut(texts(docs).join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")

    pairs = cut(stars(members, hot), "pairs")
    links = cut(confirm(pairs, whole, k, percent), "links")
    found = cut(components(links), "components")
    placed = cut(members.join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
    live = cut(unsettled(placed, hot), "live")
    drop(pairs, links, members, placed)
    if not live.isEmpty():
        more = cut(rest_links(live, whole, k, percent), "links")
        if not more.isEmpty():
            found = cut(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "components")
        drop(more)
    drop(live, whole)

    classes = there.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    placed = cut(classes.join(found, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component"), "n"), "classes")
    hot = hot_keys(placed, "set_hash", "n", sketch.count())  # copies of one text
    alone = sketch.filter(F.col("set_hash").isNull() | F.col("doc_id").isNull()).withColumn("component", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component"]
    rows = on_key(there, placed.drop("n"), [bytes(h) for h in hot], "set_hash").select(columns).union(alone.select(columns))
    component = F.col("component")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
