"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

Documents of a source are cut into blocks in doc_id order. With integer weights p of sum W, block i (from 0) of a source
may start at slot floor(i * W / p) and is due before slot ceil((i + 1) * W / p); in every slot the block that may start
and is due first gets it (ties by source). Every W slots each source has had exactly p blocks, so one period of W slots is
scheduled once and repeats: a block's slot follows from its number alone, and at any slot before a source has run out each
source's count is less than one block from its share.

No slot is dealt out one by one. Blocks get a rank by due time and source. Those of the first ranks take slots as if the others weren't there: after i slots they
have had min(i, i + the least of released - slots so far) of them, a running minimum. So one pass of window functions tells for each slot which of RADIX
classes of ranks has it, and each further pass does so within a class, until every class is one block: passes grow with the logarithm of W. Weights are divided by
their greatest common divisor, and slots that no block of the documents reaches are left out.

Rows are numbered within their source by two-level prefix sums: they are range-partitioned and sorted by source and doc_id and written, a row's
place in its partition is one part of its number, and the counts of the partitions before it are the other. So no task holds a whole source,
however the doc_ids are spread. The texts are at most carried along, whatever their length; they are not compared.

A source that a caller's weights do not list gets one slot a period, so that its rows are placed too; a weight that is null or below one counts as one, and those of a source listed
more than once are added. Null sources are a source of their own;
null doc_ids come first; equal doc_ids follow a hash of their text; an empty table gives no rows. Repeated rows are all placed. A source that has
run out leaves its slots empty. Columns `block`, `slot` and `position` of the input are replaced by the mixture's; other extra columns stay. The first pass sorts the
slots of a period in one task, which spills: PERIOD and one a source with default weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, partitions

BLOCK = 64
#: Slots that the weights are scaled to; a source has one at least.
PERIOD = 1_000
#: Classes that one pass tells apart.
RADIX = 4
#: A table of sources or slots is broadcast up to this many rows (about 10 MB), and joined by a shuffle beyond.
SMALL = 200_000
#: Keys that the rows of one slot of the period are spread over in such a shuffle.
SALTS = 64
#: Blocks of a source that are listed in one row.
CHUNK = 1 << 16

#: The greatest common divisor of the values of p.
DIVISOR = """aggregate(collect_set(p), 0L, (g, x) -> aggregate(sequence(1, 93), named_struct('a', g, 'b', x),
    (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a))"""


def shares_of(docs: DataFrame, weights: DataFrame | None = None, period: int = PERIOD) -> DataFrame:
    """source, n (documents), p: as `weights` (source, p) say, by default about `period` in proportion to the square root of n.

    One row per source of either, written.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is not None:
        listed = weights.select("source", F.lit(0).cast("long").alias("n"), F.greatest(F.lit(1), F.col("p").cast("long")).alias("p"))
        both = counts.withColumn("p", F.lit(0).cast("long")).unionByName(listed)
        return cut(both.groupBy("source").agg(F.sum("n").alias("n"), F.greatest(F.lit(1), F.sum("p")).cast("long").alias("p")), "shares")
    roots = cut(counts.withColumn("root", F.round(F.sqrt("n")).cast("long")), "shares")
    total = roots.agg(F.sum("root")).first()[0] or 1
    return roots.select("source", "n", F.greatest(F.lit(1), F.expr(f"root * {period} div {total}")).cast("long").alias("p"))


def period_slots(weights: DataFrame) -> DataFrame:
    """source, j (block within the period), at (its slot) for `weights` (source, p)."""
    sources, w = weights.agg(F.count("*"), F.coalesce(F.sum("p"), F.lit(0))).first()
    return slots_until(weights, sources, w, w)


def slots_until(weights: DataFrame, sources: int, w: int, until: int) -> DataFrame:
    """The same for the slots before `until` of a period of w slots; `weights` has so many `sources`."""
    last = F.expr(f"({until}L * p + {w}L - 1) div greatest(1L, {w}L) - 1")  # blocks that may start before `until`
    chunks = weights.select("source", "p", last.alias("last")).filter("last >= 0").select("*", F.explode(F.expr(f"sequence(0L, last, {CHUNK}L)")).alias("lo"))
    blocks = chunks.select("source", "p", F.explode(F.expr(f"sequence(lo, least(lo + {CHUNK - 1}, last))")).alias("j"))
    due = F.expr(f"((j + 1) * {w}L + p - 1) div p")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(due, F.col("source").asc_nulls_first())).cast("long") - 1
    blocks = blocks.select(F.expr(f"j * {w}L div p").alias("t"), rank.alias("rank"), F.struct("source", "j").alias("block"))
    rows = blocks.unionByName(weights.sparkSession.range(until).select(F.col("id").alias("t")), allowMissingColumns=True).withColumn("node", F.lit(0).cast("long"))
    passes = 1
    while RADIX**passes < min(w, until + sources):
        passes += 1
    for size in (RADIX**i for i in reversed(range(passes))):
        # Blocks come before the slot that they may start at.
        order = Window.partitionBy("node").orderBy("t", F.col("rank").isNull())
        upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
        own = F.expr(f"rank div {size} % {RADIX}")
        classes = range(RADIX - 1)  # what they leave is the last one's
        ahead = {f"_a{c}": F.sum(F.when(own.isNull(), -1).when(own <= c, 1).otherwise(0)).over(upto) for c in classes}
        least = {f"_m{c}": F.min(F.when(F.col("rank").isNull(), F.col(f"_a{c}"))).over(before) for c in classes}
        rows = rows.select("*", *[x.alias(c) for c, x in ahead.items()])
        rows = rows.select("*", *[x.alias(c) for c, x in least.items()])
        taker = F.coalesce(*[F.when(F.col(f"_a{c}") >= F.least(F.lit(0), f"_m{c}"), c) for c in classes], F.lit(RADIX - 1))
        rows = rows.select("t", "rank", "block", (F.col("node") * RADIX + F.coalesce(own, taker)).alias("node"))
    pairs = rows.groupBy("node").agg(F.max("block").alias("block"), F.max(F.expr("if(rank is null, t, null)")).alias("at")).filter("at is not null")
    return pairs.select("block.source", "block.j", "at")


def numbered(docs: DataFrame, shares: DataFrame, small: bool, tie: str | None = None) -> DataFrame:
    """`docs` with _n: its number within its source, from 0, by doc_id, then a hash of the text (so that texts needn't be compared), and _p: the p of its source in `shares`.

    The order is written to the shared folder, so that a partition that is computed again can't change it. small: `shares` may be broadcast.
    """
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    rows = docs.withColumn("_tie", F.xxhash64("text") if tie is None else F.col(tie))
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("_tie")
    # Partition and place of each row in one number; 33 bits are the place.
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbers").withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(F.col("source").alias("_s"), F.col("_part").alias("_r")).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_s", "_r", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    shares = shares.select(F.col("source").alias("_t"), F.col("p").alias("_p"))
    runs = runs.join(F.broadcast(shares) if small else shares, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    # As ranges follow the source, there are fewer runs than partitions and sources together, and none has more rows than a partition.
    rows = placed.join(F.broadcast(runs) if small else runs, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_r")))
    return rows.withColumn("_n", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_s", "_r", "_shift")


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD, tie: str | None = None) -> DataFrame:
    """`docs` (with doc_id, text, source) with block, slot and position, by which the mixture is ordered.

    tie: a column with the hash xxhash64 of the texts, where `docs` has no texts. `docs` is computed more than once, so it should be a table.
    """
    shares = shares_of(docs, weights, period)
    blocks = f"(n + {block - 1}) div {block}"
    sources, total, divisor, reach = shares.agg(F.count("*"), F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.expr(DIVISOR), F.lit(1)), F.max(F.expr(f"double({blocks}) / p"))).first()
    divisor = max(1, divisor)
    w = total // divisor
    # Where no source has a whole period of blocks, slots after the last due time are never used; a little more than that, as the share is a double.
    until = min(w, math.ceil((reach or 0.0) * divisor * w * (1 + 1e-9)) + 1)
    small = sources <= SMALL and until <= SMALL
    shares = shares.withColumn("p", F.expr(f"p div {divisor}"))
    slots = slots_until(shares.select("source", "p"), sources, w, until).select(F.col("source").alias("_s"), F.col("j").alias("_j"), F.col("at").alias("_slot"))
    rows = numbered(docs.drop("block", "slot", "position"), shares, small, tie).withColumn("block", F.expr(f"_n div {block}")).withColumn("_b", F.expr("block % _p"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_j"))
    if small:
        rows = rows.join(F.broadcast(slots), same)
    else:
        salted = slots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(salted, same & (F.expr(f"cast(block div _p % {SALTS} as int)") == F.col("_salt"))).drop("_salt")
    rows = rows.withColumn("slot", F.expr(f"block div _p * {w}L + _slot")).withColumn("position", F.expr(f"slot * {block} + _n % {block}"))
    return rows.drop("_n", "_p", "_b", "_s", "_j", "_slot")


def mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of `docs` in the mixture's order: range-partitioned and sorted by position."""
    columns = docs.columns
    # A column of that name is kept under another one meanwhile.
    own = {c: f"_own_{c}" for c in columns if c in ("block", "slot", "position")}
    rows = mix(docs.withColumnsRenamed(own), **options)
    rows = rows.repartitionByRange(F.col("position")).sortWithinPartitions("position")
    return rows.select(*[F.col(own.get(c, c)).alias(c) for c in columns])
