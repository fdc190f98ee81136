"""Hard-negative mining by distributed radix selection over integer scores.

Shards of vectors meet tiles of anchors, as in the exact search of `vectors`. One pass finds each anchor's positives: every shard's highest scores of the
anchor's label, merged in a tree. A positive opens a window of scores, from LOW to HIGH per cent of its own. The kth highest score of
another label inside a window is located digit by digit: shards count scores by digit, the counts are added, and the digit that holds the kth
is divided again, until it holds no more than is wanted or is one score. Then a last pass gathers the rows from that score up. A shard sends the counts of its
highest digits alone, up to the number wanted, as what lies below them cannot hold the kth; and of a score that many rows share it sends the k
smallest vec_ids. So no window's rows meet in one task, whatever share of all rows has one score or label.

Rows with a null label, vector or vec_id, or a null or non-finite component, or an empty vector take no part. Of rows with one vec_id the smallest (vector,
label) counts. Vectors are compared with those of their own length only. Ties go to the smaller vec_id. An inner product beyond 64
bits counts as the nearest long. A positive with a negative score has an empty window, one with score 0 the window of score 0. Anchors without
another row of their label, and windows without a row, give no rows; an empty table gives none. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut
from ledgerline.llm.vectors import Scaled, first, inner, matrix, meet, merged, sharded, usable

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
#: Bits of a digit.
DIGIT = 8


def _batch(columns: list[tuple[str, list[np.ndarray], type]], extra: dict[str, int]) -> pa.RecordBatch:
    arrays = {name: np.concatenate([np.zeros(0, kind), *parts]).astype(kind) for name, parts, kind in columns}
    n = len(next(iter(arrays.values())))
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays.values()), *[pa.array(np.full(n, v, np.int32)) for v in extra.values()]], [*arrays, *extra])


def _windows(tile: pa.RecordBatch, i: int) -> list[dict]:
    return tile.column("windows")[i].as_py()


def bounds(positives: DataFrame, low: int = LOW, high: int = HIGH) -> DataFrame:
    """`positives` with lo and hi, the least and greatest long n with low * score <= 100 * n <= high * score; rows without any go. 0 <= low <= high <= 100."""
    part = lambda p, up: f"{p} * (score div 100) + ({p} * (score % 100) + {up}) div 100"  # noqa: E731  no product is beyond 64 bits
    return positives.filter("score >= 0").withColumn("lo", F.expr(part(low, 99))).withColumn("hi", F.expr(part(high, 0))).filter("lo <= hi")


def mine(table: DataFrame, anchors: Callable[[DataFrame], DataFrame], positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, digit: int = DIGIT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `table` (vec_id, embedding, label); anchors picks from its usable rows."""
    labelled = table.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).filter("label is not null")
    rows = cut(usable(labelled, "label"), "labelled")
    dealt, shards = sharded(rows)
    dealt, asked = dealt.withColumn("place", F.col("vec_id")), anchors(rows)

    def prepare(shard: pa.RecordBatch) -> tuple:
        return shard.column("vec_id").to_numpy(), shard.column("label").to_numpy(), Scaled(matrix(shard.column("v")), scale)

    def scored(held: tuple, tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tile.column("vec_id").to_numpy(), tile.column("label").to_numpy(), inner(Scaled(matrix(tile.column("v")), scale), held[2])

    def alike(held: tuple, tile: pa.RecordBatch, shard: int) -> pa.RecordBatch:
        ids, labels, _ = held
        who, own, s = scored(held, tile)
        query, vec, score = [], [], []
        for i in range(len(who)):
            best = first(s[i], np.flatnonzero((labels == own[i]) & (ids != who[i])), positives)
            query.append(np.full(len(best), who[i]))
            vec.append(ids[best])
            score.append(s[i][best])
        return _batch([("anchor_id", query, np.int64), ("vec_id", vec, np.int64), ("score", score, np.int64)], {"shard": shard})

    def histograms(held: tuple, tile: pa.RecordBatch, shard: int) -> pa.RecordBatch:
        _, labels, _ = held
        who, own, s = scored(held, tile)
        shifts = tile.column("shift").to_numpy()
        query, positive, bucket, n = [], [], [], []
        for i in range(len(who)):
            other = s[i][labels != own[i]]
            for w in _windows(tile, i):
                counts = np.bincount((other[(other >= w["lo"]) & (other <= w["hi"])] - w["lo"]) >> shifts[i])
                # From the highest digit down, until as many rows as wanted are counted: the kth of all shards can't be lower.
                at = np.flatnonzero(counts)[::-1]
                at = at[: np.searchsorted(np.cumsum(counts[at]), w["need"]) + 1]
                query.append(np.full(len(at), who[i]))
                positive.append(np.full(len(at), w["positive_id"]))
                bucket.append(at)
                n.append(counts[at])
        return _batch([("anchor_id", query, np.int64), ("positive_id", positive, np.int64), ("bucket", bucket, np.int64), ("n", n, np.int64)], {})

    def gathered(held: tuple, tile: pa.RecordBatch, shard: int) -> pa.RecordBatch:
        ids, labels, _ = held
        who, own, s = scored(held, tile)
        query, positive, vec, score = [], [], [], []
        for i in range(len(who)):
            other = labels != own[i]
            for w in _windows(tile, i):
                best = first(s[i], np.flatnonzero(other & (s[i] >= w["lo"]) & (s[i] <= w["hi"])), k)
                query.append(np.full(len(best), who[i]))
                positive.append(np.full(len(best), w["positive_id"]))
                vec.append(ids[best])
                score.append(s[i][best])
        return _batch([("anchor_id", query, np.int64), ("positive_id", positive, np.int64), ("vec_id", vec, np.int64), ("score", score, np.int64)], {"shard": shard})

    def with_windows(state: DataFrame, lo: str, hi: str, **more) -> DataFrame:
        """The anchors with their windows: at most `positives` for each."""
        own = state.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", F.col(lo).alias("lo"), F.col(hi).alias("hi"), "need")).alias("windows"))
        return asked.join(own, "vec_id").withColumns(more)

    found = meet(dealt, shards, asked, prepare, alike, "anchor_id long, vec_id long, score long, shard int")
    found = merged(found, ["anchor_id"], positives, shards).select("anchor_id", F.col("vec_id").alias("positive_id"), "score")
    window = bounds(found, low, high).withColumnRenamed("score", "positive_score")
    # from_: the lowest score that is still wanted; lo_ and hi_: the digit that holds it, once it is located.
    state = cut(window.select("*", F.col("lo").alias("from_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.lit(k).cast("long").alias("need"), F.lit(True).alias("open")), "windows")
    widest = state.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    bits = 0 if widest is None else max(1, int(widest).bit_length())
    while bits and not state.filter("open").isEmpty():
        bits = max(0, bits - digit)
        counts = meet(dealt, shards, with_windows(state.filter("open"), "lo_", "hi_", shift=F.lit(bits)), prepare, histograms, "anchor_id long, positive_id long, bucket long, n long")
        counts = counts.groupBy("anchor_id", "positive_id", "bucket").agg(F.sum("n").alias("n"))
        # A window has at most 2 ** digit rows here.
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)))
        both = state.filter("open").join(counts, ["anchor_id", "positive_id"]).filter("upto >= need and upto - n < need")
        least, rest = F.col("lo_") + F.expr(f"shiftleft(bucket, {bits})"), F.col("need") - (F.col("upto") - F.col("n"))
        located = both.select("anchor_id", "positive_id", least.alias("_from"), F.least("hi_", least + ((1 << bits) - 1)).alias("_hi"), rest.alias("_need"), ((rest < F.col("n")) & F.lit(bits > 0)).alias("_open"))
        # A window that isn't located has fewer rows than wanted; all from its lower bound count.
        next_ = state.join(located, ["anchor_id", "positive_id"], "left")
        state = cut(next_.select("anchor_id", "positive_id", "positive_score", "lo", "hi", F.coalesce("_from", "from_").alias("from_"), F.coalesce("_from", "lo_").alias("lo_"), F.coalesce("_hi", "hi_").alias("hi_"), F.coalesce("_need", "need").alias("need"), F.coalesce("_open", F.lit(False)).alias("open")), "windows")
    taken = meet(dealt, shards, with_windows(state, "from_", "hi"), prepare, gathered, "anchor_id long, positive_id long, vec_id long, score long, shard int")
    best = merged(taken, ["anchor_id", "positive_id"], k, shards)
    return best.join(state.select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
