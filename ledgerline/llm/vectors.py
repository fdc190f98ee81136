"""Exact top-k search by tiled matrix products, and approximate nearest neighbours by vantage-point trees.

Vectors are dealt out over shards of about SHARD_BYTES, the queries over blocks of BLOCK, and each pair of a shard and a block is one run
of sorted rows: the shard first, which the task keeps, then the block's queries, which stream by in tiles. So a task holds
one shard and one tile, each vector is sent once per block and each query once per shard, in the component type of the table (float or
double). The lists of a query are merged in a tree: of FAN_IN shards each, then of FAN_IN such groups, until one list is left.

Vectors that are null, empty or hold null or non-finite components take no part (in the tree search, zero vectors neither); null
vec_ids neither. Of rows with one vec_id the smallest vector counts. Vectors are only compared with those of their own
length. Extra columns are ignored, whatever their names. A query is never its own neighbour; with fewer candidates than k, all are
returned; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, long_rows, partitions

SHARD_BYTES = 64 << 20
#: Queries that meet a shard in one task.
BLOCK = 1 << 18
#: Queries of one tile.
TILE = 1_024
#: No finer shards than these, however many tasks could run.
LEAST = 1 << 12
FAN_IN = 8
#: How far the product of two unit vectors may be from their cosine.
SLACK = 1e-9
#: Bytes of the pairs of vectors that are scored at a time.
PAIR_BYTES = 32 << 20
LONG = (1 << 63) - 1


def usable(table: DataFrame, *carry: str) -> DataFrame:
    """vec_id, v (array<float> or array<double>, as in the table), the columns `carry`, dim; one row per vec_id, the smallest."""
    kind = "float" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *carry).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    least = rows.groupBy("vec_id").agg(F.min(F.struct("v", *carry)).alias("_least")).select("vec_id", "_least.*") if carry else rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return least.withColumn("dim", F.size("v"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut where the values of `keys` change."""
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
            yield batch.slice(lo, hi - lo)


def sharded(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` (vec_id, v, dim) with shard, and the number of shards."""
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    shards = max(1, math.ceil(n * (dim or 0) * 8 / SHARD_BYTES), min(partitions(rows.sparkSession), math.ceil(n / LEAST)))
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), shards


def meet(rows: DataFrame, shards: int, queries: DataFrame, prepare: Callable, work: Callable, schema: str) -> DataFrame:
    """`work` on every shard and tile of queries, as a table of `schema`.

    rows: vec_id, v, dim, shard, `place` in the shard, and more; queries: vec_id, v, dim, and more. prepare(batch of a whole shard) gives what
    work(it, tile of queries, shard) needs, which returns a batch.
    """
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", each(blocks)).withColumn("query", F.lit(False))
    right = queries.select("*", each(shards).alias("shard"), F.lit(0).cast("long").alias("place"))
    right = right.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("query", F.lit(True))
    run = ["dim", "shard", "block"]
    long_rows(rows.sparkSession)
    dealt = left.unionByName(right, allowMissingColumns=True).repartition(*run).sortWithinPartitions(*run, "query", "place")

    def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for part in _runs(batches, [*run, "query"]):
            of = tuple(part.column(c)[0].as_py() for c in run)
            if of != now:
                now, parts, held = of, [], None
            if not part.column("query")[0].as_py():
                parts.append(part)
                continue
            if held is None and parts:
                held, parts = prepare(pa.Table.from_batches(parts).combine_chunks().to_batches()[0]), []
            if held is None:
                continue  # no vectors of this length in the shard
            for lo in range(0, len(part), TILE):
                yield work(held, part.slice(lo, TILE), of[1])

    return dealt.mapInArrow(tiles, schema)


def merged(found: DataFrame, by: list[str], k: int, shards: int, tie: str = "vec_id") -> DataFrame:
    """The k highest scores of each `by` with their rank, ties to the smaller `tie`: lists of FAN_IN shards are merged, then such groups, until one is left."""
    order = [F.col("score").desc(), F.col(tie)]
    while shards > FAN_IN:  # the tree's inner nodes
        shards = math.ceil(shards / FAN_IN)
        found = found.withColumn("shard", F.expr(f"shard div {FAN_IN}").cast("int")).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "shard").orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k).drop("shard")


def search(rows: DataFrame, shards: int, queries: DataFrame, prepare: Callable, work: Callable, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: meet(), then merges of each query's lists. work(it, query ids, queries) returns query ids, ids and scores."""
    type_ = pa.int64() if kind == "long" else pa.float64()

    def lists(held: object, tile: pa.RecordBatch, shard: int) -> pa.RecordBatch:
        query, vec, score = work(held, tile.column("vec_id").to_numpy(), matrix(tile.column("v")))
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, type_), pa.array(np.full(len(query), shard, np.int32))], ["query_id", "vec_id", "score", "shard"])

    found = meet(rows, shards, queries.select("vec_id", "v", "dim"), prepare, lists, f"query_id long, vec_id long, score {kind}, shard int")
    return merged(found, ["query_id"], k, shards).select("query_id", "rank", "vec_id", "score")


def every(divisor: int) -> Callable[[DataFrame], DataFrame]:
    """The stated query set: rows whose vec_id is divisible by `divisor`."""
    return lambda rows: rows.filter(F.col("vec_id") % divisor == 0)


class Scaled:
    """The rows of a matrix as floor(scale * component), sorted by how large they are, so that inner products are exact.

    Level 0: sums of products fit doubles; 1: they fit 64 bits; 2: they need Python's integers. A row beyond level 0 costs its own products, not its shard's.
    """

    def __init__(self, m: np.ndarray, scale: int):
        self.m, self.scale = m.astype(np.float64), scale
        with np.errstate(over="ignore"):
            self.floors = np.floor(scale * self.m)
        most = np.abs(self.floors).max(axis=1, initial=0)
        self.most = most
        self.level = (most > math.isqrt((2**53 - 1) // m.shape[1])).astype(np.int8) + (most > math.isqrt((2**63 - 1) // m.shape[1]))
        self.kinds: dict[type, np.ndarray] = {}

    def doubles(self, kind: type) -> np.ndarray:
        """The floors in float32 or float64, with zeros for rows beyond level 0."""
        if kind not in self.kinds:
            self.kinds[kind] = np.where(self.level[:, None] == 0, self.floors, 0).astype(kind)
        return self.kinds[kind]

    def integers(self, at: np.ndarray) -> np.ndarray:
        whole = lambda x: math.floor(x) * self.scale if abs(x) >= 2**53 else math.floor(self.scale * x)
        return np.array([[whole(x) for x in row] for row in self.m[at].tolist()], object).reshape(len(at), -1)


def inner(a: Scaled, b: Scaled) -> np.ndarray:
    """The inner products of the rows of a with those of b; one beyond 64 bits is the nearest long."""
    bound = a.most[a.level == 0].max(initial=0) * b.most[b.level == 0].max(initial=0) * a.m.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64
    s = (a.doubles(kind) @ b.doubles(kind).T).astype(np.int64)
    for level in (1, 2):
        for rows, columns in ((a.level == level, b.level <= level), (a.level < level, b.level == level)):
            i, j = np.flatnonzero(rows), np.flatnonzero(columns)
            if not len(i) or not len(j):
                continue
            if level == 1:
                s[np.ix_(i, j)] = a.floors[i].astype(np.int64) @ b.floors[j].astype(np.int64).T
            else:
                s[np.ix_(i, j)] = np.clip(a.integers(i) @ b.integers(j).T, -LONG - 1, LONG).astype(np.int64)
    return s


def first(s: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the ascending places `at` of the scores s, the k of the highest, ties to the smaller place."""
    if len(at) > k:
        own = s[at]
        least = np.partition(own, len(at) - k)[len(at) - k]
        above = at[own > least]
        at = np.concatenate([above, at[own == least][: k - len(above)]])
    return at[np.argsort(~s[at], kind="stable")]  # ~s falls as s rises, without overflow


def exact_top(table: DataFrame, queries: Callable[[DataFrame], DataFrame], k: int = 20, scale: int = 64) -> DataFrame:
    """Per query its k largest integer inner products of floor(scale * component): query_id, rank, vec_id, score.

    A product beyond 64 bits counts as the nearest long, so such products tie.
    """

    def prepare(shard: pa.RecordBatch) -> tuple:
        return shard.column("vec_id").to_numpy(), Scaled(matrix(shard.column("v")), scale)

    def work(held: tuple, query_ids: np.ndarray, q: np.ndarray) -> tuple:
        ids, shard = held
        s = inner(Scaled(q, scale), shard)
        top = min(k + 1, len(ids))  # its own row may be among them
        if top == len(ids):
            best = np.tile(np.arange(len(ids)), (len(s), 1))
        else:
            limit = 2**62 // (len(ids) + 1)
            plain = (s.max(axis=1) < limit) & (s.min(axis=1) > -limit)
            best = np.zeros((len(s), top), np.int64)
            place = s[plain] * len(ids) + (len(ids) - 1 - np.arange(len(ids)))  # ties to the smaller id
            best[plain] = np.argpartition(place, len(ids) - top, axis=1)[:, len(ids) - top :]
            for i in np.flatnonzero(~plain):
                best[i] = first(s[i], np.arange(len(ids)), top)
        r, c = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
        keep = query_ids[r] != ids[c]
        return query_ids[r[keep]], ids[c[keep]], s[r[keep], c[keep]]

    rows = cut(usable(table), "vectors")
    dealt, shards = sharded(rows)
    return search(dealt.withColumn("place", F.col("vec_id")), shards, queries(rows), prepare, work, k, "long")


class VantageTree:
    """A vantage-point tree over unit vectors, laid out in an array.

    A node is a range of places: its vantage point comes first, then the nearer half of the rest, then the farther half. Halves are cut by
    rank, so that equal distances can't unbalance it; `near` and `far` hold at the vantage point the largest distance of the nearer
    half and the smallest of the farther half. Ranges of LEAF or fewer are leaves.
    """

    LEAF = 64

    def __init__(self, points: np.ndarray, near: np.ndarray, far: np.ndarray):
        self.points, self.near, self.far = points, near, far

    @classmethod
    def order(cls, points: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The points in the order of their places, and `near` and `far`."""
        at, random = np.arange(len(points)), np.random.default_rng(seed)
        near, far = np.zeros(len(points)), np.zeros(len(points))
        stack = [(0, len(points))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= cls.LEAF:
                continue
            top = random.integers(lo, hi)
            at[lo], at[top] = at[top], at[lo]
            d = np.linalg.norm(points[at[lo + 1 : hi]] - points[at[lo]], axis=1)
            half = (hi - lo) // 2
            by = np.argpartition(d, half - 1)
            at[lo + 1 : hi] = at[lo + 1 : hi][by]
            near[lo], far[lo] = d[by[:half]].max(), d[by[half:]].min()
            stack += [(lo + 1, lo + 1 + half), (lo + 1 + half, hi)]
        return at, near, far

    def nearest(self, queries: np.ndarray, k: int, factor: float, ids: np.ndarray, query_ids: np.ndarray, exact: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Per query the places of the k found and their scores, nearest first (place -1: none).

        factor 1 is exact; a smaller one prunes as if the kth distance were that much smaller. exact(rows of queries, places) gives the scores by which points
        are ranked, ties to the smaller id; products of unit vectors only tell which points may be among the k. A query does not find its own id.
        """
        cosine = np.full((len(queries), k), -np.inf)
        place = np.full((len(queries), k), -1, np.int64)
        name = np.full((len(queries), k), np.iinfo(np.int64).max)
        step = max(1, PAIR_BYTES // (8 * queries.shape[1]))

        def offer(q: np.ndarray, lo: int, hi: int, c: np.ndarray) -> None:
            """These cosines of the queries q with the points lo to hi."""
            c = np.where(query_ids[q][:, None] == ids[None, lo:hi], -np.inf, c)
            least = cosine[q, -1]
            if hi - lo > k:
                least = np.maximum(least, np.partition(c, hi - lo - k, axis=1)[:, hi - lo - k])
            # All that may tie with the kth are scored, however many.
            r, j = np.nonzero((c >= least[:, None] - SLACK) & np.isfinite(c))
            score = np.full(c.shape, -np.inf)
            for at in range(0, len(r), step):
                x, y = r[at : at + step], j[at : at + step]
                score[x, y] = exact(q[x], lo + y)
            some = np.flatnonzero((score >= cosine[q, -1:]).any(axis=1) & np.isfinite(score).any(axis=1))
            if len(some):
                q, score = q[some], score[some]
                both = np.concatenate([cosine[q], score], axis=1)
                which = np.concatenate([place[q], np.where(np.isfinite(score), np.arange(lo, hi), -1)], axis=1)
                names = np.concatenate([name[q], np.broadcast_to(ids[lo:hi], score.shape)], axis=1)
                by = np.lexsort((names, -both), axis=1)[:, :k]
                cosine[q], place[q], name[q] = (np.take_along_axis(x, by, 1) for x in (both, which, names))

        # (range, queries, their distances to a half's boundary): what lies too far beyond is passed over when it is taken up.
        stack: list[tuple[int, int, np.ndarray, np.ndarray]] = [(0, len(self.points), np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            lo, hi, q, gap = stack.pop()
            reach = gap <= factor * np.sqrt(np.maximum(0, 2 - 2 * cosine[q, -1])) + 1e-5  # the slack covers rounding near distance 0
            q = q[reach]
            if not len(q) or lo == hi:
                continue
            if hi - lo <= self.LEAF:
                offer(q, lo, hi, queries[q] @ self.points[lo:hi].T)
                continue
            c = queries[q] @ self.points[lo]
            offer(q, lo, lo + 1, c[:, None])
            d = np.sqrt(np.maximum(0, 2 - 2 * c))
            mid = lo + 1 + (hi - lo) // 2
            to_near, to_far = np.maximum(0, d - self.near[lo]), np.maximum(0, self.far[lo] - d)
            first = d - self.near[lo] <= self.far[lo] - d
            # The last one pushed is searched first: each query's own half before the other one.
            stack += [(lo + 1, mid, q[~first], to_near[~first]), (mid, hi, q[first], to_far[first]), (mid, hi, q[~first], to_far[~first]), (lo + 1, mid, q[first], to_near[first])]
        return np.where(np.isfinite(cosine), place, -1), cosine


def near_vectors(table: DataFrame, queries: Callable[[DataFrame], DataFrame], k: int = 5, factor: float = 0.8) -> DataFrame:
    """Per query its k nearest by cosine that the trees find: query_id, rank, vec_id, score (cosine of the original vectors).

    Every shard has one tree of all its vectors, built once and written as a table: the vectors with their places and the distances that part the
    halves. factor 1 restores the exact answer. Huge components are scaled before they are squared, so that no length overflows.
    """

    def unit(m: np.ndarray) -> np.ndarray:
        m = m / np.abs(m).max(axis=1, keepdims=True)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def build(shard: pa.Table) -> pa.Table:
        v = shard.column("v").combine_chunks()
        at, near, far = VantageTree.order(unit(matrix(v).astype(np.float64)))
        return pa.table({"vec_id": shard.column("vec_id").take(at), "v": v.take(pa.array(at)), "dim": shard.column("dim"), "shard": shard.column("shard"), "place": np.arange(len(at)), "near": near, "far": far})

    def prepare(shard: pa.RecordBatch) -> tuple:
        m = matrix(shard.column("v")).astype(np.float64)
        return shard.column("vec_id").to_numpy(), m, VantageTree(unit(m), shard.column("near").to_numpy(), shard.column("far").to_numpy())

    def work(held: tuple, query_ids: np.ndarray, q: np.ndarray) -> tuple:
        ids, m, tree = held
        q = q.astype(np.float64)
        place, score = tree.nearest(unit(q), k, factor, ids, query_ids, lambda rows, at: cosines(m[at], q[rows]))
        r, c = np.nonzero(place >= 0)
        return query_ids[r], ids[place[r, c]], score[r, c]

    rows = cut(usable(table).filter("exists(v, x -> x != 0)"), "vectors")
    dealt, shards = sharded(rows)
    v = rows.schema["v"].dataType.simpleString()
    trees = cut(dealt.groupBy("dim", "shard").applyInArrow(build, f"vec_id long, v {v}, dim int, shard int, place long, near double, far double"), "trees")
    return search(trees, shards, queries(rows), prepare, work, k, "double")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices in double precision; where lengths overflow or vanish, of scaled rows."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    odd = ~np.isfinite(out)
    if odd.any():
        a, b = (x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True) for x in (a, b))
        out[odd] = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    return out
