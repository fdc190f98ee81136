"""Importance resampling towards a target distribution: hashed word runs, gains of buckets, and a draw by Gumbel noise.

Identical texts are collapsed first by grouping on the full text, with the number of copies. The features of a distinct text, all runs of 1 to
RUN consecutive words, are computed once; each counts as often as the text has copies. A feature's bucket is the crc32 of its UTF-8 bytes
modulo BUCKETS: checksums are linear, so those of words are joined to those of runs on flat numpy arrays, whatever the runs' length.
The gains of all buckets (BUCKETS numbers) are sent to the tasks that weigh the distinct texts. Weights are joined back to the documents by the
text's digest, and only then comes the noise, which belongs to the doc_id. Texts that more than a thousandth of all documents share are fewer than
a thousand, so their weights are broadcast and no task gets all copies of one. The draw is a place in the order of all scores, numbered by
two-level prefix sums over written ranges: no task sees more than a range.

A null text has no words and is equal to an empty one; texts of any length are read whole, in pieces that overlap by the words of a run. A null doc_id
gets the noise of an empty one, and goes first where scores tie. Repeated rows are all returned and all may be drawn; where score and doc_id tie, the
row of fewer features comes first. Extra columns are ignored, whatever their names. An empty table gives no rows; an empty target has
no features, so that gains follow the corpus alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import CHUNK_BYTES, cut, flat, numbered, row_chunks, texts
from ledgerline.llm.shingles import LOWER

BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: A text with more than this share of all documents meets them by broadcast; there are fewer such texts than its inverse.
HOT = 1_000

#: Bytes of words once A-Z are lower-cased: digits, letters and all beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The checksum's table by byte, the shifts by 0 to 63 bytes, and those by 64, 128, 256, ... bytes; a shift is four tables by byte."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    shifts = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(64):
        shifts.append(byte[shifts[-1] & 255] ^ (shifts[-1] >> 8))
    powers = [shifts.pop()]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return byte, np.stack(shifts), powers


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


BYTE, SHIFTS, POWERS = _tables()
_FLAT = SHIFTS.ravel()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What checksums contribute once n more bytes follow: crc(a + b) is shifted(crc(a), len(b)) ^ crc(b)."""
    at = (n & 63) << 10
    out = _FLAT[at + (crc & 255)] ^ _FLAT[at + 256 + ((crc >> 8) & 255)] ^ _FLAT[at + 512 + ((crc >> 16) & 255)] ^ _FLAT[at + 768 + (crc >> 24)]
    high = n >> 6
    for table in POWERS:
        if not high.any():
            break
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(table, out[odd])
        high = high >> 1
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksums of the words, byte by byte of all words at once; words over 64 bytes one by one."""
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(n > 64).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + n[i]])
    at = np.flatnonzero(n <= 64)
    crc, length, place = np.full(len(at), 0xFFFFFFFF, np.uint32), n[at], starts[at]
    for j in range(64):
        crc = BYTE[(crc ^ data[place + j]) & 255] ^ (crc >> 8)
        ends = length == j + 1
        out[at[ends]] = ~crc[ends]
        rest = ~ends
        at, crc, length, place = at[rest], crc[rest], length[rest], place[rest]
        if not len(at):
            break
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray, run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, number of rows, bytes, offsets, words at its start that came before): rows together, or a long row in parts between words."""
    for lo, hi in row_chunks(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= 2 * CHUNK_BYTES or hi - lo > 1:
            yield lo, hi - lo, data[a:b], offsets[lo : hi + 1] - a, 0
            continue
        at = a
        while at < b:
            end = min(at + CHUNK_BYTES, b)
            while end < b and not (gaps := np.flatnonzero(~WORD[LOWER[data[end : min(end + CHUNK_BYTES, b)]]])).size:
                end = min(end + CHUNK_BYTES, b)  # a word longer than a piece
            end = end + int(gaps[0]) if end < b else b
            front, carried, back = at, 0, CHUNK_BYTES
            while at > a:  # the last words before, which runs may start with
                front = max(a, at - back)
                inside = WORD[LOWER[data[front:at]]]
                edges = np.flatnonzero(inside & ~np.concatenate([[front > a and bool(WORD[LOWER[data[front - 1]]])], inside[:-1]]))
                if len(edges) >= run - 1 or front == a:
                    carried = min(len(edges), run - 1)
                    front = front + int(edges[-carried]) if carried else at
                    break
                back *= 2
            yield lo, 1, data[front:end], np.array([0, end - front]), carried
            at = end


def gram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of (buckets of all runs of words, their rows, words of each row), rows numbered from 0."""
    total = len(offsets) - 1
    for lo, rows, part, at, carried in _pieces(data, offsets, run):
        part = LOWER[part]
        inside = WORD[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(part) else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(part) else starts
        n = ends - starts
        words = np.diff(np.searchsorted(starts, at))
        row = np.repeat(np.arange(lo, lo + rows), words)
        word = word_crcs(part, starts, n)
        follows = shifted(np.full(len(n), zlib.crc32(b" "), np.uint32), n) ^ word  # a space and the word
        crcs, of, now = [word[carried:]], [row[carried:]], word
        for k in range(1, run):
            if len(now) < 2:
                break
            now = shifted(now[:-1], n[k:] + 1) ^ follows[k:]
            same = row[k:] == row[:-k]
            same[: max(0, carried - k)] = False
            crcs.append(now[same])
            of.append(row[:-k][same])
        counts = np.zeros(total, np.int64)
        counts[lo : lo + rows] = words
        counts[lo] -= carried
        yield (np.concatenate(crcs) % np.uint32(buckets)).astype(np.int64), np.concatenate(of), counts


def collapsed(docs: DataFrame) -> DataFrame:
    """The distinct texts and their number of copies, as a table."""
    return cut(texts(docs).groupBy("text").agg(F.count("*").alias("copies")), "distinct")


def bucket_counts(distinct: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How often all texts have a feature of each bucket; copies count."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            copies = batch.column("copies").to_numpy()
            for bucket, row, _ in gram_buckets(*flat(batch.column("text")), buckets, run):
                # Whole numbers below 2**53, which doubles add exactly.
                out += np.bincount(bucket, weights=copies[row], minlength=buckets).astype(np.int64)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for r in distinct.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row for each bucket
        found[r["bucket"]] = r["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the target's smoothed share over the corpus's) of each bucket."""
    s, t, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + k) / ((x + 1.0) * (t + k)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(distinct: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """key (the text's digest), copies, n_words, n_features, weight of each distinct text, as a table."""
    shared = distinct.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            n = len(batch)
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for bucket, row, counts in gram_buckets(*flat(batch.column("text")), len(of), run):
                words += counts
                features += np.bincount(row, minlength=n)
                weight += np.bincount(row, weights=of[bucket], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), *map(pa.array, (words, features, weight))], ["key", "copies", "n_words", "n_features", "weight"])

    rows = distinct.select(_digest(), "copies", "text").mapInArrow(weigh, "key binary, copies long, n_words long, n_features long, weight long")
    return cut(rows, "weights")


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")


def importance(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document; `target` has texts alone."""
    distinct = collapsed(docs)
    like = cut(target.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies")), "target")
    weights = weighed(distinct, gains(bucket_counts(distinct, buckets, run), bucket_counts(like, buckets, run)), run)
    total = weights.agg(F.sum("copies")).first()[0] or 0
    columns = ("n_words", "n_features", "weight")
    hot = F.col("copies") * HOT > total
    few = weights.filter(hot).select("key", *[F.col(c).alias(f"_{c}") for c in columns])
    rest = weights.filter(~hot).select(F.col("key").alias("_key"), *columns)
    rows = texts(docs).select("doc_id", _digest()).join(F.broadcast(few), "key", "left")
    # A hot text's rows have their weights; they are dealt by a key of another length, which meets nothing.
    rows = rows.withColumn("_key", F.when(F.col("_n_words").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id").cast("string").cast("binary"))).join(rest, "_key", "left")
    return rows.select("doc_id", *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def noise(doc_id, seed: int = SEED):
    """floor(1000 * Gumbel noise) of a doc_id, from its digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """doc_id, n_features, weight, score, rank: `percent` of the documents of `least_words` or more are drawn and ranked."""
    rows = importance(docs, target, buckets, run).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_able", F.col("n_words") >= least_words)
    rows = cut(rows.drop("n_words"), "scores")
    drawn = rows.filter("_able").count() * percent // 100
    order = [F.col("_able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features")]
    placed = numbered(rows, order)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_n") < drawn, F.col("_n") + 1).alias("rank"))
