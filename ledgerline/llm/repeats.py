"""Removal of long byte strings that an earlier document has too, by suffix arrays over shared text.

A position's window is the `length` bytes that start there. Each window has an anchor, the smallest hash among its
k-byte grams (leftmost first), which depends on the window alone; so equal windows have equal anchors, and neighbouring
windows with one anchor make a segment. Three shuffles follow, each of packed rows:
1. anchor hashes, one per flush of a task and hash: which of them does more than one document have?
2. segments around these anchors, one per flush and distinct segment: a bucket's segments are one text, whose
   suffix array (two-stage sorting) and adjacent common prefixes give the groups of equal windows and the smallest
   doc_id of each;
3. the intervals to remove, by document.
Within a flush, copies of a segment are settled against the smallest doc_id there, so a very common passage sends one row
per flush. The texts are shuffled once, by doc_id; both joins with them use the same exchange.

There are as many buckets as BUCKET_BYTES of text, so a bucket stays as small however much text there is. An anchor that very many
documents have with different bytes around it would still fill one bucket; such anchors are estimated from a sample of documents (which
only decides where segments go, not what is found), and their segments go to buckets by the anchor and some of the bytes around it:
each level takes half of what a window has beyond, from its longer side, until at the last level a window goes by all its bytes.
As that depends on the window alone, equal windows still meet.

Null doc_ids take no part and keep their text; rows with one doc_id don't remove from each other, and each keeps the spans of its
own text; a null text is an empty one; a text of any length is read in pieces of PIECE bytes; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import CHUNK_BYTES, batches_by_bytes, flat, long_rows, partitions, row_chunks
from ledgerline.llm.shingles import mix
from ledgerline.llm.suffix_array import common_prefixes, keys8, suffix_array

#: Bits of a position within a piece; the rest of the 64 are the gram's hash.
PLACE = 24
PIECE = 1 << (PLACE - 1)
#: Bytes of text after which a task sends what it has gathered.
FLUSH = 16 << 20
#: Bytes of text for one bucket.
BUCKET_BYTES = 2 << 20
#: 128 bits of a text.
DIGEST = "struct(xxhash64(text), xxhash64(1, text))"
#: Tells apart texts that share a doc_id: 0, or the place of this text among them (`several`, see texts_by_id()).
VERSION = f"coalesce(array_position(several, {DIGEST}), 0)"
#: Documents with an anchor from which on its segments are split, and the factor from level to level.
HOT, HOTTER = 4_096, 8
#: Documents that the estimate reads: all up to so many, then a share, 1 / SPARSE of them at least; anchors that it finds.
SAMPLE, SPARSE, HOT_MAX = 20_000, 1_024, 1 << 18


def gram_of(length: int) -> int:
    """Bytes of the grams for windows of this length; a window has more than two of them."""
    return 16 if length > 32 else 8


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All segments of these texts: row, first window, last window, anchor (positions in the text), anchor hash."""
    out, gram = [], gram_of(length)
    for lo, hi in row_chunks(offsets):
        base, end = int(offsets[lo]), int(offsets[hi])
        row_of = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
        whole = np.arange(base, end) + length <= np.repeat(offsets[lo + 1 : hi + 1], np.diff(offsets[lo : hi + 1]))
        # A text that is longer than a piece is read in pieces that overlap by a window less one byte.
        for piece in range(base, end, PIECE):
            part = data[piece : min(end, piece + PIECE + length - 1)]
            if len(part) < length:
                continue
            eight = np.ndarray((len(part) - 7,), "<u8", np.ascontiguousarray(part), strides=(1,)).astype(np.uint64)
            n = len(part) - gram + 1
            hashed = eight[:n].copy()
            for at in range(8, gram, 8):
                hashed *= np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
                hashed += eight[at : at + n]
            hashed = mix(hashed)
            low = (hashed & np.uint64(-1 << PLACE & (1 << 64) - 1)) | np.arange(n, dtype=np.uint64)
            width, have = length - gram + 1, 1
            while have < width:  # minimum of `have` values, doubled up to the window's
                step = min(have, width - have)
                low = np.minimum(low[:-step], low[step:])
                have += step
            windows = min(len(low), PIECE)
            fits = np.flatnonzero(whole[piece - base : piece - base + windows])
            if not len(fits):
                continue
            anchor, row = low[fits], row_of[fits + (piece - base)]
            first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
            last = np.append(first[1:], len(fits)) - 1
            start = offsets[row[first]] - piece
            place = (anchor[first] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
            out.append((row[first], fits[first] - start, fits[last] - start, place - start, hashed[place]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each as differences, compressed."""
    parts = [np.int64(len(columns[0])).tobytes(), *[np.diff(c.astype(np.int64), prepend=np.int64(0)).tobytes() for c in columns]]
    return zstandard.ZstdCompressor(level=1).compress(_planes(b"".join(parts)))


def _planes(data: bytes) -> bytes:
    """Equal bytes of the 64-bit numbers together, which compresses better."""
    return np.frombuffer(data, np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The columns of pack(), as rows of a matrix."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
    return np.cumsum(raw[1:].reshape(-1, int(raw[0])), axis=1) if raw[0] else np.zeros((0, 0), np.int64)


def same_text(data: np.ndarray, at: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """For each segment of `data` the number of one with equal bytes, the same for all of them.

    Segments are sorted by a hash of their words of eight bytes and compared word by word with the first of their hash;
    one that differs from it (which needs a collision) stays on its own.
    """
    n = np.arange(len(at))
    if not len(at):
        return n
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    front = length // 8
    back = -(-(2 * length - gram_of(length) - 8 * front) // 8)  # what the longest segment has beyond
    words = [*(eight[at + 8 * i] for i in range(front)), *(eight[at + size - 8 * (i + 1)] for i in range(back))]
    h = size.astype(np.uint64)
    for w in words:
        h = mix(h + w)
    order = np.argsort(h, kind="stable")
    head = _runs(h[order])
    first = np.empty(len(at), np.int64)
    first[order] = np.repeat(order[head], np.diff(np.append(head, len(at))))
    equal = size == size[first]
    for w in words:
        equal &= w == w[first]
    return np.where(equal, first, n)


def cut_out(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of these segments, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _blobs(columns: list[np.ndarray], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows that only pass a stage, packed, spread over its buckets."""
    for lo in range(0, len(columns[0]), 8_192):
        yield (lo // 8_192 * 7_919 + int(columns[0][lo])) % buckets, 1, pack(*[c[lo : lo + 8_192] for c in columns])


def _rows(found: Iterable[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "data"])


def _read(table: pa.Table, width: int) -> tuple[list[bytes], np.ndarray]:
    """The blobs of a bucket that are to be worked on, and the columns of those that pass."""
    kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
    return [d for d, k in zip(data, kinds, strict=True) if not k], np.concatenate([np.zeros((width, 0), np.int64), *[unpack(d) for d, k in zip(data, kinds, strict=True) if k]], axis=1)


def _anchor(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's bucket and 32 bits of its hash; a clash only adds candidates."""
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _flushes(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches_by_bytes(batches, "text", 2 * CHUNK_BYTES):
        held.append(batch)
        size += len(flat(batch.column("text"))[0])
        if size >= FLUSH:
            yield held
            held, size = [], 0
    if held:
        yield held


def per_bucket(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`work` on the rows of each bucket; buckets are dealt out in turn, as hashes of so few numbers would leave some tasks with twice their share."""
    n = partitions(rows.sparkSession)
    dealt = rows.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = _runs(bucket).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                if held and bucket[lo] != now:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                now = bucket[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(run, schema)


def split(data: np.ndarray, at: np.ndarray, size: np.ndarray, anchor: np.ndarray, level: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Parts of segments by the bytes around their anchors: segment number, shift, size, hash of these bytes.

    data; at, size, anchor: where a segment and its anchor start in it, and the segment's size; level: 1 or more. A part holds the windows
    with the same bytes around the anchor.
    """
    if not len(at):
        return at, at, at, np.zeros(0, np.uint64)
    gram = gram_of(length)
    count = size - length + 1
    of = np.repeat(np.arange(len(at)), count)
    window = np.repeat(at - np.cumsum(count) + count, count) + np.arange(count.sum())
    lo = anchor[of]
    hi = lo + gram
    rounds, most = level[of], int(level.max(initial=0))
    for n in range(most):
        left, right = lo - window, window + length - hi
        take = np.where(rounds > n, (left + right + 1) // 2, 0)
        to_right = right >= take
        hi, lo = hi + np.where(to_right, take, 0), lo - np.where(to_right, 0, take)
    head = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
    last = np.append(head[1:], len(of)) - 1
    lo, hi, n = lo[head], hi[head], hi[head] - lo[head]
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = n.astype(np.uint64)
    for word in range(-(-length // 8)):  # the last one ends with these bytes
        h = np.where(8 * word < n, mix(h + eight[np.minimum(lo + 8 * word, hi - 8)]), h)
    return of[head], window[head] - at[of[head]], window[last] - window[head] + length, h


def hot_anchors(whole: DataFrame, length: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and levels of the anchors that HOT documents or more have, by a sample of `whole` (id, text; of `rows` rows).

    At most HOT_MAX pairs of numbers come to the driver, the most common ones; those behind them are rarer than 1 / HOT_MAX of all.
    """
    sparse = max(1, min(SPARSE, rows // SAMPLE))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _flushes(batches):
            found = []
            for batch in held:
                row, _, _, _, anchor = segments(*flat(batch.column("text")), length)
                order = np.lexsort((row, anchor))
                row, anchor = row[order], anchor[order]
                found.append(anchor[np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])[: len(row)]])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    few = whole.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(sparse)) == 0).select("text")
    counts = few.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") * sparse >= HOT)
    found = counts.orderBy(F.col("n").desc(), "h").limit(HOT_MAX).collect() if rows >= HOT else []
    h, n = (np.array([r[c] for r in found], np.int64) for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], 1 + np.floor(np.log(np.maximum(n[order] * sparse / HOT, 1)) / math.log(HOTTER)).astype(np.int64)


def shared_anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """doc_id, anchor (long): the anchors that another document may have too."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _flushes(batches):
            hashes, ids = [], []
            for batch in held:
                row, _, _, _, anchor = segments(*flat(batch.column("text")), length)
                hashes.append(_anchor(anchor, buckets))
                ids.append(batch.column("doc_id").to_numpy()[row])
            h, doc = np.concatenate(hashes), np.concatenate(ids)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
            h, doc = h[once], doc[once]
            first = _runs(h)
            size = np.diff(np.append(first, len(h)))
            known = np.repeat(size > 1, size)  # several documents of this flush have it
            one_h, one_doc = h[first], doc[first]
            cuts = _runs(one_h >> 32)
            parts = zip(cuts.tolist(), [*cuts[1:].tolist(), len(one_h)], strict=True) if len(one_h) else ()
            yield _rows([*((int(one_h[lo] >> 32), 0, pack(one_h[lo:hi], one_doc[lo:hi])) for lo, hi in parts), *_blobs([h[known], doc[known]], buckets)])

    def meet(table: pa.Table) -> pa.Table:
        blobs, passed = _read(table, 2)
        h, doc = np.concatenate([np.zeros((2, 0), np.int64), *map(unpack, blobs)], axis=1)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        size = np.diff(np.append(_runs(h), len(h)))
        known = np.repeat(size > 1, size)
        h, doc = np.concatenate([np.stack([h[known], doc[known]]), passed], axis=1)
        return pa.table({"doc_id": pa.array(doc), "anchor": pa.array(h)})

    return per_bucket(docs.mapInArrow(gather, "bucket long, kind int, data binary"), meet, "doc_id long, anchor long")


def texts_by_id(whole: DataFrame) -> DataFrame:
    """id, several: digests of the texts under a doc_id that has more than one."""
    return whole.groupBy("id").agg(F.array_sort(F.collect_set(F.expr(DIGEST))).alias("several")).filter("size(several) > 1")


def removals(whole: DataFrame, several: DataFrame, length: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, version (of the text), start, end: intervals to remove; they may overlap."""
    wanted = shared_anchors(whole.select(F.col("id").alias("doc_id"), "text"), length, buckets).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("anchor").alias("anchors"))
    # All columns stay, so that this join and the last one have one exchange of the texts.
    versioned = whole.join(wanted, "id").join(several, "id", "left").select(*whole.columns, F.expr(VERSION).cast("int").alias("version"), "anchors")
    shared = whole.sparkSession.sparkContext.broadcast(hot)  # at most HOT_MAX pairs

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_hash, hot_level = shared.value
        for held in _flushes(batches):
            found, base = [], 0
            for batch in held:
                data, at = flat(batch.column("text"))
                row, first, last, anchor, h = segments(data, at, length)
                key = _anchor(h, buckets)
                lists = batch.column("anchors")
                ends = np.asarray(lists.offsets).astype(np.int64)
                wanted_row = np.repeat(np.arange(len(batch)), np.diff(ends))
                both = lambda k, r: mix(k.astype(np.uint64)) + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                hit = np.isin(both(key, row), both(np.asarray(lists.values)[ends[0] : ends[-1]], wanted_row))
                row, first, size = row[hit], first[hit], (last - first)[hit] + length
                ids, versions = batch.column("id").to_numpy(), batch.column("version").to_numpy()
                found.append((key[hit] >> 32, h[hit], ids[row], versions[row].astype(np.int64), first, base + at[row] + first, size, base + at[row] + anchor[hit]))
                base += len(data)
            data = np.concatenate([flat(batch.column("text"))[0] for batch in held])
            bucket, h, doc, version, first, at, size, anchor = map(np.concatenate, zip(*found, strict=True))
            group = same_text(data, at, size, length)
            order = np.lexsort((doc, group))
            head = _runs(group[order])
            least = np.empty(len(doc), np.int64)
            least[order] = np.repeat(doc[order[head]], np.diff(np.append(head, len(doc))))
            gone, stays = doc > least, np.flatnonzero(doc == least)
            rows = list(_blobs([doc[gone], version[gone], first[gone], (first + size)[gone]], buckets))
            _, one, owner = np.unique(group[stays], return_index=True, return_inverse=True)
            one = stays[one]  # the different segments
            place = np.minimum(np.searchsorted(hot_hash, h[one]), max(0, len(hot_hash) - 1))
            level = np.where(hot_hash[place] == h[one], hot_level[place], 0) if len(hot_hash) else np.zeros(len(one), np.int64)
            split_ = np.flatnonzero(level)
            of, shift, part, around = split(data, at[one[split_]], size[one[split_]], anchor[one[split_]], level[split_], length)
            whole_ = np.flatnonzero(level == 0)
            of = np.concatenate([whole_, split_[of]])
            shift, part = np.concatenate([np.zeros(len(whole_), np.int64), shift]), np.concatenate([size[one[whole_]], part])
            to = np.concatenate([bucket[one[whole_]], (around % np.uint64(buckets)).astype(np.int64)])
            # Each owner of a segment owns its parts, which are put in the order of their buckets.
            order = np.argsort(of, kind="stable")
            count = np.bincount(of, minlength=len(one))
            begins = np.cumsum(count) - count
            n = count[owner]
            mine = order[np.repeat(begins[owner] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            stays = np.repeat(stays, n)
            by = np.argsort(to[mine], kind="stable")
            mine, stays = mine[by], stays[by]
            cuts = _runs(to[mine])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(stays)], strict=True) if len(stays) else ():
                parts, number = np.unique(mine[lo:hi], return_inverse=True)
                own = stays[lo:hi]
                numbers = pack(number, doc[own], version[own], first[own] + shift[mine[lo:hi]])
                body = zstandard.ZstdCompressor(level=1).compress(cut_out(data, at[one[of[parts]]] + shift[parts], part[parts]).tobytes())
                rows.append((int(to[parts[0]]), 0, np.array([len(numbers), len(parts)], "<i8").tobytes() + numbers + part[parts].astype("<i4").tobytes() + body))
            yield _rows(rows)

    def settle(table: pa.Table) -> pa.Table:
        blobs, passed = _read(table, 4)
        owners, sizes, bodies, n = [], [], [], 0
        for blob in blobs:
            long, parts = np.frombuffer(blob, "<i8", 2).tolist()
            owner = unpack(blob[16 : 16 + long])
            owner[0] += n
            n += parts
            owners.append(owner)
            sizes.append(np.frombuffer(blob, "<i4", parts, 16 + long).astype(np.int64))
            bodies.append(zstandard.ZstdDecompressor().decompress(blob[16 + long + 4 * parts :]))
        found = settled(np.frombuffer(b"".join(bodies), np.uint8), np.concatenate(sizes), np.concatenate(owners, axis=1), length) if blobs else np.zeros((4, 0), np.int64)
        doc, *rest = np.concatenate([passed, found], axis=1)
        return pa.table([pa.array(doc), *[pa.array(c.astype(np.int32)) for c in rest]], names=["doc_id", "version", "start", "end"])

    return per_bucket(versioned.mapInArrow(gather, "bucket long, kind int, data binary"), settle, "doc_id long, version int, start int, end int")


def settled(data: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """Intervals (doc_id, version, start, end) to remove, by the suffix array of a bucket's segments.

    data, size: the segments one after the other; owner: rows of segment number, doc_id, version, start in the text.
    """
    at = np.cumsum(size) - size
    _, one, number = np.unique(same_text(data, at, size, length), return_index=True, return_inverse=True)
    text = cut_out(data, at[one], size[one])
    size = size[one]
    at = np.cumsum(size) - size
    owner[0] = number[owner[0]]
    owner = owner[:, np.argsort(owner[0], kind="stable")]
    least = np.minimum.reduceat(owner[1], _runs(owner[0]))  # by segment; each has an owner
    depth = -(-length // 8) * 8
    keys = keys8(text, depth)
    sa = suffix_array(text, depth, keys)
    # A window must end within its segment.
    segment_of, stop = np.repeat(np.arange(len(size)), size), np.repeat(at + size, size)
    sa = sa[sa + length <= stop[sa]]
    group = np.flatnonzero(np.concatenate([[True], common_prefixes(text, sa, keys, stop) < length]))
    smallest = np.empty(len(text), np.int64)
    smallest[sa] = np.repeat(np.minimum.reduceat(least[segment_of[sa]], group), np.diff(np.append(group, len(sa))))
    # The windows of each segment in text order, against each owner of the segment.
    count = (size - length + 1)[owner[0]]
    starts = np.cumsum(count) - count
    step = np.arange(count.sum()) - np.repeat(starts, count)
    hit = smallest[np.repeat(at[owner[0]], count) + step] < np.repeat(owner[1], count)
    low = np.minimum.reduceat(np.where(hit, step, length), starts)
    high = np.maximum.reduceat(np.where(hit, step, -1), starts)
    some = high >= 0
    # A segment's windows start within `length` bytes of each other, so their union is one interval.
    return np.stack([owner[1], owner[2], owner[3] + low, owner[3] + high + length])[:, some]


def remove_repeats(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, text, spans (maximal removed byte runs, array<struct<start, end>>), kept (binary) and the columns `carry` of every row.

    length: 17 bytes or more. as_text: kept is a string; a character cut in two goes as a whole.
    """
    if length <= 2 * gram_of(length):
        raise ValueError("length must be 17 bytes or more")
    long_rows(docs.sparkSession)
    own = F.coalesce("text", F.lit(""))
    # Under another name, as Catalyst would drop an alias of the same one in one of the joins and then see two exchanges.
    every = docs.select(F.col("doc_id").cast("long").alias("id"), own.alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    whole = every.filter("id is not null")
    none = F.array().cast("array<struct<version: int, start: int, end: int>>")
    size = whole.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(4 * partitions(docs.sparkSession), size[1] // BUCKET_BYTES)
    several = texts_by_id(whole)
    gone = removals(whole, several, length, buckets, hot_anchors(whole, length, size[0]))
    gone = gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("version", "start", "end")).alias("gone"))
    rows = whole.join(gone, "id", "left").join(several, "id", "left").select(*whole.columns, F.expr(VERSION).cast("int").alias("version"), F.coalesce("gone", none).alias("gone"))
    rows = rows.union(every.filter("id is null").select("*", F.lit(0), none))
    schema = T.StructType.fromDDL("doc_id long, text string, spans array<struct<start: int, end: int>>, kept " + ("string" if as_text else "binary"))
    schema = T.StructType([*schema.fields, *[T.StructField(c, docs.schema[c].dataType) for c in carry]])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches_by_bytes(batches, "text", 4 * CHUNK_BYTES):
            data, at = flat(batch.column("text"))
            raw, lists = data.tobytes(), batch.column("gone")
            ends, parts = np.asarray(lists.offsets), lists.values
            version, start, end = (np.asarray(parts.field(i)) for i in range(3))
            spans, kept = [], []
            for r, mine in enumerate(batch.column("version").to_pylist()):
                lo, hi = ends[r], ends[r + 1]
                take = version[lo:hi] == mine
                s, e = start[lo:hi][take], end[lo:hi][take]
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.append(True, s[1:] > e[:-1])[: len(s)]
                s, e = s[new].tolist(), e[np.append(new[1:], True)[: len(s)]].tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(s, e, strict=True)])
                base, stop = int(at[r]), int(at[r + 1])
                kept.append(b"".join([raw[base + a : base + b] for a, b in zip([0, *e], [*s, stop - base], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(spans, span), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), *[batch.column(f"_{c}") for c in carry]], ["doc_id", "text", "spans", "kept", *carry])

    return rows.mapInArrow(work, schema)


def digests(removed: DataFrame) -> DataFrame:
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return removed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
