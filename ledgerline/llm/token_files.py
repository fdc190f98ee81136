"""Token-id files: Parquet list columns in ascending doc_id order, with chosen encodings, row groups and page indexes.

The documents are range-partitioned by doc_id as texts (ids would be twice the bytes), each partition is encoded in
order and written by Spark's committed Parquet writer. Every row holds its own place in its partition, so that the place of
a document in the whole stream follows from the small metadata columns and one offset per partition; the ids need not be
read for it. Page indexes (written by default) and doc_id order let a filter on doc_id read a few pages.

A null text is an empty one and holds the end id alone; null doc_ids come first, and are dealt out by a hash of their text; repeated rows
are kept, in an order that follows their text; texts of any length are read whole; other columns are ignored; an empty table gives an empty
file set.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import CHUNK_BYTES, batches_by_bytes, partitions, texts

#: Texts of these characters alone are split here; others go to the library whole.
PLAIN = "[^\t\n\r -~¡-ɏ]"
PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])
#: The split rule of the byte-level vocabulary (fixed value), with its letters and numbers among these characters.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
# Letters come first, being the most common; no other alternative starts like them.
WORDS = rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on; 0 parts words here.
SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - SELF)) if b}
#: Bytes of words and their ids, with EACH for every word, that a worker keeps; beyond it starts anew. Words of over LONG characters are not kept.
CACHE_BYTES, EACH, LONG = 72 << 20, 160, 256


class ByteBpe:
    """The library's encoder with the ids of words seen before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile(PLAIN).search
        self.split = re.compile(WORDS).findall
        self.known: dict[str, bytes] = {}
        self.held = 0

    def whole(self, text: str) -> bool:
        """Whether the library has to split the text itself."""
        if any(token in text for token in self.special):
            return True
        return bool(text.encode().translate(None, PLAIN_ASCII)) if text.isascii() else self.odd(text) is not None

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of little-endian 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        found = [None if self.whole(t) else self.split(t) for t in batch]
        new = list(set().union(*[words for words in found if words]).difference(known))
        # A word that the rule has found is one word by itself too, so the library's merges alone are asked for.
        new.sort(key=str.isascii)
        cut = sum(not w.isascii() for w in new)
        mapped = "\0".join(new[:cut]).encode().decode("latin-1").translate(ALPHABET).split("\0") if cut else []
        ascii_ = "\0".join(new[cut:])
        for c in " \n\t\r":  # all that the alphabet changes of plain ASCII
            ascii_ = ascii_.replace(c, chr(ALPHABET[ord(c)]))
        mapped += ascii_.split("\0") if cut < len(new) else []
        tokenize = self.library.model.tokenize
        for w, letters in zip(new, mapped, strict=True):
            known[w] = ids = array("i", [t.id for t in tokenize(letters)]).tobytes()
            self.held += 2 * len(w) + len(ids) + EACH
        get = known.__getitem__
        out = [np.array(self.library.encode(t, add_special_tokens=False).ids, "<i4").tobytes() if words is None else b"".join(map(get, words)) for t, words in zip(batch, found, strict=True)]
        for w in new:
            if len(w) > LONG:
                self.held -= 2 * len(w) + len(known.pop(w)) + EACH
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, row_group_bytes: int = 32 << 20, page_rows: int = 1_000, dictionary: bool = True) -> None:
    """Writes doc_id, ids (array<int>, `end_id` last), n_tokens, part, part_start to Parquet at `path`.

    dictionary: ids as indexes into a dictionary page per row group; else as delta-packed integers.
    part_start is the number of ids before the row in its part.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, tail, part, before = encoder(tokenizer_file), np.array([end_id], "<i4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches_by_bytes(batches, "text", CHUNK_BYTES):
            rows = [ids + tail for ids in bpe.encode(batch.column("text").to_pylist())]
            size = np.array([len(r) // 4 for r in rows], np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(size), pa.array(np.full(len(rows), part, np.int32)), pa.array(at[:-1] + before)], ["doc_id", "ids", "n_tokens", "part", "part_start"])
            before += int(at[-1])

    n = partitions(docs.sparkSession)
    # Only where there are null doc_ids must the texts be read to find the ranges.
    tie = [] if docs.filter("doc_id is null").isEmpty() else [F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    ordered = texts(docs).repartitionByRange(n, "doc_id", *tie).sortWithinPartitions("doc_id", *tie, "text")
    (
        ordered.mapInArrow(work, "doc_id long, ids array<int>, n_tokens long, part int, part_start long")
        .write.option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", 1)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.writer.version", "v1" if dictionary else "v2")
        .parquet(path)
    )


def read(spark, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and `columns` from files of write()."""
    rows = spark.read.parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row for each written part: as many as write() had tasks.
    before = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", *columns)


def ids_crc32(ids: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def crc(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: zlib.crc32(np.asarray(x).astype("<u4").tobytes()))

    return crc(ids)
