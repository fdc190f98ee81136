"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of a BPE model with escaped white space has its space mark behind another character, so a text
falls into words (a run of spaces with what follows it) that never merge with each other. Words are cut further wherever
two characters meet that no piece has next to each other, so that text without spaces falls apart too. The distinct words
of a chunk lie in one flat numpy array of symbols. Each round looks up the rank of every adjacent pair, takes
the smallest rank of each word by a segmented minimum, merges its leftmost occurrences at once, and
compacts the arrays; words without a pair leave. Several merges of a word in one round stand only as long as none of
them makes a pair of the same or a better rank, so that the order is that of the library, one merge at a time.

Empty texts give the end id alone; a null text is an empty one; rows repeat as they come; an empty table gives no rows; other columns
are ignored. Texts and words of any length are read whole; words of over LONG characters are not remembered.
"""

from __future__ import annotations

import codecs
import re
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import CHUNK_BYTES, batches_by_bytes, texts

MARK = "▁"
NONE = np.int64(1 << 40)
#: Bytes of words and their ids, with EACH for every word, that a worker keeps; beyond it starts anew.
CACHE_BYTES, EACH, LONG = 28 << 20, 160, 256

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceBpe:
    """The tables of one model file: initial symbols, pair ranks, and the bytes of every piece."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n, self.end = model.vocab_size(), model.eos_id()
        pieces = [model.id_to_piece(i) for i in range(self.n)]
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        if any(MARK in p.strip(MARK) or (p[0] != MARK and MARK in p) for p in plain):
            raise ValueError("a piece has a space mark after another character: words are not independent")
        self.byte_ids = [next(i for i in range(self.n) if model.is_byte(i) and pieces[i] == f"<0x{b:02X}>") for b in range(256)]
        #: A character that is no piece has the symbol n + code point.
        self.span = self.n + 0x110000
        self.first = np.arange(self.n, self.span, dtype=np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        symbol = lambda p: plain.get(p, self.n + ord(p) if len(p) == 1 else None)
        rank = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        pairs = {}
        for p, i in plain.items():
            for at in range(1, len(p)):
                left, right = symbol(p[:at]), symbol(p[at:])
                if left is not None and right is not None:
                    pairs[left * self.span + right] = (rank[model.get_score(i)], i)
        #: Pairs of characters that stand next to each other in a piece.
        self.neighbours = np.unique(np.array([ord(x) * 0x110000 + ord(y) for p in plain for x, y in zip(p, p[1:])], np.int64))
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        # Only at a newline, which no piece holds, may a text be cut further.
        self.words = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if not any("\n" in p for p in plain) else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # No piece joins these punctuation marks to other characters, apart from a few; texts without those are cut around them too.
        near = {c: {x for p in plain for i, x in enumerate(p) if x not in MARK + c and c in (p[i - 1 : i], p[i + 1 : i + 2])} for c in string.punctuation}
        marks = set(near)
        while joined := {c for c in marks if any(x.isascii() and x.isprintable() and x not in marks for x in near[c])}:
            marks -= joined
        few = "".join(sorted(set().union(*(near[c] for c in marks)) - marks)) if marks else ""
        marks = "".join(sorted(marks))
        marks = re.escape(marks)
        self.finer = re.compile(rf"{MARK}*[^{MARK}\n{marks}]+|{MARK}*[{marks}]+|{MARK}+|\n") if marks and not any("\n" in p for p in plain) else self.words
        self.joined = re.compile(f"[{re.escape(few)}]") if few else None
        surface = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(s) for s in surface], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.spaced = np.array([p.startswith(MARK) and p in plain for p in pieces])
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no such piece) and merged symbol of each pair."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def rank_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """pair_rank() of the pairs that start at these places; NONE at the end of a word."""
        after = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self.pair_rank(symbols[at], symbols[after])
        rank[(word[after] != word[at]) | (after == at)] = NONE
        return rank, made

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their word numbers, words in order."""
        done_s, done_w = [], []
        rank, made = self.rank_at(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            n = len(symbols)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, n)))
            over = least == NONE
            if over.any():
                done_s.append(symbols[over])
                done_w.append(word[over])
                live = ~over
                symbols, word, rank, made, least = symbols[live], word[live], rank[live], made[live], least[live]
                n = len(symbols)
                if not n:
                    break
            best = rank == least
            # Of a run of overlapping occurrences, every second from the left.
            run = np.arange(n) - np.maximum.accumulate(np.where(best & ~np.concatenate([[False], best[:-1]]), np.arange(n), 0))
            at = np.flatnonzero(best & (run % 2 == 0))
            w = word[at]
            several = np.flatnonzero(w[1:] == w[:-1])
            if len(several):
                taken = np.zeros(n, bool)
                taken[at] = True
                after = np.minimum(at + 2, n - 1)
                right, _ = self.pair_rank(made[at], symbols[after])
                right[(at + 2 >= n) | (word[after] != w)] = NONE
                before, two = np.maximum(at - 1, 0), np.maximum(at - 2, 0)
                left, _ = self.pair_rank(np.where((at >= 2) & taken[two] & (word[two] == w), made[two], symbols[before]), made[at])
                left[(at == 0) | (word[before] != w)] = NONE
                stop = np.minimum(left, right) <= least[at]
                if stop.any():  # what follows such a merge in its word waits
                    behind = np.cumsum(stop) - stop
                    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    at = at[behind == np.repeat(behind[first], np.diff(np.append(first, len(w))))]
            symbols[at] = made[at]
            stay = np.ones(n, bool)
            stay[at + 1] = False
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
            # Only the pairs around a merge are new.
            at = at - np.arange(len(at))
            at = np.concatenate([at, at[at > 0] - 1])
            rank[at], made[at] = self.rank_at(symbols, word, at)
        if not done_s:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def learn(self, words: list[str]) -> None:
        """Adds the ids of new words, as bytes of little-endian 32-bit integers."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        pair = chars[:-1].astype(np.int64) * 0x110000 + chars[1:]
        joined = self.neighbours[np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)] == pair
        part = np.cumsum(np.concatenate([[True], ~joined | (number[1:] != number[:-1])])) - 1
        symbols, word = self.merge(self.first[chars], part)
        word = number[np.searchsorted(part, word)]
        unknown = symbols >= self.n
        if unknown.any():  # byte fallback
            parts = {int(s): [self.byte_ids[b] for b in chr(int(s) - self.n).encode("utf-8", "surrogatepass")] for s in np.unique(symbols[unknown])}
            spread = np.ones(len(symbols), np.int64)
            spread[unknown] = [len(parts[int(s)]) for s in symbols[unknown]]
            ids, word = np.repeat(symbols, spread), np.repeat(word, spread)
            ids[np.repeat(unknown, spread)] = [i for s in symbols[unknown] for i in parts[int(s)]]
        else:
            ids = symbols
        data = ids.astype("<i4").tobytes()
        ends = (4 * np.searchsorted(word, np.arange(len(words)), "right")).tolist()
        lo = 0
        for w, hi in zip(words, ends, strict=True):
            self.known[w] = data[lo:hi]
            self.held += 2 * len(w) + hi - lo + EACH
            lo = hi

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        whole = self.joined.search if self.joined else lambda text: None
        found = [(self.words if whole(t) else self.finer).findall(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        new = list({w for words in found for w in words if w not in self.known})
        if new:
            self.learn(new)
        known = self.known
        out = [np.frombuffer(b"".join([known[w] for w in words]), "<i4") for words in found]
        for w in new:
            if len(w) > LONG:
                self.held -= 2 * len(w) + len(known.pop(w)) + EACH
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row of ids."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.surface[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], size)].tobytes()
        rows = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            first = next((i for i in range(lo, hi) if size[i]), hi)
            skip = first < hi and bool(self.spaced[ids[first]])
            rows.append(out[ends[lo] + skip : ends[hi]].decode("utf-8", "each_byte"))
        return rows


@lru_cache(maxsize=2)
def model(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode(docs: DataFrame, model_file: str, add_end: bool = True, decoded: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and `ids` array<int> of every whole text; model_file is a path that each executor can read.

    decoded: also the text `decoded` from these ids, by the same Python worker. carry: further columns of `docs` to keep.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_file)
        tail = [bpe.end] if add_end else []
        for batch in batches_by_bytes(batches, "text", CHUNK_BYTES):
            rows = [np.append(ids, tail).astype(np.int32) for ids in bpe.encode(batch.column("text").to_pylist())]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))]
            if decoded:
                columns.append(pa.array(bpe.decode(values, at), pa.string()))
            names = ["doc_id", "ids", "decoded"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carry], [*names, *carry])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return texts(docs, carry).mapInArrow(work, "doc_id long, ids array<int>" + ", decoded string" * decoded + kinds)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the `decoded` text of its ids; null ids give an empty text."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_file)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                ids = part.column("ids")
                at = np.asarray(ids.offsets).astype(np.int64)
                values = np.asarray(ids.values)[at[0] : at[-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(bpe.decode(values, at - at[0]), pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Token counts and the SHA-256 of ids and text, and the columns `carry`."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *carry)
