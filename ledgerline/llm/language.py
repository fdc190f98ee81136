"""Language identification by string kernels: presence of character n-grams, Nyström landmarks, one-versus-rest kernel ridge regression.

Letters are lower-cased characters; all between two letters counts as one gap. The kernel of two texts is the blended spectrum of their n-grams of 1 to
GRAM symbols by presence: the number that both have, over the root of the product of the numbers that each has, among the n-grams of
the landmarks. Landmarks are training texts, the same number of each language. The kernel between the landmarks gives the Nyström features, and ridge
regression on them a coefficient for each landmark and language. A batch of texts is scored by two matrix products: presence with the
landmarks' presence, then kernels with coefficients. The n-grams of the landmarks are a trie laid out as a table by node and symbol, so a text's
n-grams are found by GRAM look-ups at every place of a batch at once.

The fit reads at most SAMPLE rows of each language and no more than SAMPLE_ROWS of all, chosen by a hash, of at most LANGUAGES languages, the commonest,
and of a longer text SAMPLE_CHARS characters from a place that the hash gives: that is the bound of what reaches the driver, whatever the corpus
holds. Scoring reads every whole text and nothing else; symbols of a long text are looked up in slices that overlap by an n-gram.

A text that is null or has no letter is `und` with score 0. The score is the clipped regression value of the language over the sum of all: it is 1 where only
one language was learned; ties go to the language that comes first by name; with nothing to learn from every text is `und`. Letters that no landmark has
are one symbol of their own. Null doc_ids are never learned from nor held out; rows with null language are predicted only; repeated rows
are all predicted; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import texts

SAMPLE = 400
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 2_000
LANGUAGES = 200
#: Landmarks of all languages, and characters of each.
LANDMARKS = 128
LANDMARK_CHARS = 1_000
GRAM = 4
RIDGE = 0.05
UND = "und"
#: Texts of one matrix product, and symbols that one look-up works on.
BATCH = 256
SLICE = 1 << 18
_CODES = 0x110000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for the letters among all code points."""
    return np.fromiter((chr(c).isalpha() for c in range(_CODES)), np.uint8, _CODES)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    alphabet: str  # symbols 3, 4, ... ; 0 ends a text, 1 is a gap, 2 any other letter
    trie: np.ndarray  # node by node and symbol; 0: none; node 0 is the root
    landmarks: np.ndarray  # presence of nodes by landmark, divided by the landmark's root
    coefficients: np.ndarray  # by landmark and language, the last row is added

    def kernels(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernels of the texts with the landmarks, and which texts have a letter."""
        seen, lettered = np.zeros((len(rows), len(self.trie)), np.float32), np.zeros(len(rows), bool)
        for lo, hi, symbols, at in _symbols(rows, _classes(self.alphabet)):
            row = np.repeat(np.arange(lo, hi), np.diff(at))
            lettered[lo:hi] = np.diff(np.concatenate([[0], np.cumsum(symbols > 1)])[at]) > 0
            for a in range(0, len(symbols), SLICE):
                _mark(seen, self.trie, symbols[a : a + SLICE + GRAM - 1], row[a : a + SLICE], min(SLICE, len(symbols) - a))
        seen[:, 0] = 0
        size = np.sqrt(np.maximum(1, seen.sum(axis=1, keepdims=True)))
        return (seen @ self.landmarks) / size, lettered

    def predict(self, rows: list[str]) -> tuple[list[str], np.ndarray]:
        k, lettered = self.kernels(rows)
        value = np.clip(k @ self.coefficients[:-1] + self.coefficients[-1], 1e-6, 1)
        best = value.argmax(axis=1)
        score = np.where(lettered, value[np.arange(len(rows)), best] / value.sum(axis=1), 0.0)
        return [self.languages[b] if t else UND for b, t in zip(best.tolist(), lettered.tolist(), strict=True)], score


@lru_cache(maxsize=2)
def _classes(alphabet: str) -> np.ndarray:
    """The symbol of every code point: 1 a gap, 2 a letter that is not in the alphabet."""
    out = _letters() + np.uint8(1)
    out[[ord(c) for c in alphabet]] = np.arange(3, 3 + len(alphabet))
    return out


def _symbols(rows: list[str], classes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, symbols of these rows, where each row starts in them): gaps before, between and after words, then the end."""
    lo = 0
    while lo < len(rows):
        hi, size = lo, 0
        while hi < len(rows) and (hi == lo or size + len(rows[hi]) <= SLICE):
            size += len(rows[hi])
            hi += 1
        parts, lengths = [], []
        for text in rows[lo:hi]:
            mapped = [np.ones(1, np.uint8)]
            for a in range(0, len(text), SLICE):
                mapped.append(classes[np.frombuffer(text[a : a + SLICE].lower().encode("utf-32-le", "replace"), np.uint32)])
            s = np.concatenate([*mapped, np.ones(1, np.uint8)])
            s = s[np.concatenate([[True], (s[1:] > 1) | (s[:-1] > 1)])]  # one gap stands for a run of them
            parts += [s, np.zeros(1, np.uint8)]
            lengths.append(len(s) + 1)
        yield lo, hi, np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)])
        lo = hi


def _mark(seen: np.ndarray, trie: np.ndarray, symbols: np.ndarray, row: np.ndarray, starts: int) -> None:
    """Marks the trie's nodes that the n-grams from the first `starts` places lead to, in their text's row; the end of a text leads nowhere."""
    width, flat_trie, flat_seen = trie.shape[1], trie.ravel(), seen.ravel()
    symbols = symbols.astype(np.int64)
    at, of, node = np.arange(starts), row * trie.shape[0], np.zeros(starts, np.int64)
    for j in range(GRAM):
        if len(symbols) < starts + j:
            inside = at + j < len(symbols)
            at, of, node = at[inside], of[inside], node[inside]
        node = flat_trie[node * width + (symbols[at + j] if j else symbols[:starts])]
        flat_seen[of + node] = 1  # the root's column is cleared by the caller
        if j + 1 < GRAM:
            alive = np.flatnonzero(node)
            at, of, node = at[alive], of[alive], node[alive]


def _trie(parts: list[np.ndarray], width: int) -> np.ndarray:
    """The table of all n-grams of 1 to GRAM symbols in the symbol arrays."""
    tables, count = np.zeros((1, width), np.int64), 1
    fronts = [np.zeros(len(p), np.int64) for p in parts]  # the node of the n-gram at each place so far
    for j in range(GRAM):
        keys = [f[: max(0, len(p) - j)] * width + p[j:] for f, p in zip(fronts, parts, strict=True)]
        known = np.unique(np.concatenate(keys))
        tables = np.concatenate([tables, np.zeros((len(known), width), np.int64)])
        tables[known // width, known % width] = np.arange(count, count + len(known))
        fronts = [count + np.searchsorted(known, k) for k in keys]
        count += len(known)
    return tables


def train(rows: list[tuple[str, str]]) -> LanguageModel | None:
    """The model of (text, language) rows, which are taken in the given order; None without a letter."""
    rows = [(t, lang) for t, lang in rows if any(c.isalpha() for c in t)]
    if not rows:
        return None
    languages = tuple(sorted({lang for _, lang in rows}))
    letters: dict[str, int] = {}
    for text, _ in rows:
        for c in text.lower():
            if c.isalpha():
                letters[c] = letters.get(c, 0) + 1
    alphabet = "".join(sorted(letters, key=lambda c: (-letters[c], c))[:252])
    each = max(1, LANDMARKS // len(languages))
    marks = [t[:LANDMARK_CHARS] for lang in languages for t in [x for x, own in rows if own == lang][:each]]
    parts = [s[a : b - 1] for _, _, s, at in _symbols(marks, _classes(alphabet)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    trie = _trie(parts, 3 + len(alphabet))
    seen = np.zeros((len(marks), len(trie)), np.float32)
    for i, p in enumerate(parts):
        _mark(seen, trie, p, np.full(len(p), i), len(p))
    seen[:, 0] = 0
    seen /= np.sqrt(np.maximum(1, seen.sum(axis=1, keepdims=True)))
    bare = LanguageModel(languages, alphabet, trie, np.ascontiguousarray(seen.T), np.zeros((len(marks) + 1, len(languages))))
    between = (seen @ seen.T).astype(np.float64)
    values, vectors = np.linalg.eigh(between)
    some = values > 1e-6 * values.max()
    root = vectors[:, some] / np.sqrt(values[some])  # kernels times root are the Nyström features
    k = np.concatenate([bare.kernels([t for t, _ in rows[a : a + BATCH]])[0] for a in range(0, len(rows), BATCH)]).astype(np.float64)
    own = np.array([languages.index(lang) for _, lang in rows])
    y = (own[:, None] == np.arange(len(languages))).astype(np.float64)
    weight = (1 / np.bincount(own, minlength=len(languages)))[own] / len(languages)  # languages weigh the same
    x = k @ root
    mean_x, mean_y = weight @ x, weight @ y
    x, y = x - mean_x, y - mean_y
    beta = np.linalg.solve((x * weight[:, None]).T @ x + RIDGE / len(rows) * np.eye(x.shape[1]), (x * weight[:, None]).T @ y)
    return LanguageModel(languages, alphabet, trie, bare.landmarks, np.vstack([root @ beta, mean_y - mean_x @ beta]).astype(np.float64))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 by 4: never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> LanguageModel | None:
    """The model of the rows of `docs` (doc_id, text, lang) that have a language and aren't held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    each = min(SAMPLE, SAMPLE_ROWS // len(counts))
    # A share of the hashes that twice `each` rows of a language are expected to have; fewer than that are all taken.
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 2 * each / r["count"])) for r in counts], "lang string, share double")
    known = known.withColumn("_at", F.xxhash64("doc_id")).join(F.broadcast(share), "lang").filter((F.col("_at") / F.lit(2.0**64) + 0.5) < F.col("share"))
    start = F.pmod(F.col("_at"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    part = known.select("lang", "_at", "doc_id", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("text"))
    # What is left is about twice the sample at most, and the drawing per language of fewer rows still.
    rows = part.groupBy("lang", "_at", "doc_id").agg(F.min("text").alias("text")).collect()
    found: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(rows, key=lambda r: (r["_at"], r["doc_id"])):
        if len(found.setdefault(r["lang"], [])) < each:
            found[r["lang"]].append((r["text"], r["lang"]))
    return train([x for lang in sorted(found) for x in found[lang]])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS * LANDMARK_CHARS * GRAM nodes at most

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                part = batch.slice(a, BATCH)
                names, scores = m.predict(part.column("text").to_pylist()) if m else ([UND] * len(part), np.zeros(len(part)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: every document by the model of those that aren't held out."""
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
