"""Evaluation texts leaking into training text.

Texts are reduced to words that restyling leaves alone (case, marks, markup, invisible and look-alike characters). Every window of a passage and
of a document goes through the CGK random walk, which copies the word under its pointer and moves on by a coin that depends on step and word:
two windows a few word edits apart fall back into step, so edit distance becomes Hamming distance. Sampled steps of several walks are the keys
of the locality-sensitive hash; as many walks of SAMPLES samples each are taken as reach the target recall. What collides is verified exactly: a chain of equal
runs, broken only by single edits, with at least NEED equal words.

The corpus is only mapped: the items' keys, at most PASS_WORDS words a pass, are broadcast, and larger item sets take several passes. No document
is grouped with another, so a source or copy that holds a third of all rows weighs no more than its text.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, and equal words of a stretch that makes a case; a shorter passage must be there whole, if it has more than COMMON words.
WINDOW, NEED, COMMON = 12, 15, 10
#: Words of the passage for each edit; matching words that an edit needs on either side.
EDIT_EACH, RUN = 6, 2
#: Samples of a random walk, steps in a sample; share of the windows with as many edits as they may have that must meet their like. The number of
#: walks follows from it.
SAMPLES, STEPS, TARGET = 5, 4, 0.95
#: Words of passages in one pass over the corpus.
PASS_WORDS = 400_000

# Letters of other scripts that look like Latin ones.
_LOOKS = dict(zip("аеорсухіјѕԁһԛԝѵьАВЕКМНОРСТУХІЈЅαεοραιουκνχτρΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡℓ", "aeopcyxijsdhqwvbABEKMHOPCTYXIJSaeopaioukvxtpABEZHIKMNOPTYXigl"))
_LOOK = {ord(k): v for k, v in _LOOKS.items()}
_MARKUP = re.compile(r"</?[a-zA-Z|][^<>]{0,200}>|\]\([^)\s]*\)")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐­]\s*\n\s*(?=[a-z])")
_MARK = re.compile(r"[`´'’ʼ‘\"*_~]+")
_BEYOND = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(50_000)
def _plain(run: str) -> str:
    """A run of characters beyond ASCII without look-alikes, marks and invisible ones."""
    return "".join(c for c in unicodedata.normalize("NFKD", run.translate(_LOOK)) if c.isascii() or unicodedata.category(c) not in ("Mn", "Cf", "Me"))


def words_of(text: str) -> list[str]:
    """Words as restyling leaves them: case, accents, markup, invisible and look-alike characters put aside."""
    if "<" in text or "](" in text:
        text = _MARKUP.sub(" ", text) if "](" in text else _MARKUP.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "­" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _BEYOND.sub(lambda m: _plain(m[0]), text)
    return _WORD.findall(_MARK.sub("", text.lower()))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def walk_keys(windows: np.ndarray, repeats: int | None = None, seed: int = 11) -> np.ndarray:
    """windows x (walks * SAMPLES): the hash keys of windows of word numbers."""
    n, width = windows.shape
    repeats = walks() if repeats is None else repeats
    rng = np.random.default_rng(seed)
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    rows, out = np.arange(n), []
    for r in range(repeats):
        # Steps beyond twice the width mostly read the padding: the pointer moves on every other step.
        picks = [np.sort(rng.choice(2 * width - 2, STEPS, replace=False)) for _ in range(SAMPLES)]
        at = np.zeros(n, np.int64)
        keys = [np.full(n, (r * SAMPLES + s + 1) * 0x51ED27, np.uint64) for s in range(SAMPLES)]
        for step in range(2 * width - 2):
            word = padded[rows, at]
            for s in range(SAMPLES):
                if step in picks[s]:
                    keys[s] = _mix(keys[s] ^ word, 0xD1B54A32 + step)
            at = np.minimum(at + (_mix(word, (seed * 1009 + r) * 7919 + step) & np.uint64(1)).astype(np.int64), width)
        out += keys
    return np.stack(out, axis=1)


def edited(windows: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """Each window after so many random edits of single words, cut or padded to its width."""
    out = np.zeros_like(windows)
    for row, window in enumerate(windows):
        words = window.tolist()
        for _ in range(edits):
            i, kind = int(rng.integers(len(words))), int(rng.integers(3))
            words[i : i + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 1 << 62))]
        words = words[: len(window)]
        out[row, : len(words)] = words
    return out


@lru_cache(1)
def walks(target: float = TARGET, tried: int = 2_000, most: int = 32) -> int:
    """The least number of walks with which windows meet their like with WINDOW // EDIT_EACH edits as often as the target says, on random windows."""
    rng = np.random.default_rng(17)
    windows = rng.integers(1, 1 << 62, size=(tried, WINDOW)).astype(np.uint64)
    equal = (walk_keys(windows, most) == walk_keys(edited(windows, WINDOW // EDIT_EACH, rng), most)).reshape(tried, most, SAMPLES).any(axis=2)
    recall = np.logical_or.accumulate(equal, axis=1).mean(axis=0)
    if recall[-1] < target:
        raise ValueError(f"{most} walks reach a recall of {recall[-1]:.3f}, not {target}")
    return int(np.argmax(recall >= target)) + 1


def chain(doc: list, passage: list, j: int, i: int) -> tuple[int, int]:
    """(words of the passage, edits) of the longest chain through the equal words doc[j] and passage[i]."""

    def grow(j: int, i: int, d: int, left: int) -> tuple[int, int]:
        """Words of the passage and edits gained from (j, i) on in direction d; an edit must be followed by RUN equal words."""
        n = 0
        while 0 <= j < len(doc) and 0 <= i < len(passage) and doc[j] == passage[i]:
            n, j, i = n + 1, j + d, i + d
        best = (n, 0)
        if left:
            for dj, di in ((1, 1), (1, 0), (0, 1)):
                a, b = j + d * dj, i + d * di
                if all(0 <= a + d * k < len(doc) and 0 <= b + d * k < len(passage) and doc[a + d * k] == passage[b + d * k] for k in range(RUN)):
                    more, edits = grow(a, b, d, left - 1)
                    if n + di + more > best[0]:
                        best = (n + di + more, edits + 1)
        return best

    most = len(passage) // EDIT_EACH + 1
    ahead, back = grow(j, i, 1, most), grow(j - 1, i - 1, -1, most)
    return ahead[0] + back[0], ahead[1] + back[1]


def is_leak(span: int, edits: int, length: int) -> bool:
    return length > COMMON and span - edits >= min(NEED, length) and edits * EDIT_EACH <= span


class Items:
    """The passages of one pass: their words, and which passage each key comes from."""

    def __init__(self, passages: list[tuple[int, list[str]]]):
        self.words = [w for _, w in passages]
        self.ids = [i for i, _ in passages]
        self.places: list[dict[tuple[str, str], list[int]]] = []
        for words in self.words:
            places: dict[tuple[str, str], list[int]] = {}
            for a, pair in enumerate(zip(words, words[1:])):
                places.setdefault(pair, []).append(a)
            self.places.append(places)
        self.numbers: dict[str, int] = {}
        keys, where = [], []
        for k, words in enumerate(self.words):
            if len(words) <= COMMON:
                continue
            width = min(WINDOW, len(words))
            ids = np.array([self.number(w) for w in words], np.uint64)
            if width < WINDOW:
                ids = np.concatenate([ids, np.zeros(WINDOW - width, np.uint64)])
            windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
            keys.append(walk_keys(windows).ravel())
            where.append(np.full(keys[-1].size, k))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        place = np.concatenate(where) if where else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.keys, self.place = flat[order], place[order]
        self.vocabulary = np.unique(np.array([self.number(w) for x in self.words for w in x] or [0], np.uint64))

    def number(self, word: str) -> int:
        found = self.numbers.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            found = (zlib.crc32(raw) << 32 | zlib.crc32(raw[::-1] + b"+")) or 1
            if len(self.numbers) > 500_000:
                self.numbers.clear()
            self.numbers[word] = found
        return found

    def leaked(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        """(position of the text, id of the item) of every leak."""
        docs, ids, filled = [], [], 0
        for k, t in enumerate(texts):
            words = words_of(t) if t else []
            if len(words) > COMMON:
                docs.append((k, filled, words))
                ids += map(self.number, words)
                # As much padding as keeps windows within their text.
                ids += [0] * (WINDOW - 1)
                filled = len(ids)
            if filled >= 200_000:
                yield from self._leaked(docs, np.array(ids, np.uint64))
                docs, ids, filled = [], [], 0
        if docs:
            yield from self._leaked(docs, np.array(ids, np.uint64))

    def _leaked(self, docs: list[tuple[int, int, list[str]]], ids: np.ndarray) -> Iterator[tuple[int, int]]:
        if not len(self.keys):
            return
        windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
        there, known = (np.concatenate([[0], np.cumsum(x)]) for x in (ids != 0, np.isin(ids, self.vocabulary) & (ids != 0)))
        length, near = there[WINDOW:] - there[:-WINDOW], known[WINDOW:] - known[:-WINDOW]
        # A window within reach of a passage has at most an edit for EDIT_EACH words: all others are passage words.
        starts = np.flatnonzero((length > COMMON) & (ids[: len(windows)] != 0) & (near >= length - (WINDOW // EDIT_EACH + 1)))
        if not len(starts):
            return
        firsts = np.array([d[1] for d in docs])
        owner = np.searchsorted(firsts, starts, "right") - 1
        keys = walk_keys(windows[starts])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        tried: set[tuple[int, int]] = set()
        for row, column in np.argwhere(high > low):
            at, _, words = docs[owner[row]]
            for k in self.place[low[row, column] : high[row, column]].tolist():
                if (at, k) not in tried:
                    tried.add((at, k))
                    if self.verified(words, k):
                        yield at, self.ids[k]

    def verified(self, doc: list[str], k: int) -> bool:
        """Exact: a chain through some run of equal words of the document and the passage. Each run is tried once, from its start."""
        passage, places = self.words[k], self.places[k]
        for b, pair in enumerate(zip(doc, doc[1:])):
            if pair in places:
                for a in places[pair]:
                    if not (a and b and doc[b - 1] == passage[a - 1]) and is_leak(*chain(doc, passage, b, a), len(passage)):
                        return True
        return False


def _passes(items: DataFrame, item_id: str, passage: str) -> Iterator[list[tuple[int, list[str]]]]:
    held, words = [], 0
    for r in items.filter(F.col(passage).isNotNull() & F.col(item_id).isNotNull()).select(item_id, passage).toLocalIterator():
        w = words_of(r[1])
        if held and words + len(w) > PASS_WORDS:
            yield held
            held, words = [], 0
        held.append((r[0], w))
        words += len(w)
    if held:
        yield held


_made: dict[int, Items] = {}


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc id, item id) of every document that carries a stretch of an item's passage.

    Defined cases: null, empty and blank texts and passages, and those of COMMON words or fewer, match nothing; passages of fewer than NEED words
    must be there whole; a repeated row comes out once; null ids never match; no items or no documents give no rows; other columns are ignored.
    """
    spark, out = documents.sparkSession, None
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    for block in _passes(items, item_id, passage):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            key = shared.id if hasattr(shared, "id") else id(shared)
            if key not in _made:
                _made.clear()
                _made[key] = Items(shared.value)
            ready = _made[key]
            for b in batches:
                pairs = list(ready.leaked(b.column(1).to_pylist()))
                rows, found = [k for k, _ in pairs], [i for _, i in pairs]
                kind = b.schema.field(0).type
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())).cast(kind), pa.array(found, _arrow(kinds[1]))], ["d", "i"])

        part = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"d {kinds[0]}, i {kinds[1]}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"d {kinds[0]}, i {kinds[1]}")
    return out.distinct().select(F.col("d").alias(doc_id), F.col("i").alias(item_id))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
