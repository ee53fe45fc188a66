"""Long repeated passages by recompression.

A text starts as its words. Rounds of recompression then rename it: a maximal run of one
symbol becomes one symbol, and adjacent symbols a b become one symbol where a coin of the
round puts a on the left side and b on the right. Names are fingerprints of what they stand
for, so all tasks give the same name to the same thing without exchanging a dictionary.

Whether a symbol arises depends only on a stretch of words around it, its context; equal
passages therefore hold the same symbols wherever a context lies inside them. Each window of
``window`` words picks one symbol whose context it contains: one of the highest round, among
those the one of least name. The windows that pick the same occurrence follow one another;
together they form a segment, filed under the fingerprint of the symbol's context. Then

1. a context that occurs in one document only settles all its windows: not repeated;
2. a context whose segments are all equal settles them too: every document but the first
   repeats them;
3. otherwise equal segments are treated alike, and the first document of each distinct
   segment files its single windows, by fingerprints of all their words.

Steps 1 and 2 verify a repeat, and its absence, on symbols; step 3 is left for the ends of
repeats and for near copies. Fingerprints of segments and windows have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import (
    WHITE, keyed, mixed, pieces, powers, settled, utf8, word_bounds, word_hashes,
)

ROUNDS = 4
#: Symbols of more words are not merged further; no more than a third of a window.
LONGEST = 16
_BASES = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)


class Words:
    """The words of a few texts laid end to end, with range fingerprints."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = utf8(texts)
        self.starts, self.ends, self.first = word_bounds(self.data, self.offsets, WHITE)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self._sums = [self._running(self.hashes, _BASES[0])]

    def _running(self, values: np.ndarray, base: int) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=sums[1:])
        return sums

    def fingerprint(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Of words [a, b), a function of the words alone."""
        if which and len(self._sums) == 1:
            self._sums.append(self._running(word_hashes(self.data, self.starts, self.ends, 12), _BASES[1]))
        sums = self._sums[which]
        return mixed((sums[b] - sums[a]) * powers(_BASES[which], len(sums), inverse=True)[a])


def _runs(symbol, start, low, high, text, end, round_):
    """Maximal runs of one symbol as one symbol each."""
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(symbol)))
    last = at + length - 1
    name = np.where(length > 1, mixed(symbol[at] + mixed(length.astype(np.uint64) + np.uint64(round_ << 32))), symbol[at])
    # a run, also of one, ends where its neighbours differ, so it depends on them too
    before, after = _neighbours(low, high, text, at, last)
    return name, start[at], np.minimum(low[at], before), np.maximum(high[last], after), text[at]


def _neighbours(low, high, text, first, last):
    """Context of the symbols before ``first`` and after ``last``; beyond a text, one word more."""
    n = len(low)
    inside = (first > 0) & (text[first] == text[np.maximum(first - 1, 0)])
    before = np.where(inside, low[np.maximum(first - 1, 0)], low[first] - 1)
    inside = (last < n - 1) & (text[last] == text[np.minimum(last + 1, n - 1)])
    after = np.where(inside, high[np.minimum(last + 1, n - 1)], high[last] + 1)
    return before, after


def _pairs(symbol, start, low, high, text, end, round_):
    """Adjacent symbols of the left and the right side as one symbol each."""
    n = len(symbol)
    coin = (mixed(symbol + np.uint64(round_ * 0x632BE5AB + 1)) & np.uint64(1)).astype(bool)
    length = np.diff(np.append(start, end))
    merge = np.zeros(n, bool)
    merge[:-1] = (coin[:-1] & ~coin[1:] & (text[1:] == text[:-1]) & (length[:-1] + length[1:] <= LONGEST))
    second = np.zeros(n, bool)
    second[1:] = merge[:-1]
    keep = ~second
    at = np.flatnonzero(keep)
    joined = merge[at]
    other = np.minimum(at + 1, n - 1)
    name = np.where(joined, mixed(symbol[at] * np.uint64(3) + mixed(symbol[other] + np.uint64(1))), symbol[at])
    last = np.where(joined, other, at)
    # whether a symbol stayed alone depends on its neighbours; a pair only on its own two parts
    before, after = _neighbours(low, high, text, at, last)
    low_ = np.where(joined, np.minimum(low[at], low[other]), np.minimum(low[at], before))
    high_ = np.where(joined, np.maximum(high[at], high[other]), np.maximum(high[at], after))
    return name, start[at], low_, high_, text[at]


def contexts(words: Words, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, low, high) of the symbols after each round, last round first; contexts [low, high)."""
    n = len(words.hashes)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    start = np.arange(n)
    state = (words.hashes, start, start, start + 1, text)
    levels = [state]
    for r in range(1, ROUNDS + 1):
        state = _runs(*state, n, 2 * r)
        state = _pairs(*state, n, 2 * r + 1)
        levels.append(state)
    for name, _, low, high, _ in reversed(levels):
        fits = high - low <= window
        yield name[fits], low[fits], high[fits]


def picks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, low, high): the context that each window picked.

    Windows lie inside one text each. Ties of equal names go to the leftmost.
    """
    n = len(words.hashes)
    counts = np.maximum(np.diff(words.first) - window + 1, 0)
    whole = np.repeat(words.first[:-1], counts) + np.arange(counts.sum()) - np.repeat(
        np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    if not len(whole):
        return whole, whole, whole
    low_of, high_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_ = np.zeros(n, bool)
    open_[whole] = True
    for name, low, high in contexts(words, window):
        # a context serves the windows from high - window to low
        a, b = np.maximum(high - window, 0), low
        waiting = np.concatenate([[0], np.cumsum(open_)])
        use = (b >= 0) & (a <= b) & (waiting[np.minimum(b + 1, n)] > waiting[np.minimum(a, n)])
        if not use.any():
            continue
        name, low, high, a, b = name[use], low[use], high[use], a[use], b[use]
        rank = np.empty(len(name), np.int64)
        rank[np.lexsort((low, name))] = np.arange(len(name))
        best = _least_over(a, b, rank, n)
        hit = open_ & (best < len(name))
        by_rank = np.argsort(rank)
        chosen = by_rank[best[hit]]
        low_of[hit], high_of[hit] = low[chosen], high[chosen]
        open_ &= ~hit
        if not open_.any():
            break
    return whole, low_of[whole], high_of[whole]


def _least_over(a: np.ndarray, b: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """For each position the least rank of the intervals [a, b] over it (by doubling tables)."""
    none = np.iinfo(np.int64).max
    power = np.floor(np.log2(b - a + 1)).astype(np.int64)
    top = int(power.max())
    below = None
    for k in range(top, -1, -1):
        table = np.full(n, none)
        mine = power == k
        if mine.any():
            np.minimum.at(table, a[mine], rank[mine])
            np.minimum.at(table, b[mine] - (1 << k) + 1, rank[mine])
        if below is not None:
            half = 1 << k
            np.minimum(table, below, out=table)
            table[half:] = np.minimum(table[half:], below[:-half] if half < n else below[:0])
        below = table
    return below


def segments(words: Words, window: int):
    """(text, low, high, first window, last window) of each run of windows with one context."""
    whole, low, high = picks(words, window)
    if not len(whole):
        return (np.zeros(0, np.int64),) * 5
    text = np.searchsorted(words.first, whole, side="right") - 1
    new = np.ones(len(whole), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (whole[1:] != whole[:-1] + 1) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(whole)) - 1
    return text[at], low[at], high[at], whole[at], whole[last]


FILED = "doc_id {id}, doc_fp long, at int, windows int, context long, s1 long, s2 long"


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, doc_fp, spans): word spans [from, to) to remove, for documents that have any.

    ``docs`` is (doc_id, doc_fp, text) as from :func:`keyed`. A word goes if a window over it also
    starts in a document of smaller id; null ids count as larger than all others.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    filed_as = FILED.format(id=kind)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column(2))
                text, low, high, one, last = segments(words, window)
                context = mixed(words.fingerprint(low, high) + (high - low).astype(np.uint64))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(take), piece.column(1).take(take),
                    pa.array((one - words.first[text]).astype(np.int32)), pa.array((last - one + 1).astype(np.int32)),
                    pa.array(context.view(np.int64)),
                    *(pa.array(mixed(words.fingerprint(one, last + window, w) + (last - one).astype(np.uint64))
                               .view(np.int64)) for w in (0, 1))],
                    ["doc_id", "doc_fp", "at", "windows", "context", "s1", "s2"])

    filed = settled(docs.filter(F.length("text") >= 2 * window - 1).mapInArrow(file, filed_as), "filed")
    # ids in order, null last
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    shared = settled(
        filed.groupBy("context")
        .agg(F.min(order).alias("first"), F.max(order).alias("last"),
             F.min("s1").alias("a1"), F.max("s1").alias("b1"), F.min("s2").alias("a2"), F.max("s2").alias("b2"))
        .filter("first <> last")
        .select("context", "first", ((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))).alias("varied")),
        "shared")
    met = settled(filed.join(shared, "context"), "met", filed)
    span = F.array("at", F.col("at") + F.col("windows") + (window - 1))
    alike = met.filter(~F.col("varied") & (F.col("first") < order)).select("doc_id", "doc_fp", span.alias("span"))

    varied = met.filter("varied").drop("first")
    firsts = settled(varied.groupBy("context", "s1", "s2").agg(F.min(order).alias("first")), "firsts")
    varied = settled(varied.join(firsts, ["context", "s1", "s2"]).drop("varied"), "varied", firsts, shared)
    again = varied.filter(F.col("first") < order).select("doc_id", "doc_fp", span.alias("span"))

    # Single windows of each distinct segment, from the document that has it first.
    asked = (varied.filter(F.col("first") == order).groupBy("doc_id", "doc_fp")
             .agg(F.collect_list(F.array("at", "windows")).alias("asked")))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words(piece.column(2))
                row, at = [], []
                for i, ranges in enumerate(piece.column(3).to_pylist()):
                    spots = np.concatenate([np.arange(a, a + n) for a, n in ranges])
                    row.append(np.full(len(spots), i))
                    at.append(np.unique(spots) if len(ranges) > 1 else spots)
                    row[-1] = row[-1][:len(at[-1])]
                row, at = np.concatenate(row), np.concatenate(at)
                a = words.first[row] + at
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(take), piece.column(1).take(take), pa.array(at.astype(np.int32)),
                    *(pa.array(words.fingerprint(a, a + window, w).view(np.int64)) for w in (0, 1))],
                    ["doc_id", "doc_fp", "at", "w1", "w2"])

    same = F.col("d.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("d.doc_fp") == F.col("q.doc_fp"))
    windows = settled(
        docs.alias("d").join(asked.alias("q"), same).select("d.doc_id", "d.doc_fp", "d.text", "q.asked")
        .mapInArrow(single, f"doc_id {kind}, doc_fp long, at int, w1 long, w2 long"), "windows")
    known = settled(windows.groupBy("w1", "w2").agg(F.min(order).alias("first"), F.max(order).alias("last"))
                    .filter("first <> last").select("w1", "w2", "first"), "known")
    ends = (windows.join(known, ["w1", "w2"]).filter(F.col("first") < order)
            .select("doc_id", "doc_fp", F.array("at", F.col("at") + window).alias("span")))
    return settled(alike.unionByName(again).unionByName(ends)
                   .groupBy("doc_id", "doc_fp").agg(F.collect_list("span").alias("spans")), "spans",
                   met, varied, windows, known)


def kept_words(texts: pa.Array, spans: list[list[list[int]] | None]) -> list[tuple[int, int, bytes]]:
    """(words, words removed, the others joined by one space) of each text."""
    data, offsets = utf8(texts)
    starts, ends, first = word_bounds(data, offsets, WHITE)
    raw = data.tobytes()
    out = []
    for i, cut in enumerate(spans):
        a, b = int(first[i]), int(first[i + 1])
        keep = np.ones(b - a, bool)
        for x, y in cut or ():
            keep[x:y] = False
        s, e = starts[a:b][keep].tolist(), ends[a:b][keep].tolist()
        out.append((b - a, b - a - len(s), b" ".join([raw[x:y] for x, y in zip(s, e)])))
    return out


def deduplicated(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text",
                 digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row; with ``digest``, kept_sha256 for kept.

    Null, empty and blank texts have no words; texts shorter than a window lose nothing;
    repeated rows (equal id and text) are alike, so none of them is earlier than another.
    """
    texts = keyed(docs, id_col, text_col)
    spans = repeats(texts, window)
    kind = texts.schema["doc_id"].dataType.simpleString()
    last = "kept_sha256" if digest else "kept"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = kept_words(piece.column(1), piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([r for _, r, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() if digest else k.decode() for _, _, k in found])],
                    ["doc_id", "n_words", "n_removed", last])

    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.doc_fp") == F.col("r.doc_fp"))
    return (texts.alias("d").join(spans.alias("r"), same, "left").select("d.doc_id", "d.text", "r.spans")
            .mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, {last} string"))
