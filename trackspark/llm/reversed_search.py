"""Ranked lexical search turned round: the items are indexed, the documents stream through.

The inverted index over the items' terms is what is broadcast; it is bounded by ``POSTINGS``
(more items make more shares, each with its own pass). A first pass counts, for every indexed
term, the documents that hold it, and the totals of the corpus. In the second, every task reads
its documents once and keeps, per item, the ``k`` best it has met. Those bounded heaps are all
that is exchanged; merging them gives the answer.

A heap that is full also saves work: the terms of an item are put in order of their weight, and
the light ones that together cannot reach the item's k-th score open no candidates. Every
candidate is scored in full, in 64-bit integers, so the result is exact whatever the order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.common import BENCH_SEPARATORS, pieces, settled, utf8, word_bounds, word_hashes

#: Most terms of items in one broadcast index (of an item that alone has more, all): 60 bytes each.
POSTINGS = 500_000
#: Tasks per core in a pass over the documents; each sends at most k rows an item.
TASKS_PER_CORE = 4
#: Text bytes of a task's first step, before its heaps hold anything; later steps double.
FIRST_BYTES = 1 << 14
STEP_BYTES = 1 << 18
#: Candidates and terms looked at in one vectorised step.
STEP_TERMS = 1 << 20

# Fixed values of the score: its scale, and the shares of a document's length in its damping.
SCALE, LENGTH_SHARE, FLAT_SHARE = 1_000_000_000, 25, 75


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, first term per row) of all terms; only A-Z are lower-cased."""
    data, offsets = utf8(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = word_bounds(data, offsets, BENCH_SEPARATORS)
    return word_hashes(data, starts, ends), word_hashes(data, starts, ends, 12), first


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start .. start + size - 1 of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``most`` at most (or hold one)."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


@dataclass
class Index:
    """Terms of items in packed arrays; postings lie together by item, in order of their worth."""

    hashes: np.ndarray          # of each term, ascending
    second: np.ndarray
    item: np.ndarray            # per posting
    term: np.ndarray
    times: np.ndarray           # how often the item has the term
    first: np.ndarray           # first posting of each item, and the end
    weight: np.ndarray | None = None
    reached: np.ndarray | None = None        # worth of a posting and all lighter ones of its item
    documents: int = 0
    words: int = 1

    @classmethod
    def over(cls, texts: list[str | None]) -> Index:
        hashes, second, first = terms_of(pa.array(texts, pa.large_string()))
        known, at = np.unique(hashes, return_index=True)
        pair, times = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * max(len(known), 1)
                                + np.searchsorted(known, hashes), return_counts=True)
        item, term = np.divmod(pair, max(len(known), 1))
        return cls(known, second[at], item, term, times, np.searchsorted(item, np.arange(len(texts) + 1)))

    def numbers(self, hashes: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Positions of terms in the index; -1 for those of no item."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.second[at] == second), at, -1)

    def weigh(self, holding: np.ndarray, documents: int, words: int) -> None:
        """Set weights from how many of all documents hold each term, and order the postings."""
        self.documents, self.words = documents, max(words, 1)
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
                                for df in holding.tolist()], np.int64)
        worth = self.times * self.weight[self.term]
        order = np.lexsort((worth, self.item))
        self.term, self.times, worth = self.term[order], self.times[order], worth[order]
        sums = np.concatenate([[0], np.cumsum(worth)])
        self.reached = sums[1:] - sums[self.first[self.item]]


class Search:
    """One task's heaps: the ``k`` best documents of each item so far."""

    def __init__(self, index: Index, k: int):
        self.index, self.k = index, k
        items = len(index.first) - 1
        self.score = np.zeros((items, k), np.int64)      # 0: free; rows are in order of rank
        self.doc = np.zeros((items, k), np.int64)
        self.nameless = np.zeros((items, k), bool)       # the document's id is null
        self.seen = self.ordered_at = 0
        self._order()

    def _order(self) -> None:
        """Postings by term, those of items that are easiest to reach first."""
        index = self.index
        need = np.maximum(self.score[:, -1], 1)[index.item]
        with np.errstate(divide="ignore"):
            reach = np.minimum(need / index.reached / 1_000_000, 0.999)       # share of a document's best damping
        order = np.lexsort((reach, index.term))
        self.by_term = index.item[order]
        # a little early, so that rounding opens a candidate rather than losing one
        self.keys = index.term[order] + np.maximum(reach[order] - 1e-7, 0.0)
        self.begin = np.searchsorted(index.term[order], np.arange(len(index.hashes) + 1))
        self.ordered_at = self.seen

    def add(self, texts: pa.Array, ids: np.ndarray, nameless: np.ndarray) -> None:
        index, width = self.index, max(len(self.index.hashes), 1)
        hashes, second, first = terms_of(texts)
        number = index.numbers(hashes, second)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        held = number >= 0
        pairs, tf = np.unique(row[held] * width + number[held], return_counts=True)
        if len(pairs):
            self._match(pairs, tf, np.diff(first), ids, nameless)
        self.seen += len(hashes)
        if self.seen - self.ordered_at >= min(self.ordered_at or 1, len(index.item)):
            self._order()

    def _match(self, pairs: np.ndarray, tf: np.ndarray, n: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        index, items = self.index, len(self.index.first) - 1
        row, term = np.divmod(pairs, max(len(index.hashes), 1))
        length = np.array([FLAT_SHARE + LENGTH_SHARE * x * index.documents // index.words for x in n.tolist()], np.int64)
        damped = SCALE * tf // (1000 * tf + 12 * length[row])
        start = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.maximum.reduceat(damped, start)[np.cumsum(np.diff(row, prepend=-1) > 0) - 1]
        begin = self.begin[term]
        upto = np.searchsorted(self.keys, term + np.minimum(best / 1_000_000, 0.9995), side="right")
        opened = np.maximum(upto - begin, 0)
        per_row = np.add.reduceat(opened, start)
        bounds = np.append(start, len(row))
        for a, b in steps(per_row, STEP_TERMS):
            part = slice(bounds[a], bounds[b])
            found = np.unique(np.repeat(row[part], opened[part]) * items + self.by_term[spread(begin[part], opened[part])])
            if len(found):
                self._score(*np.divmod(found, items), pairs, index.weight[term] * damped, ids, nameless)

    def _score(self, row: np.ndarray, item: np.ndarray, pairs: np.ndarray, worth: np.ndarray, ids: np.ndarray,
               nameless: np.ndarray) -> None:
        """Score candidates in full and keep those that enter a heap."""
        index, width = self.index, len(self.index.hashes)
        sizes = index.first[item + 1] - index.first[item]
        for a, b in steps(sizes, STEP_TERMS):
            size = sizes[a:b]
            posting = spread(index.first[item[a:b]], size)
            wanted = np.repeat(row[a:b], size) * width + index.term[posting]
            at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            part = np.where(pairs[at] == wanted, worth[at] * index.times[posting], 0)
            total = np.add.reduceat(part, np.cumsum(size) - size)
            good = total >= np.maximum(self.score[item[a:b], -1], 1)
            if good.any():
                r = row[a:b][good]
                self._keep(item[a:b][good], total[good], ids[r], nameless[r])

    def _keep(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, nameless: np.ndarray) -> None:
        touched = np.unique(item)
        k = self.k
        item = np.concatenate([np.repeat(touched, k), item])
        score = np.concatenate([self.score[touched].ravel(), score])
        doc = np.concatenate([self.doc[touched].ravel(), doc])
        nameless = np.concatenate([self.nameless[touched].ravel(), nameless])
        order = np.lexsort((doc, nameless, -score, item))
        first = np.searchsorted(item[order], touched)
        kept = order[(first[:, None] + np.arange(k)).ravel()]            # each item has k rows at least
        for heap, values in ((self.score, score), (self.doc, doc), (self.nameless, nameless)):
            heap[touched] = values[kept].reshape(-1, k)

    def rows(self) -> pa.RecordBatch:
        item, place = np.nonzero(self.score)
        return pa.RecordBatch.from_arrays([
            pa.array(item), pa.array(self.doc[item, place], mask=self.nameless[item, place]),
            pa.array(self.score[item, place])], ["item", "doc", "score"])


def growing(batch: pa.RecordBatch, done: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch; the first of a task are small, for its heaps are empty."""
    at = 0
    while at < batch.num_rows:
        rest = batch.slice(at)
        piece = next(pieces(rest, most=min(STEP_BYTES, max(FIRST_BYTES, done))))
        done += piece.column(0).nbytes
        at += piece.num_rows
        yield piece


def _counts(texts: DataFrame, index: Index) -> tuple[np.ndarray, int, int]:
    """(documents that hold each term, documents with terms, terms of all documents)."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = len(known.hashes)
        holding, documents, words = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            for piece in pieces(batch, most=STEP_BYTES):
                hashes, second, first = terms_of(piece.column(0))
                number, n = known.numbers(hashes, second), np.diff(first)
                held = number >= 0
                pair = np.unique(np.repeat(np.arange(len(n)), n)[held] * max(width, 1) + number[held])
                holding += np.bincount(pair % max(width, 1), minlength=width)[:width]
                documents, words = documents + int((n > 0).sum()), words + len(hashes)
        met = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, [-1, -2])), pa.array(np.append(holding[met], [documents, words]))],
                                         ["term", "n"])

    # one row per indexed term, and two
    rows = texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    totals = {r["term"]: r["n"] for r in rows}
    holding = np.zeros(len(index.hashes), np.int64)
    for term, n in totals.items():
        if term >= 0:
            holding[term] = n
    return holding, totals.get(-1, 0), totals.get(-2, 0)


def _best(docs: DataFrame, index: Index, k: int) -> DataFrame:
    """(item, doc, score): what the heaps of all tasks hold."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, done = Search(shared.value, k), 0
        for batch in batches:
            for piece in growing(batch, done):
                ids = piece.column(1)
                search.add(piece.column(0), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
                done += piece.column(0).nbytes
        yield search.rows()

    return docs.mapInArrow(stream, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", most: int = POSTINGS) -> DataFrame:
    """The ``k`` best rows of ``docs`` for every row of ``items``: item id, rank, document id, score.

    Equal scores go by ascending id, null last; rows that score 0 don't appear. Items and documents
    without terms (null or empty text) find and are found by nothing, and only documents with terms
    count in the statistics. Repeated rows of either table are rows of their own. ``id_col`` holds
    integers; other columns aren't read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = settled(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    # a term takes a byte and a separator at least, so half the bytes bound the terms
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shares = max(1, math.ceil(size / 2 / most))
    slim = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc")).coalesce(
        TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    found = []
    for share in range(shares):
        part = rows.filter(F.pmod(F.xxhash64("item"), F.lit(shares)) == share).select("item", "text").collect()
        index = Index.over([r["text"] for r in part])
        index.weigh(*_counts(slim.select("text"), index))
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(part)], "at long, name long")
        found.append(_best(slim, index, k).withColumnRenamed("item", "at").join(F.broadcast(names), "at")
                     .select(F.col("name").alias("item"), "doc", "score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    best = (reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))
    return best.join(rows.select("item", "item_id"), "item").select(
        F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
