"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item. A document's words are read
through it once; the state tells the longest run that ends at each word and is also in some
item. Where that run reaches ``window`` words (or is a whole shorter item), those words are
hit. Items are dealt to as many automata as keep each below ``AUTOMATON_WORDS``; each is
broadcast with that bound and read against all documents, and the spans are joined per text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.llm.common import BENCH_SEPARATORS, pieces, settled, utf8, word_bounds, word_hashes

WINDOW = 10
#: Most words in one automaton; bounds what is broadcast (about 100 bytes a word).
AUTOMATON_WORDS = 1_000_000


class SuffixAutomaton:
    """Suffix automaton of many word sequences, with the items that each state occurs in."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, words in items:
            state, path = 0, []
            for w in words:
                state = self._extend(state, w)
                path.append(state)
            ends.append(path)
        self.items: list[set[str]] = [set() for _ in self.length]
        whole: dict[int, set[tuple[int, str]]] = defaultdict(set)
        for (name, words), path in zip(items, ends):
            for state in path:
                while state > 0 and name not in self.items[state]:
                    self.items[state].add(name)
                    state = self.link[state]
            if 0 < len(words) < window:
                state = path[-1]
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                whole[state].add((len(words), name))
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.whole: list[tuple[tuple[int, str], ...]] = [()] * len(self.length)
        for state in order[1:]:
            own = tuple(sorted(whole.get(state, ())))
            self.whole[state] = own + self.whole[self.link[state]] if own else self.whole[self.link[state]]
        self.least = min([min(len(w), window) for _, w in items if w], default=window)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of state ``q`` that is no longer than ``p`` and ``w``, as a state of its own."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def longest(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known run that ends at each word."""
        state, length, edges, link, lengths = 0, 0, self.next, self.link, self.length
        for w in words:
            to = edges[state].get(w)
            while to is None and state:
                state = link[state]
                length = lengths[state]
                to = edges[state].get(w)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield state, length

    def read(self, words: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        """Adds the hit spans [from, to) of words that start at ``at``, and the items that hit."""
        window, link, lengths = self.window, self.link, self.length
        for i, (state, length) in enumerate(self.longest(words), at + 1):
            if length >= window:
                spans.append((i - window, i))
                for n, name in self.whole[state]:
                    found.add(name)
                while lengths[link[state]] >= window:
                    state = link[state]
                found |= self.items[state]
            elif self.whole[state]:
                for n, name in self.whole[state]:
                    if n <= length:
                        spans.append((i - n, i))
                        found.add(name)


class Matcher:
    """An automaton over word numbers and the vocabulary that gives them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        words, first = words_of(texts)[2:]
        self.vocabulary = np.unique(words)
        ids = np.searchsorted(self.vocabulary, words).tolist()
        self.automaton = SuffixAutomaton(
            [(name, ids[a:b]) for (name, _), a, b in zip(items, first[:-1], first[1:])], window)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def spans(self, numbers: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, set[str]]]:
        """Per text: merged hit spans as an (n, 2) array of word positions, and the items."""
        n = len(first) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        found: list[set[str]] = [set() for _ in range(n)]
        known = numbers >= 0
        if known.any():
            edge = np.zeros(len(known) + 1, bool)        # a run of known words also ends with its text
            edge[first] = True
            inner = np.zeros(len(known) + 1, bool)
            inner[1:-1] = known[1:] & known[:-1]
            inner &= ~edge
            starts = np.flatnonzero(known & ~inner[:-1])
            ends = np.flatnonzero(known & ~inner[1:]) + 1
            long = ends - starts >= self.automaton.least
            row = np.searchsorted(first, starts[long], side="right") - 1
            for r, a, b in zip(row.tolist(), starts[long].tolist(), ends[long].tolist()):
                self.automaton.read(numbers[a:b].tolist(), a - int(first[r]), spans[r], found[r])
        for s, f in zip(spans, found):
            yield merged(s), f


def merged(spans: list[tuple[int, int]]) -> np.ndarray:
    """Overlapping and touching spans joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def words_of(texts: pa.Array):
    """(byte starts, byte ends, hashes, first word per row) of lower-cased alphanumeric words."""
    data, offsets = utf8(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = word_bounds(data, offsets, BENCH_SEPARATORS)
    return starts, ends, word_hashes(data, starts, ends), first


def cut_out(text: str, spans: np.ndarray) -> str:
    """``text`` without the words of the spans (and what separates them)."""
    if not len(spans):
        return text
    starts, ends, _, _ = words_of(pa.array([text]))
    data, kept, at = text.encode(), [], 0
    for a, b in spans:
        kept.append(data[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "replace")


def item_shares(items: DataFrame, item_col: str, text_col: str, most: int = AUTOMATON_WORDS) -> list[DataFrame]:
    """The items in shares of bounded size; items without an id go by the name 'null'."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    # a word takes a byte and a separator at least, so half the bytes bound the words
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n = max(1, math.ceil(size / 2 / most))
    return [rows] if n == 1 else [
        rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


SPANS = "n_words long, spans array<array<long>>, items array<string>"


def _reader(shared: Broadcast, cut: bool):
    """The column function that reads texts through one broadcast matcher.

    With ``cut`` it also returns the text without its hits, in the same worker.
    """
    fields = SPANS.split(", ") + ["clean string"] * cut
    names = [f.split()[0] for f in fields]

    @F.pandas_udf(f"struct<{','.join(':'.join(c.split(' ', 1)) for c in fields)}>")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = shared.value
        for part in texts:
            rows = []
            for piece in pieces(pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])):
                _, _, words, first = words_of(piece.column(0))
                found = matcher.spans(matcher.numbers(words), first)
                for i, (n, (spans, items)) in enumerate(zip(np.diff(first), found)):
                    row = (int(n), spans.tolist(), sorted(items))
                    rows.append((*row, cut_out(piece.column(0)[i].as_py(), spans) if len(spans) else None)
                                if cut else row)
            yield pd.DataFrame(rows, columns=names)

    return read.asNondeterministic()         # else a filter on its result would read every text again


@F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
def joined(spans: pd.Series) -> pd.Series:
    return pd.Series([merged([tuple(x) for x in s]).tolist() for s in spans])


@F.pandas_udf(T.StringType())
def cut_texts(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or not len(s) else cut_out(t, np.array([list(x) for x in s]))
                      for t, s in zip(texts, spans)])


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", most: int = AUTOMATON_WORDS,
         cut: bool = False) -> DataFrame:
    """Every row of ``docs`` with n_words, hit spans (word positions) and the items that hit.

    With ``cut`` also ``clean``: the text without its hits, null where it has none.

    Null and empty texts have no words and no hits; an empty item table hits nothing; repeated
    rows are judged alike. Columns of ``docs`` with those three names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "spans", "items", "clean")
    found: list[DataFrame] = []
    shares = item_shares(items, item_col, item_text_col, most)
    for share in shares:
        shared = spark.sparkContext.broadcast(Matcher([(r["item"], r["text"]) for r in share.collect()], window))
        found.append(docs.withColumn("_hit", _reader(shared, cut and len(shares) == 1)(F.col(text_col))))
    if len(found) == 1:
        return found[0].select(*docs.columns, "_hit.*")

    # Several automata: keep what each found, join it by text, and go over the texts once more.
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    parts = [settled(f.withColumn("_key", key).filter(F.size("_hit.spans") > 0)
                     .select("_key", "_hit.*").dropDuplicates(["_key"]), "hits") for f in found]

    all_hits = (reduce(DataFrame.unionByName, parts).groupBy("_key")
                .agg(F.flatten(F.collect_list("spans")).alias("spans"),
                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
                .withColumn("spans", joined("spans")))
    counted = found[0].withColumn("_key", key).withColumn("n_words", F.col("_hit.n_words")).drop("_hit")
    joined_hits = counted.join(all_hits, "_key", "left").select(
        *docs.columns, "n_words", F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    if not cut:
        return joined_hits
    return joined_hits.withColumn("clean", F.when(F.size("spans") > 0, cut_texts(text_col, "spans")))


def coverage() -> F.Column:
    """Words inside hit spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_covered: float = 0.5,
                   text_col: str = "text", **names: str) -> DataFrame:
    """``docs`` with the hit spans cut out of their texts.

    A document of whose words more than ``most_covered`` are hit goes as a whole; one
    without hits comes back unchanged.
    """
    whole = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))
    marked = hits(whole, items, window, "_text", cut=True, **names)
    kept = marked.filter(coverage() <= most_covered * F.col("n_words"))
    text = F.coalesce("clean", "_text")
    return kept.select(*[text.alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def digest_of_items() -> F.Column:
    return F.sha2(F.concat_ws(",", "items"), 256)


