"""Language identification by cross-parsing against suffix automata.

For every language, passages of labelled texts go into one suffix automaton over bytes, which
accepts exactly the runs of bytes that occur in them. A text is parsed against each language:
starting from the root, the automaton is followed as far as it goes (the longest match at that
place), which is one phrase; the next phrase starts at the byte that had no way on. Few, long
phrases mean that the text is made of what the language is made of: ``phrases * log2(training
bytes) / bytes`` estimates the cross entropy, and the language with the least of it wins.

Texts are lower-cased and everything that is no letter or mark becomes one space. Every text is
parsed as a whole, in blocks of ``BLOCK`` bytes that start phrases anew; the blocks of a step
advance side by side, one byte at a time, so the inner loop is a table lookup over an array.

The classifier is fitted on a bounded sample (``SAMPLE_ROWS`` rows a language, and of their
passages ``MODEL_BYTES`` over all languages); automata are built in executors, one language a
group, and their tables are what is broadcast.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.llm.common import pieces, settled, utf8

#: Bounds of the classifier: labelled rows of a language, bytes of training text of all languages.
SAMPLE_ROWS = 2_000
MODEL_BYTES = 1 << 18
#: Characters of a training passage.
PASSAGE = 256
#: Bytes that are parsed from one start, and bytes of one vectorised step.
BLOCK = 512
STEP_BYTES = 1 << 19

UNDECIDED = "und"


def letters(text: str | F.Column) -> F.Column:
    """The lower-cased letters and marks of a text with single spaces between; null reads as none."""
    text = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{M}]+", " "))


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """True where crc32 of the id as text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


class Automaton:
    """Suffix automaton of byte strings, with one row of ``width`` ways per state."""

    def __init__(self, passages: list[bytes]):
        seen = sorted(set(b"".join(passages)))
        self.width = len(seen) + 1                                  # the last column is for other bytes
        self.column = np.full(256, len(seen), np.int32)
        self.column[seen] = np.arange(len(seen))
        self.bytes = sum(map(len, passages))
        self._none = array("i", [-1]) * self.width
        self.ways, self.link, self.length = array("i", self._none), [-1], [0]
        for passage in passages:
            state = 0
            for c in self.column[np.frombuffer(passage, np.uint8)].tolist():
                state = self._after(state, c)

    def _state(self, ways: array, link: int, length: int) -> int:
        self.ways.extend(ways)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _redirect(self, state: int, c: int, old: int, new: int) -> int:
        """Point the way ``c`` of a state and its suffixes from ``old`` to ``new``; where that ends."""
        while state >= 0 and self.ways[state * self.width + c] == old:
            self.ways[state * self.width + c] = new
            state = self.link[state]
        return state

    def _own(self, state: int, c: int, to: int) -> int:
        """The state of exactly the runs of ``state`` followed by ``c``, split off if need be."""
        if self.length[to] == self.length[state] + 1:
            return to
        at = to * self.width
        copy = self._state(self.ways[at:at + self.width], self.link[to], self.length[state] + 1)
        self.link[to] = copy
        self._redirect(state, c, to, copy)
        return copy

    def _after(self, state: int, c: int) -> int:
        to = self.ways[state * self.width + c]
        if to >= 0:                                                 # the run is known from an earlier passage
            return self._own(state, c, to)
        new = self._state(self._none, 0, self.length[state] + 1)
        rest = self._redirect(state, c, -1, new)
        if rest >= 0:
            self.link[new] = self._own(rest, c, self.ways[rest * self.width + c])
        return new

    def table(self) -> np.ndarray:
        """Ways as offsets of rows; a negative entry ends the phrase, its complement is where the next one is.

        At the root every byte starts a phrase. A byte that starts no known run is a phrase of its own.
        """
        ways = np.frombuffer(self.ways, np.int32).reshape(-1, self.width) * np.int32(self.width)
        fresh = np.maximum(ways[0], 0)
        table = np.where(ways < 0, ~fresh, ways)
        table[0] = ~fresh
        return np.ascontiguousarray(table.ravel(), np.int32)


@dataclass
class Language:
    name: str
    column: np.ndarray
    table: np.ndarray
    bytes: int

    def phrases(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each block of ``text``; blocks come longest first."""
        codes = self.column[text]
        state, count = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        ends = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        for at, n in enumerate(ends.tolist()):                       # blocks longer than ``at``
            to = self.table[state[:n] + codes[starts[:n] + at]]
            over = to >> 31                                          # -1 where a phrase starts
            count[:n] -= over
            state[:n] = to ^ over
        return count


def entropies(languages: list[Language], texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each text, cross entropy of each text and language); texts are made by ``letters``."""
    data, offsets = utf8(texts)
    sizes = np.diff(offsets)
    blocks = -(-sizes // BLOCK)
    row = np.repeat(np.arange(len(sizes)), blocks)
    place = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = offsets[:-1][row] + place * BLOCK
    length = np.minimum(BLOCK, offsets[1:][row] - starts)
    order = np.argsort(-length, kind="stable")
    out = np.zeros((len(sizes), len(languages)))
    for k, language in enumerate(languages):
        found = language.phrases(data, starts[order], length[order])
        out[:, k] = np.bincount(row[order], weights=found, minlength=len(sizes)) * np.log2(max(language.bytes, 2))
    return sizes, out / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
           lang_col: str = "lang") -> DataFrame:
    """(lang, id, text): about ``rows`` labelled rows of each language outside the held-out fold, at most.

    A first pass counts the languages; the rows whose hash lies below the share their language
    may fill are kept, so a language with a third of all rows is thinned before anything is
    exchanged. Of equal texts of a language one counts.
    """
    usable = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    shares = usable.groupBy("lang").agg((F.lit(2.0 * rows) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = usable.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).drop("share")
    text = F.xxhash64(letters("text"))
    once = near.withColumn("key", text).dropDuplicates(["lang", "key"])
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("order"), "key"), "key")
    return once.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= rows).select("lang", "id", "text")


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, model_bytes: int = MODEL_BYTES, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> list[Language]:
    """One automaton per language that has a labelled text with letters outside the held-out fold.

    Rows without language or text teach nothing. The model's bytes are shared equally among the
    languages; each gets one passage at least. Which passages are taken follows from hashes
    of their text, so the model does not depend on partitioning.
    """
    passages = settled(
        sample(docs, rows, id_col, text_col, lang_col).select("lang", letters("text").alias("text"))
        .select("lang", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(PASSAGE))
                                     ).alias("_", "at"), "text")
        .select("lang", F.expr(f"substring(text, at + 1, {PASSAGE})").alias("passage")).filter("passage <> ''").distinct(),
        "passages")
    languages = passages.select("lang").distinct().count()
    share = model_bytes // max(languages, 1)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("passage"), "passage")
    size = F.sum(F.octet_length("passage")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = passages.withColumn("upto", size).filter(F.col("upto") - F.octet_length("passage") < share)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = Automaton([p.encode() for p in part["passage"]])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "col": [made.column.tobytes()],
                             "ways": [made.table().tobytes()], "bytes": [made.bytes]})

    tables = chosen.select("lang", "passage").groupBy("lang").applyInPandas(
        build, "lang string, col binary, ways binary, bytes long")
    return sorted((Language(r["lang"], np.frombuffer(r["col"], np.int32), np.frombuffer(r["ways"], np.int32), r["bytes"])
                   for r in tables.collect()), key=lambda x: x.name)


def identified(docs: DataFrame, languages: list[Language], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the margin of the best language over the next (0 to 1).

    A text without a letter (null, empty, digits) is ``und`` with score 0; so is every text if no
    language was learned. With a single language it is taken, with score 1. Ties go to
    the name that sorts first. Repeated rows come out alike; columns of ``docs`` with those two
    names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text_col])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        names = np.array([x.name for x in known] + [UNDECIDED], object)
        for batch in batches:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for part in pieces(pa.RecordBatch.from_arrays([batch], ["text"]), most=STEP_BYTES):
                sizes, bits = entropies(known, part.column(0))
                if known:
                    first = bits.argmin(1)
                    low = bits[np.arange(len(sizes)), first]
                    bits[np.arange(len(sizes)), first] = np.inf
                    # 1 - low / inf is 1: there is no other language
                    margin = 1 - low / np.maximum(bits.min(1), 1e-12)
                else:
                    first, margin = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
                nothing = sizes == 0
                best.append(np.where(nothing, len(known), first))
                score.append(np.where(nothing, 0.0, np.clip(margin, 0.0, 1.0)))
            yield pa.StructArray.from_arrays([pa.array(names[np.concatenate(best)], pa.string()),
                                              pa.array(np.concatenate(score))], ["lang_pred", "score"])

    text = letters(text_col)
    # marks alone are no letters
    text = F.when(text.rlike(r"\p{L}"), text).otherwise("")
    made = "_judged" + "_" * sum(c.startswith("_judged") for c in docs.columns)
    # not deterministic to the optimiser, else both fields would read the text
    return docs.withColumn(made, judge.asNondeterministic()(text)).select(
        *[F.col(f"`{c}`") for c in docs.columns], f"{made}.lang_pred", f"{made}.score")
