"""Byte-level BPE over overlapping chunks.

Long texts are cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``. Every
chunk is pre-tokenised from its own first character, wherever that falls. The pre-token
pattern never looks back, so once two neighbouring chunks share one boundary inside their
overlap they agree from there on: the earlier chunk owns the pre-tokens before that
boundary, the later one those after it. A boundary within ``MARGIN`` characters of a
chunk's end is not trusted, because the pattern may still be reading. If an overlap holds
no shared boundary (one pre-token longer than the overlap), the two chunks are joined and
read again from the last boundary that is certain. Decoding concatenates the bytes of the ids.

Texts of one chunk never leave their task; only the chunks of longer texts are exchanged,
by chunk for encoding and by text for stitching.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import settled

CHUNK = 1 << 15
OVERLAP = 512
MARGIN = 4
#: Distinct pre-tokens whose ids a task remembers (and the length up to which it does).
MEMORY, MEMORY_CHARS = 100_000, 48


class Codec:
    """Ids of single pre-tokens, and bytes of ids."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.match = regex.compile(pattern).findall
        # only its merges are used, on pieces that are matched here: a plain pattern keeps it small
        self.one = tiktoken.Encoding("byte_bpe", pat_str=".", mergeable_ranks=ranks,
                                     special_tokens={})._encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.known: dict[str, list[int]] = {}

    def ids(self, parts: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        known, out = self.known, []
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = self.one(part.encode("utf-8", "replace"))
                if len(part) <= MEMORY_CHARS:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[part] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> np.ndarray:
        return flat(self.ids(self.match(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()])


def flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter((i for part in ids for i in part), "<u4")


@lru_cache(maxsize=1)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


@contextmanager
def lent(rank_file: str, pattern: str) -> Iterator[Codec]:
    """The codec for one partition; after it the worker, which later stages use again, forgets it."""
    try:
        yield codec(rank_file, pattern)
    finally:
        codec.cache_clear()


def encoded_chunk(c: Codec, text: str, start: int, last: bool) -> tuple[bytes, bytes, bytes]:
    """(ids, boundaries, ids before each boundary) of one chunk, boundaries as text positions.

    The end of a chunk that is not the last is a boundary only where it is certain.
    """
    parts = c.match(text)
    ids = c.ids(parts)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    counts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
    if not last:
        sure = ends <= len(text) - MARGIN
        ends, counts = ends[sure], counts[sure]
    return flat(ids)[:counts[-1]].tobytes(), (ends + start).tobytes(), counts.tobytes()


def stitched(c: Codec, chunks: list[tuple[str, int, bytes, bytes, bytes]]) -> Iterator[np.ndarray]:
    """The ids of a whole text, piece by piece, from its chunks in order."""
    begin = 0                                        # certain boundary up to which ids are out
    text, start, ids, ends, counts = chunks[0]
    ids, ends, counts = (np.frombuffer(ids, "<u4"), np.frombuffer(ends, np.int64), np.frombuffer(counts, np.int64))
    for next_text, next_start, *rest in chunks[1:]:
        n_ids, n_ends, n_counts = (np.frombuffer(b, t) for b, t in zip(rest, ("<u4", np.int64, np.int64)))
        low = max(next_start, begin)
        shared = np.intersect1d(ends[ends >= low], n_ends[n_ends >= low], assume_unique=True)
        if len(shared):
            meet = int(shared[0])
            a, b = counts[np.searchsorted(ends, begin)], counts[np.searchsorted(ends, meet)]
            yield ids[a:b]
            begin, text, start = meet, next_text, next_start
            ids, ends, counts = n_ids, n_ends, n_counts
        else:                                        # read both chunks again as one
            text = text[begin - start:] + next_text[start + len(text) - next_start:]
            start = begin
            last = next_text is chunks[-1][0]
            ids, ends, counts = (np.frombuffer(b, t) for b, t in zip(
                encoded_chunk(c, text, start, last), ("<u4", np.int64, np.int64)))
    yield ids[counts[np.searchsorted(ends, begin)]:]


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
           fold: Callable[[Codec, Iterator[np.ndarray]], tuple] | None = None,
           returns: str = "ids binary", as_name: str = "encoded") -> DataFrame:
    """``docs`` with a struct column of what ``fold`` makes of the ids of each whole text.

    Without ``fold`` the struct holds the ids as little-endian unsigned 32-bit integers.
    Null reads as the empty text, which has no ids. Repeated rows stay repeated rows. All
    other columns are kept; one named like ``as_name`` is replaced. ``rank_file`` must be
    readable on every executor.
    """
    fold = fold or (lambda c, parts: (b"".join(p.tobytes() for p in parts),))
    spark = docs.sparkSession
    names = [f.split()[0] for f in returns.split(",")]
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.drop(as_name)
    short, long = docs.filter(size <= CHUNK), docs.filter(size > CHUNK)

    @F.pandas_udf(f"struct<{','.join(':'.join(f.split()) for f in returns.split(','))}>")
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with lent(rank_file, pattern) as c:
            for part in texts:
                yield pd.DataFrame([fold(c, iter([c.encode(t or "")])) for t in part], columns=names)

    # written once: both sides of the join below must see the same numbers, also after a lost executor
    rows = settled(long.withColumn("_row", F.monotonically_increasing_id()), "long_texts")
    cut_schema = "row long, at int, start long, last boolean, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                starts = range(0, max(1, len(text) - OVERLAP), CHUNK)
                yield pa.RecordBatch.from_pydict({
                    "row": [row] * len(starts), "at": pa.array(range(len(starts)), pa.int32()),
                    "start": list(starts), "last": [s == starts[-1] for s in starts],
                    "text": [text[s:s + CHUNK + OVERLAP] if s != starts[-1] else text[s:] for s in starts]})

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent(rank_file, pattern) as c:
            for batch in batches:
                text, start, last = (batch.column(i).to_pylist() for i in (4, 2, 3))
                done = [encoded_chunk(c, *x) for x in zip(text, start, last)]
                out = [batch.column(i) for i in (0, 1, 2, 4)] + [pa.array(x, pa.binary()) for x in zip(*done)]
                yield pa.RecordBatch.from_arrays(out, ["row", "at", "start", "text", "ids", "ends", "counts"])

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(rank_file, pattern)
        pdf = pdf.sort_values("at")
        parts = list(zip(pdf.text, pdf.start, pdf.ids, pdf.ends, pdf.counts))
        return pd.DataFrame([(pdf.row.iloc[0], *fold(c, stitched(c, parts)))], columns=["row", *names])

    done = (rows.select("_row", text_col).mapInArrow(cut, cut_schema)
            .repartition("row", "at")
            .mapInArrow(chunks, "row long, at int, start long, text string, ids binary, ends binary, counts binary")
            .groupBy("row").applyInPandas(stitch, f"row long, {returns}")
            .select(F.col("row").alias("_done"), F.struct(*names).alias(as_name)))
    whole_rows = short.withColumn(as_name, whole(F.col(text_col)))
    long_rows = rows.join(done, F.col("_row") == F.col("_done")).select(*docs.columns, as_name)
    return whole_rows.select(*docs.columns, as_name).unionByName(long_rows)


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids_col: str, as_name: str = "decoded") -> DataFrame:
    """Adds the bytes that a binary column of 32-bit ids stands for (null for null)."""

    @F.pandas_udf("binary")
    def bytes_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(rank_file, pattern)
        for part in parts:
            yield pd.Series([None if b is None else c.decode(np.frombuffer(b, "<u4")) for b in part])

    return encoded.withColumn(as_name, bytes_of(F.col(ids_col)))


def round_trip(c: Codec, parts: Iterator[np.ndarray]) -> tuple[int, str, str]:
    """(number of ids, digest of the ids, digest of the decoded bytes), in one reading."""
    n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for part in parts:
        n += len(part)
        ids.update(part.tobytes())
        decoded.update(c.decode(part))
    return n, ids.hexdigest(), decoded.hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def kept_with_digests(c: Codec, parts: Iterator[np.ndarray]) -> tuple[int, bytes, str, str]:
    """The ids themselves as well."""
    parts = list(parts)
    n, ids, decoded = round_trip(c, iter(parts))
    return n, b"".join(p.tobytes() for p in parts), ids, decoded


KEPT = "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
