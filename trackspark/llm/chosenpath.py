"""Near-duplicate components by a chosen-path similarity join.

Every distinct shingle set walks down ``TREES`` independent trees; at each node it follows
the branch of its minwise token under that node's hash, so two sets of similarity J stay
together for d levels with probability J**d. Two levels are taken at once; a node that then
holds more than ``NODE`` sets branches further, level by level. Small nodes are compared
exhaustively on full sets; a node that is still large at ``DEPTH`` is compared in pairs of
blocks of bounded size. At J = 0.85 a pair misses all 24 trees with probability 4e-14 at two
levels and 1e-5 at six.

Sets that are equal are one set from the start, and a node reports a spanning forest
instead of its pairs. The first two trees join most of what belongs together; the others look
only at nodes that still hold different parts, and there only at sets that share their node in
several other trees with a set of another part, as linked sets do but for a chance of
``MISS``. So neither large groups of copies nor repeated trees multiply the work.
"""

from __future__ import annotations

from collections.abc import Iterator

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import (
    WHITE, components, keyed, mixed, pieces, range_hashes, settled, utf8, word_bounds, word_hashes,
)

TREES, FIRST_TREES, DEPTH, NODE = 24, 2, 6, 1024
MISS = 1e-7
_STEP = 0xA0761D6478BD642F                       # odd: base of the shingle polynomial
_DRAWS = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 64, (TREES, 2, 2), np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, words lower-cased in A-Z.

    Fewer words than ``width`` are one shingle as a whole; no words give the empty set.
    """
    data, offsets = utf8(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, first = word_bounds(data, offsets, WHITE)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    at = np.arange(len(words))
    last = np.repeat(first[1:], counts)
    begin = np.flatnonzero((at + width <= last) | (at == np.repeat(first[:-1], counts)))
    end = np.minimum(begin + width, last[begin])
    hashes = mixed(range_hashes(words, begin, end, _STEP) + (end - begin).astype(np.uint64))
    cuts = np.searchsorted(begin, first)
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _minima(hashes: np.ndarray, starts: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    return np.minimum.reduceat(hashes * a + b, starts)


def first_paths(sets: list[np.ndarray]) -> np.ndarray:
    """Per non-empty set and tree, the node it is in after two levels."""
    hashes = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), TREES), np.uint64)
    for t in range(TREES):
        one, two = (_minima(hashes, starts, *_DRAWS[t, level]) for level in (0, 1))
        out[:, t] = mixed(mixed(one ^ np.uint64(t)) + two)
    return out


def next_path(path: int, hashes: np.ndarray) -> int:
    """The child that a set follows from a node: its token of least hash under that node."""
    node = np.uint64(path % (1 << 64))
    low = np.min(mixed(hashes ^ node))
    return int(mixed(np.array([low + mixed(np.array([node]))[0]], np.uint64)).view(np.int64)[0])


def linked(a: int, b: int, common, share: int) -> bool:
    return 100 * common >= share * (a + b - common)


def least_agreement(share: int) -> int:
    """Trees in which linked sets share their two-level node at least, but for a chance of MISS."""
    p, below = (share / 100) ** 2, 0.0
    for k in range(TREES + 1):
        below += comb(TREES, k) * p ** k * (1 - p) ** (TREES - k)
        if below > MISS:
            return k
    return TREES


def sifted(nodes: np.ndarray, parts: np.ndarray, paths: np.ndarray, least: int) -> np.ndarray:
    """Which rows agree in ``least`` trees with a row of the same node and another part.

    Rows are ordered by node; the k-th pass compares all rows with their k-th successor.
    """
    keep = np.zeros(len(nodes), bool)
    at = np.arange(len(nodes))
    for k in range(1, len(nodes)):
        at = at[at + k < len(nodes)]
        at = at[nodes[at] == nodes[at + k]]
        if not len(at):
            break
        pair = at[parts[at] != parts[at + k]]
        pair = pair[(paths[pair] == paths[pair + k]).sum(1) >= least]
        keep[pair] = keep[pair + k] = True
    return keep


def forest(sets: list[np.ndarray], groups: list[int], share: int) -> list[tuple[int, int]]:
    """Pairs of positions, linked on full sets, that join all groups the node can join."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    for i, g in enumerate(groups):
        parent[i] = seen.setdefault(g, i)
    left = len(seen)
    if left < 2:
        return []
    size = np.array([len(s) for s in sets])
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    posting, starts = owner[order], np.searchsorted(flat[order], np.arange(len(tokens) + 1))
    several = np.diff(starts) > 1
    begins = np.concatenate([[0], np.cumsum(size)])
    out: list[tuple[int, int]] = []
    for i in range(len(sets)):
        if left < 2:
            break
        mine = flat[begins[i]:begins[i + 1]]
        mine = mine[several[mine]]
        if not len(mine):
            continue
        lens = starts[mine + 1] - starts[mine]
        spots = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        common = np.bincount(posting[spots], minlength=len(sets))
        for j in np.flatnonzero(linked(size[i], size, common, share)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                left -= 1
                out.append((i, j))
    return out


def stars(links: list[tuple[int, int]], ids: list[int]) -> list[tuple[int, int]]:
    """The same connections with the smallest id of each component in the middle."""
    low: dict[int, int] = {}

    def root(i: int) -> int:
        while low.get(i, i) != i:
            low[i] = low.get(low[i], low[i])
            i = low[i]
        return i

    for i, j in links:
        a, b = sorted((root(ids[i]), root(ids[j])))
        low[b] = a
    return [(i, root(i)) for i in low]


SIGNED = "doc_id long, doc_fp long, n long, s1 long, s2 long, paths array<long>"


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("doc_id", docs_type(docs)), ("doc_fp", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()),
                        ("s2", pa.int64()), ("paths", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(piece.column(2), width)
                full = [s for s in sets if len(s)]
                paths = iter(first_paths(full).view(np.int64)) if full else iter(())
                sums = [[int(x.sum(dtype=np.uint64).astype(np.int64)) for x in (s, mixed(s + np.uint64(1)))] for s in sets]
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), piece.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()),
                    pa.array([next(paths) if len(s) else [] for s in sets], pa.list_(pa.int64()))], schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sign, SIGNED.replace("doc_id long", f"doc_id {kind}"))


def docs_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(docs.schema["doc_id"].dataType)


def _crowded(nodes: DataFrame, label: str) -> DataFrame:
    """(tree, path, set_id, size) of the sets in nodes of two sets or more."""
    counts = settled(nodes.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), f"{label}-sizes")
    return settled(nodes.join(counts, "path").select("tree", "path", "set_id", "size"), label)


def _compared(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that join what belongs together in the nodes of ``members`` (node, set_id, part)."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set_id")
        found = forest([np.frombuffer(b, np.uint64) for b in pdf.shingles], pdf.part.tolist(), share)
        return pd.DataFrame(stars(found, pdf.set_id.tolist()), columns=["a", "b"]).astype("int64")

    return members.join(sets, "set_id").groupBy("node").applyInPandas(compare, "a long, b long")


def _sifted(members: DataFrame, paths: DataFrame, share: int) -> DataFrame:
    """The rows of ``members`` that may bring a link to another part of their node."""
    least = least_agreement(share)

    names = ["node", "set_id", "part"]

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            node, part = (table.column(c).to_numpy() for c in ("node", "part"))
            paths = table.column("paths").combine_chunks().flatten().to_numpy().reshape(-1, TREES)
            kept = table.select(names).filter(pa.array(sifted(node, part, paths, least)))
            return pa.RecordBatch.from_arrays([kept.column(c).combine_chunks() for c in names], names)

        for batch in batches:                            # the last node of a batch may go on in the next
            table = pa.Table.from_batches([*held, batch])
            node = table.column("node").to_numpy()
            whole = int(np.searchsorted(node, node[-1])) if len(node) else 0
            held = table.slice(whole).to_batches()
            if whole:
                yield out(table.slice(0, whole))
        if held:
            yield out(pa.Table.from_batches(held))

    # few bytes but much work, so the number of tasks is kept
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.join(paths, "set_id").select(*names, "paths").repartition(tasks, "node")
            .sortWithinPartitions("node").mapInArrow(sift, "node long, set_id long, part long"))


def _blocks(members: DataFrame) -> DataFrame:
    """Members with the node they are compared in: their own, or pairs of blocks of a large one."""
    n = F.ceil(F.col("size") / NODE).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.greatest(n, F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.xxhash64(
        "path", F.least(own, o), F.greatest(own, o)))
    return members.withColumn("node", F.explode(F.when(F.col("size") <= NODE, F.array("path")).otherwise(pairs)))


def near_duplicates(docs: DataFrame, share: int = 80, width: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, doc_fp, n_shingles, component_id, kept) for every row of ``docs``.

    Documents whose shingle sets satisfy 100 * intersection >= share * union are linked;
    ``component_id`` is the smallest id reachable, itself included. Null, empty and blank texts
    have no set and stay alone. Null ids take part but are nobody's smallest id; repeated rows
    come back as often as they came.
    """
    texts = keyed(docs, id_col, text_col)
    signed = settled(_signatures(texts, width), "signatures")
    sets = settled(
        signed.filter("n > 0").groupBy("s1", "s2", "n")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_fp", "doc_id")).alias("rep"),
             F.any_value("paths").alias("paths"))
        .withColumn("set_id", F.monotonically_increasing_id()), "sets")
    nodes = sets.select("set_id", F.posexplode("paths").alias("tree", "path"))
    members = _crowded(nodes, "members")

    wanted = members.select("set_id").distinct().join(sets.select("set_id", "rep.*"), "set_id")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array([s.tobytes() for s in shingle_sets(piece.column(1), width)], pa.binary())],
                    ["set_id", "shingles"])

    same = (F.col("t.doc_fp") == F.col("w.doc_fp")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    full = settled(texts.alias("t").join(wanted.alias("w"), same).select("w.set_id", "t.text")
                   .mapInArrow(shingle, "set_id long, shingles binary").dropDuplicates(["set_id"]), "shingles")

    # Nodes that are still too large branch on.
    small = [members.filter(F.col("size") <= NODE)]
    large = members.filter(F.col("size") > NODE)
    for depth in range(3, DEPTH + 1):
        if large.isEmpty():
            break

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = [next_path(p, np.frombuffer(b, np.uint64))
                         for p, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(paths, pa.int64()), batch.column(2)], ["tree", "path", "set_id"])

        deeper = _crowded(large.join(full, "set_id").select("tree", "path", "set_id", "shingles")
                          .mapInArrow(descend, "tree int, path long, set_id long"), "members")
        small.append(deeper.filter(F.col("size") <= NODE))
        large = deeper.filter(F.col("size") > NODE)
    small.append(large)
    every = small[0]
    for more in small[1:]:
        every = every.unionByName(more)
    every = _blocks(every)

    first = every.filter(F.col("tree") < FIRST_TREES).withColumn("part", F.col("set_id"))
    links = settled(_compared(first.select("node", "set_id", "part"), full, share), "links")
    # parts: what the first trees joined, as far as two steps to smaller ids tell
    step = links.groupBy(F.col("a").alias("set_id")).agg(F.min("b").alias("up"))
    again = step.select(F.col("set_id").alias("up"), F.col("up").alias("upper"))
    parts = settled(step.join(again, "up", "left").select("set_id", F.coalesce("upper", "up").alias("part")), "parts")

    rest = (every.filter(F.col("tree") >= FIRST_TREES).join(parts, "set_id", "left")
            .withColumn("part", F.coalesce("part", "set_id")))
    rest = settled(rest.select("node", "set_id", "part"), "rest")
    open_ = rest.groupBy("node").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    open_ = settled(open_.select("node"), "open")
    wide = settled(_sifted(rest.join(open_, "node"), sets.select("set_id", "paths"), share), "sifted", rest, open_, members)
    more = settled(_compared(wide, full, share), "links", full, wide)
    parts = settled(components(links.unionByName(more)).select(F.col("node").alias("set_id"), "component"),
                    "parts", links, more, parts)

    labelled = sets.join(parts, "set_id", "left").select(
        "s1", "s2", "n", "first_id", F.coalesce("component", "set_id").alias("component"))
    lowest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = settled(labelled.join(lowest, "component").select("s1", "s2", "n", "component_id"), "components", sets)
    out = signed.drop("paths").join(found, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "doc_fp", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, share: int = 80, width: int = 5, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate component (the one of smallest id), all columns kept."""
    found = near_duplicates(docs, share, width, id_col, text_col)
    kept = found.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("doc_fp").alias("_fp"),
                                       (F.col("n_shingles") > 0).alias("_has")).distinct()
    fp = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    marked = docs.withColumn("_doc_fp", fp).join(
        kept, (F.col("_doc_fp") == F.col("_fp")) & F.col(id_col).eqNullSafe(F.col("_kept_id")))
    once = marked.filter("_has").dropDuplicates(["_doc_fp", "_kept_id"])
    return once.unionByName(marked.filter("not _has")).select(*docs.columns)


