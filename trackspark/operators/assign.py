"""One-to-one matching: frame links, ground-truth matching, optional matchings.

Spark partitions the work: candidate pairs come from the grid join, one group per frame
(or per connected component of the candidate graph), and a small NumPy kernel solves
each group. A group goes to a kernel if its cost matrix fits ``TASK_CELLS``; larger
frames are split into components, and a component that is still too large is solved by
an auction that runs as joins and aggregations over the whole cluster. All three give an
optimum of the same objective, so the route changes the cost of an answer, not the answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators.graph import connected_components
from trackspark.operators.grouped import TASK_CELLS, crowded, distances, picked, side_by_side, spread, whole_groups
from trackspark.operators.pricing import link_priced
from trackspark.operators.spatial import as_sources, link_candidates, next_frame, range_join
from trackspark.schema import DEFAULT_SCALE, MATCH_RADIUS_UM
from trackspark.session import cut_lineage, discard, is_empty

#: Weights of an auction are whole multiples of this: exact for float32 weights up to 1.
RESOLUTION = 2.0 ** -27
_WHOLE = "decimal(38,0)"


# -- kernels (plain NumPy, one group at a time) ---------------------------------

def cheapest_assignment(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Full assignment of the smaller side at least total cost.

    Rows start on their cheapest free column, which settles most of a frame. Rows left
    over first bid for a column by the margin to their second choice, and only those
    still without one are placed by shortest augmenting paths on reduced costs.
    """
    if cost.shape[0] > cost.shape[1]:
        cols, rows = cheapest_assignment(cost.T)
        order = np.argsort(rows, kind="stable")
        return rows[order], cols[order]
    n, m = cost.shape
    first = cost.argmin(axis=1) if m else np.zeros(0, int)
    row_price = cost[np.arange(n), first] if n else np.zeros(0)
    col_price = np.zeros(m)
    col_of = np.full(n, -1)
    row_of = np.full(m, -1)
    for r in range(n):
        if row_of[first[r]] < 0:
            row_of[first[r]], col_of[r] = r, first[r]
    waiting = np.flatnonzero(col_of < 0) if m > 1 else []
    for _ in range(4):
        outbid = []
        for r in waiting:
            reduced = cost[r] - col_price
            j = int(reduced.argmin())
            low = reduced[j]
            reduced[j] = np.inf
            second = reduced.min()
            if second <= low and row_of[j] >= 0:
                outbid.append(r)
                continue
            if row_of[j] >= 0:
                # Only a column that stays taken may change its price.
                col_price[j] -= second - low
                row_price[r] = second
                outbid.append(row_of[j])
                col_of[row_of[j]] = -1
            else:
                row_price[r] = low
            row_of[j], col_of[r] = r, j
        waiting = outbid
    # one set of arrays for all paths: a step is a few passes over a row, so allocation would cost as much
    through, nearer, outside = np.empty(m), np.empty(m, bool), np.empty(m, bool)
    for start in np.flatnonzero(col_of < 0):
        row_price[start] = (cost[start] - col_price).min()
        reach = cost[start] - row_price[start] - col_price
        via = np.full(m, start)
        outside.fill(True)
        open_reach = reach.copy()
        while True:
            j = int(open_reach.argmin())
            limit = reach[j]
            outside[j] = False
            open_reach[j] = np.inf
            r = row_of[j]
            if r < 0:
                break
            np.add(cost[r], limit, out=through)
            np.subtract(through, row_price[r], out=through)
            np.subtract(through, col_price, out=through)
            np.less(through, open_reach, out=nearer)
            np.logical_and(nearer, outside, out=nearer)
            np.copyto(reach, through, where=nearer)
            np.copyto(open_reach, through, where=nearer)
            via[nearer] = r
        settled = ~outside
        done = np.flatnonzero(settled)
        gain = limit - reach[done]
        owned = row_of[done] >= 0
        col_price[done] -= gain
        row_price[row_of[done[owned]]] += gain[owned]
        row_price[start] += limit
        while True:
            r = via[j]
            row_of[j], col_of[r], j = r, j, col_of[r]
            if r == start:
                break
    return np.arange(n), col_of


def pair_components(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number per candidate pair that pairs share if a chain of common ends joins them."""
    lu, li = np.unique(left, return_inverse=True)
    ru, ri = np.unique(right, return_inverse=True)
    ri = ri + len(lu)
    root = np.arange(len(lu) + len(ru))
    while True:
        a, b = root[li], root[ri]
        if np.array_equal(a, b):
            return a
        # hook the higher root below the lower one, then let every end point at its root
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up


def heaviest_matching(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the candidate pairs of greatest total weight, each end used once at most.

    Components of the candidates are solved one by one, so the largest cost matrix is that
    of a component, not of all ends.
    """
    if not len(left):
        return np.zeros(0, np.int64)
    part = pair_components(left, right)
    order = np.argsort(part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    chosen, plain = _undisputed(left, right, weight, part)
    open_ = ~plain[part[order[bounds[:-1]]]]
    for a, b in zip(bounds[:-1][open_], bounds[1:][open_]):
        own = order[a:b]
        chosen.append(own[_heaviest(left[own], right[own], weight[own])])
    chosen = np.concatenate(chosen)
    return np.sort(chosen[weight[chosen] > 0])


def _undisputed(left: np.ndarray, right: np.ndarray, weight: np.ndarray,
                part: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(pairs of the components that need no solving, a mark for each such component by its number).

    If all ends of one side have a best partner of their own, above zero and better than their second,
    these pairs are the only optimum: no other choice gives any of them as much.
    """
    plain, chosen = np.zeros(int(part.max()) + 1, bool), []
    for own, other in ((left, right), (right, left)):
        order = np.lexsort((-weight, own))
        mine, value = own[order], weight[order]
        first = np.append(True, mine[1:] != mine[:-1])
        tied = np.append(value[1:] == value[:-1], False) & first & ~np.append(first[1:], True)
        best = order[first]
        spoilt = np.zeros(len(plain), bool)
        spoilt[part[order[tied]]] = True
        spoilt[part[best[weight[best] <= 0]]] = True
        taken = best[np.argsort(other[best], kind="stable")]
        spoilt[part[taken[1:][other[taken[1:]] == other[taken[:-1]]]]] = True
        chosen.append(best[~spoilt[part[best]] & ~plain[part[best]]])
        plain[np.unique(part[best])] |= ~spoilt[np.unique(part[best])]
    return chosen, plain


def _heaviest(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    lu, li = np.unique(left, return_inverse=True)
    ru, ri = np.unique(right, return_inverse=True)
    index = np.full((len(lu), len(ru)), -1)
    index[li, ri] = np.arange(len(left))
    cost = np.zeros(index.shape)
    cost[li, ri] = -np.maximum(weight, 0.0)
    rows, cols = cheapest_assignment(cost)
    chosen = index[rows, cols]
    return chosen[chosen >= 0]


def fullest_matching(left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Among the matchings of greatest size, the one of greatest total weight."""
    bonus = 2.0 * (min(len(set(left)), len(set(right))) + 1) * max(1.0, float(np.abs(weight).max()))
    return heaviest_matching(left, right, weight + bonus)


# -- distribution --------------------------------------------------------------

def _oversized(pairs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    return (pairs.groupBy(*keys)
            .agg(F.count_distinct(left).alias("_nl"), F.count_distinct(right).alias("_nr"))
            .where(F.col("_nl").cast("double") * F.col("_nr") > TASK_CELLS).select(*keys))


def _split_groups(pairs: DataFrame, keys: list[str], left: str, right: str):
    """(pairs solvable per key, pairs solvable per component, pairs of huge components)."""
    big = _oversized(pairs, keys, left, right)
    if is_empty(big):
        return pairs, None, None
    big = cut_lineage(big, "oversized")
    small = pairs.join(big, keys, "left_anti")
    large = cut_lineage(pairs.join(big, keys, "left_semi"), "large")
    links = large.select(*keys, (F.col(left) * 2).alias("_a"), (F.col(right) * 2 + 1).alias("_b"))
    ends = links.select(*keys, F.explode(F.array("_a", "_b")).alias("_e")).distinct()
    parts = connected_components(ends, links, keys, "_e", "_a", "_b")
    tagged = cut_lineage(
        large.withColumn("_e", F.col(left) * 2).join(parts, [*keys, "_e"]).drop("_e"), "tagged")
    deep = [*keys, "component"]
    huge = _oversized(tagged, deep, left, right)
    if is_empty(huge):
        return small, tagged, None
    huge = cut_lineage(huge, "oversized")
    return (small, tagged.join(huge, deep, "left_anti"), tagged.join(huge, deep, "left_semi"))


def max_weight_matching(pairs: DataFrame, keys: list[str], left: str, right: str,
                        weight: str, fullest: bool = False) -> DataFrame:
    """Per key group, the pairs of greatest total weight with each end used at most once.

    With ``fullest`` the number of pairs comes first and their weight second. ``pairs`` must
    not repeat a (left, right) pair; all its columns come back.
    """
    pairs = cut_lineage(pairs if fullest else pairs.where(F.col(weight) > 0), "pairs")
    small, parts, huge = _split_groups(pairs, keys, left, right)
    best = fullest_matching if fullest else heaviest_matching

    def pick(l, r, w):
        return [(best(l, r, w.astype(float)), True)]

    out = picked(small, keys, [left, right, weight], pick)
    if parts is not None:
        solved = picked(parts, [*keys, "component"], [left, right, weight], pick)
        out = out.unionByName(solved.drop("component"))
    if huge is not None:
        out = out.unionByName(auction(huge.drop("component"), keys, left, right, weight, fullest))
    return out


def match_near(left: DataFrame, right: DataFrame, radius: float, keys: list[str], left_id: str, right_id: str,
               big: Callable) -> DataFrame:
    """One-to-one pairs within ``radius`` of least total distance per key group: keys, left_id, right_id, d.

    A row left alone costs ``big`` of the group's longest pair. Both sides carry ``zu, yu, xu``. A group whose
    distances fit a task is solved from its points, and its pairs are never written or exchanged; only
    the pairs of larger groups come from the grid join.
    """
    ends = [left.withColumnRenamed(left_id, "node_id"), right.withColumnRenamed(right_id, "node_id")]
    kinds = dict(left.dtypes)[left_id], dict(right.dtypes)[right_id]

    def solve(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        d = distances(a[1:], b[1:])
        l, r = np.nonzero(d <= radius)
        d = d[l, r]
        weight = big(d.max()) - d if len(d) else d
        l, r, d, weight = (x[weight > 0] for x in (l, r, d, weight))
        best = heaviest_matching(a[0][l], b[0][r], weight)
        return [a[0][l[best]], b[0][r[best]], d[best]]

    def solved(sides):
        return side_by_side(*sides, keys, ["node_id", "zu", "yu", "xu"],
                            f"{left_id} {kinds[0]}, {right_id} {kinds[1]}, d double", solve)

    large = crowded(*ends, keys, TASK_CELLS)
    if large is None:
        return solved(ends)
    pairs = cut_lineage(range_join(*[s.join(large, keys, "left_semi") for s in (left, right)], radius, keys)
                        .select(*keys, left_id, right_id, "d"), "near")
    tops = pairs.groupBy(*keys).agg(F.max("d").alias("_top"))
    weighted = pairs.join(tops, keys).withColumn("_w", big(F.col("_top")) - F.col("d")).drop("_top")
    rest = max_weight_matching(weighted, keys, left_id, right_id, "_w").drop("_w")
    return solved([s.join(large, keys, "left_anti") for s in ends]).unionByName(rest)


def _offers(pairs: DataFrame, keys: list[str], left: str, right: str, worth: Column) -> DataFrame:
    """The graph whose complete matchings are the matchings of ``pairs``: keys, p, o, worth.

    Bidders are the lefts and a mirror of every right, objects the rights and a mirror of every
    left. An end that stays alone takes its own mirror at no worth, and the mirrors of a
    matched pair take each other.
    """
    base = pairs.select(*keys, (F.col(left) * 2).alias("_l"), (F.col(right) * 2).alias("_r"), worth.alias("_w"))
    zero = F.lit(0).cast(_WHOLE)
    crossed = base.select(*keys, F.explode(F.array(
        F.struct(F.col("_l").alias("p"), F.col("_r").alias("o"), F.col("_w").alias("worth")),
        F.struct((F.col("_r") + 1).alias("p"), (F.col("_l") + 1).alias("o"), zero.alias("worth")))).alias("_e"))
    lone = (base.select(*keys, F.explode(F.array(
        F.struct(F.col("_l").alias("p"), (F.col("_l") + 1).alias("o"), zero.alias("worth")),
        F.struct((F.col("_r") + 1).alias("p"), F.col("_r").alias("o"), zero.alias("worth")))).alias("_e")).distinct())
    return crossed.unionByName(lone).select(*keys, "_e.*")


def auction(pairs: DataFrame, keys: list[str], left: str, right: str, weight: str,
            fullest: bool = False, resolution: float | None = None) -> DataFrame:
    """The same matching for groups too large for one task.

    Bidders raise the price of their best object by the margin to their second choice plus a
    step; an object goes to its highest bid. Everybody ends up with an object, so prices may
    be carried over while the step falls from half the largest worth by a factor of six a
    phase: ties cost a few rounds a phase instead of one per unit of price. Worths are whole
    numbers times one more than the number of bidders, so the last step of 1 makes the result
    optimal. Weights count in multiples of ``resolution`` (by default RESOLUTION).
    """
    resolution = resolution or RESOLUTION
    pairs = cut_lineage(pairs, "auction")
    ends = pairs.groupBy(*keys).agg((F.count_distinct(left) + F.count_distinct(right)).alias("n"))
    top = ends.agg(F.max("n")).first()[0]
    if not top:
        return pairs
    units = F.rint(F.col(weight) / F.lit(resolution)).cast(_WHOLE)
    most = int(pairs.agg(F.max(F.abs(units))).first()[0])
    first = (most + 1) * (top + 1) if fullest else 0
    worth = ((units + F.lit(str(first)).cast(_WHOLE)).cast(_WHOLE) * F.lit(top + 1).cast("decimal(12,0)")).cast(_WHOLE)
    offers = cut_lineage(_offers(pairs, keys, left, right, worth), "offers")
    lots = cut_lineage(offers.select(*keys, "o").distinct().withColumns({
        "price": F.lit(0).cast(_WHOLE), "owner": F.lit(None).cast("bigint")}), "lots")
    everyone = cut_lineage(offers.select(*keys, "p").distinct(), "everyone")
    rank = Window.partitionBy(*keys, "p").orderBy(F.col("value").desc(), "o")
    step = max(1, (most + first) * (top + 1) // 2)
    while True:
        bidders, mine = everyone, None
        lots = lots.withColumn("owner", F.lit(None).cast("bigint"))
        while True:
            choice = (offers.join(bidders, [*keys, "p"], "left_semi").join(lots.select(*keys, "o", "price"), [*keys, "o"])
                      .withColumn("value", (F.col("worth") - F.col("price")).cast(_WHOLE))
                      .withColumn("_r", F.row_number().over(rank)).where("_r <= 2")
                      .groupBy(*keys, "p").agg(
                          F.max(F.when(F.col("_r") == 1, F.struct("o", "price", "value"))).alias("_b"),
                          F.max(F.when(F.col("_r") == 2, F.col("value"))).alias("_second"))
                      .select(*keys, "p", F.col("_b.o").alias("o"),
                              (F.col("_b.price") + F.col("_b.value") - F.col("_second")
                               + F.lit(str(step)).cast(_WHOLE)).cast(_WHOLE).alias("bid")))
            choice = cut_lineage(choice, "bids")
            won = choice.groupBy(*keys, "o").agg(F.max(F.struct("bid", "p")).alias("_w"))
            after = cut_lineage(
                lots.join(won, [*keys, "o"], "left")
                .select(*keys, "o", F.coalesce("_w.bid", "price").alias("price"),
                        F.coalesce("_w.p", "owner").alias("owner"),
                        F.when(F.col("_w").isNotNull(), F.col("owner")).alias("ousted")), "lots")
            lost = choice.select(*keys, "p").join(
                after.select(*keys, F.col("owner").alias("p")), [*keys, "p"], "left_anti")
            again = cut_lineage(lost.unionByName(
                after.where("ousted IS NOT NULL").select(*keys, F.col("ousted").alias("p"))), "bidders")
            discard(choice, mine, bidders if bidders is not everyone else None)
            bidders, mine, lots = again, after, after.drop("ousted")
            if is_empty(bidders):
                break
        if step == 1:
            break
        step = max(1, step // 6)
    # a left is even, and so is the right it owns (its own mirror is odd)
    owned = lots.where("owner % 2 = 0 AND o % 2 = 0").select(
        *keys, F.shiftright("owner", 1).alias(left), F.shiftright("o", 1).alias(right))
    return pairs.join(owned, [*keys, left, right], "left_semi")


# -- ground-truth matching -------------------------------------------------------

def match_candidates(pred: DataFrame, gt: DataFrame, radius: float = MATCH_RADIUS_UM,
                     scale=DEFAULT_SCALE, carry: tuple = ()) -> DataFrame:
    """Pairs within ``radius`` in the frames both graphs have: dataset, t, gt_id, pred_id, d, w.

    The columns ``carry`` of ``pred`` come along.
    """
    a = with_um(gt, scale).select("dataset", "t", F.col("node_id").alias("gt_id"), "zu", "yu", "xu")
    b = with_um(pred, scale).select("dataset", "t", F.col("node_id").alias("pred_id"), "zu", "yu", "xu", *carry)
    near = range_join(a, b, radius, ["dataset", "t"])
    return near.select("dataset", "t", "gt_id", "pred_id", "d", *carry,
                       (F.lit(1.0) / (F.lit(1.0) + F.col("d"))).cast("float").cast("double").alias("w"))


def _matched_extent(pairs: DataFrame, pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame the size of the smaller side that a full matching would have to cover.

    Either side counts its nodes up to the last one (in id order) that has a candidate.
    """
    last = pairs.groupBy(*keys).agg(F.max("gt_id").alias("_g"), F.max("pred_id").alias("_p"))
    rows = gt.join(last, keys).where("node_id <= _g").groupBy(*keys).agg(F.count(F.lit(1)).alias("_ng"))
    cols = pred.join(last, keys).where("node_id <= _p").groupBy(*keys).agg(F.count(F.lit(1)).alias("_np"))
    return rows.join(cols, keys).select(*keys, F.least("_ng", "_np").alias("_cover"))


def match_nodes(pred: DataFrame, gt: DataFrame, radius: float = MATCH_RADIUS_UM,
                scale=DEFAULT_SCALE) -> DataFrame:
    """One-to-one matching of predicted and true nodes per frame: dataset, t, pred_id, gt_id, d.

    If the smaller side of a frame can be matched completely, the complete matching of
    greatest Σ 1/(1+d) is taken; otherwise the matching of greatest Σ (1 + 1/(1+d)).
    """
    return match_pairs(match_candidates(pred, gt, radius, scale), pred, gt, ["dataset", "t"])


def match_pairs(pairs: DataFrame, pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """The same from candidate ``pairs``, for groups of any ``keys`` that all three tables carry."""
    pairs = cut_lineage(pairs, "candidates")
    pairs = cut_lineage(pairs.join(_matched_extent(pairs, pred, gt, keys), keys), "candidates")
    small, parts, huge = _split_groups(pairs, keys, "gt_id", "pred_id")
    ends = ["gt_id", "pred_id", "w"]

    def both(l, r, w):
        return fullest_matching(l, r, w), heaviest_matching(l, r, w + 1.0)

    def pick_frame(l, r, w, cover):
        full = fullest_matching(l, r, w)
        complete = len(full) == cover[0]
        return [(full if complete else heaviest_matching(l, r, w + 1.0), complete)]

    out = picked(small, keys, [*ends, "_cover"], pick_frame, "_full")
    if parts is not None:
        # A frame is complete only if its components are; solve both ways, then choose.
        solved = picked(parts, [*keys, "component"], ends,
                        lambda l, r, w: list(zip(both(l, r, w), (True, False))), "_full").drop("component")
        if huge is not None:
            rest = huge.drop("component").withColumn("_w1", F.col("w") + 1.0)
            for full in (True, False):
                won = auction(rest, keys, "gt_id", "pred_id", "w" if full else "_w1", full)
                solved = solved.unionByName(won.drop("_w1").withColumn("_full", F.lit(full)))
        solved = cut_lineage(solved, "solved")
        complete = (solved.where("_full").groupBy(*keys)
                    .agg(F.count(F.lit(1)).alias("_n"), F.max("_cover").alias("_c"))
                    .select(*keys, (F.col("_n") == F.col("_c")).alias("_complete")))
        chosen = (solved.join(complete, keys).where(F.col("_full") == F.col("_complete"))
                  .drop("_complete"))
        out = out.unionByName(chosen)
    return out.select(*keys, "pred_id", "gt_id", "d")


# -- frame-to-frame links --------------------------------------------------------

def link_optimal(nodes: DataFrame, radius: float, mode: str = "full") -> DataFrame:
    """Optimal one-to-one links of consecutive frames: dataset, t, source_id, target_id, d.

    ``nodes`` carries ``zu, yu, xu``. The mode is the caller's and holds for every frame:

    * full: the smaller frame is assigned as a whole at least total distance, far pairs
      included, and links longer than ``radius`` are dropped afterwards. A frame pair is one
      group with its cost matrix, so this mode is for frames that fit a task.
    * priced: the same optimum from near pairs only, more of them added where the dual prices of
      the solution call for it (``pricing.link_priced``). For frames of any size.
    * gated: only pairs within ``radius`` count; as many links as possible, and among those
      the least total distance. Solved by components of the candidates at any size.
    """
    if mode == "gated":
        pairs = link_candidates(nodes, radius).withColumn("_w", F.lit(float(radius)) - F.col("d"))
        found = max_weight_matching(pairs, ["dataset", "t"], "source_id", "target_id", "_w", fullest=True)
        return found.select("dataset", "t", "source_id", "target_id", "d")
    if mode == "priced":
        return link_priced(nodes, radius)
    if mode != "full":
        raise ValueError(f"mode {mode!r}: full, priced or gated")
    # Each node takes part in two frame pairs, once per side.
    sides = nodes.select("dataset", "node_id", "zu", "yu", "xu", F.explode(F.array(
        F.struct(F.col("t").alias("t"), F.lit(0).alias("side")),
        F.struct((F.col("t") - 1).alias("t"), F.lit(1).alias("side")))).alias("_s")) \
        .select("dataset", "_s.t", "_s.side", "node_id", "zu", "yu", "xu")
    schema = "dataset string, t bigint, source_id bigint, target_id bigint, d double"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["dataset", "t"]):
            side, ids = (table.column(c).to_numpy() for c in ("side", "node_id"))
            where = np.stack([table.column(c).to_numpy() for c in ("zu", "yu", "xu")], 1)
            found = []
            for begin, end in zip(at[:-1], at[1:]):
                # sorted by side
                mid = begin + int(np.searchsorted(side[begin:end], 1))
                if mid in (begin, end):
                    continue
                p, q = where[begin:mid], where[mid:end]
                d = np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2))
                rows, cols = cheapest_assignment(d)
                keep = d[rows, cols] <= radius
                rows, cols = rows[keep], cols[keep]
                found.append((begin + rows, mid + cols, d[rows, cols]))
            if found:
                a, b, d = (np.concatenate(x) for x in zip(*found))
                frames = table.select(["dataset", "t"]).take(pa.array(a)).combine_chunks().to_batches()
                for f in frames:
                    yield pa.RecordBatch.from_arrays([*f.columns, pa.array(ids[a]), pa.array(ids[b]), pa.array(d)],
                                                     ["dataset", "t", "source_id", "target_id", "d"])

    return spread(sides, ["dataset", "t"], ["side", "node_id"]).mapInArrow(solve, schema)


def recall_at_budget(pred: DataFrame, gt: DataFrame, radius: float = MATCH_RADIUS_UM) -> DataFrame:
    """Share of true nodes that some prediction matches, per dataset."""
    hit = match_nodes(pred, gt, radius).groupBy("dataset").agg(F.count_distinct("gt_id").alias("_h"))
    total = gt.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    return total.join(hit, "dataset", "left").select(
        "dataset", (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("recall"))


__all__ = ["match_nodes", "link_optimal", "max_weight_matching", "auction", "as_sources", "next_frame"]
