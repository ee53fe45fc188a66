"""Toxic passages by maximum-scoring segments.

Every word carries a log-odds of toxicity, learned from labelled documents. The odds of a
word are smoothed towards those of its prefix, and so on down to the overall rate (a
Dirichlet prior with two categories at every step), so inflected or unseen words of a toxic
stem are scored by the stem. What a word's log-odds exceed their own standard error by counts,
in either direction; a constant ``drift`` is taken off every word, so that the mean over clean
text is negative and segments stay short, and what is left above zero counts for an n-th at the
n-th mention of the word in a text. One linear scan finds all maximal scoring segments of
a text; the extreme-value law of such scores in clean documents (rate from the distribution of
word scores, constant from the clean maxima) turns a segment's score into the number of equally
good segments expected by chance, and the significant segments of a document add up to its
evidence, which a logistic curve maps to 0..1.

Odds are learned from four fifths of the labelled sample; drift, law and curve from the rest,
whose words taught nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import BENCH_SEPARATORS, mixed, pieces, settled, utf8, word_bounds, word_hashes

PREFIXES = (7, 6, 5, 4, 3)
PRIOR = 4.0
#: Bound of what the classifier is fitted on, in labelled rows; one in ``FOLDS`` is for calibration.
SAMPLE_ROWS = 40_000
FOLDS = 5
#: What may be taken off every word; the calibration rows choose.
DRIFTS = (0.25, 0.5, 1.0)
#: A feature whose score is within this of the one its words would get without it isn't stored.
NEAR = 0.2
#: Standard errors that log-odds must exceed.
ERRORS = 2.0


def leveled_words(texts: pa.Array):
    """(first word per row, [hashes at each level]): whole words, then prefixes of PREFIXES.

    A word no longer than a prefix length has the hash of the level before it there.
    """
    data, offsets = utf8(texts)
    starts, ends, first = word_bounds(data, offsets, BENCH_SEPARATORS)
    levels = [word_hashes(data, starts, ends)]
    begins = (data & 0xC0) != 0x80
    chars = np.flatnonzero(begins)
    order = np.concatenate([[0], np.cumsum(begins)])
    last = len(chars) - 1
    for k in PREFIXES:
        long = order[ends] - order[starts] > k
        cut = np.where(long, chars[np.minimum(order[starts] + k, max(last, 0))] if len(chars) else 0, ends)
        h = mixed(word_hashes(data, starts, cut) ^ np.uint64(k))
        levels.append(np.where(long, h, levels[-1]))
    return first, levels


@dataclass
class Model:
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    drift: float = 0.5
    rate: float = 1.0                # of the extreme-value law
    constant: float = 1.0
    slope: float = 1.0               # of the logistic curve
    offset: float = -1.0

    def word_odds(self, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of every word, a number that equal words share)."""
        words, at, back = np.unique(levels[0], return_index=True, return_inverse=True)
        odds = np.zeros(len(words))
        open_ = np.ones(len(words), bool)
        if len(self.features):
            for level in levels:
                h = level[at]
                k = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                hit = open_ & (self.features[k] == h)
                odds[hit] = self.odds[k[hit]]
                open_ &= ~hit
        return odds[back], back.ravel()

    def word_scores(self, first: np.ndarray, odds: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Odds less the drift; what is above zero counts for an n-th at a text's n-th mention of the word."""
        scores = odds - self.drift
        marked = np.flatnonzero(scores > 0)
        key = np.stack([np.searchsorted(first, marked, side="right"), number[marked]])
        order = np.lexsort(key[::-1])
        same = np.zeros(len(marked), bool)
        same[1:] = (key[:, order[1:]] == key[:, order[:-1]]).all(0)
        run = np.arange(len(marked)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(marked))))
        scores[marked[order]] /= run + 1
        return scores

    def chance(self, score: float, words: int) -> float:
        """Segments of at least this score expected in so many clean words."""
        return self.constant * max(words, 1) * math.exp(-self.rate * score)

    def evidence(self, segments: list[tuple[int, int, float]], words: int) -> float:
        return sum(max(0.0, -math.log(max(self.chance(s, words), 1e-300))) for _, _, s in segments)

    def probability(self, evidence: float) -> float:
        x = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [from, to) with their scores, in order, in linear time.

    Only words above zero can start or grow a segment, so the scan steps from one such word
    to the next. Each candidate keeps the running total before it and at its end; a new one
    is merged leftwards into the latest candidate that starts from a lower total, if its own
    end is higher than that candidate's end.
    """
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []      # from, to, total before, total at end
    lower: list[int] = []                                # nearest earlier candidate with a lower start
    for i in np.flatnonzero(scores > 0).tolist():
        a, b, left, right = i, i + 1, totals[i], totals[i + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= right:
                break
            a, left = found[j][0], found[j][2]
            del found[j:], lower[j:]
        found.append((a, b, left, right))
        lower.append(j)
    return [(a, b, float(right - left)) for a, b, left, right in found]


def _per_text(model: Model, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"])):
        first, levels = leveled_words(piece.column(0))
        scores = model.word_scores(first, *model.word_odds(levels))
        positive = np.concatenate([[0], np.cumsum(scores > 0)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield b - a, segments(scores[a:b]) if positive[b] > positive[a] else []


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    """True where crc32 of the id as text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


_COUNTED = pa.schema([(c, pa.int64()) for c in ("feature", "parent", "level", "top", "toxic", "clean")])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the (text, toxic) rows of each label a word or prefix occurs, step by step."""
    for batch in batches:
        for piece in pieces(batch):
            first, levels = leveled_words(piece.column(0))
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            label = piece.column(1).to_numpy().astype(np.int64)
            top, levels = levels[-1], [*levels, np.zeros(len(row), np.uint64)]
            found = []
            for k, (level, below) in enumerate(zip(levels[:-1], levels[1:])):
                up = level != below
                found.append((level[up], below[up], np.full(up.sum(), k), top[up], row[up]))
            own, parent, level, tops, rows = (np.concatenate(x) for x in zip(*found))
            pairs = np.zeros(len(own), [("f", np.uint64), ("r", np.int64)])
            pairs["f"], pairs["r"] = own, rows
            _, at = np.unique(pairs, return_index=True)
            if not len(at):
                continue
            features, where, back = np.unique(own[at], return_index=True, return_inverse=True)
            toxic = np.bincount(back, weights=label[rows[at]] > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(features.view(np.int64)), pa.array(parent[at][where].view(np.int64)),
                pa.array(level[at][where]), pa.array(tops[at][where].view(np.int64)),
                pa.array(toxic), pa.array(np.bincount(back).astype(np.int64) - toxic)], schema=_COUNTED)


def smoothed(feature: np.ndarray, parent: np.ndarray, level: np.ndarray, toxic: np.ndarray, clean: np.ndarray,
             overall: float) -> tuple[np.ndarray, np.ndarray]:
    """(score, whether it is stored) of each feature; ``feature`` is sorted and holds its own parents.

    The share of toxic documents is smoothed towards the parent's share with weight ``PRIOR``; its
    log-odds over the overall rate, less ``ERRORS`` standard errors towards zero, are the
    score. Stored are scores that differ by more than ``NEAR`` from the nearest stored prefix's.
    """
    base = math.log(overall / (1 - overall))
    share, score, passed = np.full(len(feature), overall), np.zeros(len(feature)), np.zeros(len(feature))
    stored = np.zeros(len(feature), bool)
    for k in range(len(PREFIXES), -1, -1):
        own = np.flatnonzero(level == k)
        at = np.minimum(np.searchsorted(feature, parent[own]), max(len(feature) - 1, 0))
        known = feature[at] == parent[own]
        below, inherited = np.where(known, share[at], overall), np.where(known, passed[at], 0.0)
        t, c = toxic[own] + PRIOR * below, clean[own] + PRIOR * (1 - below)
        share[own] = t / (t + c)
        odds, error = np.log(t / c) - base, ERRORS * np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        score[own] = np.sign(odds) * np.maximum(np.abs(odds) - error, 0.0)
        stored[own] = np.abs(score[own] - inherited) > NEAR
        passed[own] = np.where(stored[own], score[own], inherited)
    return score, stored


def _lexicon(taught: DataFrame, overall: float) -> DataFrame:
    """(feature, score) of the stored words and prefixes of (text, toxic) rows.

    Words that share their shortest prefix are settled in one task, in packed arrays; the rows
    are those of the bounded sample.
    """
    kinds = "feature long, parent long, level long, top long, toxic long, clean long"
    counts = (taught.select("text", "toxic").mapInArrow(_count, kinds).groupBy("feature")
              .agg(*[F.min(c).alias(c) for c in ("parent", "level", "top")],
                   *[F.sum(c).alias(c) for c in ("toxic", "clean")]))

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), _COUNTED)
        columns = [whole.column(c).to_numpy() for c in ("feature", "parent", "level", "toxic", "clean")]
        order = np.argsort(columns[0])
        columns = [c[order] for c in columns]
        score, stored = smoothed(*columns, overall)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0][stored]), pa.array(score[stored])], ["feature", "score"])

    return counts.repartition("top").mapInArrow(smooth, "feature long, score double")


def _rate(tally: dict[float, int]) -> float:
    """The positive root of the mean of exp(rate * score) = 1 over clean words."""
    n = sum(tally.values())
    parts = [(s, c / n) for s, c in tally.items()]
    low, high = 1e-6, 1.0
    mean = lambda x: sum(p * math.exp(x * s) for s, p in parts) - 1
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a logistic curve with a weak ridge, by Newton steps, and its log-loss."""
    if y.min() == y.max():
        return 0.0, 4.0 if y[0] else -4.0, 0.0
    scale = max(float(x.max()), 1e-9)
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w, ridge = np.zeros(2), np.array([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (times * (p - y)) + ridge * w
        hess = (design * (times * p * (1 - p))[:, None]).T @ design + np.diag(ridge) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 8 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(w[0] / scale), float(w[1]), float(-(times * np.log(np.where(y > 0, p, 1 - p))).sum())


def labelled(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, calibrates): at most ``rows`` labelled ids outside the held-out fold, equal texts once.

    The ids of least hash, so the sample does not depend on partitioning; the bound makes it
    safe to broadcast. Which rows calibrate depends on the text alone, so copies stay on one side.
    """
    wanted = (labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col))
              .groupBy(id_col).agg(F.max("toxic").cast("long").alias("toxic"))
              .orderBy(F.xxhash64(id_col), id_col).limit(rows))
    texts = docs.select(id_col, F.lower(F.col(text_col)).alias("text")).filter("text is not null")
    key = F.xxhash64("text")
    return (texts.join(F.broadcast(settled(wanted, "wanted")), id_col).groupBy(key.alias("key"), "text")
            .agg(F.max("toxic").alias("toxic"))
            .select("text", "toxic", (F.pmod(F.xxhash64("key"), F.lit(FOLDS)) == 0).alias("calibrates")))


def _tally(models: list[Model]):
    """Per (text, toxic) row and drift: its words, its segments' scores, and counts of word scores in tenths."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                first, levels = leveled_words(piece.column(0))
                free = models[0].word_odds(levels)
                out: dict[str, list] = {"at": [], "toxic": [], "words": [], "found": [], "bins": []}
                for at, model in enumerate(models):
                    scores = model.word_scores(first, *free)
                    for a, b, toxic in zip(first[:-1].tolist(), first[1:].tolist(), piece.column(1).to_pylist()):
                        bins, times = np.unique(np.round(scores[a:b] * 10).astype(int), return_counts=True)
                        for name, value in zip(out, (at, int(toxic > 0), b - a, [s for *_, s in segments(scores[a:b])],
                                                     dict(zip(bins.tolist(), times.tolist())))):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["at"], pa.int64()), pa.array(out["toxic"], pa.int64()), pa.array(out["words"], pa.int64()),
                     pa.array(out["found"], pa.list_(pa.float64())),
                     pa.array([list(b.items()) for b in out["bins"]], pa.map_(pa.int64(), pa.int64()))], list(out))

    return tally


def _calibrated(rows: DataFrame, models: list[Model]) -> Model:
    """The model, of some that differ in their drift, that explains the calibration rows best."""
    seen = settled(rows.select("text", "toxic").mapInArrow(
        _tally(models), "at long, toxic long, words long, found array<double>, bins map<long,long>"), "tally")
    bins = (seen.filter("toxic = 0").select("at", F.explode("bins")).groupBy("at", "key").agg(F.sum("value").alias("n"))
            .collect())                                              # a few hundred tenths a drift
    best: tuple[float, Model] | None = None
    for at, model in enumerate(models):
        tally = {r["key"] / 10: r["n"] for r in bins if r["at"] == at} or {-model.drift: 1}
        if max(tally) <= 0:
            tally[1.0] = 1
        model = replace(model, rate=_rate(tally))
        mine = seen.filter(F.col("at") == at)
        top = F.coalesce(F.array_max("found"), F.lit(0.0))
        chance = mine.filter("toxic = 0").agg(F.count("*").alias("n"), F.sum(F.col("words") * F.exp(-model.rate * top)).alias("s")).first()
        model = replace(model, constant=max(chance["n"], 1) / max(chance["s"] or 0.0, 1.0))
        evidence = F.aggregate("found", F.lit(0.0), lambda e, s: e + F.greatest(
            F.lit(0.0), s * model.rate - F.log(F.lit(model.constant) * F.greatest("words", F.lit(1)))))
        points = mine.groupBy(F.round(evidence, 1).alias("x"), "toxic").count().collect()    # evidence in tenths
        if not points:
            return model
        x, y, n = (np.array([float(r[k]) for r in points]) for k in range(3))
        slope, offset, loss = _logistic(x, y, n)
        if best is None or loss < best[0]:
            best = loss, replace(model, slope=slope, offset=offset)
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """A model from at most ``sample_rows`` labelled documents outside the held-out fold.

    Null ids, labels and texts are skipped, an id with several labels is toxic if one of them says
    so, and of equal texts one counts. Without toxic labels every document scores low. If the
    calibration rows lack one of the labels, all rows calibrate.
    """
    sample = settled(labelled(docs, labels, sample_rows, id_col, text_col), "labelled")
    counted = {(r["calibrates"], r["toxic"] > 0): r["n"] for r in
               sample.groupBy("calibrates", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (sum(n for (_, y), n in counted.items() if y == x) for x in (True, False))
    if not toxic:
        return Model()
    taught, judged = sample.filter("not calibrates"), sample.filter("calibrates")
    if not all(counted.get((x, y)) for x in (True, False) for y in (True, False)):
        taught = judged = sample
    lexicon = _lexicon(taught, (toxic + 1) / (toxic + clean + 2)).toPandas()
    features, odds = lexicon["feature"].to_numpy(np.int64).view(np.uint64), lexicon["score"].to_numpy(np.float32)
    order = np.argsort(features)
    return _calibrated(judged, [Model(features[order], odds[order], drift) for drift in DRIFTS])


SCORED = "score double, passages array<struct<from_word:long,to_word:long,score:double,chance:double>>"


def scored(docs: DataFrame, model: Model, text_col: str = "text", most_chance: float = 1.0) -> DataFrame:
    """``docs`` with ``score`` and ``passages`` (significant segments, as word positions).

    Null and empty texts hold no words and get the score of no evidence; repeated rows score
    alike. Columns of ``docs`` with those two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "passages")

    @F.pandas_udf("score double, passages array<struct<from_word:long,to_word:long,score:double,chance:double>>")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in texts:
            rows = []
            for n, found in _per_text(m, pa.array(part, pa.string())):
                passages = [{"from_word": a, "to_word": b, "score": s, "chance": m.chance(s, n)} for a, b, s in found]
                rows.append((m.probability(m.evidence(found, n)),
                             [p for p in passages if p["chance"] <= most_chance]))
            yield pd.DataFrame(rows, columns=["score", "passages"])

    # not deterministic to the optimiser, else a filter on the score would read every text again
    return (docs.withColumn("_scored", read.asNondeterministic()(F.lower(F.col(text_col))))
            .select(*docs.columns, "_scored.score", "_scored.passages"))


def predicted(threshold: float = 0.5) -> F.Column:
    return (F.col("score") >= threshold).cast("int")
