import random
import zlib

import numpy as np
from samples import prose

from trackspark.llm import toxicity as T


def brute_segments(scores):
    """Ruzzo and Tompa's definition, by recursion on the best segment (ties to the shortest, then leftmost)."""
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
               default=(0, 0, 0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = best[3:]
    return brute_segments(scores[:a]) + [(a, b, best[0])] + [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]


def test_segments_equal_the_definition():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.choice([-3, -2, -1, 1, 2, 5]) + r.random() / 7 for _ in range(r.randrange(14))]
        got = T.segments(np.array(scores))
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def corpus(n=600):
    r, texts, labels = random.Random(1), [], []
    for i in range(n):
        w = prose(i, 40 + i % 60).split()
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["vileword", "rudeness", "grim" + r.choice("abcdefgh") + "x"]))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    return texts, labels


def test_held_out_accuracy_and_stems(spark, documents):
    texts, labels = corpus()
    extra = ["so grimzz here grimqq", "", None, "entirely new words", "vileword " * 50 + prose(1, 30)]
    docs = documents(texts + extra)
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = T.scored(docs.drop("score"), model).withColumn("held", T.held_out()).withColumn("p", T.predicted()).collect()
    by = {r.doc_id: r for r in out}
    assert all(by[i].held == (zlib.crc32(str(i).encode()) % 5 == 0) for i in by)
    held = [(by[i].p, y) for i, y in labels if by[i].held]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    n = len(texts)
    assert by[n].score > by[n + 3].score and by[n + 4].p == 1
    assert by[n + 1].score == by[n + 2].score < 0.5 and by[n + 1].passages == []
    assert all(0 <= r.score <= 1 for r in out)
    spot = by[n + 4].passages[0]
    assert (spot.from_word, spot.to_word) == (0, 50)


def test_labels_that_teach_nothing(spark, documents):
    docs = documents(["a b", None])
    for labels in ([], [(0, None), (None, 1), (7, 1)], [(0, 0), (0, 0)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert all(r.score < 0.5 for r in T.scored(docs, model).collect())
    assert T.scored(documents([]), model).count() == 0


def test_several_mildly_toxic_words_and_balanced_labels(spark, documents):
    """No single word tells; half of the labels are toxic."""
    r, texts, labels = random.Random(8), [], []
    mild = [f"mild{c}x" for c in "abcdefghijkl"]
    for i in range(800):
        w, toxic = prose(i, 50).split(), i % 2
        for _ in range(8 if toxic else 2):
            w.insert(r.randrange(len(w)), r.choice(mild))
        texts.append(" ".join(w))
        labels.append((i, toxic))
    docs = documents(texts)
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.p for x in T.scored(docs.drop("score"), model).withColumn("p", T.predicted()).collect()}
    held = [got[i] == y for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) >= 0.85 * len(held)


def test_repeated_weak_words_add_up_slowly():
    model = T.Model(drift=0.5)
    odds = np.array([1.5, 1.5, -2.0, 1.5, 0.2, 1.5])
    got = model.word_scores(np.array([0, 4, 6]), odds, np.array([7, 7, 3, 7, 9, 7]))
    assert np.allclose(got, [1.0, 0.5, -2.5, 1 / 3, -0.3, 1.0])


def test_smoothing_equals_a_plain_recursion():
    r = random.Random(2)
    names = {i + 1: (r.choice([0, *range(1, i + 1)]) if i else 0) for i in range(60)}
    level = {0: 6}
    for f in sorted(names):
        level[f] = level[names[f]] - 1 if level[names[f]] else None
    rows = [(f, p, level[f], r.randrange(30), r.randrange(60)) for f, p in sorted(names.items())
            if level[f] is not None and level.get(p) is not None]
    kept = {f for f, *_ in rows}
    rows = [x for x in rows if x[1] == 0 or x[1] in kept]
    f, p, lv, t, c = (np.array(x) for x in zip(*rows))
    score, stored = T.smoothed(f, p, lv, t, c, 0.2)
    counts = {x[0]: x for x in rows}

    def share(g):
        if g not in counts:
            return 0.2
        _, up, _, toxic, clean = counts[g]
        return (toxic + T.PRIOR * share(up)) / (toxic + clean + T.PRIOR)

    def want(g):
        _, up, _, toxic, clean = counts[g]
        a, b = toxic + T.PRIOR * share(up), clean + T.PRIOR * (1 - share(up))
        odds = np.log(a / b) - np.log(0.25)
        return np.sign(odds) * max(0.0, abs(odds) - T.ERRORS * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))

    assert np.allclose(score, [want(g) for g in f])

    def seen(g):
        while g in counts:
            if stored[list(f).index(g)]:
                return score[list(f).index(g)]
            g = counts[g][1]
        return 0.0

    assert all(abs(seen(g) - want(g)) <= T.NEAR + 1e-9 for g in f)
