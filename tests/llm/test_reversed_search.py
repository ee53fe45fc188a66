import math
import random
import re
from collections import Counter

import pytest
from samples import PROSE, prose

from trackspark.llm import reversed_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {x: x + 32 for x in range(65, 91)}


def terms(t):
    return [w.translate(LOWER) for w in TERM.findall(t or "")]


def brute(docs, items, k=20):
    """(item, rank, doc, score) by scoring every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // words
            score = sum(weight[w] * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(n=300):
    r = random.Random(5)
    texts = [prose(k % 90, r.choice([1, 3, 20, 60, 200])) for k in range(n)]
    texts += [None, "", "!!", "ALPHA alpha é É", "alpha " * 500, prose(7, 6000), "only_once unheard"]
    items = [(k, prose(k, 30)) for k in range(0, 40, 3)] + [
        (100, None), (101, ""), (102, "nowhere known"), (103, "alpha ALPHA beta"), (104, "É é only once"),
        (105, " ".join(PROSE * 3)), (106, prose(7, 2000))]
    return texts, items


@pytest.mark.parametrize("most, k, first", [(R.POSTINGS, 20, R.FIRST_BYTES), (300, 3, 64), (2000, 1, 1 << 20)])
def test_equals_brute_force(spark, documents, monkeypatch, most, k, first):
    monkeypatch.setattr(R, "FIRST_BYTES", first)
    texts, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(R.search(documents(texts), table, k, most=most)) == brute(list(enumerate(texts)), items, k)


def test_small_steps_within_a_task():
    """Full heaps prune, and small steps of candidates lose none."""
    texts, items = corpus(600)
    docs = list(enumerate(texts))
    index = R.Index.over([t for _, t in items])
    held = [set(terms(t)) for t in texts]
    known = {w: int(index.numbers(*R.terms_of(R.pa.array([w]))[:2])[0]) for w in set().union(*held)}
    holding = R.np.zeros(len(index.hashes), R.np.int64)
    for words in held:
        for w in words:
            if known[w] >= 0:
                holding[known[w]] += 1
    index.weigh(holding, sum(map(bool, held)), sum(len(terms(t)) for t in texts))
    old = R.STEP_TERMS
    try:
        R.STEP_TERMS = 50
        search = R.Search(index, 5)
        for k in range(0, len(docs), 7):
            part = docs[k:k + 7]
            search.add(R.pa.array([t for _, t in part], R.pa.string()), R.np.array([i for i, _ in part]),
                       R.np.zeros(len(part), bool))
    finally:
        R.STEP_TERMS = old
    got = {(items[r["item"]][0], r["doc"], r["score"]) for r in search.rows().to_pylist()}
    assert got == {(i, d, s) for i, _, d, s in brute(docs, items, 5)}


def test_ties_nulls_and_repeated_rows(spark, documents):
    rows = [(9, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (4, "gamma"), (5, "delta"), (6, None)]
    items = [(1, "alpha"), (1, "alpha"), (None, "gamma gamma")]
    got = rows_of(R.search(documents([t for _, t in rows], [i for i, _ in rows]),
                           spark.createDataFrame(items, "item_id long, text string"), 3))
    assert got == brute(rows, items, 3)
    assert [r[2] for r in got if r[0] == 1] == [3, 3, 3, 3, 9, 9]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert R.search(documents(["alpha", None]), none).count() == 0
    assert R.search(documents([]), some).count() == 0
    assert R.search(documents([None, ""]), some).count() == 0
    assert R.search(documents(["alpha"]), some).count() == 1
