import random
import re

import pytest
from samples import PROSE, prose

from trackspark.llm import suffix as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {x: x + 32 for x in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(texts, items, window=10):
    windows = {}
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(name) if name is not None else "null")
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def corpus():
    r = random.Random(2)
    few = PROSE[:4]
    items = [(i, " ".join(r.choice(few) for _ in range(r.choice([3, 9, 10, 11, 25])))) for i in range(20)]
    items += [(20, prose(1, 40)), (20, prose(2, 12)), (21, ""), (22, None), (None, prose(3, 15)), (23, "alpha"), (24, prose(1, 40))]
    texts = [None, "", "!! ...", items[20][1], "x, " + items[20][1].upper().replace(" ", ";; ") + " y", items[0][1]]
    texts += [" ".join(r.choice(few + ["other"] * (k % 2)) for _ in range(200)) for k in range(8)]
    texts += [prose(1, 40)[30:120], prose(1, 40) + " " + prose(2, 12), "é" + prose(3, 15), prose(8, 3000)]
    return texts, items


@pytest.mark.parametrize("most", [S.AUTOMATON_WORDS, 120])
def test_equals_brute_force(spark, documents, most):
    texts, items = corpus()
    table = spark.createDataFrame(items, "item_id long, text string")
    marked = S.hits(documents(texts), table, most=most)
    got = {r.doc_id: (r.n_words, r.covered, r["items"]) for r in marked.withColumn("covered", S.coverage()).collect()}
    for i, want in enumerate(brute(texts, items)):
        assert got[i] == want, i


def test_removed_spans_leave_the_rest(spark, documents):
    item = prose(5, 30)
    texts = ["Before, it. " + item + " -- after it " + prose(6, 40), item, None, "", prose(7, 50)]
    docs = documents(texts)
    clean = S.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[0] == "Before, it.  -- after it " + prose(6, 40)
    assert 1 not in got and got[2] is None and got[3] == "" and got[4] == texts[4]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert S.hits(documents([]), none).count() == 0
    assert [r.spans for r in S.hits(documents(["a b c"]), none).collect()] == [[]]
