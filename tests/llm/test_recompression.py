import random
import re

import numpy as np
import pyarrow as pa
import pytest
from samples import prose

from trackspark.llm import recompression as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, words = {}, []
    for i, t in sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(t or "")
        words.append((i, w))
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), (i is None, i or 0))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (i is None, i or 0):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(5)
    passage, other = prose(100, 130), prose(101, 90)
    texts = [None, "", " \n\t ", "one two", prose(1, 400), passage, prose(2, 60) + " " + passage + " " + prose(3, 60)]
    texts += [prose(4, 30) + "\n" + passage[r.randrange(200):] + " " + other for _ in range(6)]
    texts += ["word " * 300, "word " * 200 + "end", "a b " * 150, "x a b " + "a b " * 120, prose(1, 400), prose(9, 5000)]
    texts += [prose(9, 5000).replace(" alpha ", " changed ", 12), "é à ü " * 60, "é à ü " * 61]
    return texts


@pytest.mark.parametrize("window", [50, 7])
def test_equals_brute_force(documents, window):
    texts = corpus()
    docs = documents(texts)
    got = [tuple(x) for x in R.deduplicated(docs, window).collect()]
    assert sorted(got, key=repr) == brute(list(enumerate(texts)), window)


def test_null_and_repeated_ids(documents):
    p = prose(7, 80)
    rows = [(3, p), (3, p), (3, "x " + p), (None, p), (None, p + " y"), (9, p)]
    got = [tuple(x) for x in R.deduplicated(documents([t for _, t in rows], [i for i, _ in rows])).collect()]
    assert sorted(got, key=repr) == brute(rows, 50)


def test_empty_table(documents):
    assert R.deduplicated(documents([])).count() == 0


def test_equal_windows_pick_equal_contexts():
    """The property the filing rests on: a pick depends on the words of its window alone."""
    inner = prose(30, 70)
    texts = [prose(31, 40) + " " + inner + " " + prose(32, 40), inner, "a a a a " + inner + " a a", prose(33, 3) + " " + inner]
    words = R.Words(pa.array(texts))
    whole, low, high = R.picks(words, 50)
    seen = {}
    for i, a, b in zip(whole, low, high):
        key = tuple(words.hashes[i:i + 50])
        assert i <= a < b <= i + 50
        assert seen.setdefault(key, (a - i, b - i)) == (a - i, b - i)
    assert len(seen) < len(whole)


def test_names_do_not_depend_on_the_batch():
    t = prose(40, 300)
    a = [x.tolist() for x in R.segments(R.Words(pa.array([t])), 50)]
    many = R.segments(R.Words(pa.array(["p q r", t])), 50)
    mine = many[0] == 1
    assert [x[mine].tolist()[:3] for x in many[3:]] == [[y + 3 for y in x[:3]] for x in a[3:]]
    assert np.all(np.diff(many[3]) > 0)
