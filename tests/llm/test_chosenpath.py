import itertools
import random
import re

from samples import prose

from trackspark.llm import chosenpath as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {x: x + 32 for x in range(65, 91)}


def shingles(t, width=5):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, share):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (x, (_, a)), (y, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= share * len(a | b):
            parent[root(x)] = root(y)
    out = []
    for x, (i, s) in enumerate(sets):
        ids = [rows[y][0] for y in range(len(rows)) if root(y) == root(x) and rows[y][0] is not None]
        low = min(ids, default=None) if s else i
        out.append((i, len(s), low, i == low))
    return sorted(out, key=repr)


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
    return " ".join(w)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def corpus():
    base, other = prose(1, 300), prose(2, 120)
    texts = [None, "", "  ", "One two", "one TWO", "one two three", base, base.upper(), base + " tail"]
    texts += [edited(base, n, s) for s, n in enumerate([1, 2, 3, 4, 5, 6, 8, 10, 12, 15])]
    texts += [edited(other, n % 4, n) for n in range(30)] + [prose(s, 80) for s in range(50, 80)]
    return texts


def test_equals_brute_force(documents):
    texts = corpus()
    for share in (85, 80):
        assert rows_of(C.near_duplicates(documents(texts), share)) == brute(list(enumerate(texts)), share)


def test_large_nodes_branch_and_split_into_blocks(documents, monkeypatch):
    monkeypatch.setattr(C, "NODE", 4)
    texts = corpus()
    assert rows_of(C.near_duplicates(documents(texts), 85)) == brute(list(enumerate(texts)), 85)


def test_null_and_repeated_ids(documents):
    base = prose(1, 100)
    rows = [(5, base), (5, base), (5, prose(3, 90)), (None, base), (None, None), (2, edited(base, 1, 1)), (7, "")]
    assert rows_of(C.near_duplicates(documents([t for _, t in rows], [i for i, _ in rows]), 85)) == brute(rows, 85)


def test_one_of_each_group_stays(documents):
    base = prose(1, 200)
    docs = documents([base, base, edited(base, 1, 2), prose(9, 50), "", None], [4, 4, 6, 8, 9, 10])
    kept = C.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 8, 9, 10]


def test_empty_table(documents):
    assert C.near_duplicates(documents([])).count() == 0
    assert C.deduplicated(documents([])).count() == 0


def test_sieve_keeps_every_row_that_may_link():
    import numpy as np
    r = np.random.default_rng(3)
    nodes = np.sort(r.integers(0, 12, 60))
    parts, paths = r.integers(0, 9, 60), r.integers(0, 2, (60, C.TREES))
    want = [any(nodes[i] == nodes[j] and parts[i] != parts[j] and (paths[i] == paths[j]).sum() >= 14 for j in range(60))
            for i in range(60)]
    assert C.sifted(nodes, parts, paths, 14).tolist() == want
    assert C.sifted(nodes[:0], parts[:0], paths[:0], 14).tolist() == []


def test_sieve_misses_less_than_its_bound():
    from math import comb
    for share in (80, 85, 95):
        p, k = (share / 100) ** 2, C.least_agreement(share)
        fewer = [sum(comb(C.TREES, i) * p ** i * (1 - p) ** (C.TREES - i) for i in range(n)) for n in (k, k + 1)]
        assert fewer[0] <= C.MISS < fewer[1]
