import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trackspark.llm import crossparse as C

SYLLABLES = {"aa": "ka lo mi tan ru be so", "bb": "sch ön ge ver ung ich ein", "cc": "ча на то ли ра не ко"}


def words(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def brute_phrases(passages, text):
    """Greedy parse by substring search."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at:at + size + 1] in p for p in passages):
            size += 1
        count, at = count + 1, at + size
    return count


def test_phrases_equal_brute_force(monkeypatch):
    r = random.Random(3)
    for trial in range(40):
        alphabet = b"abc" if trial % 2 else b"abcdefg "
        passages = [bytes(r.choice(alphabet) for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 6))]
        texts = [bytes(r.choice(alphabet + b"x") for _ in range(r.randrange(0, 60))).decode() for _ in range(12)]
        made = C.Automaton(passages)
        assert len(made.length) <= 2 * sum(map(len, passages)) + 1
        language = C.Language("l", made.column, made.table(), made.bytes)
        monkeypatch.setattr(C, "BLOCK", r.choice([5, 16, 512]))
        sizes, bits = C.entropies([language], pa.array(texts))
        for i, t in enumerate(texts):
            blocks = [t[k:k + C.BLOCK].encode() for k in range(0, len(t), C.BLOCK)]
            want = sum(brute_phrases(passages, b) for b in blocks) * np.log2(max(made.bytes, 2)) / max(len(t), 1)
            assert sizes[i] == len(t) and bits[i, 0] == pytest.approx(want)


def corpus():
    rows, langs = [], list(SYLLABLES)
    for i in range(400):
        lang = langs[0] if i % 3 else langs[1 + i % 2]
        rows.append((i, words(lang, i, 2 + i % 40), lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, lang_pred string")


def test_held_out_accuracy(spark):
    rows = corpus()
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 -- 4!", "cc"), (903, "́̂", "aa"), (None, words("cc", 1, 9), None),
           (904, words("bb", 5, 9).upper(), None), (905, words("cc", 7, 30_000), None), (905, words("cc", 7, 30_000), None)]
    docs = table(spark, rows + odd)
    model = C.fit(docs)
    assert [x.name for x in model] == ["aa", "bb", "cc"]
    out = C.identified(docs, model).withColumn("held", C.held_out())
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "held"]
    got = out.collect()
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == r.lang for r in got if r.held and r.doc_id < 900]
    assert len(held) > 50 and sum(held) == len(held)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [by[k] for k in (900, 901, 902, 903)] == [("und", 0.0)] * 4
    assert (by[None][0], by[904][0], by[905][0]) == ("cc", "bb", "cc")


def test_labels_of_the_held_out_fold_and_ids_are_not_read(spark):
    rows = corpus()
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [(i, t, "zz" if i in held else lang) for i, t, lang in rows]
    a, b = C.fit(table(spark, rows)), C.fit(table(spark, wrong))
    assert [(x.name, x.table.tobytes()) for x in a] == [(x.name, x.table.tobytes()) for x in b]


def test_bounds_and_hot_language(spark):
    rows = corpus()
    docs = table(spark, rows)
    chosen = C.sample(docs, rows=20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] <= 20 for r in chosen} == {x: True for x in SYLLABLES}
    small = C.fit(docs, model_bytes=900)
    assert all(x.bytes < 300 + C.PASSAGE * 2 for x in small)


def test_nothing_to_learn(spark):
    docs = table(spark, [(1, "abc", None), (2, None, "aa"), (None, "1 2", "bb"), (3, "  ", "aa")])
    assert C.fit(docs) == []
    assert {r.lang_pred for r in C.identified(docs, []).collect()} == {"und"}
    one = C.fit(table(spark, [(1, "abc abd", "aa"), (2, "abc abd", "aa")]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in C.identified(docs, one).collect()}
    assert got[1] == ("aa", 1.0) and got[3] == ("und", 0.0)
    empty = table(spark, [])
    assert C.fit(empty) == [] and C.identified(empty, one).count() == 0
