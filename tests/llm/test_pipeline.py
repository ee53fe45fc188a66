import re
import zlib

from samples import prose

import corpus_pipeline as C
from trackspark.llm.common import settled

ITEM = prose(900, 40)


def tables(spark, folder):
    base = prose(1, 120)
    texts, labels = [], []
    for i in range(200):
        w = prose(i + 10, 60)
        if i % 5 == 0:
            w = "vileword rudeness vileword " + w + " rudeness"
        texts.append(w)
        labels.append((i, 1, int(i % 5 == 0)))
    texts += [base, base + " tail", base, "intro words " + ITEM + " closing words " + prose(2, 60), ITEM,
              "write to joe.doe12@mail.example.com now", None, "", "vileword rudeness vileword rudeness"]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long, spans int")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, texts


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    docs, texts = tables(spark, str(tmp_path))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        at = settled(stage(spark, at, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in at.collect()}
        if name != C.STAGES[-1][0]:
            assert at.columns == docs.columns
    n = 200
    assert set(seen["toxicity"]) == {i for i in range(n + 8) if i >= n or i % 5}
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {n + 1, n + 2}
    cut = seen["decontamination"]
    assert set(seen["near_duplicates"]) - set(cut) == {n + 4}
    assert ITEM not in cut[n + 3].text and cut[n + 3].text.startswith("intro words") and cut[n + 3].n_chars == len(cut[n + 3].text)
    private = seen["personal_data"]
    assert "joe.doe12" not in private[n + 5].text and re.search(r"write to \S+@\S+ now", private[n + 5].text)
    assert private[n + 6].text is None and private[n + 7].text == ""
    final = seen["token_ids"]
    assert set(final) == set(private) and final[n + 7].n_tokens == 0
    whole = {r.doc_id: r.ids_sha256 for r in C.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.ids_sha256 for i, r in final.items()}
    assert zlib.crc32(b"") == 0
