import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from samples import prose

from trackspark.llm import bpe

FILE = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
WHOLE = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})

TEXTS = [None, "", " ", "   lead", "it's we're 123 x  \n\n y\t\t z   ", "ß" * 700, "a" * 5000, " " * 3000 + "x",
         prose(1, 900), "it's we'll they've " * 300, "日本語テキスト " * 200, "!?" * 900, "<|endoftext|>", "🙂🙃" * 300,
         "\n \n  \n" * 400, "x　y z" * 200]


def check(docs, texts):
    rows = bpe.encode(docs, FILE, P.PATTERN, fold=bpe.round_trip, returns=bpe.DIGESTS)
    assert rows.columns == [*docs.columns, "encoded"]
    got = {r.doc_id: r.encoded for r in rows.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array(WHOLE.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), i


def test_whole_texts(documents):
    check(documents(TEXTS), TEXTS)


def test_chunks_equal_whole_texts():
    """Every place of the cuts, on the pieces that make up the chunked path."""
    c = bpe.codec(FILE, P.PATTERN)
    for t in filter(None, TEXTS):
        want = WHOLE.encode_ordinary(t)
        for size, overlap in ((40, 8), (41, 17), (97, 30), (200, 60)):
            starts = list(range(0, max(1, len(t) - overlap), size))
            chunks = []
            for s in starts:
                text = t[s:] if s == starts[-1] else t[s:s + size + overlap]
                chunks.append((text, s, *bpe.encoded_chunk(c, text, s, s == starts[-1])))
            got = np.concatenate(list(bpe.stitched(c, chunks))).tolist()
            assert got == want, (t[:20], size)


def test_long_texts_through_spark(documents):
    texts = ["".join(x or "" for x in TEXTS) * 9, prose(3, 30000), "z" * 70000]
    check(documents(texts), texts)


def test_round_trip_and_repeats(documents):
    docs = documents(["same text", "same text"], [1, 1])
    rows = bpe.decode(bpe.encode(docs, FILE, P.PATTERN).select("doc_id", "text", "encoded.ids"), FILE, P.PATTERN, "ids")
    assert [bytes(r.decoded).decode() for r in rows.collect()] == ["same text", "same text"]
    assert bpe.encode(documents([]), FILE, P.PATTERN).count() == 0
