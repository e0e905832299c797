import hashlib
import random

import public_tokenizers
import sentencepiece

from tellmark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(3)
    letters = "abcdefghij      ▁\n\té日本😀ßñ0123.,;(){}=+-_\"'AB\x00"
    fixed = ["", None, " ", "  a  b ", "a<s>b</s>", "▁▁a ▁", "a" * 3000, " " * 700, "ab" * 900, "the " * 400, "\x00a\x01 �"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(500)] + [
        "".join(rng.choice("abn") for _ in range(rng.randrange(200))) for _ in range(100)
    ]


def test_digests_equal_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    data = [(i, t, "x") for i, t in enumerate(texts())] + [(1, "again", "x")] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, ids string").repartition(5)
    got = sorted(map(tuple, pieces.digests(df, PATH).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in data:
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert got == sorted(want)


def test_encode_and_decode(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    ids = pieces.encode(df, PATH)
    assert all(r["ids"] == lib.encode(r["text"] or "") for r in ids.join(df, "doc_id").collect())
    other = [[200, 150, 259, 5], [0, 1, 2], [], None, [3 + 0xE6, 3 + 0x97, 3 + 0xA5, 264]]
    tokens = spark.createDataFrame(list(enumerate(other)), "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(tokens, PATH).collect()}
    assert got == {i: lib.decode(x or []) for i, x in enumerate(other)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.digests(empty, PATH).collect() == [] and pieces.encode(empty, PATH).collect() == []
