import hashlib
import random
import struct

import public_tokenizers as P
import regex
import tiktoken

from quillmill.llm.bpe import Merger, boundaries, decode_ids, encode_documents, read_ranks, stitch

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = ["the ", "I'll ", "  ", "\n\n ", "été", "日本語", "1234567", "...!!", " x'y'ss", "\t", "ß ", "a" * 90, "'re", "' ll", "🙂"]


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def random_text(rng, n):
    return "".join(rng.choice(WORDS) for _ in range(n))


def test_stitching_equals_whole_matching():
    cut, rng = regex.compile(P.PATTERN), random.Random(5)
    for n in (1, 10, 200):
        for size, overlap in ((7, 3), (20, 6), (50, 25)):
            text = random_text(rng, n)
            starts = range(0, max(1, len(text) - overlap), size)
            chunks = [(s, boundaries(cut, text[s:] if s == starts[-1] else text[s : s + size + overlap], s == starts[-1])) for s in starts]
            assert stitch(cut, text, chunks)[1:] == [m.end() for m in cut.finditer(text)]


def test_long_pieces_merge_alike():
    m, rng = Merger(read_ranks(RANKS)), random.Random(2)
    for n in (65, 200, 1000):
        piece = bytes(rng.choice(b"abcdethn ") for _ in range(n))
        assert m.merge_long(piece) == reference()._encode_single_piece(piece)


def test_documents_equal_the_library(spark, docs):
    rng = random.Random(1)
    texts = [None, "", " ", "don't  stop\n", "<|endoftext|>", *(random_text(rng, k) for k in (5, 300, 900)), "z" * 5000, " " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "null id")]
    got = encode_documents(docs(*rows), RANKS, P.PATTERN, chunk_chars=600, overlap=64, with_ids=True)
    assert got.count() == len(rows)
    enc = reference()
    for r in decode_ids(got.drop("decoded"), RANKS).join(got.select("id", "decoded").distinct().withColumnRenamed("decoded", "d2"), "id").distinct().collect():
        text = dict(rows)[r.id] or ""
        ids = enc.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert bytes(r.decoded) == bytes(r.d2) == text.encode() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table_and_extra_columns(spark, docs):
    from pyspark.sql import functions as F

    d = docs((1, "x"))
    assert encode_documents(d.limit(0), RANKS, P.PATTERN).count() == 0
    assert encode_documents(d.withColumn("id", F.lit("clash")).withColumn("hash", F.lit(1)), RANKS, P.PATTERN).first().id == 1
