"""The encoder against the library, edits against encoding anew, whole tables against a round trip."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from massloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return bpe.load(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(vocab):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def ids(vocab, text):
    raw = vocab.encode(text)
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_texts(vocab, library):
    r = random.Random(3)
    texts = ["", "a" * 3000, "ab" * 500, "  \n\n x  ", "日本語🎉🎉", "<|endoftext|>", " don't I'LL"]
    texts += ["".join(r.choice("ab c\n1é!'ß") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert ids(vocab, t) == library.encode_ordinary(t) and vocab.decode(ids(vocab, t)) == t.encode()


def test_append_and_replace(vocab):
    r = random.Random(4)
    for _ in range(150):
        raw = "".join(r.choice("thandeinrou ") for _ in range(200)).encode()
        p = bpe.Prefixes(vocab, raw[:90])
        p.append(raw[90:])
        assert p.last == bpe.Prefixes(vocab, raw).last
        i = r.randrange(195)
        j, by = i + r.randrange(6), b"".join(r.choice([b"the", b"x", b"in"]) for _ in range(r.randrange(4)))
        p.replace(i, j, by)
        want = bpe.Prefixes(vocab, raw[:i] + by + raw[j:])
        assert p.data == want.data and p.last == want.last and p.tokens() == want.tokens()


def test_tables(spark, sf, vocab, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-1, None), (None, "x y")], "doc_id long, text string")
    docs = docs.union(odd).selectExpr("doc_id", "text", "1 AS ids", "'x' AS n_tokens")
    want = []
    for r in docs.collect():
        got = library.encode_ordinary(r.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in got)
        want.append((r.doc_id, len(got), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_and_check(docs, PATH, P.PATTERN).collect()), key=repr) == sorted(want, key=repr)
    decoded = bpe.decode_documents(bpe.encode_documents(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted((r.doc_id, bytes(r.bytes).decode()) for r in decoded.where("doc_id is not null").collect()) == sorted(
        (r.doc_id, r.text or "") for r in docs.where("doc_id is not null").collect()
    )
    assert bpe.encode_and_check(docs.limit(0), PATH, P.PATTERN).count() == 0
