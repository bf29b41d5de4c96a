import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from logweave.llm import bpe


@pytest.fixture(scope="module")
def both():
    data = bpe.vocabulary(bpe.default_vocabulary())
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines())}
    return bpe.Codec(data), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(memoryview(packed).cast("I"))


EDGE = ["", " ", "  ", "a  b", "\n\n a", "a \n", "it's 'tis ''s '' 'll'd I've we'rex '", " 's", "x's's", "!!'s", "\t's", "\n's", "'re've'm", "'r", "'l l", "l'l", "1's", "a" * 5000, "!?" * 3000, "é" * 300 + "日本語 ٣٤ ⅷ", "  'll", "  x", "a\u0000b", "<|endoftext|>", "'ſ"]


def test_edges(both):
    c, t = both
    got = c.encode(EDGE + [None])
    for text, x in zip(EDGE + [""], got, strict=True):
        assert ids(x) == t.encode_ordinary(text), repr(text)
        assert c.decode(x) == text.encode()


def test_random(both):
    c, t = both
    rng = random.Random(5)
    alphabet = list("  ''stmdrevlLa1!\n\t.é") + [" ", "日", "²", "ﬀ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(20)) for _ in range(500)]
    for text, x in zip(texts, c.encode(texts), strict=True):
        assert ids(x) == t.encode_ordinary(text), repr(text)
        assert c.decode(x, c.offsets(x)) == text.encode()


def test_operator(spark, both):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, bpe.default_vocabulary()), bpe.default_vocabulary()).orderBy("doc_id").collect()
    assert [ids(r["ids"]) for r in out] == [both[1].encode_ordinary("a b"), [], [], []]
    assert [bytes(r["decoded"]) for r in out] == [b"a b", b"", b"", b""]
    assert bpe.encode_decode(df.limit(0), bpe.default_vocabulary()).count() == 0
