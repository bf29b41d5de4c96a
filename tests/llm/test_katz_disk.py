"""What the Katz model writes, and tokens dealt out in slices and after hot words."""

import math
import os
import random
from zlib import crc32

import numpy as np
import pytest
from logweave.llm import katz

from .test_katz_orders import brute, corpus


def test_tables_written_are_smaller_than_the_texts(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.6)), 20000)}" for _ in range(400)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written, keep = [], katz.keep

    def measured(own, what):
        out = keep(own, what)
        path = out.kept_path.removeprefix("file:")
        written.append(sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")))
        return out

    monkeypatch.setattr(katz, "keep", measured)
    assert katz.score(df, katz.fit(df, 1, 3)).count() == len(texts)
    assert 0 < sum(written) < sum(map(len, texts))


@pytest.mark.parametrize("slices", [1, 3])
def test_hot_words(spark, monkeypatch, slices):
    docs, df = corpus(spark)
    training = ~katz.held("doc_id", 5, 1)
    texts = [t for i, t in docs if crc32(str(i).encode()) % 5 != 1]
    monkeypatch.setattr(katz, "HOT_TOKENS", 1)
    monkeypatch.setattr(katz, "SLICES", slices)
    monkeypatch.setattr(katz, "SLICE_BYTES", 0)
    for least, order in ((1, 2), (1, 3), (2, 3), (1, 4)):
        model = katz.fit(df.where(training), least, order)
        hot = katz.hot_words(model, katz.parts(df))
        assert len(hot) > 3 and katz.BEGIN & katz._LOW in hot
        want = brute(texts, docs, order, least)
        for how in (training, None):
            got = {r["doc_id"]: r["score"] for r in katz.score(df, model, how).collect()}
            assert len(got) == len(docs) and all(math.isclose(got[i], x, rel_tol=1e-9) for i, x in want.items()), (least, order)


def test_at_most_so_many_hot_words_and_high_least_counts(spark, monkeypatch):
    docs, df = corpus(spark)
    monkeypatch.setattr(katz, "HOT_TOKENS", 1)
    monkeypatch.setattr(katz, "HOT", 2)
    model = katz.fit(df, 8, 3)
    assert len(model.frequent) == 2
    want = brute([t for _, t in docs], docs, 3, 8)
    assert all(math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9) for r in katz.score(df, model, katz.F.lit(True)).collect())


def test_packed_keys_and_numbers_come_back():
    x = np.unique(np.array([0, 1, 2**32 - 1, 2**48, 2**48 + 1, 2**63, 2**64 - 1], np.uint64), return_counts=True)[0]
    assert katz._sorted(katz._pack_sorted(x)).tolist() == x.tolist() and not len(katz._sorted(b""))
    assert katz._keys(katz._pack_keys(x)).tolist() == [int(y) & (1 << 48) - 1 for y in x]
    for most in (0, 255, 256, 65535, 65536, 2**32 - 1, 2**32, 2**62):
        assert katz._ints(katz._pack_ints(np.array([most, 0, 1]))).tolist() == [most, 0, 1]
    assert katz._blobs(katz._pack(b"", b"abc", b"")) == [b"", b"abc", b""] and not len(katz._ints(katz._pack_ints(x[:0])))
