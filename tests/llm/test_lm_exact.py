"""Language-model losses where the corpus has more words and bigrams than any fixed table of theirs had."""

import collections

import numpy as np
import pytest

from tidewell.llm import lm
from tidewell.llm._common import words_of


def test_losses_do_not_blur_with_size(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 1000, raising=False)
    monkeypatch.setattr(lm, "FEW_WORDS", 1000, raising=False)
    rows = [(i, "a b c d e " + " ".join(f"w{i * 4000 + k} a b" for k in range(4000))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 100, 7)], "doc_id BIGINT, quality INT, toxic INT")
    good = {r.doc_id for r in df.join(labels, "doc_id").where(~lm.is_held_out()).select("doc_id").collect()}
    uni, bi, context = ([collections.Counter(), collections.Counter()] for _ in range(3))
    for i, t in rows:
        ws = words_of(t)
        for m in range(1 + (i in good)):
            uni[m].update(ws)
            context[m].update([b"", *ws[:-1]])
            bi[m].update(zip([b"", *ws], ws))
    total = sum(uni[1].values())
    scale = (total / sum(uni[0].values()), 1)
    assert len(uni[0]) > 1 << 18
    got = {x.doc_id: x for x in lm.score(df, labels).collect()}
    assert len(got) == 100
    for i, t in rows[::9]:
        ws, loss = words_of(t), [0.0, 0.0]
        for v, w in zip([b"", *ws], ws):
            for m in range(2):
                p1 = (uni[m][w] * scale[m] + 0.5) / (total + lm.UNI / 2)
                loss[m] -= np.log((bi[m][v, w] * scale[m] + lm.MU * p1) / (context[m][v] * scale[m] + lm.MU))
        assert got[i].n_tokens == len(ws)
        assert (got[i].target_loss, got[i].background_loss) == pytest.approx((loss[1] / len(ws), loss[0] / len(ws)), abs=1e-5)


def test_counts_of_any_size_come_back():
    import pyarrow as pa

    r = np.random.default_rng(1)
    n = r.integers(0, 5, 1000) * np.array([1, 100, 300, 70_000, 1 << 40])[r.integers(0, 5, 1000)]
    t, n_end = n // 3, np.where(r.random(1000) < 0.1, n // 2, 0)
    cut = np.array([0, 0, 10, 400, 400, 1000])
    rows = pa.table(lm._pack_counts(n, t, n_end, n_end // 2, cut), names=lm._COUNTS)
    got, where = lm._unpack_counts(rows)
    assert all((x == y).all() for x, y in zip(got, (n, t, n_end, n_end // 2))) and (where == cut).all()
