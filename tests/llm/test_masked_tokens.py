"""Token pseudo-likelihood against a direct reading of its formula, and on what 32 symbols could not tell apart."""
import math
from collections import Counter

import numpy as np
import pytest
from samples import nothing, odd

from touchline.llm import masked_tokens, pseudo_likelihood
from touchline.llm.queries import TOKENIZER
from touchline.llm.wordids import WordIds


def direct(texts, last):
    """Log-probability of every text's tokens, each occurrence left out of the counts by hand."""
    whole = WordIds.of(TOKENIZER).whole
    rows = []
    for at, t in enumerate(texts):
        ids = [-1, -1, *whole.encode(t or "", add_special_tokens=False).ids, -1, -1]
        rows += [(at, tuple(ids[i - 2:i + 3])) for i in range(2, len(ids) - 2)]
    contexts = [lambda w: (w[0], w[1], w[3], w[4]), lambda w: (w[1], w[3]), lambda w: ()]
    tables = [Counter((f(w), w[2]) for _, w in rows) for f in contexts]
    sums = [0.0] * len(texts)
    for at, w in rows:
        p = last[w[2]]
        for f, table in reversed(list(zip(contexts, tables))):
            left = {t: n - (t == w[2]) for (c, t), n in table.items() if c == f(w)}
            left = {t: n for t, n in left.items() if n}
            n = sum(left.values())
            if n:
                p = (max(left.get(w[2], 0) - 0.75, 0) + 0.75 * len(left) * p) / n
        sums[at] += math.log(p)
    return sums


TEXTS = ["the cat sat on the mat", "the cat sat on the mat", "a dog sat on the log", "", None, "мама мыла раму", "мама мыла раму", "ммаа ыалм умар",
         "call 1234567 now", "call 1234567 now", "call 7654321 now", "the cat sat on the red mat"]


@pytest.mark.parametrize("part_log", [21, 3])
def test_every_token_hidden_in_turn(spark, monkeypatch, part_log):
    monkeypatch.setattr(masked_tokens, "CHUNK", 40)
    net = pseudo_likelihood.WindowNet.new()
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    last = masked_tokens.vocabulary_weights(spark, net, TOKENIZER)
    assert abs(last.sum() - 1) < 1e-9 and last.min() > 0
    out = {r["doc_id"]: r for r in masked_tokens.scored(docs, net, TOKENIZER, part_log).collect()}
    want = direct(TEXTS, last)
    assert len(out) == len(TEXTS) and np.allclose([out[i]["log_likelihood"] for i in range(len(TEXTS))], want, rtol=1e-5)
    assert out[3]["n_tokens"] == out[4]["n_tokens"] == 0 and out[4]["mean_log_likelihood"] == 0
    assert out[5]["log_likelihood"] == out[6]["log_likelihood"] and out[5]["mean_log_likelihood"] > out[7]["mean_log_likelihood"] + 1
    assert out[8]["log_likelihood"] > out[10]["log_likelihood"] + 1


def test_masked_tokens_on_odd_rows(spark):
    df, data = odd(spark)
    net = pseudo_likelihood.WindowNet.new()
    out = masked_tokens.scored(df, net, TOKENIZER).collect()
    assert len(out) == len(data) and all(r["log_likelihood"] <= 0 for r in out)
    assert masked_tokens.scored(nothing(spark), net, TOKENIZER).count() == 0
