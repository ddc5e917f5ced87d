"""Personal data, quality, language, likelihood: against direct readings of their rules."""
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import nothing, odd, prose

from touchline.llm import langid, pii, pseudo_likelihood, quality, tagger
from touchline.llm.shared import documents

SF01 = SF.replace("0.001", "0.01")
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            ok = (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m.group().split(".")) or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)
                  or kind == 3 and 9 <= len(digits) <= 15)
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ@.-+_ ()0123456789%é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_known_cases():
    text = "mail x.y@a-b.example.com, 10.0.0.255 and 10.0.0.256, card 4111 1111-1111 1111, call +1 (499) 555-6503."
    found = [(tagger.KINDS[k], text[a:b]) for a, b, k in pii.base_spans(text)]
    assert found == [("email", "x.y@a-b.example.com"), ("ip", "10.0.0.255"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (499) 555-6503")]


def test_tagger_gradient():
    t = tagger.Tagger.new(1, 3)
    t.weights = {k: v.astype(np.float64) for k, v in t.weights.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, tagger.SYMBOLS, (2, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [0, 0, 7, 8, 0, 0, 0]])
    _, grad = t.loss(x, y)
    for k, w in t.weights.items():
        at = (0, x[0, 2], 1) if k == "w" else tuple(n - 1 for n in w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = t.loss(x, y)[0]
        w[at] = keep - 1e-5
        down = t.loss(x, y)[0]
        w[at] = keep
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-4


def test_reconciliation_joins_cut_spans_and_keeps_the_heaviest_set():
    parts = [(40, 60, 0, 0.9, False, True), (48, 70, 0, 0.9, True, False), (65, 90, 3, 0.95, False, False), (100, 104, 2, 0.5, False, False)]
    found = pii.reconciled("x" * 200, parts)
    assert [s[:3] for s in found] == [(40, 70, 0), (100, 104, 2)]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(found))


def test_tagger_finds_respelt_spans(spark):
    texts = [f"{prose(i, 8)} call +1 ({400 + i}) 555-{6000 + 7 * i} or ab{i}.{i % 90}@mail{i % 9}.example.com {prose(i + 99, 8)}" for i in range(120)]
    model = pii.fit(texts, steps=250)
    base, added = pii.all_spans(model, [f"{prose(3, 8)} call (444) 555-6999 {prose(7, 8)}", prose(11, 50)])[0]
    assert not base and [k for *_, k in added] in ([3], [])
    clean = pii.all_spans(model, [prose(i, 80) for i in range(40)])
    assert not any(b or a for b, a in clean)


def test_respelling_moves_the_labels_along():
    text = "mail a.b@c.example.com and call +1 (499) 555-6503, card 4111 1111 1111 1111."
    spans, rng = pii.base_spans(text), np.random.default_rng(4)
    new, moved = pii.beside(text, spans, [("10.0.0.1", 1)], rng)
    assert [new[a:b] for a, b, _ in moved] == [x for a, b, _ in spans for x in (text[a:b], "10.0.0.1")]
    new, moved = pii.respelt(text, spans, rng)
    assert [k for *_, k in moved] == [k for *_, k in spans] and all(new[a:b].strip() == new[a:b] for a, b, _ in moved)
    assert pii.masked(text, spans) == "mail [EMAIL] and call [PHONE], card [CARD]."


def test_found_and_redacted_on_odd_rows(spark):
    df, data = odd(spark)
    out = pii.found(df, None).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == len(data) and all(r["base_sha256"] == empty and r["spans"] == "" for r in out)
    kept = pii.redacted(df, None)
    assert kept.columns == df.columns and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert pii.found(nothing(spark), pii.learn(nothing(spark))).count() == 0
    one = spark.createDataFrame([(1, "write to a@b.example.org now", "en", "s", 28)], nothing(spark).schema)
    row = pii.redacted(one, None).first()
    assert row["text"] == "write to [EMAIL] now" and row["n_chars"] == len(row["text"])


def test_quality_held_out_accuracy(spark):
    d = SF.replace("0.001", "0.1")
    docs, labels = documents(spark, d), documents(spark, d, "labels")
    out = {r["doc_id"]: r for r in quality.scored(docs, quality.learn(docs, labels)).collect()}
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in out.items())
    test = [(out[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if out[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in test) / len(test) > 0.95
    assert sum(p == 0 for p, q in test if q) / sum(q for _, q in test) < 0.02


def test_quality_on_odd_rows(spark):
    df, data = odd(spark)
    labels = spark.createDataFrame([(7, 1), (9, 0), (None, 1), (6, None)], "doc_id long, quality int")
    for model in (quality.learn(df, labels), quality.learn(df, labels.limit(0)), quality.learn(nothing(spark), labels)):
        out = quality.scored(df, model).collect()
        assert len(out) == len(data) and all(0 <= r["score"] <= 1 for r in out)
        assert quality.kept(df, model, 0.0).count() == len(data) and quality.kept(df, model).columns == df.columns
        assert quality.scored(nothing(spark), model).count() == 0


def test_segmentations_are_all_summed():
    trie = langid.Trie("abc", ["ab", "bc", langid.MARK + "a", "abc", langid.MARK + "abc"])
    rng = np.random.default_rng(1)
    prob = rng.random((len(trie.pieces) + 1, 2))
    prob[0] = 0
    symbol = {langid.MARK: 2, "a": 3, "b": 4, "c": 5}
    for word in ("abc", "cab", "abcabcabcabcabcabcabcabc"):
        text = langid.MARK + word
        total = [np.zeros(2) for _ in range(len(text) + 1)]
        total[0] = np.ones(2)
        for i, j in itertools.combinations(range(len(text) + 1), 2):
            if text[i:j] in trie.pieces:
                total[j] = total[j] + total[i] * prob[trie.pieces.index(text[i:j]) + 1]
        got = langid.forward(trie, prob, np.array([[symbol[c] for c in text]], np.uint8))
        assert np.allclose(got[0], np.log(total[-1]))


def test_all_letters_pieces_and_long_words_take_part():
    """More letters than fit a byte, a piece of 14 letters, words of 60: sums and expected counts equal those over all segmentations."""
    many = "".join(chr(0x4E00 + i) for i in range(900))
    trie = langid.Trie(many + "xyz", [langid.MARK + many[:14], many[3:5], "xy", "yz", many[895:898], "zx"])
    assert langid.MARK + many[:14] in trie.pieces
    rng = np.random.default_rng(2)
    prob = rng.random((len(trie.pieces) + 1, 2)) * [[1e-7, 1e-9]]
    prob[0] = 0
    table = trie.symbols()
    for word in (many[:14] + "xyzxy", "xyz" * 20, many[890:900] + "xyzx" + many[:20]):
        text = langid.MARK + word
        ahead, back = [[np.zeros(2, np.longdouble) for _ in range(len(text) + 1)] for _ in range(2)]
        ahead[0] = back[-1] = np.ones(2, np.longdouble)
        edges = [(i, j, trie.pieces.index(text[i:j]) + 1) for j in range(len(text) + 1) for i in range(j) if text[i:j] in trie.pieces]
        for i, j, k in edges:
            ahead[j] = ahead[j] + ahead[i] * prob[k]
        for i, j, k in sorted(edges, reverse=True):
            back[i] = back[i] + back[j] * prob[k]
        symbols = np.array([[2, *table[[ord(c) for c in word]].tolist()]], table.dtype)
        assert np.allclose(langid.forward(trie, prob, symbols)[0], np.log(ahead[-1]).astype(float))
        want = np.zeros_like(prob)
        for i, j, k in edges:
            want[k] += (ahead[i] * prob[k] * back[j] / ahead[-1]).astype(float) * [2, 3]
        assert np.allclose(langid.expected(trie, prob, symbols, np.array([[2.0, 3.0]])), want)
    model = langid.fit([many[i:i + 45] for i in range(0, 450, 9)] + [many[i:i + 45] for i in range(450, 850, 8)], ["aa"] * 50 + ["bb"] * 50, [])
    assert langid.Reader(model).predict(pa.array([many[20:25], many[860:866]]))[0] == ["aa", "bb"]


def test_language_held_out_accuracy(spark):
    docs = documents(spark, SF01)
    model = langid.learn(docs, langid.public_pieces("piece_bpe_32k.model"), sample=150)
    out = {r["doc_id"]: r for r in langid.predicted(docs, model).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in out.items())
    test = [(out[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs.collect() if out[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in test) / len(test) > 0.95


def test_language_on_odd_rows(spark):
    df, data = odd(spark)
    pieces = ["the", "of", langid.MARK + "the"]
    out = langid.predicted(df, langid.learn(df, pieces)).collect()
    assert len(out) == len(data)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    nobody = langid.learn(nothing(spark), pieces)
    assert {r["lang_pred"] for r in langid.predicted(df, nobody).collect()} == {"und"} and langid.predicted(nothing(spark), nobody).count() == 0


def test_window_codes_and_network_gradient():
    texts = ["Ab1.", "", "é"]
    code, off = pseudo_likelihood.windows(texts)
    e, edge = 4, pseudo_likelihood.EDGE
    seq = [edge, edge, 0, 1, pseudo_likelihood.DIGIT, pseudo_likelihood.STOP, edge, edge]
    want = []
    for i in range(2, 6):
        v = 0
        for k in (-2, -1, 1, 2, 0):
            v = v * 32 + seq[i + k]
        want.append(v)
    v = 0
    for s in (edge, edge, edge, edge, e):
        v = v * 32 + s
    assert code.tolist() == [*want, v] and off.tolist() == [0, 4, 4, 5]
    net = pseudo_likelihood.WindowNet.new(1, 5)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    context, counts = np.array([5, 77, 1023]), np.random.default_rng(0).integers(0, 4, (3, 32)).astype(float)
    _, grad = net.loss(context, counts)
    for k, w in net.w.items():
        at = (3, 5, 1) if w.ndim == 3 else tuple(n - 1 for n in w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = net.loss(context, counts)[0]
        w[at] = keep - 1e-5
        down = net.loss(context, counts)[0]
        w[at] = keep
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-6
    assert np.allclose(np.exp(net.forward(np.arange(50))[2]).sum(axis=1), 1)


def test_pseudo_likelihood_equals_direct_sum_and_training_helps(spark):
    docs = documents(spark, SF)
    net = pseudo_likelihood.learn(docs, parts=2, rounds=2, epochs=3)
    out = {r["doc_id"]: r for r in pseudo_likelihood.scored(docs, net).collect()}
    total = {"new": 0.0, "trained": 0.0}
    fresh = pseudo_likelihood.WindowNet.new()
    for r in docs.limit(40).collect():
        code, _ = pseudo_likelihood.windows([r["text"]])
        z = net.forward(code >> 5)[2][np.arange(len(code)), code & 31]
        assert abs(z.sum() - out[r["doc_id"]]["log_likelihood"]) < 1e-2 + 1e-4 * abs(z.sum()) and out[r["doc_id"]]["n_tokens"] == len(r["text"])
        total["trained"] += z.sum()
        total["new"] += fresh.forward(code >> 5)[2][np.arange(len(code)), code & 31].sum()
    assert total["trained"] > 0.7 * total["new"]
    counts = {}
    for r in docs.collect():
        for c in pseudo_likelihood.windows([r["text"]])[0].tolist():
            counts[c] = counts.get(c, 0) + 1
    assert {r["code"]: r["n"] for r in pseudo_likelihood.window_counts(docs).collect()} == counts


@pytest.mark.parametrize("learnt", [True, False])
def test_pseudo_likelihood_on_odd_rows(spark, learnt):
    df, data = odd(spark)
    net = pseudo_likelihood.learn(df if learnt else nothing(spark), parts=2, rounds=1, epochs=1)
    out = pseudo_likelihood.scored(df, net).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(len(t or "") for _, t, *_ in data)
    assert all(r["log_likelihood"] <= 0 for r in out) and pseudo_likelihood.scored(nothing(spark), net).count() == 0


def test_words_helpers():
    from touchline.llm.words import shingle_hashes, word_hashes

    texts = ["", None, "The  the\nTHE", "the", "a b c d e f", "b c d e f", "a b c", "a b"]
    h, off = word_hashes(pa.array(texts))
    assert np.diff(off).tolist() == [0, 0, 3, 1, 6, 5, 3, 2] and len(set(h[:4].tolist())) == 1
    s, soff = shingle_hashes(pa.array(texts))
    assert np.diff(soff).tolist() == [0, 0, 1, 1, 2, 1, 1, 1]
    assert s[soff[4] + 1] == s[soff[5]] and len({s[soff[i]] for i in (2, 3, 4, 6, 7)}) == 5
