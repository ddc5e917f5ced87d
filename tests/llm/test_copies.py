"""Near copies, repeated passages, benchmark leaks, chats, fingerprints, packing: against brute force on small tables."""
import hashlib
import itertools
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import canon, connect
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import COLUMNS, nothing, odd, prose, rows

from touchline.llm import bottomk, chat_collapse, chunk_dedup, components, decontaminate, near_dups, packing, queries
from touchline.llm.shared import documents
from touchline.llm.wordids import WordIds
from touchline.session import SHUFFLE_CLEANUP, shared_folder


def grouped(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(f"{a:03}", f"{b:03}") for a, b in rng.integers(0, 120, (90, 2)).tolist()] + [(f"{i:03}", f"{i + 1:03}") for i in range(200, 240)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    want = grouped(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if any(n != m and want[m] == r for m in want)}


def test_near_duplicates_equal_all_pairs(spark):
    docs = documents(spark, SF)
    data = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    weights = near_dups.slot_weights(docs)
    e, w, off, nodes = near_dups.weighted_sets(pa.array([t for _, t in data]), weights)
    sets = [(e[off[i]:off[i + 1]], w[off[i]:off[i + 1]]) for i in range(len(data))]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(data)), 2) if nodes[i] == nodes[j] or near_dups.weighted_jaccard(sets[i], sets[j]) >= 0.8]
    want = grouped(pairs, range(len(data)))
    assert {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()} == {data[i][0]: data[r][0] for i, r in want.items()}


def test_word_slots_count_every_document(spark):
    docs = documents(spark, SF)
    counts, n = near_dups.word_slots(docs)
    want = Counter()
    for r in docs.collect():
        h, _ = near_dups.word_hashes(pa.array([r["text"]]))
        want.update(set((h >> np.uint64(64 - near_dups.SLOTS_LOG)).tolist()))
    assert n == docs.count() and {i: int(c) for i, c in enumerate(counts) if c} == dict(want)


def test_samples_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(5)
    sampler = near_dups.Sampler(512)
    e = np.sort(rng.integers(0, 2**64, 400, dtype=np.uint64))
    w = (1 + 8 * rng.random(400)).astype(np.float32)
    x = w.copy()
    x[:150] *= 0.4
    want = near_dups.weighted_jaccard((e, w), (e, x))
    assert abs((sampler.of(e, w) == sampler.of(e, x)).mean() - want) < 0.09
    assert (sampler.of(e, w, step=7) == sampler.of(e, w)).all()


def test_a_large_bucket_is_not_cut(spark):
    """Two hundred near copies of one text and a chain whose ends differ: all are one class, others stay apart."""
    base = prose(1, 300).split()
    texts = [" ".join(base[:i] + ["changed"] + base[i + 1:]) for i in range(200)]
    chain = prose(2, 200).split()
    for i in range(6):
        chain = chain[:30 * i + 5] + [f"new{i}", f"word{i}", f"here{i}"] + chain[30 * i + 8:]
        texts.append(" ".join(chain))
    texts += [prose(s, 80) for s in range(50, 60)]
    got = [r["class_id"] for r in near_dups.classes(spark.createDataFrame(rows(texts), COLUMNS)).orderBy("doc_id").collect()]
    assert got[:200] == [0] * 200 and got[200:206] == [200] * 6 and got[206:] == list(range(206, 216))


def test_rare_shingles_find_every_link(spark):
    """Texts that share a long passage, each its own component: the prefix join finds all links and few other pairs."""
    passage = prose(500, 60)
    texts = [f"{passage} {prose(i, 20)}" for i in range(40)]
    texts += [t + f" tail{i}" for i, t in enumerate(texts[:6])] + [f"lead{i} " + t for i, t in enumerate(texts[3:9])]
    data = pa.array(texts)
    weights = np.ones(1 << near_dups.SLOTS_LOG, np.float32)
    e, w, off, nodes = near_dups.weighted_sets(data, weights)
    sets = [(e[off[i]:off[i + 1]], w[off[i]:off[i + 1]]) for i in range(len(texts))]
    sampler = near_dups.Sampler()
    rest = spark.createDataFrame([(n, n, (sampler.of(*s) >> np.uint64(48)).astype(np.uint16).view(np.int16).tolist()) for n, s in zip(nodes, sets)],
                                 "node string, root string, samples array<short>")
    table = spark.createDataFrame(list(zip(nodes, texts)), "node string, text string")
    pairs = near_dups.rare_pairs(rest, table, weights)
    want = {tuple(sorted((nodes[i], nodes[j]))) for i, j in itertools.combinations(range(len(texts)), 2) if near_dups.weighted_jaccard(sets[i], sets[j]) >= 0.8}
    got = {(r["u"], r["v"]) for r in pairs.collect()}
    assert want and want <= got and len(got) < len(texts) * 3
    assert {(r["u"], r["v"]) for r in near_dups.verified(pairs, table, weights).collect()} == want


def test_a_group_of_near_copies_is_not_met_in_pairs(spark, monkeypatch):
    """Copies of one text with two to seven edits each: most pairs are less alike than the threshold, and few of these are compared."""
    base, rng, texts = prose(9, 300).split(), np.random.default_rng(3), []
    for i in range(300):
        own = list(base)
        for j, at in enumerate(rng.choice(300, 2 + i % 6, replace=False)):
            own[at] = f"edit{i}x{j}"
        texts.append(" ".join(own))
    compared, plain = [], near_dups.verified

    def verified(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near_dups, "verified", verified)
    docs = spark.createDataFrame(rows(texts), COLUMNS)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    e, w, off, _ = near_dups.weighted_sets(pa.array(texts), near_dups.slot_weights(docs))
    sets = [(e[off[i]:off[i + 1]], w[off[i]:off[i + 1]]) for i in range(len(texts))]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if root[i] != root[j] and near_dups.weighted_jaccard(sets[i], sets[j]) >= 0.8:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root))
    assert sum(compared) < 14 * len(texts), compared


def test_near_duplicates_on_odd_rows(spark):
    df, data = odd(spark)
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in near_dups.classes(df).collect()]
    assert len(got) == len(data) and (8, 7, 2) in got and got.count((9, 9, 2)) == 2 and (9, 9, 1) in got
    kept = near_dups.one_of_each(df)
    assert kept.columns == df.columns
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert set(left.values()) == {1} and len(left) == 9
    assert near_dups.classes(nothing(spark)).count() == 0 and near_dups.one_of_each(nothing(spark)).count() == 0


def test_gear_hash_by_its_definition():
    data = np.frombuffer(prose(1).encode(), np.uint8)
    want = 0
    got = chunk_dedup.gear(data)
    for i, b in enumerate(data.tolist()):
        want = ((want << 1) + int(chunk_dedup._GEAR[b])) % 2**16
        assert got[i] == want


def test_chunks_tile_texts_and_survive_insertions():
    texts = ["", "short", prose(1, 400), "x" * 3000, "é" * 1000 + prose(2, 50)]
    row, start, end, d1, _ = chunk_dedup.chunks(pa.array(texts))
    for i, t in enumerate(texts):
        own = np.flatnonzero(row == i)
        assert "".join(t[a:b] for a, b in zip(start[own], end[own])) == t
        assert all(len(t[a:b].encode()) <= chunk_dedup.LARGEST for a, b in zip(start[own], end[own]))
    text = prose(3, 400)
    _, _, _, a, _ = chunk_dedup.chunks(pa.array([text]))
    _, _, _, b, _ = chunk_dedup.chunks(pa.array([text[:900] + "inserted " + text[900:]]))
    assert len(set(a.tolist()) & set(b.tolist())) >= len(set(a.tolist())) - 8


def test_repeated_passages(spark):
    passage = prose(1000, 60)
    texts = [prose(i, 90) for i in range(12)]
    texts[2] = f"{prose(20, 30)} {passage} {prose(21, 40)}"
    texts[7] = f"lead {passage} {prose(22, 70)}"
    texts[9] = f"{passage}"
    texts += [texts[4], "All rights reserved. " + prose(30, 40), "All rights reserved. " + prose(31, 40)]
    df = spark.createDataFrame(rows(texts), COLUMNS)
    out = {r["doc_id"]: r for r in chunk_dedup.repeated(df).collect()}
    assert set(out) == {2, 4, 7, 9, 12}
    assert out[2]["removable_chars"] == 0 and out[7]["removable_chars"] > 0.6 * len(passage) and out[12]["removable"] == f"0:{len(texts[4])}"
    for i, r in out.items():
        for span in r["spans"].split(","):
            a, b = map(int, span.split(":"))
            assert any(texts[i][a:b] in t for j, t in enumerate(texts) if j != i)
    left = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicated(df).collect()}
    assert left[4] == texts[4] and left[12] == "" and left[0] == texts[0] and len(left[7]) < len(texts[7])


def test_passages_equal_brute_force(spark):
    docs = documents(spark, SF)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen, short = defaultdict(set), defaultdict(set)
    for d, t in text.items():
        w = t.split()
        for i in range(len(w) - 49):
            seen[tuple(w[i:i + 50])].add(d)
        for i in range(len(t) - chunk_dedup.MIN_RUN + 1):
            short[t[i:i + chunk_dedup.MIN_RUN]].add(d)
    must = set().union(*[s for s in seen.values() if len(s) > 1])
    may = set().union(*[s for s in short.values() if len(s) > 1])
    got = {r["doc_id"] for r in chunk_dedup.repeated(docs).collect()}
    assert must <= got <= may


def test_passages_on_odd_rows(spark):
    df, _ = odd(spark)
    got = {r["doc_id"] for r in chunk_dedup.repeated(df).collect()}
    assert got == {7, 8}
    assert chunk_dedup.repeated(nothing(spark)).count() == 0


ITEM = "If Mary buys 12 apples of 3 kg each and then Mary gives 12 apples to her friend, how many of the apples does she keep for the long winter"


def leaked(spark, texts, items=(ITEM,)):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows(texts), COLUMNS), bench).collect()}


def test_reparameterised_items_are_found(spark):
    other = ITEM.replace("Mary", "Thomas").replace("12", "45").replace("3 kg", "7 lb")
    broken = ITEM.replace("then Mary", "then Peter").replace("gives 12", "gives 99")
    texts = [f"{prose(1)} {ITEM} {prose(2)}", f"{prose(3)}. {other}. {prose(4)}", f"{prose(5)} {broken} {prose(6)}", f"{prose(7)} {ITEM.upper()}!", prose(8, 200),
             f"{prose(9)} how many of the apples does she keep {prose(10)}", "  ".join(w + "," for w in ITEM.split())]
    assert leaked(spark, texts) == {(0, 0), (1, 0), (3, 0), (6, 0)}


def test_copies_are_found_however_slots_are_read(spark):
    """Items full of slots, and names that the copy's surroundings or case turn into words or words into names."""
    items = ["What is 17 + 25?", "Compute 12 + 15 + 18 + 20 + 22", "Tom gives Ann 5 kg of 7 lb", "Find 3 boxes of Ann near 4 trees now"]
    texts = [f"so What is 17 + 25? {prose(1)}", f"question: Compute 12 + 15 + 18 + 20 + 22. {prose(2)}", f"{prose(3)}\n\nquestion: tom gives\nann 5 kg  of 7 lb", f"question: Find 5 boxes of ann near 6 trees now {prose(4)}",
             f"it is that What is 18 + 25? {prose(5)}", f"{prose(6)} compute 12 + 15 + 18 + 20 + 23", ITEM.lower(), f"we ask: {ITEM.replace(' Mary', '  Mary').replace('12', '45')}"]
    assert leaked(spark, texts, [*items, ITEM]) == {(0, 0), (1, 1), (2, 2), (3, 3), (6, 4), (7, 4)}


def held_stretch(item, words, need):
    """(length, all equal) of the longest stretches of equal-length token lists that hold the item, by trying all; slots are upper case or digits."""
    best = (0, False)
    for a in range(len(item)):
        seen, same = {}, 0
        for e in range(a, len(item)):
            i, d = item[e], words[e]
            slot = i.isdigit()
            if i != d and not (slot and d.isdigit()) or slot and seen.setdefault(i, d) != d:
                break
            same += i == d
            if e + 1 - a >= need and 2 * same >= e + 1 - a:
                best = max(best, (e + 1 - a, same == e + 1 - a))
    return best


def test_an_edit_does_not_hide_a_long_copy(spark):
    rng = np.random.default_rng(9)
    items, docs = [], []
    for k in range(40):
        item = [str(rng.integers(10, 14)) if rng.random() < 0.4 else f"w{'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10]}{'uvwxyzabcd'[k % 10]}{'efgh'[k // 10]}" for j in range(50)]
        words = list(item)
        for j in rng.choice(50, rng.integers(1, 7), replace=False):
            words[j] = str(rng.integers(10, 16)) if words[j].isdigit() else words[j] if rng.random() < 0.7 else "other"
        items.append(item)
        docs.append(words)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(rows([" ".join(d) for d in docs]), COLUMNS)
    got = {r["doc_id"]: (r["matched_tokens"], r["verbatim"]) for r in decontaminate.leaks(df, bench, stretches=True).collect() if r["doc_id"] == r["item_id"]}
    want = {k: s for k in range(40) if (s := held_stretch(items[k], docs[k], 13))[0]}
    assert got == want and set(want) > {r["doc_id"] for r in decontaminate.leaks(df, bench).collect()}
    assert queries.op4_template_decontamination(spark, SF).columns == ["doc_id", "item_id", "matched_tokens", "item_tokens", "verbatim"]
    edited = f"{prose(5)} {ITEM.replace('gives 12', 'gives 99')} {prose(6)}"
    assert decontaminate.clean(spark.createDataFrame(rows([edited, prose(7)]), COLUMNS), spark.createDataFrame([(0, ITEM)], "item_id long, text string")).count() == 1


def test_leaks_equal_brute_force(spark):
    d = SF.replace("0.001", "0.01")
    docs, bench = documents(spark, d), documents(spark, d, "benchmark")
    index = defaultdict(set)
    for r in bench.collect():
        w = r["text"].lower().replace(".", " ").replace(",", " ").split()
        for i in range(len(w) - 12):
            index[tuple(w[i:i + 13])].add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = "".join(c if c.isalnum() else " " for c in r["text"].lower()).split()
        for i in range(len(w) - 12):
            want |= {(r["doc_id"], k) for k in index.get(tuple(w[i:i + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_leaks_on_odd_rows(spark):
    df, _ = odd(spark)
    bench = spark.createDataFrame([(1, prose(2, 30), "x"), (2, None, "x"), (3, "", "x"), (4, "one", "x"), (4, "12 34 56", "x")], "item_id long, text string, key string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert (9, 1) in got and (4, 4) in got and not any(i in (2, 3) for _, i in got)
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and left.where("doc_id = 9").count() == 1
    assert decontaminate.leaks(nothing(spark), bench).count() == 0 and decontaminate.clean(df, bench.limit(0)).count() == df.count()


def test_snapshots_by_sql_and_by_hand(spark):
    con = connect(SF)
    got = queries.op2_snapshot_collapse(spark, SF)
    cur = con.execute(chat_collapse.ORACLE)
    columns = [c[0] for c in cur.description]
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(cur.fetchall(), columns)
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"say {t}") for c, n in ((1, 3), (2, 700), (3, 3), (5, 700)) for t in range(n)] + [(4, 0, "user", "say 0"), (4, 1, "user", "else")]
    df = spark.createDataFrame([(*r, "x") for r in turns], "conv_id long, turn long, role string, text string, part string")
    assert sorted((r["conv_id"], r["copies"]) for r in chat_collapse.maximal(df).collect()) == [(2, 2), (4, 1)]
    parts = chat_collapse.rendered(df).where("conv_id = 2").orderBy("part").collect()
    assert len(parts) == 11 and "".join(r["text"] for r in parts) == "".join(f"<|{'user' if t % 2 == 0 else 'assistant'}|>\nsay {t}<|end|>\n" for t in range(700))


def test_chats_on_odd_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (2, 0, None, ""), (2, 1, "user", "x" * 50_000), (None, 5, "user", "hi")],
                               "conv_id long, turn long, role string, text string")
    out = chat_collapse.rendered(df).collect()
    assert {(r["conv_id"], r["n_turns"]) for r in out} == {(1, 2), (2, 2), (None, 2)}
    assert chat_collapse.rendered(df.limit(0)).count() == 0


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_fingerprints_against_sets(spark):
    docs = documents(spark, SF)
    data = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    out = {r["doc_id"]: r for r in bottomk.fingerprints(docs).collect()}
    assert len(out) == len(data)
    errors = []
    for i, (d, text) in enumerate(data):
        after = data[(i + 1) % len(data)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = out[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = shingle_set(text), shingle_set(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            if len(a | b) <= bottomk.K:
                assert got == pytest.approx(want)
            errors.append(abs(got - want))
    assert max(errors) < 0.2 and float(np.mean(errors)) < 0.03


def test_sketches_merge():
    parts = [prose(1, 900), prose(2, 700)]
    a, b = bottomk.sketches(pa.array(parts))
    both = np.union1d(a, b)[:bottomk.K]
    assert (bottomk.merge(a, b) == both).all() and (bottomk.decode(bottomk.encode(a)) == a).all()
    assert bottomk.containment(a, a) == 1 and bottomk.resemblance(a, b) < 0.1
    many = shingle_set(parts[0])
    assert abs(bottomk.distinct(a) / len(many) - 1) < 0.35


def test_fingerprints_on_odd_rows(spark):
    df, data = odd(spark)
    out = bottomk.fingerprints(df).collect()
    assert len(out) == len(data)
    text = {r["n_chars"]: r["fingerprint"] for r in out}
    assert text[0] == "" and len({r["fingerprint"] for r in out if r["doc_id"] in (7, 8)}) == 1
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for i, r in enumerate(order):
        t, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[(r[0], hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in out) == want
    assert bottomk.fingerprints(nothing(spark)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB'é <|>9.\ńÉ×ß日 \x0b-sT İ", max_size=40))
def test_word_ids_equal_the_tokenizer(text):
    ids = WordIds.of("word_bpe_49k.json")
    got, off = ids.rows(pa.array([text, None, text + " a"]))
    want = ids.whole.encode(text, add_special_tokens=False).ids
    assert got[:off[1]].tolist() == want and off[1] == off[2]


def best_of(sizes, capacity):
    """Fewest bins by trying everything."""
    best = [len(sizes)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                put(i + 1, bins)
                bins[k] -= sizes[i]
        put(i + 1, [*bins, sizes[i]])

    put(0, [])
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(sizes):
    fixed, rest = packing.reduce_by_dominance(Counter(sizes), 20)
    left = [s for s, n in rest.items() for _ in range(n)]
    used = Counter(left)
    for many, inside in fixed:
        assert sum(s * n for s, n in inside) <= 20
        for s, n in inside:
            used[s] += many * n
    assert used == Counter(sizes)
    assert sum(n for n, _ in fixed) + (best_of(sorted(left, reverse=True), 20) if left else 0) == best_of(sorted(sizes, reverse=True), 20)
    assert packing.lower_bound(Counter(sizes), 20) <= best_of(sorted(sizes, reverse=True), 20) <= packing.bins_needed(Counter(sizes), 20)


def test_best_fit_on_counts_equals_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = Counter(rng.integers(1, 60, 80).tolist())
        bins = []
        for s in sorted(counts.elements(), reverse=True):
            fit = [b for b in bins if b[0] >= s]
            if fit:
                min(fit, key=lambda b: b[0])[0] -= s
            else:
                bins.append([100 - s])
        got = packing.best_fit(counts, 100)
        assert sum(n for n, _ in got) == len(bins)


def checked_packing(out, texts):
    ids = WordIds.of("word_bpe_49k.json")
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    want = Counter()
    for d, t in texts:
        seq = [*ids.whole.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(seq), packing.CAPACITY)):
            import zlib
            part = seq[a:a + packing.CAPACITY]
            want[(d, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    return len(by)


def test_packing_of_documents(spark):
    docs = documents(spark, SF)
    out = queries.op9_best_fit_packing(spark, SF).collect()
    bins = checked_packing(out, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert bins <= packing.lower_bound(Counter(r["length"] for r in out)) + 1


def test_packing_of_odd_rows(spark):
    df, data = odd(spark)
    checked_packing(packing.packed_documents(df, queries.TOKENIZER).collect(), [(r[0], r[1]) for r in data])
    assert packing.packed_documents(nothing(spark), queries.TOKENIZER).count() == 0


def test_near_dedup_leaves_few_files(spark):
    """Shuffle files go as their query ends, tables of the turns as the classes are known."""
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffles():
        return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    def tables():
        folder = shared_folder(spark).removeprefix("file:")
        return {f for f in os.listdir(folder) if f.startswith("touchline-")} if os.path.isdir(folder) else set()

    words = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join(words[k:] + words[:k]) for k in range(12)] + [" ".join(words) + " more"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    setting = spark.conf.get(SHUFFLE_CLEANUP)
    old_shuffles, old_tables = shuffles(), tables()
    kept = near_dups.one_of_each(docs).count()
    assert 0 < kept <= 13 and spark.conf.get(SHUFFLE_CLEANUP) == setting
    assert len(tables() - old_tables) <= 20
    assert len({f.split("_")[1] for f in shuffles() - old_shuffles}) <= 25
