"""Spelling variants: against all pairs of a small vocabulary, and against the SQL."""
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from conftest import SF
from samples import COLUMNS, nothing, odd

from touchline.llm import spelling
from touchline.llm.shared import documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def result(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def hard_rows():
    rng = random.Random(5)
    base = ["abcabcabc", "aaaaaaa", "äöüäöüé", "prefixed" + "q" * 30, "hotpre" + "x" * 6]
    words = set()
    for w in base:
        words.add(w)
        for _ in range(60):  # chains of edits: ends, middles, repeated letters, one hot beginning
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abxyäÿ") + w[i:], w[:i] + w[i + 1:] if len(w) > 6 else w, w[:i] + rng.choice("abzé") + w[i + 1:]])
            words.add(w)
        words |= {base[4][:6] + "".join(rng.choice("abc") for _ in range(4)) for _ in range(40)}
    return [(k % 7, " ".join([w.upper() if rng.random() < 0.2 else w] * rng.choice([1, 5, 6, 30, 200]))) for k, w in enumerate(sorted(words))]


@pytest.mark.parametrize("size", [7, 20_000])
def test_variants_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(spelling, "RANGE", size)
    monkeypatch.setattr(spelling, "SHARE", 5)
    rows = hard_rows()
    expect = brute(rows)
    assert result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == expect
    assert any(r[4] > 3 for r in expect) and any(r[1] not in (None, r[2]) for r in expect)  # many near words, a root behind the form


def test_variants_on_odd_rows(spark):
    df, data = odd(spark)
    assert result(spelling.variants(df)) == brute([r[:2] for r in data])
    assert spelling.variants(nothing(spark)).collect() == []
    long = [(1, "z" * 3000), (1, ("y" + "z" * 2999 + " ") * 5), (2, ("z" * 3000 + " ") * 30), (None, "straße× " * 9)]
    assert result(spelling.variants(spark.createDataFrame([(i, t, None, None, None) for i, t in long], COLUMNS))) == brute(long)


def test_range_is_skipped_only_beyond_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(6, 10)))
        depth = rng.randrange(1, 4)
        prefix = w[:depth] + "".join(rng.choice("ab") for _ in range(rng.randrange(4)))
        reach = {w[:i] + x + w[j:] for i in range(depth, len(w) + 1) for j in (i, i + 1) for x in ("", "a", "b")} | {w}
        if any(v.startswith(prefix) for v in reach):
            assert spelling.shares_of_edit(w, prefix, depth)


def test_variants_equal_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{os.path.join(SF, 'documents.parquet')}'")
    names = "word, form, root, n, n_near, form_n"
    expect = sorted(con.sql(f"SELECT {names} FROM ({spelling.ORACLE})").fetchall())
    assert result(spelling.variants(documents(spark, SF))) == expect and expect
