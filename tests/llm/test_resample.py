"""Importance resampling: against a direct reading of the rule, and against the SQL."""
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import nothing, odd, prose

from touchline.llm import queries, resample


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target):
    """docs: (doc_id, text). Rows without the rank of equal rows."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features_of(text))
    for text in target:
        t.update(features_of(text))
    n_s, n_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[k] + 1) * (n_s + 10000) / ((s[k] + 1) * (n_t + 10000)))) for k in range(10000)]
    rows = []
    for i, text in docs:
        f = features_of(text)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= 20])
    order = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(order[:25 * len(order) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 .-\n\x01\x7fé日𝄞", max_size=30), st.just("x" * 70 + " y " + "日" * 40)), max_size=5))
def test_composed_features_equal_hashed_ones(texts):
    found, ends = resample.features_of(pa.array(texts, pa.string()))
    assert [found[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [features_of(t) for t in texts]


def test_slices_of_arrays_keep_their_features():
    texts = pa.array(["one two", None, "three", "", "Four five six", "z"])
    found, ends = resample.features_of(texts[2:5])
    assert [found[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [features_of(t) for t in ("three", "", "Four five six")]


def test_resampling_equals_the_rule(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 4000)
    docs = [(i, prose(i, 10 + i % 40)) for i in range(300)]
    target = [prose(i, 30) for i in range(0, 300, 40)]
    out = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert result(out) == brute(docs, target)
    ranks = sorted(r["rank"] for r in out.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 25 * sum(len(words_of(t)) >= 20 for _, t in docs) // 100


def test_resampling_of_odd_rows(spark):
    df, data = odd(spark)
    assert result(resample.resampled(df, df.limit(0))) == brute([r[:2] for r in data], [])
    assert result(resample.resampled(nothing(spark), df)) == []
    same = spark.createDataFrame([(None, prose(1, 40))] * 40 + [(7, prose(2, 40))] * 40, "doc_id long, text string")  # equal rows are ranked each
    ranks = [r["rank"] for r in resample.resampled(same, df.select("text")).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 21)) and len(ranks) == 80


def test_query_equals_the_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS FROM '{os.path.join(SF, name)}.parquet'")
    expect = sorted(con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({resample.ORACLE})").fetchall(), key=str)
    assert result(queries.op13_importance_resampling(spark, SF)) == expect and any(r[4] for r in expect)
