"""The stages in order on the smallest tables, each on what its predecessor kept."""
import corpus_pipeline
import pytest
from compare import check, connect
from conftest import SF
from samples import nothing, odd

from touchline.llm import decontaminate, near_dups, queries
from touchline.llm.shared import documents, written
from touchline.plans import catalog


def test_entry_registers_every_operator():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names) and set(catalog.QUERIES) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]


def test_stages_take_effect(spark):
    docs = documents(spark, SF)
    bench = documents(spark, SF, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = written(stage(spark, docs, SF))
        assert new.columns == docs.columns and new.count() <= docs.count()
        if name == "near_dedup":
            assert near_dups.classes(new).where("class_size > 1").count() == 0 and new.count() < docs.count()
        if name == "decontamination":
            assert decontaminate.leaks(new, bench).count() == 0
            bad = {r["doc_id"] for r in decontaminate.leaks(docs, bench).collect()}
            assert {r["doc_id"] for r in docs.collect()} - bad == {r["doc_id"] for r in new.collect()}
        if name == "personal_data":
            assert new.count() == docs.count() and new.where("text rlike '@mail[0-9]'").count() == 0
        docs = new
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_rows(spark, empty):
    docs = nothing(spark) if empty else odd(spark)[0]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns
        docs = written(new)
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0) == empty


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name, monkeypatch):
    monkeypatch.setitem(catalog.QUERIES, name, queries.QUERIES[name])
    monkeypatch.setitem(catalog.ORACLES, name, queries.ORACLES[name])
    assert check(spark, connect(SF), SF, name)[1] == "ok"
