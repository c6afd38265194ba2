"""Plans whose tasks don't grow with the tables: what is never broadcast, and how many pieces large joins have."""

import re

import pytest
from lodestone import session
from lodestone.operators import finders, graph
from lodestone.plans import catalog, model

from tests import oracle


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_dictionaries_are_merged(spark, tiny):
    m = model.from_tables(spark, tiny, True)
    assert re.search(r"SortMergeJoin \[dex_id#\d+, string_idx#\d+L\]", plan(graph.string_edges(m)))
    assert re.search(r"SortMergeJoin \[dex_id#\d+, type_idx#\d+L\]", plan(graph.type_edges(m)))
    ids = spark.createDataFrame([(0, "string", 1)], "dex_id int, ref_kind string, ref_idx long")
    assert re.search(r"SortMergeJoin \[dex_id#\d+, ref_kind#\d+, ref_idx#\d+L\]", plan(finders.texts(m, ids)))


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(session, "PIECE", 4096)


@pytest.mark.parametrize("name", ["string_edges_distinct", "string_edges_distinct_whole", "type_edges_whole", "texts_of_ids_whole"])
def test_large_joins_go_in_pieces(spark, tiny, small_pieces, name):
    n = session.pieces(model.read_table(spark, tiny, "lineitem"))
    assert n > 8
    told = plan(catalog.QUERIES[name](spark, tiny))
    keys = ["l_orderkey"] if name.startswith("texts") else ["l_orderkey", "dex_id#\\d+, code_off"]
    for key in keys:  # both sides of the join (of two, where refs are a union), and no other exchange by its keys
        assert len(re.findall(rf"hashpartitioning\({key}#\d+L, {n}\), REPARTITION_BY_NUM", told)) in (2, 4)
        assert not re.search(rf"hashpartitioning\({key}#\d+L, \d+\), ENSURE", told)
    assert oracle.compare(spark, catalog.QUERIES[name], catalog.SQL[name], tiny)


def test_pieces_follow_the_largest_table(spark, monkeypatch, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    bytes_of_it = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    monkeypatch.setattr(session, "PIECE", 1000)
    assert session.pieces(table.join(spark.range(5), "id")) == -(-bytes_of_it // 1000)
    assert session.pieces(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "id long")) == 0
