"""Hierarchies deeper than the driver's tables have, and circles."""

from types import SimpleNamespace

import pytest
from lodestone.operators import graph

DEEP = 70


def model(spark, supers):
    """Classes as (index, index of the superclass or None)."""
    types = spark.createDataFrame([(0, k, f"L{k};") for k, _ in supers], "dex_id long, type_idx long, descriptor string")
    defs = spark.createDataFrame([(0, f"L{k};", s) for k, s in supers], "dex_id long, class_name string, superclass_idx long")
    return SimpleNamespace(types=types.coalesce(1), class_defs=defs.coalesce(1))


def test_deep_hierarchy(spark):
    m = model(spark, [(k, k - 1 if k else None) for k in range(DEEP)])
    assert sorted(graph.hierarchy(m).collect(), key=lambda r: r["depth"]) == [(f"L{k};", k + 1, "L0;") for k in range(DEEP)]
    assert sorted(graph.descendants(m, "L0;").collect(), key=lambda r: r["depth"]) == [(f"L{k};", k) for k in range(1, DEEP)]


def test_circle(spark):
    with pytest.raises(ValueError):
        graph.descendants(model(spark, [(0, 1), (1, 0)]), "L0;")
