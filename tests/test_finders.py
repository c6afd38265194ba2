"""Finders and cross references over decoded archives."""

from dataclasses import replace

import pytest
from lodestone.operators import finders, refs
from lodestone.operators.locate import FindQuery
from lodestone.sources import apk

from tests import dexfile
from tests.test_archives import archive, rows


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("found")
    (folder / "a.apk").write_bytes(archive([("classes.dex", dexfile.two_methods()), ("classes2.dex", dexfile.calls())]))
    return apk.ingest(spark, str(folder / "*.apk"), str(folder / "tables"))


def test_patterns_are_anchored_at_the_start_only(model):
    assert rows(finders.find_strings(model, "tok")) == [("token",)] and rows(finders.find_strings(model, "oken")) == []
    assert rows(finders.find_classes(model, "Lexample/T")) == [("Lexample/Target;", True), ("Lexample/Test;", False)]
    assert rows(finders.find_classes(model, no_external=True)) == [("Lexample/Test;", False)]
    assert rows(finders.find_methods(model, flags="public").select("name")) == [("first",), ("run",), ("second",)]
    assert rows(finders.external_methods(model)) == [("Lexample/Target;", "call", "(I)V")]


def test_references_in_both_directions(model):
    assert rows(finders.callees(model, "Lexample/Test;")) == [("Lexample/Target;", "call", "(I)V", True)]
    assert rows(finders.callers(model, "Lexample/Target;", "call").select("from_name")) == [("run",)]
    assert rows(finders.string_users(model, "token").select("method_name")) == [("first",), ("second",)]
    assert rows(finders.field_users(model, "Lexample/Test;", "size").select("method_name", "access")) == [("run", "r")]
    assert finders.field_users(model, "Lexample/Test;", "size", "w").count() == 0


def test_texts_of_missing_ids(spark, model):
    dex = model.dex.select("dex_id").first()[0]
    ids = spark.createDataFrame([(dex, "string", 99), (dex, "type", 0)], "dex_id string, ref_kind string, ref_idx long")
    assert rows(finders.texts(model, ids).select("text")) == [(finders.NO_STRING,), ("Lexample/Test;",)]


def test_outer_classes(spark, model):
    names = ["La/B;", "La/B$C;", "La/B$C$D;", "La/X$1;", "La/$;"]
    model = replace(model, class_defs=spark.createDataFrame([(n,) for n in names], "class_name string"))
    assert rows(finders.outer_classes(model)) == [("La/B$C$D;", "La/B$C;", "La/B;"), ("La/B$C;", "La/B;", "La/B;")]


def test_result_lines(spark, model):
    lines = refs.render_occurrences(refs.occurrences(model, FindQuery("method", "call")))
    row = refs.parse_whole(lines, "method").first()
    assert (row["target_class"], row["target_name"], row["target_descriptor"], row["occurrence"]) == ("Lexample/Target;", "call", "(I)V", 0)
    assert (row["class_display"], row["method_name"], row["method_descriptor"]) == ("example.Test", "run", "()V")
    odd = spark.createDataFrame([("a.dex | La;->f()V | matched=(x | y) | occurrence=12",), ("a.dex | La;->f | matched=(x) z)",)], "line string")
    assert rows(refs.parse_whole(odd, "string").select("target_name", "occurrence", "method_descriptor")) == [("x | y", 12, "()V"), ("x) z", 0, "")]
