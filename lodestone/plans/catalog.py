"""Registered queries over code models, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import finders, graph, locate, refs
from ..operators.locate import FindQuery
from ..session import ship
from .model import PRELUDE, PRELUDE_WHOLE, CodeModel, from_tables, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The queries that take a code model, by name, for models that are there already.
OF_MODELS: dict[str, Callable[[CodeModel], DataFrame]] = {}
FLAGSHIP = "refs_string_agg"
CLASS = "Lfurniture/nation_17/Customer_000000042;"


def model_query(sql: str, cut: bool = True) -> Callable:
    """Register a function of a model, with the SQL that follows the model's projection.

    Queries on references are registered twice: as they were (``cut``), over the model's cut of line items, and as ``<name>_whole`` over all of them.
    """

    def register(f: Callable[[CodeModel], DataFrame]) -> Callable:
        def over(whole: bool) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(from_tables(spark, sf_dir, whole))

            return run

        OF_MODELS[f.__name__] = f
        if cut:
            QUERIES[f.__name__], SQL[f.__name__] = over(False), PRELUDE + sql
        if re.search(r"\brefs\b", sql):
            QUERIES[f"{f.__name__}_whole"], SQL[f"{f.__name__}_whole"] = over(True), PRELUDE_WHOLE + sql
        return f

    return register


def table_query(sql: str | None) -> Callable:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# -- classes ----------------------------------------------------------------------------------------


@model_query("SELECT d.dex_id AS entry_ord, 0 AS logical_ord, class_def_ord, dex_name, class_name FROM class_defs c JOIN dex d ON d.dex_id = c.dex_id")
def list_classes(m: CodeModel) -> DataFrame:
    return locate.list_classes(m)


@model_query("SELECT d.dex_id AS entry_ord, 0 AS logical_ord, class_def_ord, dex_name, class_name FROM class_defs c JOIN dex d ON d.dex_id = c.dex_id WHERE starts_with(class_name, 'Lbuilding/nation_1')")
def list_classes_prefix(m: CodeModel) -> DataFrame:
    return locate.list_classes(m, "building.nation_1")


@model_query("SELECT DISTINCT replace(substr(class_name, 2, length(class_name) - 2), '/', '.') AS class_display FROM class_defs WHERE contains(lower(replace(class_name, '/', '.')), 'furniture.nation_1') ORDER BY 1 LIMIT 20")
def class_filter_ci_limit(m: CodeModel) -> DataFrame:
    return locate.class_filter(m, " FURNITURE.NATION_1 ", 20)


@model_query("SELECT dex_name FROM dex WHERE dex_id IN (SELECT dex_id FROM class_defs WHERE ends_with(class_name, 'Customer_000000042;'))")
def defines_class(m: CodeModel) -> DataFrame:
    one = m.class_defs.where(F.col("class_name").endswith("Customer_000000042;")).select("dex_id")
    return m.dex.join(one, "dex_id", "left_semi").select("dex_name")


@model_query("SELECT class_name, arg_min(dex_name, d.dex_id) AS dex_name FROM class_defs c JOIN dex d ON d.dex_id = c.dex_id GROUP BY class_name")
def first_dex_of_class(m: CodeModel) -> DataFrame:
    return locate.first_dex_of_class(m)


@model_query("SELECT class_name, class_def_ord, dex_id FROM class_defs WHERE contains(class_name, 'Customer_000000007') ORDER BY dex_id, class_def_ord LIMIT 1")
def find_class_limit(m: CodeModel) -> DataFrame:
    found = m.class_defs.where(F.contains("class_name", F.lit("Customer_000000007")))
    return found.orderBy("dex_id", "class_def_ord").limit(1).select("class_name", "class_def_ord", "dex_id")


# -- dictionaries -----------------------------------------------------------------------------------


@model_query("SELECT dex_id, string_idx AS ref_idx, value AS label FROM strings WHERE contains(value, 'widget')")
def locate_string_literal(m: CodeModel) -> DataFrame:
    return locate.locate(m, FindQuery("string", "widget"))


@model_query("SELECT dex_id, string_idx AS ref_idx, value AS label FROM strings WHERE regexp_matches(value, '^[a-m][a-z]* [n-z]')")
def locate_string_regex(m: CodeModel) -> DataFrame:
    return locate.locate(m, FindQuery("string", "^[a-m][a-z]* [n-z]", mode="regex"))


@model_query("SELECT dex_id, type_idx AS ref_idx, descriptor AS label FROM types WHERE contains(descriptor, '/nation_12/')")
def locate_type_fuzzy(m: CodeModel) -> DataFrame:
    return locate.locate(m, FindQuery("type", ".nation_12."))


def _member_queries() -> None:
    """Six ways to name members: no, exact or fuzzy class; part or whole of a name."""
    shapes = {
        "name": ({"name": "{part}"}, "contains(name, '{part}')"),
        "exact": ({"name": "{whole}", "exact_name": True}, "name = '{whole}'"),
        "class": ({"class_name": "{cls}"}, "class_name = '{cls}'"),
        "class_name": ({"class_name": "{cls}", "name": "{part}"}, "class_name = '{cls}' AND contains(name, '{part}')"),
        "fuzzyclass": ({"class_name": "nation_3.Customer", "fuzzy_class": True}, "contains(class_name, 'nation_3/Customer')"),
        "fuzzyclass_name": ({"class_name": "/nation_9/", "fuzzy_class": True, "name": "{whole}", "exact_name": True}, "contains(class_name, '/nation_9/') AND name = '{whole}'"),
    }
    for kind, values in (("method", {"part": "URG", "whole": "1-URGENT"}), ("field", {"part": "re", "whole": "red plate"})):
        label = "class_name || '->' || name || descriptor" if kind == "method" else "class_name || '->' || name || ':' || descriptor"
        for shape, (arguments, where) in shapes.items():
            def run(m: CodeModel, kind: str = kind, arguments: dict = arguments, values: dict = values) -> DataFrame:
                values = values | {"cls": CLASS}
                given = {k: v.format(**values) if isinstance(v, str) else v for k, v in arguments.items()}
                return locate.locate(m, FindQuery(kind, **given))

            run.__name__ = f"locate_{kind}_{shape}"
            model_query(f"SELECT dex_id, {kind}_idx AS ref_idx, {label} AS label FROM {kind}s WHERE " + where.format(**values, cls=CLASS))(run)


_member_queries()


@model_query("""
SELECT dex_name, method_idx AS member_idx, class_name, name, descriptor, count(*) OVER () AS total_hits
FROM methods m JOIN dex d ON d.dex_id = m.dex_id WHERE contains(name, 'HIGH') ORDER BY d.dex_id, method_idx LIMIT 100
""")
def member_search_limit_total(m: CodeModel) -> DataFrame:
    return locate.search_members(m, "method", "HIGH", 100)


# -- references -------------------------------------------------------------------------------------

_OCC = """
SELECT d.dex_name, o.class_name, o.method_name, o.method_descriptor, o.method_idx, '{kind}' AS kind, t.label AS matched, r.ref_idx,
       row_number() OVER (PARTITION BY r.dex_id, o.method_idx, r.ref_idx ORDER BY r.insn_off) - 1 AS occurrence
FROM refs r JOIN ({targets}) t ON t.dex_id = r.dex_id AND t.ref_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off JOIN dex d ON d.dex_id = r.dex_id
WHERE r.ref_kind = '{kind}'
"""
_AGG = """
SELECT dex_name, method_idx, class_name, method_name, string_agg(label, '; ' ORDER BY ref_idx) AS matched FROM (
  SELECT DISTINCT d.dex_name, o.method_idx, o.class_name, o.method_name, r.ref_idx, t.label
  FROM refs r JOIN ({targets}) t ON t.dex_id = r.dex_id AND t.ref_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off JOIN dex d ON d.dex_id = r.dex_id
  WHERE r.ref_kind = '{kind}') GROUP BY ALL
"""
_STRINGS = "SELECT dex_id, string_idx AS ref_idx, value AS label FROM strings WHERE contains(value, 'widget')"
_METHODS = "SELECT dex_id, method_idx AS ref_idx, class_name || '->' || name || descriptor AS label FROM methods WHERE name = '1-URGENT'"
_FIELDS = "SELECT dex_id, field_idx AS ref_idx, class_name || '->' || name || ':' || descriptor AS label FROM fields WHERE contains(name, 're')"
_TYPES = "SELECT dex_id, type_idx AS ref_idx, descriptor AS label FROM types WHERE contains(descriptor, '/Customer_0000000')"


@model_query(_OCC.format(kind="string", targets=_STRINGS))
def refs_string_occ(m: CodeModel) -> DataFrame:
    return refs.occurrences(m, FindQuery("string", "widget"))


@model_query(_AGG.format(kind="string", targets=_STRINGS))
def refs_string_agg(m: CodeModel) -> DataFrame:
    return refs.aggregated(m, FindQuery("string", "widget"))


@model_query(_OCC.format(kind="method", targets=_METHODS))
def refs_method_occ(m: CodeModel) -> DataFrame:
    return refs.occurrences(m, FindQuery("method", "1-URGENT", exact_name=True))


@model_query(_AGG.format(kind="method", targets=_METHODS))
def refs_method_agg(m: CodeModel) -> DataFrame:
    return refs.aggregated(m, FindQuery("method", "1-URGENT", exact_name=True))


@model_query(_OCC.format(kind="field", targets=_FIELDS))
def refs_field_occ(m: CodeModel) -> DataFrame:
    return refs.occurrences(m, FindQuery("field", "re"))


@model_query(_AGG.format(kind="field", targets=_FIELDS))
def refs_field_agg(m: CodeModel) -> DataFrame:
    return refs.aggregated(m, FindQuery("field", "re"))


@model_query(_OCC.format(kind="type", targets=_TYPES))
def refs_type_occ(m: CodeModel) -> DataFrame:
    return refs.occurrences(m, FindQuery("type", "/Customer_0000000"))


@model_query(_AGG.format(kind="type", targets=_TYPES))
def refs_type_agg(m: CodeModel) -> DataFrame:
    return refs.aggregated(m, FindQuery("type", "/Customer_0000000"))


@model_query(f"{_OCC.format(kind='string', targets=_STRINGS)} UNION ALL {_OCC.format(kind='method', targets=_METHODS)} UNION ALL {_OCC.format(kind='type', targets=_TYPES)}")
def refs_multi_kind(m: CodeModel) -> DataFrame:
    return refs.find_refs_multi(m, [FindQuery("string", "widget"), FindQuery("method", "1-URGENT", exact_name=True), FindQuery("type", "/Customer_0000000")])


@model_query("SELECT dex_id, code_off, count(*) AS owners, string_agg(class_name || '->' || method_name, '; ' ORDER BY method_idx) AS who FROM owners GROUP BY ALL HAVING count(*) > 1")
def refs_shared_body_owners(m: CodeModel) -> DataFrame:
    rows = m.owners.groupBy("dex_id", "code_off").agg(F.count("*").alias("owners"), F.sort_array(F.collect_list(F.struct("method_idx", F.concat("class_name", F.lit("->"), "method_name").alias("w")))).alias("x"))
    return rows.where("owners > 1").select("dex_id", "code_off", "owners", F.array_join("x.w", "; ").alias("who"))


@model_query("SELECT count(*) AS refs, count(DISTINCT o.class_name) AS classes FROM refs r JOIN (" + _STRINGS + ") t ON t.dex_id = r.dex_id AND t.ref_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off WHERE r.ref_kind = 'string'")
def refs_counts(m: CodeModel) -> DataFrame:
    return refs.owned(m, FindQuery("string", "widget")).agg(F.count("*").alias("refs"), F.count_distinct("class_name").alias("classes"))


@model_query("SELECT dex_name, method_idx, dex_name || ' | ' || class_name || '->' || method_name || ' | matched=(' || matched || ')' AS line FROM (" + _AGG.format(kind="string", targets=_STRINGS) + ")")
def line_render_agg(m: CodeModel) -> DataFrame:
    return refs.render(refs.aggregated(m, FindQuery("string", "widget")))


@model_query("SELECT dex_name, class_name, method_name AS method_text, matched AS matched_text, NULL::BIGINT AS occurrence FROM (" + _AGG.format(kind="string", targets=_STRINGS) + ")")
def line_parse_roundtrip(m: CodeModel) -> DataFrame:
    return refs.parse(refs.render(refs.aggregated(m, FindQuery("string", "widget"))))


@model_query("SELECT * FROM (" + _OCC.format(kind="string", targets=_STRINGS) + ") WHERE contains(lower(class_name), 'nation_11') OR contains(lower(method_name), 'nation_11') OR contains(lower(matched), 'nation_11') OR contains(lower(dex_name), 'nation_11')")
def result_filter_any(m: CodeModel) -> DataFrame:
    return refs.filter_rows(refs.occurrences(m, FindQuery("string", "widget")), "Nation_11", ["dex_name", "class_name", "method_name", "matched"])


@table_query(PRELUDE + """
SELECT o.dex_id, p."offset", o.method_idx, o.class_name, o.method_name FROM owners o
JOIN (SELECT p_partkey % 5 AS dex_id, p_partkey * 7 AS "offset" FROM part) p ON p.dex_id = o.dex_id AND p."offset" >= o.code_off * 16 AND p."offset" < (o.code_off + 1) * 16
""")
def offset_owner_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = read_table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("dex_id"), (F.col("p_partkey") * 7).alias("offset"))
    model = from_tables(spark, sf_dir)
    bodies = model.owners.select("dex_id", "code_off", (F.col("code_off") * 16).alias("begin"), (F.col("code_off") * 16 + 16).alias("end")).distinct()
    return refs.owners_of_offsets(model, offsets, bodies)


@model_query(f"SELECT DISTINCT r.dex_id, r.ref_kind, r.ref_idx FROM refs r JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off WHERE o.class_name = '{CLASS}'")
def class_closure(m: CodeModel) -> DataFrame:
    return refs.class_closure(m, CLASS)


@model_query(f"SELECT *, row_number() OVER (PARTITION BY dex_id, ref_kind ORDER BY ref_idx) - 1 AS new_idx FROM (SELECT DISTINCT r.dex_id, r.ref_kind, r.ref_idx FROM refs r JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off WHERE o.class_name = '{CLASS}')")
def closure_dense_remap(m: CodeModel) -> DataFrame:
    return refs.dense_remap(m, CLASS)


@model_query("""
SELECT dex_id, ref_kind, ref_idx FROM refs WHERE ref_kind = 'string' AND opcode = 26 AND insn_off = 1
EXCEPT SELECT dex_id, 'string', string_idx FROM strings WHERE contains(value, 'red')
""")
def union_intersect_except_ids(m: CodeModel) -> DataFrame:
    used = m.refs.where("ref_kind = 'string'").select("dex_id", "ref_kind", "ref_idx", "insn_off")
    first, others = used.where("insn_off = 1").drop("insn_off"), used.where("insn_off <= 3").drop("insn_off")
    red = locate.locate(m, FindQuery("string", "red")).select("dex_id", F.lit("string").alias("ref_kind"), "ref_idx")
    return first.union(first).intersect(others).subtract(red)


@model_query("""
, used AS (SELECT DISTINCT dex_id, ref_idx FROM refs WHERE ref_kind = 'string'), said AS (SELECT dex_id, string_idx AS ref_idx, value FROM strings)
(SELECT dex_id, ref_idx FROM used INTERSECT SELECT dex_id, ref_idx FROM said WHERE contains(value, 'widget'))
UNION (SELECT dex_id, ref_idx FROM said WHERE contains(value, 'blue') EXCEPT SELECT dex_id, ref_idx FROM used)
""", cut=False)
def string_id_sets(m: CodeModel) -> DataFrame:
    ids = lambda text: locate.locate(m, FindQuery("string", text)).select("dex_id", "ref_idx")
    used = m.refs.where("ref_kind = 'string'").select("dex_id", "ref_idx")
    return used.intersect(ids("widget")).union(ids("blue").subtract(used)).distinct()


# -- hierarchy and graph ----------------------------------------------------------------------------

_SUPER = "SELECT d.dex_name, c.class_def_ord, c.class_name, t.descriptor AS target FROM class_defs c JOIN types t ON t.dex_id = c.dex_id AND t.type_idx = {on} JOIN dex d ON d.dex_id = c.dex_id WHERE t.descriptor = '{target}'"


@model_query(_SUPER.format(on="c.superclass_idx", target="' || (SELECT descriptor FROM types WHERE type_idx = 11 LIMIT 1) || '"))
def extends_direct(m: CodeModel) -> DataFrame:
    target = m.types.where("type_idx = 11").select("dex_id", F.col("type_idx").alias("superclass_idx"), F.col("descriptor").alias("target"))
    return m.class_defs.join(target, ["dex_id", "superclass_idx"]).join(m.dex, "dex_id").select("dex_name", "class_def_ord", "class_name", "target")


@model_query(_SUPER.format(on="c.interface_idx", target="' || (SELECT descriptor FROM types WHERE type_idx = 7 LIMIT 1) || '"))
def implements(m: CodeModel) -> DataFrame:
    target = m.types.where("type_idx = 7").select("dex_id", F.col("type_idx").alias("i"), F.col("descriptor").alias("target"))
    listed = m.class_defs.select("dex_id", "class_def_ord", "class_name", F.explode("interface_type_idxs").alias("i"))
    return listed.join(target, ["dex_id", "i"]).join(m.dex, "dex_id").select("dex_name", "class_def_ord", "class_name", "target")


_EDGES = """, edges AS (SELECT DISTINCT c.class_name, t.descriptor AS super_name FROM class_defs c LEFT JOIN types t ON t.dex_id = c.dex_id AND t.type_idx = c.superclass_idx)"""


@model_query(_EDGES + """, tree AS (
  SELECT class_name, 1::BIGINT AS depth, class_name AS root FROM edges WHERE super_name IS NULL OR super_name NOT IN (SELECT class_name FROM edges)
  UNION ALL SELECT e.class_name, depth + 1, root FROM tree JOIN edges e ON e.super_name = tree.class_name
) SELECT * FROM tree""")
def hierarchy(m: CodeModel) -> DataFrame:
    return graph.hierarchy(m)


@model_query(_EDGES + """, tree AS (SELECT class_name, 1::BIGINT AS depth, class_name AS root FROM edges WHERE super_name IS NULL UNION ALL SELECT e.class_name, depth + 1, root FROM tree JOIN edges e ON e.super_name = tree.class_name)
SELECT root, count(*) AS classes, max(depth) AS depth FROM tree GROUP BY root""")
def hierarchy_roots(m: CodeModel) -> DataFrame:
    return graph.hierarchy(m).groupBy("root").agg(F.count("*").alias("classes"), F.max("depth").alias("depth"))


@model_query(_EDGES + """, down AS (
  SELECT class_name, 1::BIGINT AS depth FROM edges WHERE super_name = (SELECT any_value(descriptor) FROM types WHERE type_idx = 1)
  UNION ALL SELECT e.class_name, depth + 1 FROM down JOIN edges e ON e.super_name = down.class_name
) SELECT * FROM down""")
def extends_transitive(m: CodeModel) -> DataFrame:
    named = m.types.where("type_idx = 1").agg(F.min("descriptor")).first()[0]
    return graph.descendants(m, named or "")


_CALLS = """, calls AS (
  SELECT r.dex_id, o.class_name AS from_class, o.method_name AS from_name, o.method_descriptor AS from_descriptor, o.method_idx, t.class_name AS to_class, t.name AS to_name,
         t.descriptor AS to_descriptor, r.ref_idx AS callee_idx, r.insn_off, d.class_name IS NULL AS is_external
  FROM refs r JOIN methods t ON t.dex_id = r.dex_id AND t.method_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off
  LEFT JOIN (SELECT DISTINCT class_name FROM class_defs) d ON d.class_name = t.class_name
  WHERE r.opcode BETWEEN 110 AND 114 OR r.opcode BETWEEN 116 AND 120)"""


@model_query(_CALLS + "SELECT * FROM calls")
def call_edges(m: CodeModel) -> DataFrame:
    return graph.call_edges(m)


@model_query(_CALLS + "SELECT DISTINCT to_class, to_name, from_class, from_name FROM calls")
def callers_distinct(m: CodeModel) -> DataFrame:
    return graph.callers_of(m)


@model_query(_CALLS + "SELECT to_class, to_name, count(*) AS calls, count(DISTINCT from_class) AS classes FROM calls WHERE starts_with(to_class, 'Lmachinery/') GROUP BY ALL")
def api_usage_prefix(m: CodeModel) -> DataFrame:
    return graph.api_usage(m, F.col("to_class").startswith("Lmachinery/"))


@model_query("""
SELECT r.dex_id, o.class_name, o.method_name, o.method_idx, f.class_name AS field_class, f.name AS field_name, f.field_idx,
       CASE WHEN r.opcode BETWEEN 82 AND 88 OR r.opcode BETWEEN 96 AND 102 THEN 'r' ELSE 'w' END AS access, r.insn_off
FROM refs r JOIN fields f ON f.dex_id = r.dex_id AND f.field_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off WHERE r.ref_kind = 'field'
""")
def field_edges_rw(m: CodeModel) -> DataFrame:
    return graph.field_edges(m)


@model_query("SELECT DISTINCT r.dex_id, o.method_idx, o.class_name, o.method_name, s.string_idx, s.value FROM refs r JOIN strings s ON s.dex_id = r.dex_id AND s.string_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off WHERE r.ref_kind = 'string'")
def string_edges_distinct(m: CodeModel) -> DataFrame:
    return graph.string_edges(m)


@model_query("SELECT DISTINCT o.class_name AS from_class, t.descriptor AS to_class, CASE WHEN r.opcode = 34 THEN 'new_instance' ELSE 'const_class' END AS kind FROM refs r JOIN types t ON t.dex_id = r.dex_id AND t.type_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off WHERE r.ref_kind = 'type' AND o.class_name <> t.descriptor")
def type_edges(m: CodeModel) -> DataFrame:
    return graph.type_edges(m)


@model_query("SELECT t.dex_id, count(c.class_name) AS internal, count(*) FILTER (c.class_name IS NULL) AS external FROM types t LEFT JOIN class_defs c ON c.dex_id = t.dex_id AND c.class_type_idx = t.type_idx GROUP BY ALL")
def external_targets(m: CodeModel) -> DataFrame:
    return graph.external_in_dex(m)


@model_query("""
SELECT DISTINCT CASE WHEN n > 1 THEN array_to_string(p[1:n-1], '/') ELSE '' END AS package, array_to_string(p[1:n], '/') AS child
FROM (SELECT DISTINCT string_split(regexp_extract(class_name, '^L(.*)/[^/]*;$', 1), '/') AS p FROM class_defs), (VALUES (1), (2)) x(n) WHERE n <= len(p)
""")
def package_children(m: CodeModel) -> DataFrame:
    return graph.package_children(m)


@model_query("""
SELECT package, simple_name, row_number() OVER (PARTITION BY package ORDER BY lower(simple_name), simple_name) - 1 AS place FROM (
  SELECT DISTINCT regexp_extract(class_name, '^L(.*)/[^/]*;$', 1) AS package, regexp_extract(class_name, '([^/]*);$', 1) AS simple_name FROM class_defs)
""")
def package_classes(m: CodeModel) -> DataFrame:
    return graph.package_classes(m)


# -- scalar functions, windows ----------------------------------------------------------------------

_FLAGS = " || ".join(f"CASE WHEN access_flags & {bit} <> 0 THEN ' {name}' ELSE '' END" for bit, name in names.ACCESS_FLAGS)


@model_query(f"SELECT class_name, access_flags, trim({_FLAGS}) AS flags FROM class_defs")
def access_flag_names(m: CodeModel) -> DataFrame:
    return m.class_defs.select("class_name", "access_flags", F.array_join(names.access_names(F.col("access_flags")), " ").alias("flags"))


@model_query("SELECT dex_id, method_idx, 0 AS pos, substr(descriptor, 2, 1) AS type FROM methods WHERE substr(descriptor, 2, 1) IN ('V','Z','B','S','C','I','J','F','D')")
def param_types_exploded(m: CodeModel) -> DataFrame:
    rows = m.methods.select("dex_id", "method_idx", F.posexplode(names.parameter_list(F.col("descriptor"))).alias("pos", "type"))
    return rows.select("dex_id", "method_idx", F.col("pos").cast("int").alias("pos"), "type")


@model_query("SELECT class_name, replace(substr(class_name, 2, length(class_name) - 2), '/', '.') || '[]' AS java, regexp_extract(class_name, '^L(.*)/[^/]*;$', 1) AS package FROM class_defs")
def java_type_names(m: CodeModel) -> DataFrame:
    return m.class_defs.select("class_name", names.java_type(F.concat(F.lit("["), "class_name")).alias("java"), names.package_of(F.col("class_name")).alias("package"))


@table_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (sum(width) OVER w - width)::BIGINT AS \"offset\" FROM (SELECT *, 2 + l_linenumber % 3 AS width FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def instruction_offsets_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running code offsets out of instruction lengths."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    width = 2 + F.col("l_linenumber") % 3
    rows = read_table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.sum(width).over(w) - width).cast("long").alias("offset"))


@table_query("""
SELECT event_id, user_id, (sum(adv // 15) OVER w)::BIGINT AS address, (1 + sum(adv % 15 - 4) OVER w)::BIGINT AS line
FROM (SELECT *, event_id * 31 % 245 AS adv FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def debug_lines_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line table's special opcodes as running sums: address += adv / 15, line += adv % 15 - 4."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = read_table(spark, sf_dir, "events").withColumn("adv", F.col("event_id") * 31 % 245)
    return rows.select("event_id", "user_id", F.sum(F.expr("adv div 15")).over(w).alias("address"), (1 + F.sum(F.expr("adv % 15 - 4")).over(w)).alias("line"))


@table_query("""
SELECT doc_id, octet_length(encode(text))::BIGINT AS utf8_bytes, length(text)::BIGINT AS code_points, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii FROM documents
""")
def string_pool_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("utf8_bytes"), F.length("text").cast("long").alias("code_points"), (~names.is_ascii(F.col("text"))).alias("non_ascii"))


@table_query("""
SELECT conv_id, turn, unnest(w) AS identifier, generate_subscripts(w, 1)::BIGINT AS place
FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*') AS w FROM conversations)
""")
def source_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))).alias("p", "identifier")
    return rows.select("conv_id", "turn", found).select("conv_id", "turn", "identifier", (F.col("p") + 1).cast("long").alias("place"))


@table_query("""
SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first_seen FROM events
""")
def occurrence_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    each = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    first = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("event_id", "user_id", "event_type", (F.row_number().over(each) - 1).cast("long").alias("occurrence"), (F.row_number().over(first) == 1).alias("first_seen"))


# -- finders ----------------------------------------------------------------------------------------

_MEMBERS = f""", own AS (
  SELECT x.class_name, x.name, x.descriptor, min(m.access_flags) AS access_flags FROM class_members m JOIN methods x ON x.dex_id = m.dex_id AND x.method_idx = m.member_idx GROUP BY ALL
), every AS (
  SELECT n.*, CASE WHEN access_flags IS NULL THEN '' ELSE trim({_FLAGS}) END AS flags, access_flags IS NULL AS is_external
  FROM (SELECT DISTINCT class_name, name, descriptor FROM methods) n LEFT JOIN own ON own.class_name = n.class_name AND own.name = n.name AND own.descriptor = n.descriptor
)"""


@model_query("""
, named AS (SELECT DISTINCT descriptor AS class_name FROM types WHERE regexp_matches(descriptor, '^Lf[r-z].*_1[0-3]/'))
SELECT class_name, class_name NOT IN (SELECT class_name FROM class_defs) AS is_external FROM named
""")
def find_classes_regex(m: CodeModel) -> DataFrame:
    return finders.find_classes(m, "Lf[r-z].*_1[0-3]/")


@model_query(_MEMBERS + "SELECT class_name, name, descriptor, flags, is_external FROM every WHERE regexp_matches(class_name, '^Lm.*_[12]/') AND regexp_matches(name, '^[1-3]-') AND regexp_matches(flags, '^public.*static')")
def find_methods_regex(m: CodeModel) -> DataFrame:
    return finders.find_methods(m, "Lm.*_[12]/", "[1-3]-", flags="public.*static", no_external=True)


@model_query("SELECT DISTINCT class_name, name, descriptor, '' AS flags, true AS is_external FROM fields WHERE regexp_matches(name, '^(red|new) [a-r]')")
def find_fields_regex(m: CodeModel) -> DataFrame:
    return finders.find_fields(m, name="(red|new) [a-r]")


@model_query("SELECT DISTINCT value FROM strings WHERE dex_id = 2 AND regexp_matches(value, '^(hot|cold) ')")
def find_strings_regex(m: CodeModel) -> DataFrame:
    return finders.find_strings(m, "(hot|cold) ", 2)


@model_query(_MEMBERS + "SELECT class_name, name, descriptor FROM every WHERE is_external")
def external_methods(m: CodeModel) -> DataFrame:
    return finders.external_methods(m)


@model_query("SELECT home AS dex_id, min(o_orderkey // 2 + 1) AS \"begin\", max(o_orderkey // 2 + 1) AS \"end\" FROM orders JOIN classes ON class_type_idx = o_custkey GROUP BY home")
def code_regions(m: CodeModel) -> DataFrame:
    return finders.code_regions(m)


@model_query(_CALLS + "SELECT DISTINCT to_class, to_name, to_descriptor, is_external FROM calls WHERE starts_with(from_class, 'Lfurniture/') AND from_name = '1-URGENT'", cut=False)
def callees_of_package(m: CodeModel) -> DataFrame:
    edges = graph.call_edges(m).where("startswith(from_class, 'Lfurniture/')")
    return finders.xrefs(edges, {"from_name": "1-URGENT"}, ["to_class", "to_name", "to_descriptor", "is_external"], False)


@model_query("SELECT DISTINCT o.class_name, o.method_name FROM refs r JOIN strings s ON s.dex_id = r.dex_id AND s.string_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off WHERE r.ref_kind = 'string' AND s.value = 'old rod'", cut=False)
def string_users(m: CodeModel) -> DataFrame:
    return finders.string_users(m, "old rod")


@model_query("""
, ids AS (SELECT DISTINCT dex_id, ref_kind, ref_idx * 2 AS ref_idx FROM refs WHERE ref_kind IN ('string', 'type'))
SELECT i.*, coalesce(s.value, t.descriptor, CASE ref_kind WHEN 'string' THEN 'AG:IS: invalid string' ELSE 'AG:ITI: invalid type' END) AS text FROM ids i
LEFT JOIN strings s ON ref_kind = 'string' AND s.dex_id = i.dex_id AND s.string_idx = i.ref_idx LEFT JOIN types t ON ref_kind = 'type' AND t.dex_id = i.dex_id AND t.type_idx = i.ref_idx
""", cut=False)
def texts_of_ids(m: CodeModel) -> DataFrame:
    ids = m.refs.where("ref_kind IN ('string', 'type')").select("dex_id", "ref_kind", (F.col("ref_idx") * 2).alias("ref_idx")).distinct()
    return finders.texts(m, ids)


@model_query("""
, hit AS (
  SELECT d.dex_name, o.class_name, o.method_name, o.method_descriptor, f.class_name AS target_class, f.name AS target_name, f.descriptor AS target_descriptor,
         row_number() OVER (PARTITION BY r.dex_id, o.method_idx, r.ref_idx ORDER BY r.insn_off) - 1 AS occurrence
  FROM refs r JOIN fields f ON f.dex_id = r.dex_id AND f.field_idx = r.ref_idx JOIN owners o ON o.dex_id = r.dex_id AND o.code_off = r.code_off JOIN dex d ON d.dex_id = r.dex_id
  WHERE r.ref_kind = 'field' AND contains(f.name, 'widget')
), said AS (
  SELECT *, class_name || '->' || method_name || method_descriptor AS method_text, 'matched=(' || target_class || '->' || target_name || ':' || target_descriptor || ')' AS matched_text FROM hit
)
SELECT dex_name, class_name, replace(substr(class_name, 2, length(class_name) - 2), '/', '.') AS class_display, method_text, method_name, method_descriptor, matched_text, 'field' AS target_type,
       target_class, target_name, target_descriptor, occurrence, dex_name || ' | ' || method_text || ' | ' || matched_text || ' | occurrence=' || occurrence AS line FROM said
""", cut=False)
def result_lines_parsed(m: CodeModel) -> DataFrame:
    return refs.parse_whole(refs.render_occurrences(refs.occurrences(m, FindQuery("field", "widget"))), "field")
