"""Code models: one bundle of DataFrames whatever they come from.

Names are resolved once, when a model is made: ``types`` has descriptors, ``methods`` and ``fields`` have
class, name and descriptor, so queries filter on names and join on ids. ``dex_id`` is part of every key, for each
DEX has id tables of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import names


@dataclass
class CodeModel:
    dex: DataFrame  # dex_id, dex_name, entry_ord, logical_ord
    strings: DataFrame  # dex_id, string_idx, value
    types: DataFrame  # dex_id, type_idx, descriptor
    fields: DataFrame  # dex_id, field_idx, class_type_idx, class_name, name, descriptor
    methods: DataFrame  # dex_id, method_idx, class_type_idx, class_name, name, descriptor
    class_defs: DataFrame  # dex_id, class_def_ord, class_type_idx, class_name, access_flags, superclass_idx, interface_type_idxs
    class_members: DataFrame  # dex_id, class_def_ord, kind, member_idx, access_flags, code_off
    refs: DataFrame  # dex_id, code_off, insn_off, opcode, ref_kind, ref_idx

    def write(self, path: str) -> None:
        """Each table as Parquet. Of one model, refs are clustered by dex_id, so that a DEX's scan prunes."""
        for f in fields(self):
            df: DataFrame = getattr(self, f.name)
            if f.name == "refs":
                df = df.repartitionByRange("dex_id", "code_off").sortWithinPartitions("dex_id", "ref_kind", "ref_idx")
            df.write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CodeModel:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))

    def views(self, prefix: str = "code_") -> None:
        """Temporary views for SQL users."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f"{prefix}{f.name}")

    @property
    def _bodies(self) -> DataFrame:
        return self.class_members.where("kind IN ('direct_method', 'virtual_method') AND code_off <> 0").select("dex_id", "code_off", F.col("member_idx").alias("method_idx"))

    @property
    def _named(self) -> DataFrame:
        return self.methods.select("dex_id", "method_idx", "class_name", F.col("name").alias("method_name"), F.col("descriptor").alias("method_descriptor"))

    @cached_property
    def owners(self) -> DataFrame:
        """Bodies and the methods that share them: dex_id, code_off, method_idx, class_name, method_name, method_descriptor."""
        return self._bodies.distinct().join(self._named, ["dex_id", "method_idx"])

    def owned(self, hits: DataFrame) -> DataFrame:
        """Distinct ``hits`` (dex_id, code_off, ...) with their owners. Only bodies that are hit get names, so that few hits make small joins."""
        return hits.join(self._bodies, ["dex_id", "code_off"]).distinct().join(self._named, ["dex_id", "method_idx"])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_tables(spark: SparkSession, sf_dir: str, whole: bool = False) -> CodeModel:
    """A stand-in model out of the driver's star schema: no Android code in it.

    whole: every line item is an instruction and names a type too; the SQL is ``PRELUDE_WHOLE``. Without it the model
    does not hold all rows: instructions come only from line items of even orders (about half of them), type references
    only from those with line number 1. ``PRELUDE`` has the same filters.

    Each of the five regions is a DEX. Id tables repeat in every DEX (as real ones also hold ids they merely refer to);
    classes and bodies are in the DEX of their customer's region. Orders 2k and 2k+1 share a body.
    """
    t = lambda name: read_table(spark, sf_dir, name)
    every = F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("dex_id")
    customer = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    descriptor = F.concat(F.lit("L"), F.lower("c_mktsegment"), F.lit("/"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")), F.lit("/"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(";"))
    classes = customer.select(F.col("c_custkey").alias("class_type_idx"), descriptor.alias("class_name"), F.col("n_regionkey").alias("home"), "n_nationkey")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    part = t("part").select("p_partkey", "p_name", "p_type")

    dex = t("region").select(F.col("r_regionkey").alias("dex_id"), F.col("r_name").alias("dex_name"), F.col("r_regionkey").alias("entry_ord"), F.lit(0).alias("logical_ord"))
    types = classes.select(every, F.col("class_type_idx").alias("type_idx"), F.col("class_name").alias("descriptor"))
    strings = part.select(every, F.col("p_partkey").alias("string_idx"), F.col("p_name").alias("value"))
    named = classes.select("class_type_idx", "class_name")
    flds = part.select(F.col("p_partkey").alias("field_idx"), (F.col("p_partkey") % 100).alias("class_type_idx"), F.col("p_name").alias("name"), F.col("p_type").alias("descriptor"))
    flds = flds.join(named, "class_type_idx").select(every, "field_idx", "class_type_idx", "class_name", "name", "descriptor")
    meths = orders.select(F.col("o_orderkey").alias("method_idx"), F.col("o_custkey").alias("class_type_idx"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("("), "o_orderstatus", F.lit(")V")).alias("descriptor"))
    meths = meths.join(named, "class_type_idx").select(every, "method_idx", "class_type_idx", "class_name", "name", "descriptor")
    ordinal = F.row_number().over(Window.partitionBy("home").orderBy("class_type_idx")) - 1
    defs = classes.select(
        F.col("home").alias("dex_id"),
        ordinal.alias("class_def_ord"),
        "class_type_idx",
        "class_name",
        (F.col("class_type_idx") * 37 % 1024).alias("access_flags"),
        F.nullif(F.expr("class_type_idx div 10"), F.lit(0)).alias("superclass_idx"),
        F.array(F.col("n_nationkey").cast("long")).alias("interface_type_idxs"),
    )
    homes = classes.select(F.col("class_type_idx").alias("o_custkey"), F.col("home").alias("dex_id"))
    ordered, homes = session.spread(["o_custkey"], orders, homes)
    own = ordered.join(homes, "o_custkey")
    members = own.select("dex_id", F.col("o_custkey").alias("class_def_ord"), F.lit("virtual_method").alias("kind"), F.col("o_orderkey").alias("member_idx"), (F.col("o_orderkey") % 32).alias("access_flags"), (F.expr("o_orderkey div 2") + 1).alias("code_off"))
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus")
    order, owned = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), own.select(F.col("o_orderkey").alias("l_orderkey"), "dex_id")
    items, owned = session.spread(["l_orderkey"], items, owned)
    if whole:  # two orders of a DEX share a body, so that places are numbered over both
        body = Window.partitionBy("dex_id", F.expr("l_orderkey div 2")).orderBy("l_orderkey", *order)
        items = items.join(owned, "l_orderkey").withColumn("insn_off", F.row_number().over(body).cast("long"))
    else:
        place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
        items = items.where("l_orderkey % 2 = 0").withColumn("insn_off", place.cast("long")).join(owned, "l_orderkey")
    kind = F.create_map(*[F.lit(x) for x in ("A", "string", "N", "method", "R", "field")])
    code_off = (F.expr("l_orderkey div 2") + 1).alias("code_off")
    # iget / iput, invoke-virtual, const-string; new-instance for the type references.
    opcode = F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", 0x52).otherwise(0x59)).when(F.col("l_returnflag") == "N", 0x6E).otherwise(0x1A)
    refs = items.select("dex_id", code_off, "insn_off", opcode.alias("opcode"), kind[F.col("l_returnflag")].alias("ref_kind"), F.col("l_partkey").alias("ref_idx"))
    typed = (items if whole else items.where("l_linenumber = 1")).select("dex_id", code_off, (F.col("insn_off") + 1_000_000).alias("insn_off"), F.lit(0x22).alias("opcode"), F.lit("type").alias("ref_kind"), F.col("l_suppkey").alias("ref_idx"))
    return CodeModel(dex, strings, types, flds, meths, defs, members, refs.unionByName(typed))


#: The same projection for DuckDB; queries' SQL begins with it.
PRELUDE = """
WITH RECURSIVE dex AS (SELECT r_regionkey AS dex_id, r_name AS dex_name FROM region),
classes AS (
  SELECT c_custkey AS class_type_idx, n_regionkey AS home, n_nationkey,
         'L' || lower(c_mktsegment) || '/' || replace(lower(n_name), ' ', '_') || '/' || replace(c_name, '#', '_') || ';' AS class_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
types AS (SELECT dex_id, class_type_idx AS type_idx, class_name AS descriptor FROM classes CROSS JOIN dex),
strings AS (SELECT dex_id, p_partkey AS string_idx, p_name AS value FROM part CROSS JOIN dex),
fields AS (
  SELECT dex_id, p_partkey AS field_idx, class_type_idx, class_name, p_name AS name, p_type AS descriptor
  FROM part JOIN classes ON class_type_idx = p_partkey % 100 CROSS JOIN dex
),
methods AS (
  SELECT dex_id, o_orderkey AS method_idx, class_type_idx, class_name, o_orderpriority AS name, '(' || o_orderstatus || ')V' AS descriptor
  FROM orders JOIN classes ON class_type_idx = o_custkey CROSS JOIN dex
),
class_defs AS (
  SELECT home AS dex_id, row_number() OVER (PARTITION BY home ORDER BY class_type_idx) - 1 AS class_def_ord, class_type_idx, class_name,
         class_type_idx * 37 % 1024 AS access_flags, nullif(class_type_idx // 10, 0) AS superclass_idx, n_nationkey AS interface_idx
  FROM classes
),
class_members AS (
  SELECT home AS dex_id, o_orderkey AS member_idx, o_custkey AS class_type_idx, o_orderkey % 32 AS access_flags, o_orderkey // 2 + 1 AS code_off
  FROM orders JOIN classes ON class_type_idx = o_custkey
),
items AS (
  SELECT m.dex_id, l.l_orderkey // 2 + 1 AS code_off, l.*,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
  FROM lineitem l JOIN class_members m ON m.member_idx = l.l_orderkey WHERE l_orderkey % 2 = 0
),
refs AS (
  SELECT dex_id, code_off, place AS insn_off, CASE l_returnflag WHEN 'A' THEN 'string' WHEN 'N' THEN 'method' ELSE 'field' END AS ref_kind, l_partkey AS ref_idx,
         CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 82 ELSE 89 END WHEN l_returnflag = 'N' THEN 110 ELSE 26 END AS opcode
  FROM items
  UNION ALL
  SELECT dex_id, code_off, place + 1000000, 'type', l_suppkey, 34 FROM items WHERE l_linenumber = 1
),
owners AS (
  SELECT m.dex_id, m.code_off, m.member_idx AS method_idx, x.class_name, x.name AS method_name, x.descriptor AS method_descriptor
  FROM class_members m JOIN methods x ON x.dex_id = m.dex_id AND x.method_idx = m.member_idx
)
"""

#: The projection of all line items.
PRELUDE_WHOLE = (
    PRELUDE.replace(" WHERE l_orderkey % 2 = 0", "")
    .replace("PARTITION BY l_orderkey ORDER BY l_linenumber", "PARTITION BY m.dex_id, l_orderkey // 2 ORDER BY l_orderkey, l_linenumber")
    .replace(" FROM items WHERE l_linenumber = 1", " FROM items")
)
