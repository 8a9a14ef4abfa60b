"""A code index made of the star-schema tables: nations are modules, customers types, orders functions, line items calls.

The text of each table is plain SQL that other engines read too; ids that need an order over all rows are added here by dense_ids
and there by row_number().
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symloom.operators import graph, resolve
from symloom.operators.ids import dense_ids
from symloom.shared import new_path

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"]
_NATION_PATH = "concat('geo/', replace(lower(r_name), ' ', '_'), '/', lower(n_name), '.rs')"
_BRAND = "CAST(substr(p_brand, 7) AS INT)"
_PART_NAME = "replace(p_name, ' ', '_')"
_PART_QNAME = f"concat('catalog.brand_', CAST({_BRAND} AS VARCHAR(9)), '.', {_PART_NAME}, '_', CAST(p_partkey AS VARCHAR(20)))"
_NATION = "{nation} JOIN {region} ON n_regionkey = r_regionkey"
_CUSTOMER_QNAME = "concat(r_name, '::', n_name, '::', c_name)"

SQL = {
    "files": f"""
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS file_id, {_NATION_PATH} AS path, 'rust' AS language FROM {_NATION}
        UNION ALL SELECT DISTINCT CAST(1000 + {_BRAND} AS BIGINT), concat('catalog/brand_', CAST({_BRAND} AS VARCHAR(9)), '.py'), 'python' FROM {{part}}
        UNION ALL SELECT CAST(2000 AS BIGINT), 'supply/suppliers.go', 'go'""",
    "symbols": f"""
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CAST(n_nationkey + 1 AS BIGINT) AS file_id, concat(r_name, '::', n_name) AS qualified_name, n_name AS name, 'module' AS kind,
          1 AS start_line, 2000000000 AS end_line, CAST(NULL AS BIGINT) AS parent_symbol_id, concat('mod ', n_name) AS signature FROM {_NATION}
        UNION ALL SELECT 1000000 + c_custkey, CAST(c_nationkey + 1 AS BIGINT), {_CUSTOMER_QNAME}, c_name, 'struct', CAST(c_custkey * 100 + 1 AS INT), CAST(c_custkey * 100 + 99 AS INT), CAST(c_nationkey + 1 AS BIGINT), concat('struct ', c_name)
          FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
        UNION ALL SELECT 1000000000 + o_orderkey, CAST(c_nationkey + 1 AS BIGINT), concat({_CUSTOMER_QNAME}, '::order_', CAST(o_orderkey AS VARCHAR(20))), concat('order_', CAST(o_orderkey AS VARCHAR(20))), 'function',
          CAST(o_custkey * 100 + 2 + o_orderkey % 90 AS INT), CAST(o_custkey * 100 + 7 + o_orderkey % 90 AS INT), 1000000 + o_custkey, NULL
          FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
        UNION ALL SELECT 3000000000 + p_partkey, CAST(1000 + {_BRAND} AS BIGINT), {_PART_QNAME}, {_PART_NAME}, 'class', CAST(p_partkey * 10 + 1 AS INT), CAST(p_partkey * 10 + 9 AS INT), NULL, concat('class ', {_PART_NAME}) FROM {{part}}
        UNION ALL SELECT 4000000000 + s_suppkey, CAST(2000 AS BIGINT), concat('supply::', s_name), s_name, 'interface', CAST(s_suppkey * 10 + 1 AS INT), CAST(s_suppkey * 10 + 9 AS INT), NULL, concat('type ', s_name) FROM {{supplier}}""",
    "calls": f"""
        SELECT 1000000000 + o_orderkey AS caller_symbol_id, CASE l_linenumber % 3 WHEN 0 THEN {_PART_QNAME} WHEN 1 THEN c_name ELSE {_PART_NAME} END AS callee_raw_name,
          CAST(c_nationkey + 1 AS BIGINT) AS file_id, CAST(l_linenumber AS INT) AS line, CAST(l_partkey % 80 AS INT) AS col,
          l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
          FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{part}} ON l_partkey = p_partkey""",
    "types": f"""
        SELECT DISTINCT 3000000000 + l_partkey AS symbol_id, 'implements' AS relation, concat('supply::', s_name) AS target_raw_name, CAST(1000 + {_BRAND} AS BIGINT) AS file_id, CAST(l_partkey * 10 + 1 AS INT) AS line, l_partkey, l_suppkey
          FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{part}} ON l_partkey = p_partkey""",
    "imports": f"""
        SELECT p_partkey + 1 AS id, CAST(p_partkey % 25 + 1 AS BIGINT) AS file_id, CASE WHEN p_partkey % 10 = 0 THEN concat('missing.', {_PART_NAME}) ELSE {_PART_QNAME} END AS raw_path, CAST(NULL AS VARCHAR(20)) AS alias, CAST(p_partkey AS INT) AS line FROM {{part}}""",
    "refs": f"""
        SELECT event_id + 1 AS id, CAST(c_nationkey + 1 AS BIGINT) AS file_id, CASE event_id % 4 WHEN 0 THEN {_CUSTOMER_QNAME} WHEN 3 THEN concat('unknown_', event_type) ELSE c_name END AS raw_name, event_type AS kind,
          CAST(CASE WHEN event_id % 7 = 0 THEN 2000000001 + event_id % 1000 ELSE c_custkey * 100 + 1 + event_id % 99 END AS INT) AS line, CAST(event_id % 80 AS INT) AS col
          FROM {{events}} JOIN {{customer}} ON user_id = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "old_files": """
        SELECT path, CASE WHEN doc_id % 5 = 0 THEN concat('0', substr(content_hash, 2)) WHEN doc_id % 11 = 0 THEN substr(content_hash, 1, 8) ELSE content_hash END AS content_hash FROM {new_files} WHERE doc_id % 7 <> 0
        UNION ALL SELECT concat('gone/doc_', CAST(doc_id AS VARCHAR(20)), '.txt'), content_hash FROM {new_files} WHERE doc_id % 3 = 0""",
}
#: Total orders for ids.
ORDER = {"calls": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"], "types": ["l_partkey", "l_suppkey"]}
COLUMNS = {"calls": ["id", "caller_symbol_id", "callee_raw_name", "file_id", "line", "col"], "types": ["id", "symbol_id", "relation", "target_raw_name", "file_id", "line"]}
NEW_FILES_SPARK = "SELECT doc_id, concat(source, '/', lang, '/doc_', CAST(doc_id AS VARCHAR(20)), '.txt') AS path, sha2(text, 256) AS content_hash, text FROM {documents}"
NEW_FILES_OTHER = NEW_FILES_SPARK.replace("sha2(text, 256)", "sha256(text)")


class Projection:
    """The index of one folder of tables, written once for a session: verbs are asked of a stored index, as they are of one of source files."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **more: DataFrame) -> DataFrame:
        used = {n: self.source(n) for n in SOURCES if "{" + n + "}" in text}
        return self.spark.sql(text, **used, **more)

    def _table(self, name: str) -> DataFrame:
        return self._sql(SQL[name])

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        with co_partitioned(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def files(self) -> DataFrame:
        return self._written(self._table("files"), "files")

    @cached_property
    def symbols(self) -> DataFrame:
        return self._written(self._table("symbols"), "symbols")

    @cached_property
    def places(self) -> DataFrame:
        """Each symbol's place in order of qualified name and id."""
        return dense_ids(self.symbols.select("id", "qualified_name"), ["qualified_name", "id"], "place", keep=["id"]).select("id", "place")

    @cached_property
    def calls(self) -> DataFrame:
        """As SQL["calls"] says, by the narrowest way: of a line item goes along what its row is made of, which leaves no more to be ordered by than that,
        and orders come to their line items in the ranges in which these are numbered."""
        part = self.source("part").select(F.col("p_partkey").alias("l_partkey"), F.expr(_PART_QNAME).alias("qname"), F.expr(_PART_NAME).alias("pname"))
        named = F.when(F.col("l_linenumber") % 3 == 0, F.col("qname")).when(F.col("l_linenumber") % 3 != 1, F.col("pname")).when(F.col("l_linenumber").isNull(), F.col("pname"))
        lines = self.source("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", named.alias("callee"))
        made = self.source("orders").join(self.source("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey", "c_name")
        every = met_in_ranges(lines, made, "l_orderkey").withColumn("callee", F.when(F.col("l_linenumber") % 3 == 1, F.col("c_name")).otherwise(F.col("callee")))
        kept = ["l_orderkey", "l_linenumber", "l_partkey", "callee", "c_nationkey"]
        with co_partitioned(self.spark):
            numbered = dense_ids(every, ["l_orderkey", F.asc_nulls_last("l_linenumber"), "l_partkey", "callee", "c_nationkey"], ranged=True, keep=kept)
        return numbered.select("id", F.expr("1000000000 + l_orderkey AS caller_symbol_id"), F.col("callee").alias("callee_raw_name"), F.expr("CAST(c_nationkey + 1 AS BIGINT) AS file_id"), F.expr("CAST(l_linenumber AS INT) AS line"), F.expr("CAST(l_partkey % 80 AS INT) AS col"))

    @cached_property
    def types(self) -> DataFrame:
        """As SQL["types"] says; what is distinct is found before names are put to it."""
        supplier = self.source("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.expr("concat('supply::', s_name)").alias("target")).distinct()
        part = self.source("part").select(F.col("p_partkey").alias("l_partkey"), F.expr(f"CAST(1000 + {_BRAND} AS BIGINT)").alias("file_id")).distinct()
        pairs = self.source("lineitem").select("l_partkey", "l_suppkey").repartition("l_suppkey").distinct()
        every = met_in_ranges(pairs.join(supplier, "l_suppkey"), part, "l_partkey")
        with co_partitioned(self.spark):
            numbered = dense_ids(every, ["l_partkey", "l_suppkey", "target", "file_id"], ranged=True)
        return numbered.select("id", F.expr("3000000000 + l_partkey AS symbol_id"), F.lit("implements").alias("relation"), F.col("target").alias("target_raw_name"), "file_id", F.expr("CAST(l_partkey * 10 + 1 AS INT) AS line"))

    @cached_property
    def imports(self) -> DataFrame:
        return self._written(self._table("imports"), "imports")

    @cached_property
    def refs(self) -> DataFrame:
        return self._written(self._table("refs"), "refs")

    @cached_property
    def names(self) -> resolve.Names:
        return resolve.Names(resolve.by_qualified_name(self.symbols), resolve.by_local_name(self.symbols.repartition("name")))

    @cached_property
    def resolved_calls(self) -> DataFrame:
        return self._written(resolve.calls(self.calls, self.names), "rcalls")

    @cached_property
    def resolved_types(self) -> DataFrame:
        return self._written(resolve.types(self.types, self.names), "rtypes")

    @cached_property
    def resolved_refs(self) -> DataFrame:
        return self._written(resolve.refs(self.refs, self.names), "rrefs")

    @cached_property
    def resolved_imports(self) -> DataFrame:
        return self._written(resolve.imports(self.imports, self.names), "rimports")

    @cached_property
    def import_edges(self) -> DataFrame:
        return self._written(graph.import_edges(self.symbols, self.resolved_imports), "iedges")

    @cached_property
    def edges(self) -> DataFrame:
        """A view of the stored tables: a question or two of them costs less than writing every edge twice in order."""
        return graph.both_ways(graph.directed(self.symbols, self.resolved_calls, self.resolved_types, self.resolved_imports, self.import_edges))

    def new_files(self) -> DataFrame:
        return self._sql(NEW_FILES_SPARK)

    def old_files(self) -> DataFrame:
        return self._sql(SQL["old_files"], new_files=self.new_files())


def met_in_ranges(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The inner join of two tables by a key, left in ranges of the key: both go there once, and rows can be numbered in its order as they lie."""
    mine, theirs = [c for c in rows.columns if c != key], [c for c in others.columns if c != key]
    one = rows.select(key, F.struct(*mine).alias("_row"), F.lit(None).alias("_other"))
    two = others.select(key, F.lit(None).alias("_row"), F.struct(*theirs).alias("_other"))
    both = one.unionAll(two).where(F.col(key).isNotNull()).repartitionByRange(key)
    met = both.withColumn("_others", F.collect_list("_other").over(Window.partitionBy(key))).where("_row IS NOT NULL")
    return met.select(key, "_row", F.explode("_others").alias("_other")).select(key, "_row.*", "_other.*")


#: While tables of the index are written: a join by name and file takes rows as they lie after a join by name, rather than sending all of them once more;
#: and a task takes fewer of these narrow rows, which are many times as large in memory as they are when sent.
_WRITING = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


@contextmanager
def co_partitioned(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_known: dict[tuple[str, str], Projection] = {}


def projection(spark: SparkSession, sf_dir: str) -> Projection:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        _known[key] = Projection(spark, sf_dir)
    return _known[key]
