"""Map inputs derived from the driver's tables; each text is SQL of both Spark and DuckDB."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

K = "CAST(1024 AS DOUBLE)"
#: A jittered lattice 40 nodes wide; all coordinates are dyadic, so sums are exact in any order.
NODES = f"""SELECT p_partkey AS node_id, CAST(p_partkey % 40 AS DOUBLE) + CAST((p_partkey * 7919) % 401 - 200 AS DOUBLE) / {K} AS x,
 CAST(p_partkey - p_partkey % 40 AS DOUBLE) / CAST(40 AS DOUBLE) + CAST((p_partkey * 104729) % 401 - 200 AS DOUBLE) / {K} AS y,
 p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_retailprice AS elevation FROM {{part}}"""
EDGES = """SELECT u, v, CASE WHEN (u * 7 + v) % 4 = 0 THEN 'primary' WHEN (u * 7 + v) % 4 = 1 THEN 'residential' WHEN (u * 7 + v) % 4 = 2 THEN 'tertiary' ELSE 'track' END AS road_class FROM (
 SELECT node_id AS u, node_id + 1 AS v FROM {nodes} WHERE node_id % 40 < 39
 UNION ALL SELECT node_id, node_id + 40 FROM {nodes}
 UNION ALL SELECT node_id, node_id + 41 FROM {nodes} WHERE node_id % 40 < 39 AND (node_id * 31) % 5 = 0) q WHERE v < (SELECT count(*) FROM {nodes})"""
MOVED = f"""SELECT node_id, x + CAST((node_id * 13) % 17 - 8 AS DOUBLE) / {K} AS x, y + CAST((node_id * 29) % 19 - 9 AS DOUBLE) / {K} AS y FROM {{nodes}}"""
POINTS = f"""SELECT c_custkey AS point_id, CAST((c_custkey * 7907) % 40960 AS DOUBLE) / {K} AS px, CAST((c_custkey * 6151) % 51200 AS DOUBLE) / {K} AS py, c_mktsegment AS segment FROM {{customer}}"""
LINES = f"""SELECT o_orderkey AS line_id, CAST((o_orderkey * 5) % 200 AS DOUBLE) / CAST(8 AS DOUBLE) AS x1, CAST((o_orderkey * 3) % 160 AS DOUBLE) / CAST(8 AS DOUBLE) AS y1,
 CAST((o_orderkey * 5) % 200 + (o_orderkey * 11) % 9 AS DOUBLE) / CAST(8 AS DOUBLE) AS x2, CAST((o_orderkey * 3) % 160 + (o_orderkey * 17) % 7 AS DOUBLE) / CAST(8 AS DOUBLE) AS y2 FROM {{orders}}""".replace("{{", "{").replace("}}", "}")
RAW = """SELECT l_partkey AS u, 1000000 + l_suppkey AS v, l_quantity AS length, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS flag FROM {lineitem}"""
#: Customers and their orders: one component a customer, some without any order.
TRADERS = "SELECT c_custkey AS node_id FROM {customer} UNION ALL SELECT 1000000000 + o_orderkey FROM {orders}"
TRADE = "SELECT o_custkey AS u, 1000000000 + o_orderkey AS v FROM {orders}"
PEAKS = """SELECT CAST((s_suppkey * 23) % 64 AS DOUBLE) AS x, CAST((s_suppkey * 37) % 64 AS DOUBLE) AS y, s_acctbal AS ele FROM {supplier}"""
STATIONS = f"""SELECT s_suppkey AS station_id, CAST((s_suppkey * 1237) % 4096 AS DOUBLE) / {K} AS x, CAST((s_suppkey * 2741) % 4096 AS DOUBLE) / {K} AS y FROM {{supplier}}"""
RINGS_SPARK = "SELECT vec_id AS poly_id, CAST(k AS BIGINT) AS pos, (1 + 0.5D * CAST(e AS DOUBLE)) * cos(2 * pi() * k / 64) AS x, (1 + 0.5D * CAST(e AS DOUBLE)) * sin(2 * pi() * k / 64) AS y FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS k, e"
RINGS_DUCK = "SELECT vec_id AS poly_id, k AS pos, (1 + 0.5 * CAST(embedding[k + 1] AS DOUBLE)) * cos(2 * pi() * k / 64) AS x, (1 + 0.5 * CAST(embedding[k + 1] AS DOUBLE)) * sin(2 * pi() * k / 64) AS y FROM embeddings, range(64) t(k)"


@dataclass(frozen=True)
class Inputs:
    """Lazy tables of one scale factor."""

    spark: SparkSession
    sf: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    @property
    def nodes(self) -> DataFrame:
        return self.sql(NODES, part=self.table("part"))

    @property
    def edges(self) -> DataFrame:
        return self.sql(EDGES, nodes=self.nodes)

    @property
    def moved(self) -> DataFrame:
        return self.sql(MOVED, nodes=self.nodes)

    @property
    def traders(self) -> DataFrame:
        return self.sql(TRADERS, customer=self.table("customer"), orders=self.table("orders"))

    @property
    def trade(self) -> DataFrame:
        return self.sql(TRADE, orders=self.table("orders"))

    @property
    def points(self) -> DataFrame:
        return self.sql(POINTS, customer=self.table("customer"))

    @property
    def lines(self) -> DataFrame:
        return self.sql(LINES, orders=self.table("orders"))

    @property
    def raw(self) -> DataFrame:
        return self.sql(RAW, lineitem=self.table("lineitem"))

    @property
    def peaks(self) -> DataFrame:
        return self.sql(PEAKS, supplier=self.table("supplier"))

    @property
    def stations(self) -> DataFrame:
        return self.sql(STATIONS, supplier=self.table("supplier"))

    @property
    def rings(self) -> DataFrame:
        return self.sql(RINGS_SPARK, embeddings=self.table("embeddings"))


#: The same inputs as DuckDB common table expressions.
CTES = {
    "nodes": NODES.format(part="part"), "edges": EDGES.format(nodes="nodes"), "moved": MOVED.format(nodes="nodes"), "traders": TRADERS.format(customer="customer", orders="orders"), "trade": TRADE.format(orders="orders"),
    "points": POINTS.format(customer="customer"), "lines": LINES.format(orders="orders"), "raw": RAW.format(lineitem="lineitem"), "peaks": PEAKS.format(supplier="supplier"),
    "stations": STATIONS.format(supplier="supplier"), "rings": RINGS_DUCK,
}
NEEDS = {"edges": ["nodes"], "moved": ["nodes"], "trade": ["traders"]}


def with_inputs(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` (which may start with further ``name AS (...)`` entries and a ``SELECT``) behind the inputs it uses."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {'RECURSIVE ' * recursive}{head}{', ' if not sql.lstrip().upper().startswith('SELECT') else ' '}{sql}"
