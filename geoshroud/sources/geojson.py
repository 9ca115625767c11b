"""GeoJSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string,geometries:string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``feature_id, type, coordinates, geometries (JSON texts), attrs`` of a FeatureCollection; a missing path raises FileNotFoundError."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    f = spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(F.posexplode("features").alias("feature_id", "f"))
    return f.select(F.col("feature_id").cast("long").alias("feature_id"), "f.geometry.type", "f.geometry.coordinates", "f.geometry.geometries", F.col("f.properties").alias("attrs"))


def points(features: DataFrame) -> DataFrame:
    c = F.from_json("coordinates", "array<double>")
    return features.filter("type = 'Point'").select("feature_id", c[0].alias("x"), c[1].alias("y"), "attrs")


def lines(features: DataFrame) -> DataFrame:
    """``feature_id, pos, x, y`` of the vertices of LineString features."""
    c = F.from_json("coordinates", "array<array<double>>")
    v = features.filter("type = 'LineString'").select("feature_id", F.posexplode(c).alias("pos", "p"))
    return v.select("feature_id", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def number(c: str) -> Column:
    return F.format_string("%.10f", F.col(c))


def point_features(nodes: DataFrame) -> DataFrame:
    """``node_id, feature``: one GeoJSON Point text a node."""
    return nodes.select("node_id", F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), number("x"), F.lit(","), number("y"), F.lit(']},"properties":{"node_id":'), F.col("node_id").cast("string"), F.lit("}}")).alias("feature"))


def line_features(ends: DataFrame) -> DataFrame:
    """``u, v, feature``: one GeoJSON LineString text an edge."""
    xy = [F.lit("["), number("ux"), F.lit(","), number("uy"), F.lit("],["), number("vx"), F.lit(","), number("vy"), F.lit("]")]
    return ends.select("u", "v", F.concat(F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":['), *xy, F.lit(']},"properties":{"u":'), F.col("u").cast("string"), F.lit(',"v":'), F.col("v").cast("string"), F.lit("}}")).alias("feature"))


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one file a partition."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


def features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``feature``: GeoJSON texts of all nodes (Point) and edges (LineString) with all their attributes, in the order of names."""
    from ..operators.graph import with_ends
    from ..operators.labelled import payload

    p = nodes.select(F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), number("x"), F.lit(","), number("y"), F.lit(']},"properties":'), payload(nodes, "x", "y"), F.lit("}")).alias("feature"))
    ends = with_ends(edges.withColumn("_p", payload(edges)), nodes)
    xy = [F.lit("["), number("ux"), F.lit(","), number("uy"), F.lit("],["), number("vx"), F.lit(","), number("vy"), F.lit("]")]
    l = ends.select(F.concat(F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":['), *xy, F.lit(']},"properties":'), F.col("_p"), F.lit("}")).alias("feature"))
    return p.unionByName(l)


def write_collection(nodes: DataFrame, edges: DataFrame, path: str, checksum: str = "", version: str = "0.1") -> None:
    """One FeatureCollection with its checksum, as text files that make one document when put together in order of their names.

    Texts are in three folders by part (0 head, 1 features, 2 tail), so features are written by many tasks.
    """
    spark = nodes.sparkSession
    meta = '],"properties":{"version":"%s","checksum":"%s"}}' % (version, checksum)
    rows = features(nodes, edges).select(F.lit(1).alias("part"), F.concat(F.lit(","), F.col("feature")).alias("value"))
    ends = spark.createDataFrame([(0, '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":null,"properties":{}}'), (2, meta)], "part int, value string")
    ends.unionByName(rows).write.mode("overwrite").partitionBy("part").text(path)
