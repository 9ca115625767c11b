"""Layer files by their extension: GeoJSON, shapefile, Parquet; and layers that may fail."""

from __future__ import annotations

import logging
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import geojson

SCHEMA = "feature_id long, type string, coordinates string, geometries string, attrs map<string,string>"
log = logging.getLogger(__name__)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _ring_area(ring: list[list[float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def shapes(b: bytes):
    """(record number, type, coordinates) of a .shp file's records; null shapes give None (ESRI Shapefile Technical Description)."""
    at = 100
    while at + 8 <= len(b):
        number, words = struct.unpack(">ii", b[at : at + 8])
        r, at = b[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        kind = struct.unpack("<i", r[:4])[0] % 10  # 11.. and 21.. are the same with z or m behind
        if kind == 1:
            yield number, "Point", list(struct.unpack("<2d", r[4:20]))
        elif kind == 8:
            n = struct.unpack("<i", r[36:40])[0]
            yield number, "MultiPoint", [list(struct.unpack("<2d", r[40 + 16 * i : 56 + 16 * i])) for i in range(n)]
        elif kind in (3, 5):
            n_parts, n = struct.unpack("<2i", r[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", r[44 : 44 + 4 * n_parts]), n]
            o = 44 + 4 * n_parts
            xy = [list(struct.unpack("<2d", r[o + 16 * i : o + 16 * i + 16])) for i in range(n)]
            runs = [xy[a:z] for a, z in zip(starts, starts[1:])]
            if kind == 3:
                yield (number, "LineString", runs[0]) if n_parts == 1 else (number, "MultiLineString", runs)
                continue
            polygons: list[list] = []
            for ring in runs:  # outer rings are clockwise, holes follow theirs
                if _ring_area(ring) > 0 and polygons:
                    polygons[-1].append(ring)
                else:
                    polygons.append([ring])
            yield (number, "Polygon", polygons[0]) if len(polygons) == 1 else (number, "MultiPolygon", polygons)
        else:
            yield number, None, None


def records(b: bytes):
    """Attribute maps of a .dbf file's records, as texts; blanks are null, deleted records None."""
    count, head, size = struct.unpack("<iHH", b[4:12])
    fields, at = [], 32
    while b[at] != 0x0D:
        fields.append((b[at : at + 11].split(b"\0")[0].decode("latin-1"), b[at + 16]))
        at += 32
    for i in range(count):
        r, o, out = b[head + i * size : head + (i + 1) * size], 1, {}
        for name, width in fields:
            out[name] = r[o : o + width].decode("utf-8", "replace").strip() or None
            o += width
        yield None if r[:1] == b"*" else out


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of a .shp file (or a folder of them) with the attributes of the .dbf beside it; one file is one task's work."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)

    import json

    def load(name: str):
        def go(batches):
            for b in batches:
                for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    stem = file.rpartition(".")[0]
                    if name == "shp":
                        rows = [(stem, i, t, json.dumps(c)) for i, t, c in shapes(content) if t]
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))] if rows else [pa.array([], k) for k in (pa.string(), pa.int64(), pa.string(), pa.string())], ["stem", "feature_id", "type", "coordinates"])
                    else:
                        rows = [(stem, i + 1, list(r.items())) for i, r in enumerate(records(content)) if r is not None]
                        kinds = (pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()))
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["stem", "feature_id", "attrs"])

        return go

    files = lambda p: spark.read.format("binaryFile").load(p).select("path", "content")
    one = path.lower().endswith(".shp")
    shp = files(path) if one else spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")
    out = shp.mapInArrow(load("shp"), "stem string, feature_id long, type string, coordinates string")
    dbf = path[:-4] + ".dbf" if one else path
    if one and not _exists(spark, dbf):
        out = out.withColumn("attrs", F.create_map().cast("map<string,string>"))
    else:
        d = files(dbf) if one else spark.read.format("binaryFile").option("pathGlobFilter", "*.dbf").load(path).select("path", "content")
        out = out.join(d.mapInArrow(load("dbf"), "stem string, feature_id long, attrs map<string,string>"), ["stem", "feature_id"], "left")
    return out.select("feature_id", "type", "coordinates", F.lit(None).cast("string").alias("geometries"), "attrs")


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """``feature_id, type, coordinates, geometries, attrs`` of a GeoJSON, shapefile or Parquet layer.

    A missing path raises FileNotFoundError, another kind of file ValueError.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    kind = path.rstrip("/").lower().rpartition(".")[2]
    if kind in ("geojson", "json"):
        return geojson.read_geojson(spark, path)
    if kind == "shp":
        return read_shapefile(spark, path)
    if kind == "parquet":
        return spark.read.schema(SCHEMA).parquet(path)
    raise ValueError(f"no reader for {kind!r} files")


def read_or_empty(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A layer, or a table without rows (and a warning) if it cannot be read."""
    try:
        out = read_layer(spark, path)
        out.limit(1).count()
        return out
    except Exception as why:  # noqa: BLE001  any reader's failure leaves the other layers usable
        log.warning("layer %s is left empty: %s", name, why)
        return spark.createDataFrame([], SCHEMA)


def tagged(features: DataFrame, tags: dict[str, bool | list[str]]) -> DataFrame:
    """Features with any of the tags: a key with any value (True), or with one of the listed."""
    want = F.lit(False)
    for key, values in tags.items():
        v = F.try_element_at(F.col("attrs"), F.lit(key))
        want = want | (v.isNotNull() if values is True else F.coalesce(v.isin(*values), F.lit(False)))
    return features.filter(want)


#: The tags of each layer of a map sheet.
LAYERS = {
    "buildings": {"building": True}, "coastline": {"natural": ["coastline"]}, "landuse": {"landuse": True, "natural": ["wood", "scrub", "grassland", "bare_rock"]},
    "water": {"natural": ["water"], "waterway": True}, "settlements": {"place": ["town", "village", "hamlet", "suburb"]}, "peaks": {"natural": ["peak"]},
}


def bundle(features: DataFrame) -> dict[str, DataFrame]:
    """All layers of a sheet from one table of features; a feature can be in several."""
    return {name: tagged(features, tags) for name, tags in LAYERS.items()}


def layer_counts(features: DataFrame) -> DataFrame:
    """``layer, n`` of every layer of a sheet, in one pass."""
    is_in = []
    for name, tags in LAYERS.items():
        want = F.lit(False)
        for key, values in tags.items():
            v = F.try_element_at(F.col("attrs"), F.lit(key))
            want = want | (v.isNotNull() if values is True else F.coalesce(v.isin(*values), F.lit(False)))
        is_in.append(F.struct(F.lit(name).alias("layer"), want.cast("long").alias("n")))
    return features.select(F.explode(F.array(*is_in)).alias("l")).groupBy("l.layer").agg(F.sum("l.n").alias("n"))
