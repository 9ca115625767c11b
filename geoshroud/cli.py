"""Command line: ``python -m geoshroud keygen | anonymise | verify``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import keyed
from .operators import labelled, layers, reembed
from .sources import geojson, layerfile, svg


def _graph(spark: SparkSession, path: str) -> labelled.Labelled:
    """Lines of a layer file as a labelled graph."""
    lines = layers.parts(layerfile.read_layer(spark, path)).filter("type = 'LineString'")
    xy = F.transform(F.from_json("coordinates", "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    road = F.coalesce(F.try_element_at(F.col("attrs"), F.lit("road_class")), F.try_element_at(F.col("attrs"), F.lit("highway")), F.lit("unknown"))
    return labelled.to_labelled(lines.select(F.xxhash64("part_id").bitwiseAND(F.lit((1 << 61) - 1)).alias("line_id"), xy.alias("path"), road.alias("road_class")))


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="geoshroud", description="Topology-preserving map anonymisation.")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("keygen", help="write a new key").add_argument("--output", "-o", required=True)
    a = sub.add_parser("anonymise", help="re-embed the roads of a layer file")
    for name, short in (("--input", "-i"), ("--key", "-k"), ("--output", "-o")):
        a.add_argument(name, short, required=True)
    a.add_argument("--svg", action=argparse.BooleanOptionalAction, default=True)
    v = sub.add_parser("verify", help="compare the checksum of a layer file's roads")
    for name, short in (("--input", "-i"), ("--key", "-k"), ("--checksum", "-c")):
        v.add_argument(name, short, required=True)
    o = top.parse_args(args)
    if o.command == "keygen":
        key = keyed.generate_key()
        keyed.save_key(key, o.output)
        print(f"key in {o.output}, fingerprint {keyed.key_fingerprint(key)}")
        return 0
    spark, key = SparkSession.builder.getOrCreate(), keyed.load_key(o.key)
    g = _graph(spark, o.input)
    got = labelled.checksum(g, key).first()["checksum"]
    if o.command == "verify":
        print("the checksum agrees" if got == o.checksum else "the checksum differs")
        return int(got != o.checksum)
    moved = reembed.reembed(g.nodes, g.edges, key=key).select("node_id", "x", "y")
    geojson.write_collection(moved, g.edges, o.output, got)
    if o.svg:
        svg.page(moved, g.edges).orderBy("layer", "id").select(F.col("element").alias("value")).coalesce(1).write.mode("overwrite").text(o.output + ".svg")
    print(f"checksum {got}")
    return 0
