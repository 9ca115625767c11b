"""A whole map sheet: roads, tagged layers and elevation from files, each part failing softly."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import layers, raster
from . import geotiff, layerfile

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Sheet:
    """The layers by name, pixels of elevation, and where those came from (``file`` or ``peaks``)."""

    layers: dict[str, DataFrame]
    dem: DataFrame
    dem_source: str
    bbox: tuple[float, float, float, float]

    def summary(self) -> str:
        rows = [f"  {name + ':':<13}{t.count():>6d} features" for name, t in self.layers.items()]
        return "\n".join(["Map sheet", *rows, f"  {'dem:':<13}{self.dem.count():>6d} pixels ({self.dem_source})", f"  bbox (N,S,E,W): {self.bbox}"])


def load(spark: SparkSession, features: str, bbox: tuple[float, float, float, float], dem: str | None = None, step: float = 0.0003) -> Sheet:
    """Layers of a feature file told apart by their tags; elevation from a GeoTIFF, or from the peaks where there is none.

    A feature file that cannot be read leaves every layer empty (and logs a warning); so does a model leave the peaks' surface.
    ``bbox`` is (north, south, east, west); ``step`` the grid of that surface.
    """
    found = layerfile.bundle(layerfile.read_or_empty(spark, features, "features"))
    if dem is not None:
        try:
            pixels = geotiff.read_dem(spark, dem)
            pixels.limit(1).count()
            return Sheet(found, pixels.select("row", "col", "z"), "file", bbox)
        except Exception as why:  # noqa: BLE001  the sheet is usable without a model
            log.warning("elevation from peaks, as the model cannot be read: %s", why)
    n, s, e, w = bbox
    at = layers.point_parts(layers.parts(found["peaks"]))
    peaks = at.selectExpr("px AS x", "py AS y", "try_element_at(attrs, 'ele') AS ele")
    return Sheet(found, raster.idw(spark, peaks, max(1, int((n - s) / step)), max(1, int((e - w) / step)), w, s, step), "peaks", bbox)
