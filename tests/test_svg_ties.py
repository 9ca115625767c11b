"""SVG coordinates have the digits of C's printf."""

from geoshroud.sources import svg


def test_page_coordinates_round_like_printf(spark):
    xs = [0.0, 0.25, 0.75, 0.15, 0.35, 12.05, 99.95, 524.25, 0.049999999999999996, 1234.25, 2000.0]
    n = spark.createDataFrame([(i, x, x) for i, x in enumerate(xs)], "node_id long, x double, y double")
    e = spark.createDataFrame([(i, i + 1) for i in range(len(xs) - 1)], "u long, v long")
    text = [f"{x / 2000 * 2000:.1f}" for x in xs]
    out = {r["id"]: r["element"] for r in svg.page(n, e, 2000.0, 2000.0, 0.0).collect()}
    for i, t in enumerate(text):
        assert f'<circle cx="{t}" cy="{t}"' in out[str(i)]
        if i:
            assert f'<line x1="{text[i - 1]}" y1="{text[i - 1]}" x2="{t}" y2="{t}"' in out[f"{i - 1}-{i}"]
