import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import colour
from tidemark.operators import raster


def test_kernels():
    x = np.arange(30.0).reshape(5, 6)
    flat = np.full((5, 6), 3.0)
    for f in (lambda v: raster.box_filter(v, 2), lambda v: raster.gaussian_blur(v, 1.0), lambda v: raster.guided_filter(v, 1, 0.1), lambda v: raster.min_filter(v, 1)):
        assert np.allclose(f(flat), flat)
    assert raster.min_filter(x, 1)[2, 2] == x[1, 1] and raster.box_filter(x, 1)[2, 2] == x[1:4, 1:4].mean()
    assert np.allclose(raster.resize(x, 6, 5), x) and np.allclose(raster.resize(flat, 3, 2), 3.0)
    assert (raster.unpack(raster.pack(x)) == x.astype(np.uint8).ravel()).all() and raster.unpack("no") is None


def test_rasters_are_rows(spark):
    rows = spark.createDataFrame([(1, 3, 2, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (2, 3, 2, [1.0]), (3, None, None, None)], raster.RASTER)
    got = {r["id"]: r for r in raster.map_rasters(rows, lambda x: raster.quarter_turns(x, 1)).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["pixels"]) == (2, 3, [4.0, 1.0, 5.0, 2.0, 6.0, 3.0])
    assert got[2]["pixels"] is None and got[3]["pixels"] is None
    assert raster.map_rasters(rows.limit(0), lambda x: x).count() == 0


def test_colour_difference_and_bands(spark):
    lab = [F.lit(v) for v in (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485)]
    bands = colour.band_weights(F.col("id") * 1.0)
    r = spark.range(1).select(F.round(colour.delta_e_2000(*lab), 4).alias("d"), *(c.alias(n) for n, c in zip("lab", colour.xyz_to_lab(F.lit(0.96422), F.lit(1.0), F.lit(0.82521)), strict=True))).first()
    assert r["d"] == 2.0425 and abs(r["l"] - 100) < 1e-9 and abs(r["a"]) < 1e-9
    sums = spark.range(360).select(F.aggregate(bands, F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9
