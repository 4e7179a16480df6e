"""Rasters as pixel tables and back."""

import math

import numpy as np


def raster(spark, array, map_no=0, **extra):
    """A pixel table from a 2-D array; NaN becomes NULL."""
    h, w = array.shape
    rows = [
        (map_no, i, j, h, w, None if math.isnan(float(array[i, j])) else float(array[i, j]))
        for i in range(h) for j in range(w)
    ]
    return spark.createDataFrame(rows, "map_no bigint, r bigint, c bigint, height bigint, width bigint, z double")


def grid_of(df, value, shape):
    out = np.full(shape, np.nan)
    for row in df.select("r", "c", value).collect():
        if row[value] is not None:
            out[row["r"], row["c"]] = row[value]
    return out
