"""Spatial operators over two double columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x1 - x2) + F.abs(y1 - y2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of radius EARTH_KM; arguments in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


METRICS = {"euclidean": euclidean, "manhattan": manhattan, "haversine": haversine}


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """box: (min x, min y, max x, max y), edges included."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def boxes_meet(a: tuple, b: tuple) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def box_area(a: tuple) -> float:
    return (a[2] - a[0]) * (a[3] - a[1])


def expand_box(a: tuple, x: float, y: float) -> tuple:
    return min(a[0], x), min(a[1], y), max(a[2], x), max(a[3], y)


def boxes_of(points: DataFrame, by: str, x: str = "lat", y: str = "lon") -> DataFrame:
    """The bounding box of each group: (by, x1, y1, x2, y2)."""
    return points.groupBy(by).agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"))


def meets(box: tuple) -> Column:
    """Whether columns x1, y1, x2, y2 meet a box, edges included."""
    return (F.col("x1") <= box[2]) & (F.lit(box[0]) <= F.col("x2")) & (F.col("y1") <= box[3]) & (F.lit(box[1]) <= F.col("y2"))


def expanded(boxes: DataFrame, x: float, y: float) -> DataFrame:
    """Boxes grown to take in a point."""
    return boxes.withColumns({"x1": F.least("x1", F.lit(x)), "y1": F.least("y1", F.lit(y)), "x2": F.greatest("x2", F.lit(x)), "y2": F.greatest("y2", F.lit(y))})


def area() -> Column:
    return (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges to the right of the point."""
    crossings = []
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if y1 == y2:
            continue
        at = F.lit(float(x1)) + (y - F.lit(float(y1))) * F.lit((x2 - x1) / (y2 - y1))
        crossings.append((((y < y1) != (y < y2)) & (x < at)).cast("int"))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def query_box(points: DataFrame, box: tuple, x: str = "lat", y: str = "lon") -> DataFrame:
    return points.filter(in_box(F.col(x), F.col(y), box))


def query_knn(points: DataFrame, at: tuple[float, float], k: int, metric: str = "euclidean", id_col: str = "id", x: str = "lat", y: str = "lon") -> DataFrame:
    d = METRICS[metric](F.col(x), F.col(y), F.lit(float(at[0])), F.lit(float(at[1])))
    return points.select(id_col, F.round(d, 6).alias("distance")).orderBy("distance", id_col).limit(k)


def query_radius(points: DataFrame, at: tuple[float, float], radius: float, metric: str = "euclidean", id_col: str = "id", x: str = "lat", y: str = "lon") -> DataFrame:
    d = METRICS[metric](F.col(x), F.col(y), F.lit(float(at[0])), F.lit(float(at[1])))
    return points.select(id_col, F.round(d, 6).alias("distance")).filter(F.col("distance") <= radius)


def query_polygon(points: DataFrame, corners: list[tuple[float, float]], x: str = "lat", y: str = "lon") -> DataFrame:
    return points.filter(in_polygon(F.col(x), F.col(y), corners))


def spatial_stats(points: DataFrame, x: str = "lat", y: str = "lon") -> DataFrame:
    area = (F.max(x) - F.min(x)) * (F.max(y) - F.min(y))
    return points.agg(F.count("*").alias("points"), F.min(x).alias("min_lat"), F.max(x).alias("max_lat"), F.min(y).alias("min_lon"), F.max(y).alias("max_lon"), F.round(F.count("*") / area, 6).alias("density"))
