"""The nearest of many places, by growing cells with a proof.

Places and points are on the unit sphere, in cubes of a grid in space, so poles and the
date line are like any other place. A point looks at the places of its own and the 26
cubes around it; whatever lies within a cube's side is among them. So a point whose
nearest place is no farther is done, and the others look again in larger cubes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.session import durable

#: Sides of cubes, as parts of the earth's radius: 12 km, then four times as long each.
SIDES = tuple(2.0 ** (2 * k - 9) for k in range(6))
#: Kilometres of the earth's mean radius.
RADIUS = 6371.0088


def _on_sphere(latitude: Column, longitude: Column) -> list[Column]:
    lat, lon = F.radians(latitude), F.radians(longitude)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def nearest_places(points: DataFrame, places: DataFrame) -> DataFrame:
    """points (latitude, longitude, ...) with place and km: the name of the nearest of places (name, latitude, longitude) and how far it is along the sphere.

    Equally near places go by name. Points or places without a position (or out of
    range) are near nothing: such points have nulls, as all have where there are no
    places. Equal positions are looked up once.
    """
    good = lambda t: t.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))
    x, y, z = _on_sphere(F.col("latitude"), F.col("longitude"))
    there = durable(good(places).where("name is not null").groupBy("latitude", "longitude").agg(F.min("name").alias("name")).select("name", x.alias("px"), y.alias("py"), z.alias("pz")))
    where = durable(good(points).select("latitude", "longitude").distinct().select("latitude", "longitude", x.alias("x"), y.alias("y"), z.alias("z")))
    open_, done = where, []
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for side in SIDES:
        cube = lambda c, side=side: F.floor(F.col(c) / side).cast("int")
        dealt = there.select("*", *[cube(f"p{c}").alias(f"c{c}") for c in "xyz"])
        asks = open_.select("*", *[cube(c).alias(f"c{c}") for c in "xyz"])
        for c in "xyz":
            asks = asks.withColumn("_d", F.explode(around)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
        far = sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        met = asks.join(dealt, ["cx", "cy", "cz"]).groupBy("latitude", "longitude").agg(F.min(F.struct(far.alias("far"), "name")).alias("best"))
        proven = met.where(F.col("best.far") <= (side * side if side < SIDES[-1] else 5.0))
        done.append(durable(proven.select("latitude", "longitude", F.col("best.name").alias("place"), (2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt("best.far") / 2))).alias("km"))))
        open_ = durable(open_.join(done[-1], ["latitude", "longitude"], "left_anti"))
        if open_.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    return points.join(found, ["latitude", "longitude"], "left").select(*points.columns, "place", "km")
