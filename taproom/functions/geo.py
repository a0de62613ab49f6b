"""Distances and grid cells as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from taproom import vocab as V

EARTH_METRES = 6_371_000.0
EARTH_KM = 6371.0
CELL_MARGIN = 1.001
METRES_PER_DEGREE = EARTH_METRES * math.pi / 180.0


def haversine(
    lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_METRES
) -> Column:
    """Great-circle distance in the unit of the radius."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(radius) * 2 * F.asin(F.sqrt(half))


def area_distance_km(area: Column, lat: Column, lon: Column) -> Column:
    """Kilometres from an area's centre, two decimals; null without an area."""
    known = ", ".join(
        f"'{name}', named_struct('lat', {c_lat}D, 'lon', {c_lon}D)"
        for name, (c_lat, c_lon) in V.AREA_CENTRES.items()
    )
    centre = F.try_element_at(F.expr(f"map({known})"), area)
    return F.round(haversine(centre["lat"], centre["lon"], lat, lon, EARTH_KM), 2)


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whole metres on a flat approximation with 111 km per degree; null if a side is unknown."""
    north = (lat2 - lat1) * 111000.0
    east = (lon2 - lon1) * 111000.0 * F.cos(lat1 * math.pi / 180.0)
    return F.floor(F.sqrt(north * north + east * east) + 0.5).cast("long")


def cell_row(lat: Column, metres: float) -> Column:
    """Grid row of a latitude for square cells at least this many metres high."""
    return F.floor(lat * (METRES_PER_DEGREE / (metres * CELL_MARGIN))).cast("long")


def cell_column(lon: Column, row: Column, metres: float) -> Column:
    """Grid column of a longitude inside one grid row.

    The degree width of a cell is fixed per row, from a latitude one row nearer to the pole than
    the row itself, so two points within the given metres are never more than one column apart
    even when they stand in different rows.
    """
    step = metres / METRES_PER_DEGREE
    far_edge = (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * step
    width = F.greatest(F.cos(F.radians(F.least(far_edge, F.lit(89.9)))), F.lit(0.001))
    return F.floor(lon * width * (METRES_PER_DEGREE / (metres * CELL_MARGIN))).cast("long")


def home_cell(lat: Column, lon: Column, metres: float) -> Column:
    """The cell of a point as struct<row,col>."""
    row = cell_row(lat, metres)
    return F.struct(row.alias("row"), cell_column(lon, row, metres).alias("col"))


def near_cells(lat: Column, lon: Column, metres: float) -> Column:
    """The up to nine cells that hold every point within the given metres."""
    row = cell_row(lat, metres)
    rows = F.array(row - 1, row, row + 1)
    return F.flatten(
        F.transform(
            rows,
            lambda r: F.transform(
                F.array(F.lit(-1), F.lit(0), F.lit(1)),
                lambda shift: F.struct(
                    r.alias("row"), (cell_column(lon, r, metres) + shift).alias("col")
                ),
            ),
        )
    )
