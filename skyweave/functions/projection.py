"""Lambert conformal conic projection on a sphere, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LambertConic:
    """Two-parallel conic; ``to_meter`` makes the plane unit one grid cell."""

    lat_1: float
    lat_2: float
    lat_0: float
    lon_0: float
    x_0: float = 0.0
    y_0: float = 0.0
    to_meter: float = 12000.0
    radius: float = 6370000.0

    @property
    def cone(self) -> float:
        p1, p2 = math.radians(self.lat_1), math.radians(self.lat_2)
        if self.lat_1 == self.lat_2:
            return math.sin(p1)
        return math.log(math.cos(p1) / math.cos(p2)) / math.log(
            math.tan(math.pi / 4 + p2 / 2) / math.tan(math.pi / 4 + p1 / 2)
        )

    @property
    def scale(self) -> float:
        p1 = math.radians(self.lat_1)
        return (
            self.radius
            * math.cos(p1)
            * math.tan(math.pi / 4 + p1 / 2) ** self.cone
            / self.cone
        )

    @property
    def rho_0(self) -> float:
        return self.scale / math.tan(math.pi / 4 + math.radians(self.lat_0) / 2) ** self.cone

    def _polar(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        rho = F.lit(self.scale) / F.pow(
            F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(self.cone)
        )
        return rho, F.radians(lon - F.lit(self.lon_0)) * F.lit(self.cone)

    def x(self, lon: Column, lat: Column) -> Column:
        rho, theta = self._polar(lon, lat)
        return (rho * F.sin(theta) + self.x_0) / self.to_meter

    def y(self, lon: Column, lat: Column) -> Column:
        rho, theta = self._polar(lon, lat)
        return (F.lit(self.rho_0) - rho * F.cos(theta) + self.y_0) / self.to_meter

    def _plane(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x * self.to_meter - self.x_0, F.lit(self.rho_0) - (y * self.to_meter - self.y_0)

    def lon(self, x: Column, y: Column) -> Column:
        east, north = self._plane(x, y)
        return F.degrees(F.atan2(east, north) / F.lit(self.cone)) + self.lon_0

    def lat(self, x: Column, y: Column) -> Column:
        east, north = self._plane(x, y)
        return F.degrees(
            2 * F.atan(F.pow(F.lit(self.scale) / F.hypot(east, north), F.lit(1 / self.cone)))
            - F.lit(math.pi / 2)
        )


#: The 12 km continental United States grid.
CONUS_12KM = LambertConic(
    lat_1=33.0, lat_2=45.0, lat_0=40.0, lon_0=-97.0, x_0=2556000.0, y_0=1728000.0
)


def nearest_index(coordinate: Column, size: int) -> Column:
    """1-based index of the nearest cell centre; points off the grid go to the edge cell."""
    return (F.greatest(F.least(F.floor(coordinate), F.lit(size - 1)), F.lit(0)) + 1).cast("int")


def index_to_centre(index: Column) -> Column:
    return index - F.lit(0.5)


def centre_to_index(centre: Column) -> Column:
    return (centre + F.lit(0.5)).cast("int")
