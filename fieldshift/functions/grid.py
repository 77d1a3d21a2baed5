"""Grids: where cells lie, how large they are, and how projected and geographic coordinates relate."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The common grid.
CRS = "EPSG:32636"
RESOLUTION = 10.0
ORIGIN = (0.0, 0.0)

# WGS 84
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
ECCENTRICITY2 = FLATTENING * (2 - FLATTENING)


@dataclass(frozen=True)
class Grid:
    """A north-up grid: the upper left corner, cell sizes, the number of rows and columns, and metres in a unit."""

    left: float
    top: float
    cell_x: float
    cell_y: float
    width: int
    height: int
    crs: str = CRS
    metres: float = 1.0

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (self.left, self.top, self.cell_x, self.cell_y))):
            raise ValueError("grid coordinates must be finite")
        if self.cell_x * self.cell_y == 0 or self.width <= 0 or self.height <= 0:
            raise ValueError("grid without extent")

    @property
    def cell_area(self) -> float:
        return abs(self.cell_x * self.cell_y) * self.metres**2

    @property
    def cell_size(self) -> float:
        return (abs(self.cell_x) + abs(self.cell_y)) / 2

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top"""
        return (self.left, self.top - self.height * self.cell_y, self.left + self.width * self.cell_x, self.top)

    def x(self, col: Column) -> Column:
        return F.lit(self.left) + (col + F.lit(0.5)) * F.lit(self.cell_x)

    def y(self, row: Column) -> Column:
        return F.lit(self.top) - (row + F.lit(0.5)) * F.lit(self.cell_y)

    def require_same(self, other: Grid) -> None:
        """Rasters must agree in everything before their cells are joined."""
        if self != other:
            raise ValueError(f"grids differ: {self} and {other}")


def snap_down(value: Column, step: float = RESOLUTION, origin: float = 0.0) -> Column:
    return F.floor((value - F.lit(origin)) / F.lit(step)) * F.lit(step) + F.lit(origin)


def snap_up(value: Column, step: float = RESOLUTION, origin: float = 0.0) -> Column:
    return F.ceil((value - F.lit(origin)) / F.lit(step)) * F.lit(step) + F.lit(origin)


def covering_grid(left: float, bottom: float, right: float, top: float, step: float = RESOLUTION, crs: str = CRS) -> Grid:
    """The grid of whole lattice cells around a box."""
    (ox, oy), down, up = ORIGIN, math.floor, math.ceil
    x0, y0 = down((left - ox) / step) * step + ox, down((bottom - oy) / step) * step + oy
    x1, y1 = up((right - ox) / step) * step + ox, up((top - oy) / step) * step + oy
    return Grid(x0, y1, step, step, int(up((x1 - x0) / step)), int(up((y1 - y0) / step)), crs)


def band_area(south: Column, north: Column, width_degrees: float) -> Column:
    """Area in square metres between two latitudes (degrees) over a span of longitude, on the ellipsoid, exactly."""
    e = math.sqrt(ECCENTRICITY2)

    def q(latitude: Column) -> Column:
        s = F.sin(F.radians(latitude))
        es = F.lit(e) * s
        return s / (F.lit(1.0) - es * es) + F.log((F.lit(1.0) + es) / (F.lit(1.0) - es)) / F.lit(2 * e)

    half = AXIS * AXIS * (1 - ECCENTRICITY2) / 2
    return F.abs(q(north) - q(south)) * F.lit(half * math.radians(abs(width_degrees)))


def _series(order: int = 4) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the Krüger coefficients for the forward and the inverse transverse Mercator series."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward[:order], inverse[:order]


def _zone(crs: str) -> tuple[float, float]:
    """Central meridian (degrees) and false northing of a UTM code."""
    code = int(crs.split(":")[1])
    if not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"{crs} is not a UTM zone on WGS 84")
    return (code % 100) * 6 - 183.0, 0.0 if code < 32700 else 1e7


def to_utm(longitude, latitude, crs: str = CRS):
    """Easting and northing of arrays of degrees."""
    meridian, north = _zone(crs)
    radius, forward, _ = _series()
    e = math.sqrt(ECCENTRICITY2)
    s = np.sin(np.radians(latitude))
    t = np.sinh(np.arctanh(s) - e * np.arctanh(e * s))
    lam = np.radians(np.asarray(longitude) - meridian)
    xi, eta = np.arctan2(t, np.cos(lam)), np.arcsinh(np.sin(lam) / np.hypot(t, np.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(forward, 1):
        x = x + a * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
        y = y + a * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
    return 500000 + 0.9996 * radius * x, north + 0.9996 * radius * y


def from_utm(easting, northing, crs: str = CRS):
    """Longitude and latitude in degrees of arrays of metres."""
    meridian, north = _zone(crs)
    radius, _, inverse = _series()
    xi0, eta0 = (np.asarray(northing) - north) / (0.9996 * radius), (np.asarray(easting) - 500000) / (0.9996 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(inverse, 1):
        xi = xi - b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0)
        eta = eta - b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0)
    chi = np.arcsin(np.sin(xi) / np.cosh(eta))
    e = math.sqrt(ECCENTRICITY2)
    conformal = np.sinh(np.arctanh(np.sin(chi)))
    tau = conformal.copy() if hasattr(conformal, "copy") else conformal
    for _ in range(6):  # Newton steps from conformal to geographic latitude
        sigma = np.sinh(e * np.arctanh(e * tau / np.sqrt(1 + tau * tau)))
        guess = tau * np.sqrt(1 + sigma * sigma) - sigma * np.sqrt(1 + tau * tau)
        slope = (1 + (1 - ECCENTRICITY2) * tau * tau) / ((1 - ECCENTRICITY2) * np.sqrt((1 + guess * guess) * (1 + tau * tau)))
        tau = tau + (conformal - guess) * slope
    return meridian + np.degrees(np.arctan2(np.sinh(eta), np.cos(xi))), np.degrees(np.arctan(tau))


def to_degrees(x, y, crs: str):
    """Longitude and latitude of arrays of coordinates: degrees, UTM on WGS 84, or spherical Mercator."""
    if crs == "EPSG:4326":
        return np.asarray(x, float), np.asarray(y, float)
    if crs == "EPSG:3857":
        return np.degrees(np.asarray(x) / AXIS), np.degrees(np.arctan(np.sinh(np.asarray(y) / AXIS)))
    return from_utm(x, y, crs)


def from_degrees(longitude, latitude, crs: str):
    """The reverse of :func:`to_degrees`."""
    if crs == "EPSG:4326":
        return np.asarray(longitude, float), np.asarray(latitude, float)
    if crs == "EPSG:3857":
        return AXIS * np.radians(longitude), AXIS * np.arcsinh(np.tan(np.radians(latitude)))
    return to_utm(longitude, latitude, crs)


def project(x, y, source: str, target: str):
    """Coordinates taken from one system to another; ValueError for a system that isn't known."""
    if source == target:
        return np.asarray(x, float), np.asarray(y, float)
    return from_degrees(*to_degrees(np.asarray(x, float), np.asarray(y, float), source), target)


def project_box(box: tuple[float, float, float, float], source: str, target: str, steps: int = 33) -> tuple[float, float, float, float]:
    """The box around a box's edges in another system: left, bottom, right, top."""
    left, bottom, right, top = box
    xs, ys = np.linspace(left, right, steps), np.linspace(bottom, top, steps)
    edge_x = np.concatenate([xs, xs, np.full(steps, left), np.full(steps, right)])
    edge_y = np.concatenate([np.full(steps, bottom), np.full(steps, top), ys, ys])
    x, y = project(edge_x, edge_y, source, target)
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def nice_length(length: float) -> float:
    """The largest of 1, 2 or 5 times a power of ten that is not above ``length``; 1 for no length."""
    if length <= 0:
        return 1.0
    power = 10.0 ** math.floor(math.log10(length))
    return power * next(step for step in (5, 2, 1) if length / power >= step or step == 1)
