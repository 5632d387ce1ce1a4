"""Map projections as column expressions, both ways.

The projections are the closed forms of Snyder, *Map Projections: A Working Manual* (1987)
and, for transverse Mercator, Krueger's series in the third flattening (to n^4). ETRS89 and
WGS 84 are taken as equal, as the usual null transformation between them does. Points are
structs ``(a, b)``: longitude and latitude, or x and y. Intermediate values are bound with
``let``, which keeps the expressions short.

Parameters are numbers, or columns where each row has a projection of its own, told by a system's
parameters and not by a code: such a system is the text ``name:parameter:parameter:...``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ecolake.session import let

# --- fixed values: ellipsoids and projection parameters ---------------------------------
GRS80 = (6378137.0, 1 / 298.257222101)
WGS84_ELLIPSOID = (6378137.0, 1 / 298.257223563)
WGS84 = "EPSG:4326"
GEOGRAPHIC = ["EPSG:4326", "EPSG:4258"]
CANDIDATE_CRS = [
    ("EPSG:3035", "ETRS89 / LAEA Europe"),
    ("EPSG:3034", "ETRS89 / LCC Europe"),
    ("EPSG:3857", "WGS 84 / Pseudo-Mercator"),
    ("EPSG:32633", "WGS 84 / UTM zone 33N"),
    ("EPSG:32634", "WGS 84 / UTM zone 34N"),
    ("EPSG:32635", "WGS 84 / UTM zone 35N"),
    ("EPSG:2180", "ETRS89 / Poland CS92"),
    ("EPSG:3006", "SWEREF99 TM"),
]
# ----------------------------------------------------------------------------------------


def _either(name: str):
    """The function of that name for columns and for numbers."""
    return lambda *x: getattr(F, name)(*x) if any(isinstance(v, Column) for v in x) else getattr(math, name)(*x)


_sin, _cos, _tan, _asin, _sqrt, _log, _radians, _atanh, _sinh, _atan = map(
    _either, ("sin", "cos", "tan", "asin", "sqrt", "log", "radians", "atanh", "sinh", "atan")
)


def _bound(constants: dict, body) -> Column:
    """``body`` of the constants by name; those that are columns are evaluated once per row."""
    if not any(isinstance(v, Column) for v in constants.values()):
        return body(constants)
    return let(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in constants.items()]), body)


def _point(first: Column, second: Column) -> Column:
    return F.struct(first.cast("double").alias("a"), second.cast("double").alias("b"))


@dataclass(frozen=True)
class Equatorial:
    """Spherical Mercator used by web maps."""

    radius: float | Column = 6378137.0
    lon0: float | Column = 0.0
    east0: float | Column = 0.0
    north0: float | Column = 0.0

    def inverse(self, x: Column, y: Column) -> Column:
        return _point(self.lon0 + F.degrees((x - self.east0) / self.radius), F.degrees(2 * F.atan(F.exp((y - self.north0) / self.radius)) - math.pi / 2))

    def forward(self, lon: Column, lat: Column) -> Column:
        north = let(F.tan(math.pi / 4 + F.radians(lat) / 2), lambda t: F.log(F.when(t > 0, t)) * self.radius)
        return _point(self.east0 + F.radians(lon - self.lon0) * self.radius, self.north0 + north)


@dataclass(frozen=True)
class TransverseMercator:
    lon0: float | Column
    scale: float | Column
    east0: float | Column
    north0: float | Column
    ellipsoid: tuple
    lat0: float | Column = 0.0

    def _constants(self) -> dict:
        a, f = self.ellipsoid
        n = f / (2 - f)
        series = {
            "a1": n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            "a2": 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            "a3": 61 * n**3 / 240 - 103 * n**4 / 140,
            "a4": 49561 * n**4 / 161280,
            "b1": n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            "b2": n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            "b3": 17 * n**3 / 480 - 37 * n**4 / 840,
            "b4": 4397 * n**4 / 161280,
            "d1": 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            "d2": 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            "d3": 56 * n**3 / 15 - 136 * n**4 / 35,
            "d4": 4279 * n**4 / 630,
        }
        e, radius = 2 * _sqrt(n) / (1 + n), a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * self.scale
        north = self.north0
        if isinstance(self.lat0, Column) or self.lat0:  # the origin lies on its own parallel
            s = _sin(_radians(self.lat0))
            xi = _atan(_sinh(_atanh(s) - e * _atanh(e * s)))
            north = north - radius * (xi + sum(series[f"a{j}"] * _sin(2 * j * xi) for j in range(1, 5)))
        return series | {"e": e, "radius": radius, "north": north}

    def inverse(self, x: Column, y: Column) -> Column:
        def of(k) -> Column:
            def sphere(p: Column) -> Column:
                xi, eta = p["a"], p["b"]
                for j in range(1, 5):
                    xi = xi - k[f"b{j}"] * F.sin(2 * j * p["a"]) * F.cosh(2 * j * p["b"])
                    eta = eta - k[f"b{j}"] * F.cos(2 * j * p["a"]) * F.sinh(2 * j * p["b"])
                return let(_point(xi, eta), ellipsoid)

            def ellipsoid(p: Column) -> Column:
                def lat(chi: Column) -> Column:
                    return sum((k[f"d{j}"] * F.sin(2 * j * chi) for j in range(1, 5)), chi)

                lon = self.lon0 + F.degrees(F.atan2(F.sinh(p["b"]), F.cos(p["a"])))
                return _point(lon, F.degrees(let(F.asin(F.sin(p["a"]) / F.cosh(p["b"])), lat)))

            return let(_point((y - k["north"]) / k["radius"], (x - self.east0) / k["radius"]), sphere)

        return _bound(self._constants(), of)

    def forward(self, lon: Column, lat: Column) -> Column:
        away = F.radians(lon - self.lon0)

        def of(k) -> Column:
            def sphere(t: Column) -> Column:
                return let(_point(F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))), plane)

            def plane(p: Column) -> Column:
                xi, eta = p["a"], p["b"]
                for j in range(1, 5):
                    xi = xi + k[f"a{j}"] * F.sin(2 * j * p["a"]) * F.cosh(2 * j * p["b"])
                    eta = eta + k[f"a{j}"] * F.cos(2 * j * p["a"]) * F.sinh(2 * j * p["b"])
                return _point(self.east0 + k["radius"] * eta, k["north"] + k["radius"] * xi)

            return let(let(F.sin(F.radians(lat)), lambda s: F.sinh(F.atanh(s) - k["e"] * F.atanh(k["e"] * s))), sphere)

        return _bound(self._constants(), of)


@dataclass(frozen=True)
class EqualAreaAzimuthal:
    """Lambert azimuthal equal area, oblique, on the ellipsoid."""

    lon0: float | Column
    lat0: float | Column
    east0: float | Column
    north0: float | Column
    ellipsoid: tuple

    def _constants(self) -> dict:
        a, f = self.ellipsoid
        e2 = f * (2 - f)
        e = _sqrt(e2)
        q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - _log((1 - e * s) / (1 + e * s)) / (2 * e))
        qp, s0 = q(1.0), _sin(_radians(self.lat0))
        beta0 = _asin(q(s0) / qp)
        rq = a * _sqrt(qp / 2)
        d = a * _cos(_radians(self.lat0)) / _sqrt(1 - e2 * s0 * s0) / (rq * _cos(beta0))
        return {"e2": e2, "e": e, "qp": qp, "sin0": _sin(beta0), "cos0": _cos(beta0), "rq": rq, "d": d}

    def inverse(self, x: Column, y: Column) -> Column:
        def of(k) -> Column:
            e2 = k["e2"]
            e4, e6 = e2 * e2, e2 * e2 * e2

            def polar(p: Column) -> Column:
                rho = F.hypot(p["a"], p["b"])
                return let(_point(rho, 2 * F.asin(rho / (2 * k["rq"]))), lambda r: sphere(p["a"], p["b"], r["a"], r["b"]))

            def sphere(dx: Column, dy: Column, rho: Column, c: Column) -> Column:
                far = rho >= 1e-9
                sine = F.cos(c) * k["sin0"] + F.when(far, dy * F.sin(c) * k["cos0"] / rho).otherwise(0.0)
                away = F.atan2(dx * F.sin(c), rho * k["cos0"] * F.cos(c) - dy * k["sin0"] * F.sin(c))
                lon = self.lon0 + F.degrees(F.when(far, away).otherwise(0.0))
                return _point(lon, F.degrees(let(F.asin(sine), latitude)))

            def latitude(beta: Column) -> Column:
                return (
                    beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
                    + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
                )

            return let(_point((x - self.east0) / k["d"], (y - self.north0) * k["d"]), polar)

        return _bound(self._constants(), of)

    def forward(self, lon: Column, lat: Column) -> Column:
        away = F.radians(lon - self.lon0)

        def of(k) -> Column:
            def authalic(s: Column) -> Column:
                q = (1 - k["e2"]) * (s / (1 - k["e2"] * s * s) - F.log((1 - k["e"] * s) / (1 + k["e"] * s)) / (2 * k["e"]))
                return let(F.asin(q / k["qp"]), plane)

            def plane(beta: Column) -> Column:
                cosine = 1 + k["sin0"] * F.sin(beta) + k["cos0"] * F.cos(beta) * F.cos(away)
                b = let(cosine, lambda c: k["rq"] * F.sqrt(2 / F.when(c > 0, c)))
                return _point(
                    self.east0 + b * k["d"] * F.cos(beta) * F.sin(away),
                    self.north0 + b / k["d"] * (k["cos0"] * F.sin(beta) - k["sin0"] * F.cos(beta) * F.cos(away)),
                )

            return let(F.sin(F.radians(lat)), authalic)

        return _bound(self._constants(), of)


@dataclass(frozen=True)
class ConformalConic:
    """Lambert conformal conic with two standard parallels."""

    lon0: float | Column
    lat0: float | Column
    lat1: float | Column
    lat2: float | Column
    east0: float | Column
    north0: float | Column
    ellipsoid: tuple

    def _constants(self) -> dict:
        a, f = self.ellipsoid
        e = _sqrt(f * (2 - f))

        def t(lat):
            s = _sin(_radians(lat))
            return _tan(math.pi / 4 - _radians(lat) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

        def m(lat):
            s = _sin(_radians(lat))
            return _cos(_radians(lat)) / _sqrt(1 - (e * s) ** 2)

        n = _log(m(self.lat1) / m(self.lat2)) / _log(t(self.lat1) / t(self.lat2))
        if isinstance(self.lat1, Column):  # one parallel given twice
            n = F.when(F.abs(self.lat1 - self.lat2) < 1e-9, F.sin(F.radians(self.lat1))).otherwise(n)
        big = a * m(self.lat1) / (n * t(self.lat1) ** n)
        return {"e": e, "n": n, "big": big, "rho0": big * t(self.lat0) ** n}

    def inverse(self, x: Column, y: Column) -> Column:
        def of(k) -> Column:
            dx, dy, e2 = x - self.east0, k["rho0"] - (y - self.north0), k["e"] * k["e"]

            def latitude(chi: Column) -> Column:
                return (
                    chi + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360) * F.sin(2 * chi)
                    + (7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520) * F.sin(4 * chi)
                    + (7 * e2**3 / 120 + 81 * e2**4 / 1120) * F.sin(6 * chi) + 4279 * e2**4 / 161280 * F.sin(8 * chi)
                )

            chi = math.pi / 2 - 2 * F.atan(F.pow(F.hypot(dx, dy) / k["big"], _column(1 / k["n"])))
            return _point(self.lon0 + F.degrees(F.atan2(dx, dy)) / k["n"], F.degrees(let(chi, latitude)))

        return _bound(self._constants(), of)

    def forward(self, lon: Column, lat: Column) -> Column:
        def of(k) -> Column:
            theta = k["n"] * F.radians(lon - self.lon0)
            t = let(F.sin(F.radians(lat)), lambda s: F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow(
                (1 - k["e"] * s) / (1 + k["e"] * s), _column(k["e"] / 2)
            ))
            return let(k["big"] * F.pow(t, _column(k["n"])), lambda rho: _point(
                self.east0 + rho * F.sin(theta), self.north0 + k["rho0"] - rho * F.cos(theta)
            ))

        return _bound(self._constants(), of)


def _column(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# --- fixed values: projection parameters ------------------------------------------------
PROJECTIONS = {
    "EPSG:3035": EqualAreaAzimuthal(10, 52, 4321000, 3210000, GRS80),
    "EPSG:3034": ConformalConic(10, 52, 35, 65, 4000000, 2800000, GRS80),
    "EPSG:3857": Equatorial(),
    "EPSG:2180": TransverseMercator(19, 0.9993, 500000, -5300000, GRS80),
    "EPSG:3006": TransverseMercator(15, 0.9996, 500000, 0, GRS80),
}
# UTM: WGS 84 north (326..) and south (327..), ETRS89 north (258..), by zone
UTM_CODE = r"^EPSG:(326|327|258)(0[1-9]|[1-5][0-9]|60)$"
UTM_SCALE, UTM_EAST0, UTM_SOUTH_NORTH0 = 0.9996, 500000, 10_000_000
# systems told by parameters: name of the system's text, names of the projection, parameters
TOLD = {
    "tmerc": (
        ["transverse_mercator", "gauss_kruger"],
        ["central_meridian", "latitude_of_origin", "scale_factor", "false_easting", "false_northing"],
    ),
    "laea": (
        ["lambert_azimuthal_equal_area"],
        ["central_meridian", "latitude_of_origin", "false_easting", "false_northing"],
    ),
    "lcc": (
        ["lambert_conformal_conic", "lambert_conformal_conic_2sp"],
        ["central_meridian", "latitude_of_origin", "standard_parallel_1", "standard_parallel_2", "false_easting", "false_northing"],
    ),
    "webmerc": (
        ["mercator_auxiliary_sphere", "popular_visualisation_pseudo_mercator"],
        ["central_meridian", "false_easting", "false_northing"],
    ),
}
# other names of these parameters
SAME_PARAMETER = {
    "central_meridian": ["longitude_of_center", "longitude_of_origin"],
    "latitude_of_origin": ["latitude_of_center"],
}
PARAMETER_DEFAULTS = {"latitude_of_origin": 0.0, "scale_factor": 1.0, "false_easting": 0.0, "false_northing": 0.0}
SAME_DATUM = r"(?i)WGS[ _]*(?:19)?84|ETRS[ _]*(?:19)?89|European_Terrestrial_Reference_System"
# ----------------------------------------------------------------------------------------


def known_crs(crs: Column) -> Column:
    return crs.isin(*GEOGRAPHIC, *PROJECTIONS) | crs.rlike(UTM_CODE) | crs.rlike(f"^(?:{'|'.join(TOLD)}):")


def told_crs(wkt: Column) -> Column:
    """The text of a projected system told by its parameters (WKT, double quotes): name, parameters,
    and the ellipsoid's radius and inverse flattening. Null for a projection that is not known, a
    parameter that is missing, another datum, prime meridian or unit than metres: never guessed."""
    number = r"\s*,\s*([-+0-9.eE]+)"

    def found(pattern: str) -> Column:
        return F.regexp_extract(wkt, pattern, 1).try_cast("double")

    def parameter(name: str) -> Column:
        names = "|".join([name, *SAME_PARAMETER.get(name, [])])
        value = found(rf'(?i)PARAMETER\["(?:{names})"{number}')
        return F.coalesce(value, F.lit(PARAMETER_DEFAULTS[name])) if name in PARAMETER_DEFAULTS else value

    projection = F.lower(F.regexp_extract(wkt, r'(?i)PROJECTION\["([^"]+)"', 1))
    ellipsoid = [found(rf'(?i)(?:SPHEROID|ELLIPSOID)\["[^"]*"{number}'), found(r'(?i)(?:SPHEROID|ELLIPSOID)\["[^"]*"\s*,\s*[-+0-9.eE]+' + number)]
    text = F.lit(None).cast("string")
    for name, (projections, parameters) in TOLD.items():
        parts = [parameter(p) for p in parameters] + ellipsoid
        whole = F.concat(F.lit(name), *[F.concat(F.lit(":"), p.cast("string")) for p in parts])  # null if a part is
        text = F.when(projection.isin(projections), whole).otherwise(text)
    meridian = F.coalesce(found(rf'(?i)PRIMEM\["[^"]*"{number}'), F.lit(0.0))
    unit = F.coalesce(found(rf'(?is).*\bUNIT\["[^"]*"{number}'), F.lit(1.0))
    usual = wkt.rlike(r"(?i)^\s*PROJCS") & wkt.rlike(SAME_DATUM) & (meridian == 0) & (unit == 1)
    return F.when(usual, text)


def _told(crs: Column, name: str, way: str, x: Column, y: Column) -> Column:
    """The projection whose parameters are in the row's text."""
    parts = F.transform(F.split(crs, ":"), lambda p: p.try_cast("double"))

    def of(p: Column) -> Column:
        at = lambda k: F.get(p, F.lit(k))
        n = len(TOLD[name][1])
        ellipsoid = (at(n + 1), 1 / at(n + 2))
        if name == "tmerc":
            projection = TransverseMercator(at(1), at(3), at(4), at(5), ellipsoid, at(2))
        elif name == "laea":
            projection = EqualAreaAzimuthal(at(1), at(2), at(3), at(4), ellipsoid)
        elif name == "lcc":
            projection = ConformalConic(at(1), at(2), at(3), at(4), at(5), at(6), ellipsoid)
        else:
            projection = Equatorial(at(n + 1), at(1), at(2), at(3))
        return getattr(projection, way)(x, y)

    return let(parts, of)


def _utm(crs: Column) -> TransverseMercator:
    """The projection of any UTM zone; its centre follows from the code's last two digits."""
    zone = F.regexp_extract(crs, UTM_CODE, 2).try_cast("int")
    south = F.regexp_extract(crs, UTM_CODE, 1) == "327"
    return TransverseMercator(zone * 6 - 183, UTM_SCALE, UTM_EAST0, F.when(south, UTM_SOUTH_NORTH0).otherwise(0), WGS84_ELLIPSOID)


def _by_crs(crs: Column, x: Column, y: Column, way: str) -> Column:
    point = F.when(crs.isin(*GEOGRAPHIC), _point(x, y))
    for code, projection in PROJECTIONS.items():
        point = point.when(crs == code, getattr(projection, way)(x.cast("double"), y.cast("double")))
    point = point.when(crs.rlike(UTM_CODE), getattr(_utm(crs), way)(x.cast("double"), y.cast("double")))
    for name in TOLD:
        point = point.when(crs.startswith(f"{name}:"), _told(crs, name, way, x.cast("double"), y.cast("double")))
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return let(point, lambda p: _point(finite(p["a"]), finite(p["b"])))


def to_lonlat(crs: Column, x: Column, y: Column) -> Column:
    """Point ``(a=lon, b=lat)`` in degrees of a point given in ``crs``; both null for an
    unknown CRS or a point outside the projection."""
    return _by_crs(crs, x, y, "inverse")


def from_lonlat(crs: Column, lon: Column, lat: Column) -> Column:
    """Point ``(a=x, b=y)`` in ``crs`` of a point in degrees; both null for an unknown CRS."""
    return _by_crs(crs, lon, lat, "forward")
