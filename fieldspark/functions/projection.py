"""Closed-form map projections as column expressions (angles in degrees)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.functions.binding import bound, iterate


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


# Ellipsoids and the supported coordinate systems.
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
GRS80 = Ellipsoid(6378137.0, 1 / 298.257222101)
SPHERE = Ellipsoid(6371229.0, 0.0)


@dataclass(frozen=True)
class PolarStereographic:
    lon0: float
    lat_ts: float = 90.0
    k0: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    ellipsoid: Ellipsoid = WGS84

    def radius(self) -> float:
        """rho = radius * t."""
        el, e = self.ellipsoid, self.ellipsoid.e
        if self.lat_ts >= 90:
            return 2 * el.a * self.k0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        p = math.radians(self.lat_ts)
        s = math.sin(p)
        t = math.tan(math.pi / 4 - p / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
        return el.a * math.cos(p) / math.sqrt(1 - el.e2 * s * s) / t

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, p = self.ellipsoid.e, F.radians(lat)
        s = F.sin(p) * e
        t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
        d, rho = F.radians(lon - self.lon0), t * self.radius()
        return rho * F.sin(d) + self.fe, self.fn - rho * F.cos(d)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e2, e = self.ellipsoid.e2, self.ellipsoid.e
        dx, dy = x - self.fe, self.fn - y
        t = F.hypot(dx, dy) / self.radius()
        chi = F.lit(math.pi / 2) - 2 * F.atan(t)
        e4, e6, e8 = e2**2, e2**3, e2**4
        terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520,
                 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
        p = chi
        for i, c in enumerate(terms):
            p = p + F.sin(chi * (2 * (i + 1))) * c
        s = F.sin(p) * e  # one fixed-point step on top of the series
        p = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(e / 2)))
        return _wrap(F.degrees(F.atan2(dx, dy)) + self.lon0), F.degrees(p)


@dataclass(frozen=True)
class Albers:
    lat1: float
    lat2: float
    lat0: float
    lon0: float
    ellipsoid: Ellipsoid = GRS80

    def constants(self) -> tuple[float, float, float]:
        """(n, C, rho0)."""
        el, e = self.ellipsoid, self.ellipsoid.e

        def m2(p):
            return math.cos(p) ** 2 / (1 - el.e2 * math.sin(p) ** 2)

        def q(p):
            s = math.sin(p)
            return (1 - el.e2) * (s / (1 - el.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

        a, b, o = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        n = (m2(a) - m2(b)) / (q(b) - q(a))
        c = m2(a) + n * q(a)
        return n, c, el.a * math.sqrt(c - n * q(o)) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        el, e = self.ellipsoid, self.ellipsoid.e
        n, c, rho0 = self.constants()
        s = F.sin(F.radians(lat))
        q = (s / (1 - s * s * el.e2) - F.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - el.e2)
        rho, th = F.sqrt(c - q * n) * (el.a / n), F.radians(_wrap(lon - self.lon0)) * n
        return rho * F.sin(th), rho0 - rho * F.cos(th)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        el, e = self.ellipsoid, self.ellipsoid.e
        n, c, rho0 = self.constants()
        rho, th = F.hypot(x, rho0 - y), F.atan2(x, rho0 - y)
        q = (c - (rho * (n / el.a)) ** 2) / n

        def newton(p: Column) -> Column:
            s = F.sin(p)
            w = 1 - s * s * el.e2
            return p + w * w / (2 * F.cos(p)) * (q / (1 - el.e2) - s / w + F.log((1 - s * e) / (1 + s * e)) / (2 * e))

        return _wrap(F.degrees(th / n) + self.lon0), F.degrees(iterate(F.asin(q / 2), newton, 4))


@dataclass(frozen=True)
class TransverseMercator:
    lon0: float
    k0: float = 0.9996
    fe: float = 500000.0
    fn: float = 0.0
    ellipsoid: Ellipsoid = WGS84

    def series(self) -> tuple[float, tuple[float, ...], tuple[float, ...]]:
        """(scaled meridian radius, forward terms, inverse terms) of the Krueger series."""
        f = self.ellipsoid.f
        n = f / (2 - f)
        n2, n3, n4 = n**2, n**3, n**4
        radius = self.k0 * self.ellipsoid.a / (1 + n) * (1 + n2 / 4 + n4 / 64)
        fwd = (n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440,
               61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280)
        inv = (n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440,
               17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280)
        return radius, fwd, inv

    def _conformal(self, tau: Column) -> Column:
        e = self.ellipsoid.e
        sig = F.sinh(F.atanh(tau / F.sqrt(1 + tau * tau) * e) * e)
        return tau * F.sqrt(1 + sig * sig) - sig * F.sqrt(1 + tau * tau)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        radius, fwd, _ = self.series()
        d = F.radians(_wrap(lon - self.lon0))
        (tau,) = bound([F.tan(F.radians(lat))], lambda t: (self._conformal(t),), 1)
        start = bound([tau, d], lambda t, a: (F.atan2(t, F.cos(a)), F.asinh(F.sin(a) / F.hypot(t, F.cos(a)))))

        def sums(xi0: Column, eta0: Column) -> tuple[Column, Column]:
            xi, eta = xi0, eta0
            for i, c in enumerate(fwd):
                k = 2 * (i + 1)
                xi = xi + F.sin(xi0 * k) * F.cosh(eta0 * k) * c
                eta = eta + F.cos(xi0 * k) * F.sinh(eta0 * k) * c
            return eta * radius + self.fe, xi * radius + self.fn

        return bound(list(start), sums)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        radius, _, inv = self.series()
        e = self.ellipsoid.e

        def sums(xi0: Column, eta0: Column) -> tuple[Column, Column]:
            xi, eta = xi0, eta0
            for i, c in enumerate(inv):
                k = 2 * (i + 1)
                xi = xi - F.sin(xi0 * k) * F.cosh(eta0 * k) * c
                eta = eta - F.cos(xi0 * k) * F.sinh(eta0 * k) * c
            return xi, eta

        def angles(xi: Column, eta: Column) -> tuple[Column, Column]:
            lon = _wrap(F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + self.lon0)
            return lon, F.asinh(F.sin(xi) / F.hypot(F.sinh(eta), F.cos(xi)))

        lon, psi = bound(list(bound([(y - self.fn) / radius, (x - self.fe) / radius], sums)), angles)
        # latitude from the isometric one by fixed-point steps
        (lat,) = bound([psi], lambda q: (F.degrees(iterate(F.asin(F.tanh(q)), lambda p: F.asin(F.tanh(q + F.atanh(F.sin(p) * e) * e)), 6)),), 1)
        return lon, lat


@dataclass(frozen=True)
class RotatedPole:
    pole_lon: float
    pole_lat: float

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        d, p = F.radians(lon - self.pole_lon), F.radians(lat)
        sp, cp = math.sin(math.radians(self.pole_lat)), math.cos(math.radians(self.pole_lat))
        rlat = F.asin(F.sin(p) * sp + F.cos(p) * F.cos(d) * cp)
        return F.degrees(F.atan2(-F.sin(d) * F.cos(p), F.sin(p) * cp - F.cos(p) * F.cos(d) * sp)), F.degrees(rlat)

    def inverse(self, rlon: Column, rlat: Column) -> tuple[Column, Column]:
        d, p = F.radians(rlon), F.radians(rlat)
        sp, cp = math.sin(math.radians(self.pole_lat)), math.cos(math.radians(self.pole_lat))
        lat = F.asin(F.sin(p) * sp + F.cos(p) * F.cos(d) * cp)
        off = F.atan2(-F.sin(d) * F.cos(p), F.sin(p) * cp - F.cos(p) * F.cos(d) * sp)
        return _wrap(F.degrees(off) + self.pole_lon), F.degrees(lat)


@dataclass(frozen=True)
class Geographic:
    ellipsoid: Ellipsoid = WGS84

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


CRS = {
    "EPSG:4326": Geographic(),
    "EPSG:3413": PolarStereographic(-45.0, 70.0),
    "EPSG:3338": Albers(55.0, 65.0, 50.0, -154.0),
    "EPSG:5936": PolarStereographic(-150.0, 90.0, k0=0.994, fe=2_000_000.0, fn=2_000_000.0),
    "polar-39-71": PolarStereographic(-39.0, 71.0),
    "polar-sphere-30": PolarStereographic(-30.0, 90.0, ellipsoid=SPHERE),
    "rotated-160-18": RotatedPole(160.0, 18.0),
}


def crs(name: str):
    """Coordinate system by name; UTM zones come from their EPSG number."""
    if name in CRS:
        return CRS[name]
    if name.startswith(("EPSG:326", "EPSG:327")) and name[8:].isdigit() and 1 <= int(name[8:]) <= 60:
        return TransverseMercator(int(name[8:]) * 6 - 183.0, fn=10_000_000.0 if name[7] == "7" else 0.0)
    raise ValueError(f"unsupported coordinate system {name!r}; known: {sorted(CRS)} and UTM zones")


def _wrap(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return lon - F.floor((lon + 180.0) / 360.0) * 360.0


def transform(source: str, target: str, x: Column, y: Column) -> tuple[Column, Column]:
    if source == target:
        return x, y
    return bound(list(bound([x, y], crs(source).inverse)), crs(target).forward)


def transform_box(source: str, target: str, box: tuple[Column, Column, Column, Column], n: int = 21) -> tuple[Column, Column, Column, Column]:
    """Bounding box (xmin, ymin, xmax, ymax) of the transformed, densified box edges."""
    x0, y0, x1, y1 = box
    steps = [i / (n - 1) for i in range(n)]
    pts = [(x0 + (x1 - x0) * s, e) for s in steps for e in (y0, y1)] + [(e, y0 + (y1 - y0) * s) for s in steps for e in (x0, x1)]
    arr = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in pts])
    out = F.transform(arr, lambda p: F.struct(*[c.alias(n) for c, n in zip(transform(source, target, p["x"], p["y"]), "xy")]))
    xs, ys = out["x"], out["y"]
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def local_scale_factor(name: str, x: Column, y: Column, eps_deg: float = 1e-6) -> Column:
    """sqrt of the Jacobian determinant of the projection against true metres."""
    system = crs(name)
    el = system.ellipsoid

    def factor(lon: Column, lat: Column) -> tuple[Column]:
        east, west = system.forward(lon + eps_deg, lat), system.forward(lon - eps_deg, lat)
        north, south = system.forward(lon, lat + eps_deg), system.forward(lon, lat - eps_deg)
        xl, yl = (east[0] - west[0]) / (2 * eps_deg), (east[1] - west[1]) / (2 * eps_deg)
        xp, yp = (north[0] - south[0]) / (2 * eps_deg), (north[1] - south[1]) / (2 * eps_deg)
        p = F.radians(lat)
        w = F.sqrt(1 - F.sin(p) * F.sin(p) * el.e2)
        metres = (el.a / w) * F.cos(p) * (el.a * (1 - el.e2) / (w * w * w)) * (math.pi / 180) ** 2
        return (F.sqrt(F.abs(xl * yp - yl * xp) / metres),)

    return bound(list(system.inverse(x, y)), factor, 1)[0]


def rotate_vector(source: str, target: str, x: Column, y: Column, vx: Column, vy: Column, eps: float = 10.0) -> tuple[Column, Column]:
    """Components on the target axes, by a centred difference of displaced points."""
    fx, fy = transform(source, target, x + vx * eps, y + vy * eps)
    bx, by = transform(source, target, x - vx * eps, y - vy * eps)
    return (fx - bx) / (2 * eps), (fy - by) / (2 * eps)
