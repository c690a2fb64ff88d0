"""Inverse distribution functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.binding import bound

EPS = 2.220446049250313e-16
CHOICE_NAMES = ("choices", "choice", "categorical")

# Rational coefficients of the inverse normal (published algorithm AS 241, double precision).
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
NEAR = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _ratio(coefficients, x):
    def poly(cs):
        out = None
        for c in reversed(cs):
            out = F.lit(c) if out is None else out * x + c
        return out

    return poly(coefficients[0]) / poly(coefficients[1])


def inverse_normal(u: Column) -> Column:
    def value(q: Column, tail: Column) -> tuple[Column]:
        outer = F.when(tail <= 5, _ratio(NEAR, tail - 1.6)).otherwise(_ratio(FAR, tail - 5.0))
        return (F.when(F.abs(q) <= 0.425, q * _ratio(CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * outer),)

    (u,) = bound([u], lambda x: (x,), 1)
    return bound([u - 0.5, F.sqrt(-F.log(F.least(u, 1 - u)))], value, 1)[0]


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _lower_gamma(c: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma by its power series; x stays moderate for the quantiles asked."""
    term = np.exp(c * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(c + 1))
    total = term.copy()
    for k in range(1, 600):
        term = term * x / (c + k)
        total += term
        if np.all(term <= 1e-17 * total):
            break
    return np.minimum(total, 1.0)


def log_gamma_quantile(c: float):
    """Vectorised quantile of the log-gamma law: bisection with a Newton finish on y = log(x)."""

    @F.pandas_udf("double")
    def quantile(u: pd.Series) -> pd.Series:
        p = u.to_numpy(dtype=float)
        lo, hi = np.full(p.shape, -750.0 / max(c, 1.0) - 50.0), np.full(p.shape, math.log(c + 40.0 * math.sqrt(c) + 60.0))
        for _ in range(90):
            mid = (lo + hi) / 2
            below = _lower_gamma(c, np.exp(mid)) < p
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series((lo + hi) / 2)

    return quantile


def choice_value(u: Column, choices: Sequence[Any], weights: Sequence[float] | None = None) -> Column:
    """First choice whose cumulative weight reaches u; a choice of weight 0 is never drawn."""
    w = list(weights) if weights is not None else [1.0] * len(choices)
    total, run, out = float(sum(w)), 0.0, None
    kept = [(c, x) for c, x in zip(choices, w) if x > 0]
    for c, x in kept[:-1]:
        run += x / total
        out = F.when(u <= run, F.lit(c)) if out is None else out.when(u <= run, F.lit(c))
    return F.lit(kept[-1][0]) if out is None else out.otherwise(F.lit(kept[-1][0]))


def check_spec(spec: Mapping[str, Any]) -> None:
    """Raise on an incomplete or inconsistent distribution spec."""
    name = str(spec["distribution"]).strip().lower()
    if name in CHOICE_NAMES:
        if not spec.get("choices"):
            raise ValueError(f"{name} needs a non-empty 'choices' list")
        w = spec.get("weights")
        if w is not None and (len(w) != len(spec["choices"]) or any(x < 0 or not math.isfinite(x) for x in w) or sum(w) <= 0):
            raise ValueError(f"{name} needs one finite, non-negative weight per choice with a positive sum")
    elif name == "randint":
        if "low" not in spec or "high" not in spec:
            raise ValueError("randint needs 'low' and 'high'")
        if float(spec.get("scale", 1.0)) != 1.0:
            raise ValueError("randint has no scale")
    elif name in ("uniform", "norm", "lognorm", "expon", "truncnorm", "loggamma"):
        if name != "truncnorm" and ("loc" not in spec or "scale" not in spec):
            raise ValueError(f"{name} needs 'loc' and 'scale'")
        if float(spec.get("scale", 1.0)) <= 0:
            raise ValueError(f"{name} needs a positive scale")
        shape = {"lognorm": "s", "loggamma": "c"}.get(name)
        if shape and shape not in spec:
            raise ValueError(f"{name} needs shape parameter {shape!r}")
        if name == "truncnorm" and not ({"a", "b"} <= set(spec) or {"lower", "upper"} <= set(spec)):
            raise ValueError("truncnorm needs a, b or lower, upper")
        if name == "truncnorm" and "lower" in spec and spec["lower"] >= spec["upper"]:
            raise ValueError("truncnorm needs lower < upper")
    else:
        raise ValueError(f"unknown distribution {name!r}")


def quantile(u: Column, spec: Mapping[str, Any]) -> Column:
    """Inverse distribution function of ``spec`` at u, u clipped away from 0 and 1."""
    check_spec(spec)
    name = str(spec["distribution"]).strip().lower()
    u = F.least(F.greatest(u, F.lit(EPS)), F.lit(1 - EPS))
    if name in CHOICE_NAMES:
        return choice_value(u, spec["choices"], spec.get("weights"))
    loc, scale = float(spec.get("loc", 0.0)), float(spec.get("scale", 1.0))
    if name == "uniform":
        return u * scale + loc
    if name == "randint":
        low, high = int(spec["low"]), int(spec["high"])
        k = F.ceil(u * (high - low)) - 1 + low + int(loc)
        return F.least(F.greatest(k, F.lit(low + int(loc))), F.lit(high - 1 + int(loc))).cast("bigint")
    if name == "norm":
        return inverse_normal(u) * scale + loc
    if name == "truncnorm":
        a, b = (spec["a"], spec["b"]) if "a" in spec else ((spec["lower"] - loc) / scale, (spec["upper"] - loc) / scale)
        pa, pb = normal_cdf(float(a)), normal_cdf(float(b))
        z = inverse_normal(F.least(F.greatest(u * (pb - pa) + pa, F.lit(1e-300)), F.lit(1 - EPS)))
        return F.least(F.greatest(z, F.lit(float(a))), F.lit(float(b))) * scale + loc
    if name == "lognorm":
        return F.exp(inverse_normal(u) * float(spec["s"])) * scale + loc
    if name == "expon":
        return -F.log1p(-u) * scale + loc
    return log_gamma_quantile(float(spec["c"]))(u) * scale + loc


def transform_quantiles(long: DataFrame, specs: Mapping[str, Mapping[str, Any]], sample: str = "sample") -> DataFrame:
    """Long (sample, name, u) -> wide design, one typed column per parameter, ``sample`` first."""
    wide = long.groupBy(sample).agg(*[F.max(F.when(F.col("name") == n, F.col("u"))).alias(n) for n in specs])
    return wide.select(sample, *[quantile(F.col(f"`{n}`"), s).alias(n) for n, s in specs.items()])
