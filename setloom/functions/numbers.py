"""Tempo, key, time and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_ratio(a: Column, b: Column, clip: float | None = None) -> Column:
    """Logarithm of a ratio, within ``clip`` of 0 if that is given."""
    x = F.ln(a / b)
    return x if clip is None else F.greatest(F.least(x, F.lit(clip)), F.lit(-clip))


def camelot_distance(hour_a: Column, major_a: Column, hour_b: Column, major_b: Column, unknown: float = 2.5, mode: float = 0.5) -> Column:
    """Steps around a wheel of 12, plus ``mode`` if one key is major and the other minor; ``unknown`` where an hour is null."""
    apart = F.abs(hour_a - hour_b) % 12
    return F.coalesce(F.least(apart, 12 - apart) + F.when(major_a == major_b, 0.0).otherwise(mode), F.lit(unknown))


def grid_snap(time: Column, step: float) -> Column:
    """The nearest multiple of ``step``; halves go to the even one."""
    return F.rint(time / step) * step


def affine(time: Column, zero: Column, rate: Column) -> Column:
    """Time in a record as time in the mix that plays it from ``zero`` on at ``rate``."""
    return zero + time / rate


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fma(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the errors of the product and of the sum are exact doubles and are added last."""
    high = lambda x: F.lit(134217729.0) * x - (F.lit(134217729.0) * x - x)
    halves = F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (a * b).alias("p"), high(a).alias("ah"), high(b).alias("bh"))

    def errors(h: Column) -> Column:
        al, bl = h["a"] - h["ah"], h["b"] - h["bh"]
        e = ((h["ah"] * h["bh"] - h["p"]) + h["ah"] * bl + al * h["bh"]) + al * bl
        return F.struct(h["p"].alias("p"), h["c"].alias("c"), (h["p"] + h["c"]).alias("s"), (h["p"] + h["c"] - h["p"]).alias("v"), e.alias("e"))

    return _bind(halves, lambda h: _bind(errors(h), lambda r: r["s"] + (((r["p"] - (r["s"] - r["v"])) + (r["c"] - r["v"])) + r["e"])))


def correlation(pairs: Column) -> Column:
    """Pearson's correlation of an array of structs (x, y) without nulls; null if one side doesn't vary.

    The running sums, their order and their rounding are those of DuckDB, so that a correlation that lies on a
    threshold falls on the same side of it in both engines."""
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "mx", "my", "c", "sx", "sy")))

    def step(s: Column, v: Column) -> Column:
        x, y, n = v["x"].cast("double"), v["y"].cast("double"), s["n"] + 1
        means = F.struct(n.alias("n"), x.alias("x"), y.alias("y"), (s["mx"] + (x - s["mx"]) / n).alias("mx"), (s["my"] + (y - s["my"]) / n).alias("my"))
        return _bind(means, lambda m: F.struct(m["n"].alias("n"), m["mx"].alias("mx"), m["my"].alias("my"), _fma(m["x"] - m["mx"], m["y"] - s["my"], s["c"]).alias("c"),
            (s["sx"] + (m["x"] - m["mx"]) * (m["x"] - s["mx"])).alias("sx"), (s["sy"] + (m["y"] - m["my"]) * (m["y"] - s["my"])).alias("sy")))

    return F.aggregate(pairs, zero, step, lambda s: s["c"] / s["n"] / F.nullif(F.sqrt(s["sx"] / s["n"]) * F.sqrt(s["sy"] / s["n"]), F.lit(0.0)))
