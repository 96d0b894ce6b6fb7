"""Colour arithmetic in the comparison engine's SQL."""

from __future__ import annotations

W601 = ("CAST(0.299 AS DOUBLE)", "CAST(0.587 AS DOUBLE)", "CAST(0.114 AS DOUBLE)")


def n(v) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def lin(c: str) -> str:
    v = f"(CAST({c} AS DOUBLE)/255)"
    return f"(CASE WHEN {v} <= {n(0.04045)} THEN {v}/{n(12.92)} ELSE pow(({v}+{n(0.055)})/{n(1.055)}, {n(2.4)}) END)"


def unlin(v: str) -> str:
    v = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {v}))"
    return (f"(CASE WHEN {v} <= {n(0.0031308)} THEN {v}*{n(12.92)}*255 "
            f"ELSE ({n(1.055)}*pow({v}, 1.0::DOUBLE/{n(2.4)}) - {n(0.055)})*255 END)")


def lab_lin(r, g, b) -> tuple[str, str, str]:
    def f(x, y, z, w):
        t = f"(({r}*{n(x)} + {g}*{n(y)} + {b}*{n(z)})/{n(w)})"
        return f"(CASE WHEN {t} > {n(0.008856)} THEN pow({t}, 1.0::DOUBLE/3) ELSE {n(7.787)}*{t} + 16.0::DOUBLE/116 END)"
    x = f(0.4124564, 0.3575761, 0.1804375, 0.95047)
    y = f(0.2126729, 0.7151522, 0.0721750, 1.0)
    z = f(0.0193339, 0.1191920, 0.9503041, 1.08883)
    return f"(116*{y} - 16)", f"(500*({x} - {y}))", f"(200*({y} - {z}))"


def lab(r="r", g="g", b="b"):
    return lab_lin(lin(r), lin(g), lin(b))


def lab_of(rgb: str):
    return lab(f"({rgb}//65536)", f"(({rgb}//256)%256)", f"({rgb}%256)")


def oklab_lin(r, g, b):
    def dot(t, row):
        return "(" + " + ".join(f"{n(k)}*{v}" for k, v in zip(row, t)) + ")"
    c = [f"cbrt{dot((r, g, b), row)}" for row in (
        (0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566),
        (0.0883024619, 0.2817188376, 0.6299787005))]
    return [dot(c, row) for row in ((0.2104542553, 0.7936177850, -0.0040720468),
                                    (1.9779984951, -2.4285922050, 0.4505937099),
                                    (0.0259040371, 0.7827717662, -0.8086757660))]


def oklab(r="r", g="g", b="b"):
    return oklab_lin(lin(r), lin(g), lin(b))


def d2(p, q) -> str:
    return "(" + " + ".join(f"({a} - {b})*({a} - {b})" for a, b in zip(p, q)) + ")"


def dist(p, q) -> str:
    return f"sqrt{d2(p, q)}"


def lum(r="r", g="g", b="b") -> str:
    return f"({W601[0]}*{r} + {W601[1]}*{g} + {W601[2]}*{b})"


def sat(r="r", g="g", b="b") -> str:
    m = f"greatest({r},{g},{b})"
    return f"(CASE WHEN {m} = 0 THEN 0.0::DOUBLE ELSE CAST({m} - least({r},{g},{b}) AS DOUBLE)/{m} END)"


def contrast(r="r", g="g", b="b") -> str:
    return f"(1 - abs(CAST({r}+{g}+{b} AS DOUBLE)/765 - 0.5::DOUBLE))"


def r6(v: str, alias: str, places: int = 6) -> str:
    return f"round({v}, {places}) + 0 AS {alias}"


def values(colors) -> str:
    return "(VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(colors)) + ")"
