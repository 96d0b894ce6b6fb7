"""Colour arithmetic as SQL expression text.

Every function takes and returns SQL fragments, so one definition serves
``F.expr`` in the operators and the SQL functions registered by
``functions.registry``.  All of it stays inside whole-stage code generation.
Numeric literals are written in exponent form: Spark would read a plain
``0.055`` as a DECIMAL.
"""

from __future__ import annotations

# sRGB transfer curve, D65 white point, CIE and OKLab matrices,
# luminance weights and the 4x4 ordered-dither matrix.
XYZ_ROWS = ((0.4124564, 0.3575761, 0.1804375, 0.95047),
            (0.2126729, 0.7151522, 0.0721750, 1.00000),
            (0.0193339, 0.1191920, 0.9503041, 1.08883))
OK_CONE_ROWS = ((0.4122214708, 0.5363325363, 0.0514459929),
                (0.2119034982, 0.6806995451, 0.1073969566),
                (0.0883024619, 0.2817188376, 0.6299787005))
OK_LAB_ROWS = ((0.2104542553, 0.7936177850, -0.0040720468),
               (1.9779984951, -2.4285922050, 0.4505937099),
               (0.0259040371, 0.7827717662, -0.8086757660))
LUMA_601 = (0.299, 0.587, 0.114)
LUMA_709 = (0.2126, 0.7152, 0.0722)
BAYER_4X4 = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)


def num(value: float) -> str:
    """A double literal both Spark SQL and other ANSI engines read as DOUBLE."""
    text = repr(float(value))
    return text if "e" in text else text + "E0"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def floor_div(a: str, b: str | int) -> str:
    """Integer division for non-negative values that fit in a double exactly."""
    return f"CAST(FLOOR(CAST({a} AS DOUBLE) / {b}) AS BIGINT)"


def weighted(row, terms) -> str:
    return "(" + " + ".join(f"{num(w)} * {t}" for w, t in zip(row, terms)) + ")"


def tie(expr: str) -> str:
    """A non-negative score as a whole number of billionths, so equal scores compare equal."""
    return f"CAST(FLOOR(({expr}) * 1E9 + 5E-1) AS BIGINT)"


# --- packing -----------------------------------------------------------------

def pack_rgb(r="r", g="g", b="b") -> str:
    return f"CAST({r} * 65536 + {g} * 256 + {b} AS INT)"


def pack_argb(a="a", r="r", g="g", b="b") -> str:
    """Unsigned ARGB as BIGINT."""
    return f"(CAST({a} AS BIGINT) * 16777216 + {r} * 65536 + {g} * 256 + {b})"


def channel(packed: str, index: int) -> str:
    """Channel of a packed value: 0 blue, 1 green, 2 red, 3 alpha."""
    return f"CAST({floor_div(packed, 256 ** index)} % 256 AS INT)"


def unpack_rgb(packed: str) -> tuple[str, str, str]:
    return channel(packed, 2), channel(packed, 1), channel(packed, 0)


def signed_argb(argb: str = "argb") -> str:
    """The 32-bit signed reading of an unsigned ARGB, for ties that compare signed."""
    return f"(CASE WHEN {argb} >= 2147483648 THEN {argb} - 4294967296 ELSE {argb} END)"


def canonical_argb(a="a", r="r", g="g", b="b") -> str:
    """Transparent pixels carry no colour."""
    return f"(CASE WHEN {a} = 0 THEN CAST(0 AS BIGINT) ELSE {pack_argb(a, r, g, b)} END)"


def rgb_hex(r="r", g="g", b="b") -> str:
    return f"format_string('#%02X%02X%02X', {r}, {g}, {b})"


def parse_hex_color(text: str) -> str:
    """Packed RGB of ``#RRGGBB`` or NULL; nothing shorter or longer is accepted."""
    return (f"(CASE WHEN {text} RLIKE '^#[0-9A-Fa-f]{{6}}$' "
            f"THEN CAST(conv(substring({text}, 2, 6), 16, 10) AS INT) END)")


# --- transfer curve and Lab spaces ---------------------------------------------

def srgb_to_linear(c: str) -> str:
    v = f"({dbl(c)} / 255E0)"
    return (f"(CASE WHEN {v} <= 4.045E-2 THEN {v} / 12.92E0 "
            f"ELSE pow(({v} + 5.5E-2) / 1.055E0, 2.4E0) END)")


def linear_to_srgb(v: str) -> str:
    """0..255, not yet rounded; input is clamped to 0..1."""
    v = f"LEAST(1E0, GREATEST(0E0, {v}))"
    return (f"(CASE WHEN {v} <= 3.1308E-3 THEN {v} * 12.92E0 * 255E0 "
            f"ELSE (1.055E0 * pow({v}, 1E0 / 2.4E0) - 5.5E-2) * 255E0 END)")


def lab_from_linear(lr: str, lg: str, lb: str) -> tuple[str, str, str]:
    def curve(row):
        t = (f"(({lr} * {num(row[0])} + {lg} * {num(row[1])} + {lb} * {num(row[2])}) / {num(row[3])})")
        return f"(CASE WHEN {t} > 8.856E-3 THEN pow({t}, 1E0 / 3E0) ELSE 7.787E0 * {t} + 16E0 / 116E0 END)"
    fx, fy, fz = (curve(row) for row in XYZ_ROWS)
    return f"(116E0 * {fy} - 16E0)", f"(500E0 * ({fx} - {fy}))", f"(200E0 * ({fy} - {fz}))"


def rgb_to_lab(r="r", g="g", b="b") -> tuple[str, str, str]:
    return lab_from_linear(srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b))


def oklab_from_linear(lr: str, lg: str, lb: str) -> tuple[str, str, str]:
    cones = [f"cbrt{weighted(row, (lr, lg, lb))}" for row in OK_CONE_ROWS]
    return tuple(weighted(row, cones) for row in OK_LAB_ROWS)


def rgb_to_oklab(r="r", g="g", b="b") -> tuple[str, str, str]:
    return oklab_from_linear(srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b))


def distance_sq(p, q) -> str:
    return "(" + " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(p, q)) + ")"


def distance(p, q) -> str:
    return f"sqrt{distance_sq(p, q)}"


# --- weights -------------------------------------------------------------------

def luminance601(r="r", g="g", b="b") -> str:
    return weighted(LUMA_601, (r, g, b))


def brightness(r="r", g="g", b="b") -> str:
    return f"({luminance601(r, g, b)} / 255E0)"


def saturation_weight(r="r", g="g", b="b") -> str:
    high, low = f"GREATEST({r}, {g}, {b})", f"LEAST({r}, {g}, {b})"
    return f"(CASE WHEN {high} = 0 THEN 0E0 ELSE {dbl(f'{high} - {low}')} / {high} END)"


def contrast_weight(r="r", g="g", b="b") -> str:
    return f"(1E0 - abs({dbl(f'{r} + {g} + {b}')} / 765E0 - 5E-1))"


def relief_height(r="r", g="g", b="b") -> str:
    return f"({weighted(LUMA_709, (r, g, b))} / 255E0)"


# --- per-pixel operations --------------------------------------------------------

def round_half_even(v: str) -> str:
    return f"bround({v}, 0)"


def clamp_byte(v: str) -> str:
    return f"CAST(LEAST(255, GREATEST(0, {v})) AS INT)"


def round_to_step(c: str, step: int) -> str:
    return clamp_byte(f"{round_half_even(f'{dbl(c)} / {step}')} * {step}")


def adjust_channel(c: str, mode: str, amount: float, subtract: bool) -> str:
    """Shift by a value or by a percentage of the channel; halves go away from zero."""
    sign = "-" if subtract else "+"
    if mode == "value":
        moved = f"{dbl(c)} {sign} {num(amount)}"
    elif mode == "percent":
        moved = f"{dbl(c)} {sign} {dbl(c)} * {num(amount / 100)}"
    else:
        raise ValueError(f"unknown adjustment mode {mode!r}")
    return clamp_byte(f"round({moved}, 0)")


def monochrome(r="r", g="g", b="b") -> str:
    return clamp_byte(round_half_even(luminance601(r, g, b)))


def over_alpha(sa: str, da: str) -> str:
    """Alpha of straight source-over: the destination shows through the rest."""
    return f"CAST({sa} + {floor_div(f'{da} * (255 - {sa}) + 127', 255)} AS INT)"


def over_channel(sc: str, sa: str, dc: str, da: str) -> str:
    """One colour channel of straight source-over with integer rounding."""
    total = f"(255 * {sa} + {da} * (255 - {sa}))"
    mixed = f"({sc} * {sa} * 255 + {dc} * {da} * (255 - {sa}))"
    return (f"CAST(CASE WHEN {total} = 0 THEN {sc} "
            f"ELSE FLOOR(({dbl(mixed)} + FLOOR({dbl(total)} / 2)) / {total}) END AS INT)")


def bayer4(x: str, y: str) -> str:
    """Centred 4x4 ordered-dither offset in (-0.5, 0.5)."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(BAYER_4X4))
    return f"((CASE ({y} % 4) * 4 + {x} % 4 {cases} END + 5E-1) / 16E0 - 5E-1)"


def ordered_dither(tone: str, x: str, y: str, strength: float) -> str:
    """Shift a 0..1 tone by the dither matrix; pure black and white stay put."""
    return (f"(CASE WHEN {tone} <= 0 OR {tone} >= 1 THEN {tone} "
            f"ELSE LEAST(1E0, GREATEST(0E0, {tone} + {bayer4(x, y)} * {num(strength)})) END)")


def premultiplied(c: str, a: str) -> str:
    return f"({dbl(c)} * {a} / 255E0)"


def edge_difference(p, q) -> str:
    """Largest change of alpha or premultiplied channel, 0..1; p and q are (r, g, b, a)."""
    terms = [f"abs({dbl(p[3])} - {q[3]})"]
    terms += [f"abs({premultiplied(p[i], p[3])} - {premultiplied(q[i], q[3])})" for i in range(3)]
    return f"(GREATEST({', '.join(terms)}) / 255E0)"


def cut_change(p, q) -> str:
    """Mean of the alpha change and the three premultiplied channel changes, 0..1."""
    pa, qa = f"({dbl(p[3])} / 255E0)", f"({dbl(q[3])} / 255E0)"
    terms = [f"abs({pa} - {qa})"]
    terms += [f"abs({p[i]} * {pa} - {q[i]} * {qa}) / 255E0" for i in range(3)]
    return f"(({' + '.join(terms)}) / 4E0)"


def seam_distance(p, q) -> str:
    """100 x the larger OKLab distance after compositing over black and over white."""
    def lab(pixel, background):
        a = f"({dbl(pixel[3])} / 255E0)"
        terms = [f"({srgb_to_linear(c)} * {a} + {background} * (1E0 - {a}))" for c in pixel[:3]]
        return oklab_from_linear(*terms)
    ends = [distance(lab(p, g), lab(q, g)) for g in ("0E0", "1E0")]
    return f"(100E0 * GREATEST({ends[0]}, {ends[1]}))"


def finalist_alpha(pa: str, qa: str) -> str:
    return f"CAST({floor_div(f'{pa} + {qa} + 1', 2)} AS INT)"


def finalist_channel(pc: str, pa: str, qc: str, qa: str) -> str:
    total = f"({pa} + {qa})"
    return (f"CAST(CASE WHEN {total} = 0 THEN 0 ELSE FLOOR(({dbl(f'{pc} * {pa} + {qc} * {qa}')}"
            f" + FLOOR({dbl(total)} / 2)) / {total}) END AS INT)")
