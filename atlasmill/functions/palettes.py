"""Built-in and custom colour palettes."""

from __future__ import annotations

from collections.abc import Sequence

from atlasmill.runtime import require

MAX_PALETTE = 4096

# Published 16/32-colour art palettes, the NES master palette and
# the four Game Boy greens, as packed 0xRRGGBB in their usual order.
DB16 = [0x140C1C, 0x442434, 0x30346D, 0x4E4A4E, 0x854C30, 0x346524, 0xD04648, 0x757161,
        0x597DCE, 0xD27D2C, 0x8595A1, 0x6DAA2C, 0xD2AA99, 0x6DC2CA, 0xDAD45E, 0xDEEED6]
DB32 = [0x000000, 0x222034, 0x45283C, 0x663931, 0x8F563B, 0xDF7126, 0xD9A066, 0xEEC39A,
        0xFBF236, 0x99E550, 0x6ABE30, 0x37946E, 0x4B692F, 0x524B24, 0x323C39, 0x3F3F74,
        0x306082, 0x5B6EE1, 0x639BFF, 0x124E89, 0x0099DB, 0x5FCDE4, 0xCBDBFC, 0xFFFFFF,
        0x9BADB7, 0x847E87, 0x696A6A, 0x595652, 0x76428A, 0xAC3232, 0xD95763, 0xD77BBA]
NES = [0x7C7C7C, 0x0000FC, 0x0000BC, 0x4428BC, 0x940084, 0xA80020, 0xA81000, 0x881400,
       0x503000, 0x007800, 0x006800, 0x005800, 0x004058, 0x000000, 0x000000, 0x000000,
       0xBCBCBC, 0x0078F8, 0x0058F8, 0x6844FC, 0xD800CC, 0xE40058, 0xF83800, 0xE45C10,
       0xAC7C00, 0x00B800, 0x00A800, 0x00A844, 0x008888, 0x000000, 0x000000, 0x000000,
       0xF8F8F8, 0x3CBCFC, 0x6888FC, 0x9878F8, 0xF878F8, 0xF85898, 0xF87858, 0xFCA044,
       0xF8B800, 0xB8F818, 0x58D854, 0x58F898, 0x00E8D8, 0x787878, 0x000000, 0x000000,
       0xFCFCFC, 0xA4E4FC, 0xB8B8F8, 0xD8B8F8, 0xF8B8F8, 0xF8A4C0, 0xF0D0B0, 0xFCE0A8,
       0xF8D878, 0xD8F878, 0xB8F8B8, 0xB8F8D8, 0x00FCFC, 0xF8D8F8, 0x000000, 0x000000]
GAMEBOY = [0x0F380F, 0x306230, 0x8BAC0F, 0x9BBC0F]

FIXED = {"db16": DB16, "db32": DB32, "nes": NES, "gameboy": GAMEBOY}


def fixed_palette(name: str) -> list[int]:
    require(name.lower() in FIXED, f"unknown palette {name!r}")
    return list(FIXED[name.lower()])


def custom_palette(colors: Sequence[int]) -> list[int]:
    require(len(colors) > 0, "a custom palette needs at least one colour")
    require(len(colors) <= MAX_PALETTE, f"a palette holds at most {MAX_PALETTE} colours")
    require(all(isinstance(v, int) and 0 <= v <= 0xFFFFFF for v in colors),
            "palette colours must be packed RGB between 0 and 0xFFFFFF")
    return list(colors)
