"""Quantisers by name: ``quantize(weights, "k9")`` gives each row's values and codes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import grid
from gridloom.operators import layout


def _k_grid(k: int):
    def of(x, g):
        d = grid.digit(x, g["m"], k)
        return d, grid.dequantize(d, g["m"], k)

    return of


def _signed(top: int):
    def of(x, g):
        d = grid.signed_code(x, g["m"], top)
        return d, d * g["m"] / float(top)

    return of


def _ternary(x, g):
    d = grid.ternary(x, g["a"])
    return d, d * g["a"]


def _affine(x, g):
    d = grid.affine_digit(x, g["lo"], g["hi"], 9)
    return d, grid.affine_value(d, g["lo"], g["hi"], 9)


SCHEMES = {"int8": _signed(127), "int4": _signed(7), "ternary": _ternary, "affine9": _affine}


def scheme(name: str):
    """A registered scheme, or ``kN`` for the N-level grid."""
    if name in SCHEMES:
        return SCHEMES[name]
    if (m := re.fullmatch(r"k(\d+)", name)) and int(m[1]) % 2 and int(m[1]) > 2:
        return _k_grid(int(m[1]))
    raise ValueError(f"unknown scheme {name!r}; there are {sorted(SCHEMES)} and kN for odd N")


def quantize(wide: DataFrame, name: str) -> DataFrame:
    """(tensor, row, grp, d, q) of (tensor, row, v), group by group, within each row."""
    of = scheme(name)
    g = layout.grouped(wide).withColumns({"m": layout.absmax("g"), "a": layout.mean_of(F.transform("g", lambda x: F.abs(x))), "lo": F.array_min("g"), "hi": F.array_max("g")})
    side = {c: F.col(c) for c in ("m", "a", "lo", "hi")}
    return g.select("tensor", "row", "grp", F.transform("g", lambda x: of(x, side)[0].cast("int")).alias("d"), F.transform("g", lambda x: of(x, side)[1].cast("double")).alias("q"))
