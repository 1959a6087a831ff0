"""Normalisation labels, units and matrix kinds with the formulas that their labels state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.semantics import ieee_div, ieee_ln

UNITS = ("BP", "FRAG")

#: Label and description of the normalisations that are known beforehand; others are open.
NORMS = {
    "NONE": "None",
    "VC": "Coverage",
    "VC_SQRT": "Coverage (Sqrt)",
    "KR": "Balanced",
    "SCALE": "Fast scaling",
    "GW_KR": "Genome-wide balanced",
    "GW_VC": "Genome-wide coverage",
    "GW_SCALE": "Genome-wide fast scaling",
    "INTER_KR": "Inter balanced",
    "INTER_VC": "Inter coverage",
    "INTER_SCALE": "Inter fast scaling",
}
GENOME_WIDE_INTRA = ("GW_KR", "GW_VC", "GW_SCALE")
GENOME_WIDE_INTER = ("INTER_KR", "INTER_VC", "INTER_SCALE")
BUILT_BY_DEFAULT = ("VC", "VC_SQRT", "SCALE", "INTER_SCALE", "GW_SCALE")
GENOME_WIDE_FINEST = 25_000


def norm_label(name: str) -> str:
    """Labels are compared without case; an unknown one is a norm of its own."""
    return name.strip().upper()


def finest_resolution(norm: str) -> int:
    """The finest bin size that a norm is meant for."""
    return GENOME_WIDE_FINEST if norm_label(norm) in GENOME_WIDE_INTRA + GENOME_WIDE_INTER else 0


def first_valid_norm(preferred: list[str], present: list[str]) -> str:
    have = {norm_label(p) for p in present}
    for name in preferred:
        if norm_label(name) in have:
            return norm_label(name)
    raise ValueError(f"none of {preferred} is among {sorted(have)}")


def unit_of(name: str | None) -> str | None:
    return name.upper() if name and name.upper() in UNITS else None


def _kinds() -> dict[str, Callable[[dict[str, Column]], Column]]:
    """Formulas over o, e (observed, expected), c, ec (the control's), avg_o, avg_c, e0, ec0."""
    one = lambda x: x + 1
    oe = lambda v: ieee_div(v["o"], v["e"])
    oe1 = lambda v: ieee_div(one(v["o"]), one(v["e"]))
    ce = lambda v: ieee_div(v["c"], v["ec"])
    ce1 = lambda v: ieee_div(one(v["c"]), one(v["ec"]))
    log1 = lambda x: ieee_ln(one(x))
    ratio = lambda v: ieee_div(v["o"], v["c"]) * ieee_div(v["avg_c"], v["avg_o"])
    ratio1 = lambda v: ieee_div(one(v["o"]), one(v["c"])) * ieee_div(one(v["avg_c"]), one(v["avg_o"]))
    ratio0 = lambda v: ieee_div(v["o"], v["c"]) * ieee_div(v["ec0"], v["e0"])
    ratio01 = lambda v: ieee_div(one(v["o"]), one(v["c"])) * ieee_div(one(v["ec0"]), one(v["e0"]))
    logeo = lambda v: ieee_div(log1(v["o"]), log1(v["e"]))
    logceo = lambda v: ieee_div(log1(v["c"]), log1(v["ec"]))
    return {
        "OBSERVED": lambda v: v["o"],
        "EXPECTED": lambda v: v["e"],
        "OE": oe,
        "OEV2": lambda v: ieee_ln(oe(v)),
        "OEP1": oe1,
        "OEP1V2": lambda v: ieee_ln(oe1(v)),
        "OME": lambda v: v["o"] - v["e"],
        "LOG": lambda v: log1(v["o"]),
        "LOGEO": logeo,
        "METALOGEO": lambda v: ieee_div(log1(v["o"]) + 1, log1(v["e"]) + 1),
        "EXPLOGEO": lambda v: F.exp(logeo(v)),
        "EXPLOGEOINV": lambda v: F.exp(ieee_div(log1(v["e"]), log1(v["o"]))),
        "CONTROL": lambda v: v["c"],
        "OECTRL": ce,
        "OECTRLV2": lambda v: ieee_ln(ce(v)),
        "OECTRLP1": ce1,
        "OECTRLP1V2": lambda v: ieee_ln(ce1(v)),
        "CME": lambda v: v["c"] - v["ec"],
        "LOGC": lambda v: log1(v["c"]),
        "LOGCEO": logceo,
        "EXPLOGCEO": lambda v: F.exp(logceo(v)),
        "RATIO": ratio,
        "RATIOV2": lambda v: ieee_ln(ratio(v)),
        "RATIOP1": ratio1,
        "RATIOP1V2": lambda v: ieee_ln(ratio1(v)),
        "RATIO0": ratio0,
        "RATIO0V2": lambda v: ieee_ln(ratio0(v)),
        "RATIO0P1": ratio01,
        "RATIO0P1V2": lambda v: ieee_ln(ratio01(v)),
        "OERATIO": lambda v: ieee_div(oe(v), ce(v)),
        "OERATIOV2": lambda v: ieee_ln(ieee_div(oe(v), ce(v))),
        "OERATIOP1": lambda v: ieee_div(oe1(v), ce1(v)),
        "OERATIOP1V2": lambda v: ieee_ln(ieee_div(oe1(v), ce1(v))),
        "OERATIOMINUS": lambda v: oe(v) - ce(v),
        "OERATIOMINUSP1": lambda v: oe1(v) - ce1(v),
        "LOGRATIO": lambda v: ieee_div(log1(v["o"]), log1(v["c"])),
        "LOGEORATIO": lambda v: ieee_div(logeo(v), logceo(v)),
        "DIFF": lambda v: v["o"] - v["c"],
    }


MATRIX_KINDS = _kinds()


def matrix_kind(name: str, values: dict[str, Column]) -> Column:
    """A matrix kind's value; "oe" stands for OE."""
    return MATRIX_KINDS[name.upper()](values)
