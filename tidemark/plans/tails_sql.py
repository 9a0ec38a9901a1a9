"""Tails and gamma functions as SQL expressions of names: the oracle's side of ``functions.native``."""

from __future__ import annotations

import math

from ..functions import native

_list = lambda values: "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def polynomial(x: str, powers) -> str:
    return f"list_reduce({_list(powers)}, lambda a, c: a * ({x}) + c)"


def log_erfc(z: str) -> str:
    return f"({polynomial(f'4.0 / (2.0 + {z}) - 1.0', native.ERFC_POWERS)} + ln(2.0 / (2.0 + {z})) - ({z}) * ({z}))"


def chi2_log_tail(stat: str, df: str) -> str:
    return f"CASE WHEN {df} = 2 THEN -({stat}) / 2 WHEN {df} = 1 THEN least(0.0, {log_erfc(f'sqrt(({stat}) / 2)')}) END"


def _moved(z: str, term: str) -> str:
    return f"list_sum(list_transform(range(0, {native.SHIFT}), lambda k: {term.format(f'({z} + k)')}))"


def digamma(z: str) -> str:
    y = f"({z} + {native.SHIFT})"
    return f"(ln({y}) - 0.5 / {y} + {polynomial(f'1 / ({y} * {y})', native.DIGAMMA_SERIES[::-1])} / ({y} * {y}) - {_moved(z, '1.0 / {0}')})"


def trigamma(z: str) -> str:
    y = f"({z} + {native.SHIFT})"
    return f"(1.0 / {y} + 0.5 / ({y} * {y}) + {polynomial(f'1 / ({y} * {y})', native.TRIGAMMA_SERIES[::-1])} / ({y} * {y} * {y}) + {_moved(z, '1.0 / ({0} * {0})')})"


def t_log_two_sided(z: str, n: str) -> str:
    """z >= 0."""
    unit = f"(1.0 / (({n} + 1) * {z} / ({n} + {z} * {z}) + sqrt(({n} + 1) / {n})))"
    nodes = "[" + ", ".join(f"{{v: {a!r}::DOUBLE, w: {b!r}::DOUBLE}}" for a, b in zip(native.NODES, native.WEIGHTS, strict=True)) + "]"
    log1p = lambda x: f"ln(1 + {x} * {x} / {n})"
    rest = f"list_sum(list_transform({nodes}, lambda q: q.w * exp(-({n} + 1) / 2 * ({log1p(f'({z} + {unit} * q.v)')} - {log1p(z)}))))"
    return f"least(0.0, ln(2) + lgamma(({n} + 1) / 2) - lgamma({n} / 2) - 0.5 * ln({n} * pi()) - ({n} + 1) / 2 * {log1p(z)} + ln({unit} * {rest}))"


def chi2_of_log_tail(lp: str) -> str:
    far = f"sqrt(greatest(-2 * {lp} - ln(greatest(-2 * {lp}, 1.0)) - CASE WHEN {lp} < -3 THEN {math.log(math.pi / 2)!r} ELSE 0.0 END, 1e-6))"
    tail = log_erfc(f"(z / {math.sqrt(2.0)!r})")
    step = f"greatest(z + ({tail} - {lp}) / exp({0.5 * math.log(2 / math.pi)!r} - z * z / 2 - {tail}), z / 8)"
    return f"CASE WHEN {lp} < 0 THEN pow(list_reduce(range(0, {native.NORMAL_STEPS}), lambda z, k: {step}, {far}), 2) ELSE 0.0 END"
