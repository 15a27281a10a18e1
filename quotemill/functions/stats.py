"""Normal distribution as SQL expressions (there is no built-in), for Spark and for checks alike."""

from __future__ import annotations

# Coefficients of the polynomial for the normal distribution (Abramowitz and Stegun 26.2.17).
_CDF = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# Coefficients of the rational approximation of the inverse normal distribution by P. J. Acklam.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _number(x: float) -> str:
    return f"cast({x!r} as double)"


def _horner(c: tuple[float, ...], x: str) -> str:
    out = _number(c[0])
    for v in c[1:]:
        out = f"({out} * {x} + {_number(v)})"
    return out


def normal_cdf(x: str) -> str:
    """P[Z <= x], to about 1e-7."""
    t = f"(1 / (1 + {_number(_CDF[0])} * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) * {_number(0.3989422804014327)} * {t} * {_horner(_CDF[:0:-1], t)})"
    return f"(case when ({x}) >= 0 then 1 - {tail} else {tail} end)"


def normal_inverse(p: str) -> str:
    """z with P[Z <= z] = p, to about 1e-9, for 0 < p < 1."""
    q, r = f"(({p}) - 0.5)", f"((({p}) - 0.5) * (({p}) - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    tail = lambda s: f"({_horner(_C, s)} / ({_horner(_D, s)} * {s} + 1))"
    middle = f"({_horner(_A, r)} * {q} / ({_horner(_B, r)} * {r} + 1))"
    return f"(case when ({p}) < 0.02425 then {tail(low)} when ({p}) > 0.97575 then -{tail(high)} else {middle} end)"
