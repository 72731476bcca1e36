"""Normal-distribution functions as column expressions.

Spark has no ``erf``. The complementary error function below uses the rational
Chebyshev approximations of W. J. Cody, "Rational Chebyshev Approximations for
the Error Function", Math. Comp. 23 (1969), good to about 1e-15 relative.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Coefficients of the cited paper, highest power first.
SMALL_NUM = (
    1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
    3.77485237685302021e2, 3.20937758913846947e3,
)
SMALL_DEN = (
    1.0, 2.36012909523441209e1, 2.44024637934444173e2,
    1.28261652607737228e3, 2.84423683343917062e3,
)
MIDDLE_NUM = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
    6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
    1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
MIDDLE_DEN = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
    1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
    3.43936767414372164e3, 1.23033935480374942e3,
)
TAIL_NUM = (
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
    1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4,
)
TAIL_DEN = (
    1.0, 2.56852019228982242e0, 1.87295284992346725e0,
    5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3,
)
SMALL_LIMIT = 0.46875
MIDDLE_LIMIT = 4.0


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    value = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        value = f"({value} * {x} + {c!r}D)"
    return value


def erfc(x: str) -> Column:
    """Complementary error function of a SQL expression.

    One SQL text, because the same tree from Column operators takes a driver
    round trip per polynomial term; and bound to a lambda variable, so that the
    argument is evaluated once and the long formula stays out of the generated
    code. Readouts have one row per experiment, which needs no compiled loop.
    """
    y, square, inverse = "abs(v)", "(v * v)", "(1D / (v * v))"
    small = f"1D - {y} * {_polynomial(SMALL_NUM, square)} / {_polynomial(SMALL_DEN, square)}"
    middle = f"exp(-{square}) * {_polynomial(MIDDLE_NUM, y)} / {_polynomial(MIDDLE_DEN, y)}"
    fraction = f"{inverse} * {_polynomial(TAIL_NUM, inverse)} / {_polynomial(TAIL_DEN, inverse)}"
    tail = f"exp(-{square}) * ({1 / math.sqrt(math.pi)!r}D - {fraction}) / {y}"
    positive = f"CASE WHEN {y} <= {SMALL_LIMIT}D THEN {small} WHEN {y} <= {MIDDLE_LIMIT}D THEN {middle} ELSE {tail} END"
    return F.expr(
        f"transform(array({x}), v -> CASE WHEN v < 0 THEN 2D - ({positive}) WHEN v IS NOT NULL THEN {positive} END)[0]"
    )


def upper_tail(z: str) -> Column:
    """P(Z > z) for a standard normal Z."""
    return F.lit(0.5) * erfc(f"({z} / {math.sqrt(2.0)!r}D)")


def lower_tail(z: str) -> Column:
    """P(Z < z) for a standard normal Z."""
    return F.lit(0.5) * erfc(f"(-{z} / {math.sqrt(2.0)!r}D)")


def chi2_upper_tail_1df(statistic: str) -> Column:
    """p-value of a chi-square statistic with one degree of freedom."""
    return erfc(f"sqrt({statistic} / 2D)")


def z_quantile(p: float) -> float:
    """Normal quantile of a parameter (driver side, one number)."""
    return NormalDist().inv_cdf(p)
