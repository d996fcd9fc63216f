"""The upper tail of the normal distribution as one expression, in text that Spark and other SQL engines read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational approximations of erf and erfc (1969).
ERF_TOP = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_BOTTOM = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MID_TOP = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
MID_BOTTOM = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
FAR_TOP = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
FAR_BOTTOM = (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
ROOT_PI = 5.6418958354775628695e-1


def _number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _horner(lead: str, steps: tuple[float, ...], last: float, by: str) -> str:
    out = lead
    for c in steps:
        out = f"(({out} + {_number(c)}) * {by})"
    return f"({out} + {_number(last)})"


def erfc_sql(x: str) -> str:
    """erfc of a column or other short expression ``x``; NaN stays NaN."""
    y, sq = f"abs({x})", f"({x} * {x})"
    near_top = _horner(f"{_number(ERF_TOP[4])} * {sq}", ERF_TOP[:3], ERF_TOP[3], sq)
    near_bottom = _horner(sq, ERF_BOTTOM[:3], ERF_BOTTOM[3], sq)
    # exponents keep the literals doubles: a decimal here would round
    cut = f"(CAST(floor({y} * 16e0) AS DOUBLE) / 16e0)"
    decay = f"(exp(-{cut} * {cut}) * exp(-({y} - {cut}) * ({y} + {cut})))"
    mid = f"({decay} * {_horner(f'{_number(MID_TOP[8])} * {y}', MID_TOP[:7], MID_TOP[7], y)} / {_horner(y, MID_BOTTOM[:7], MID_BOTTOM[7], y)})"
    inv = f"(1e0 / {sq})"
    tail = f"({inv} * {_horner(f'{_number(FAR_TOP[5])} * {inv}', FAR_TOP[:4], FAR_TOP[4], inv)} / {_horner(inv, FAR_BOTTOM[:4], FAR_BOTTOM[4], inv)})"
    far = f"({decay} * ({_number(ROOT_PI)} - {tail}) / {y})"
    return (
        f"CASE WHEN isnan({x}) THEN CAST('NaN' AS DOUBLE)"
        f" WHEN {y} <= 0.46875e0 THEN 1e0 - {x} * {near_top} / {near_bottom}"
        f" WHEN {x} > 27e0 THEN CAST(0 AS DOUBLE) WHEN {x} < -6e0 THEN CAST(2 AS DOUBLE)"
        f" WHEN {y} <= 4e0 THEN CASE WHEN {x} > 0 THEN {mid} ELSE 2e0 - {mid} END"
        f" WHEN {x} > 0 THEN {far} ELSE 2e0 - {far} END"
    )


def normal_tail_sql(z: str) -> str:
    """P(Z > z); z must be a column name."""
    return f"0.5e0 * ({erfc_sql(f'({z} / {_number(2**0.5)})')})"


def normal_tail(z: str) -> Column:
    return F.expr(normal_tail_sql(z))
