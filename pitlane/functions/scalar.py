"""Scalar expressions: guarded arithmetic, costs, rounding, the normal distribution."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BPS = 10_000
SECONDS_PER_YEAR = 31_557_600
PERIODS_PER_YEAR = 252
WEIGHT_DIGITS = 6


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def guarded_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Ratio that is missing when either side is missing or the denominator is not positive."""
    n, d = _c(numerator), _c(denominator)
    return F.when(d > 0, n / d)


def log_positive(x: Column | str) -> Column:
    """``ln`` of a positive value, else missing."""
    return F.when(_c(x) > 0, F.ln(_c(x)))


def round_half_up(x: Column | str, digits: int = 6) -> Column:
    """``floor(x * 10**d + 0.5) / 10**d``; the same in every SQL engine, unlike ``round``.

    Values so large that a double has no digits left to round are kept as they are.
    """
    scale = float(10**digits)
    lifted = _c(x) * F.lit(scale)
    return F.when(F.abs(lifted) < 2.0**53, F.floor(lifted + F.lit(0.5)).cast("double") / F.lit(scale)).otherwise(_c(x))


def share_down(part: str, total: str, digits: int = WEIGHT_DIGITS) -> Column:
    """``part / total`` of two decimal columns, cut down to ``digits`` by exact integer division."""
    return F.expr(f"({part} * {10**digits}) div {total}").cast("double") / F.lit(float(10**digits))


def slipped(price: Column | str, side: Column | str, bps: float) -> Column:
    """Fill price after slippage: buys pay more, sells receive less."""
    p = _c(price)
    move = p * F.lit(float(bps)) / F.lit(float(BPS))
    return F.when(_c(side) == "buy", p + move).otherwise(p - move)


def commission(qty: Column | str, per_share: float) -> Column:
    return _c(qty) * F.lit(float(per_share))


def mid_price(bid: Column | str, ask: Column | str) -> Column:
    """Mean of bid and ask; missing when it is not positive."""
    mid = (_c(bid) + _c(ask)) / 2.0
    return F.when(mid > 0, mid)


def unrealised_pl(qty: Column | str, avg_entry: Column | str, price: Column | str) -> Column:
    return (_c(price) - _c(avg_entry)) * _c(qty)


def window_label(start: Column | str, end: Column | str) -> Column:
    return F.concat_ws(" -> ", F.date_format(_c(start), "yyyy-MM-dd"), F.date_format(_c(end), "yyyy-MM-dd"))


def parse_day(text: Column | str) -> Column:
    """``YYYY-MM-DD`` to a UTC midnight timestamp; bad text is an error, as elsewhere in ANSI mode."""
    return F.to_timestamp(_c(text), "yyyy-MM-dd")


def annualised(x: Column, periods: int = PERIODS_PER_YEAR) -> Column:
    if periods < 1:
        raise ValueError(f"periods per year must be >= 1, got {periods}")
    return x * F.lit(float(periods) ** 0.5)


# Hart's double-precision rational approximation of the normal tail.
_CDF_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_CDF_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_CDF_SWITCH = 7.07106781186547
_SQRT_2PI = 2.506628274631

# Algorithm AS 241 (Wichura 1988), coefficients from the highest power down.
_PPF_MID_NUM = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
    13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608,
)
_PPF_MID_DEN = (
    5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
    5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0,
)
_PPF_TAIL_NUM = (
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
    3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734,
)
_PPF_TAIL_DEN = (
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
    0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0,
)
_PPF_FAR_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.2426609473880784386e-3, 0.026532189526576123093,
    0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772,
)
_PPF_FAR_DEN = (
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
    0.0148753612908506148525, 0.1369298809227358053, 0.5998322065558879376, 1.0,
)


def _poly(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often the body names it."""
    return F.transform(F.array(x), body)[0]


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function, about 1e-15 absolute error."""

    def body(z: Column) -> Column:
        a = F.abs(z)
        dens = F.exp(-a * a / 2.0)
        near = dens * _poly(a, _CDF_NUM) / _poly(a, _CDF_DEN)
        frac = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            frac = a + F.lit(k) / frac
        tail = F.when(a > 37, 0.0).when(a < _CDF_SWITCH, near).otherwise(dens / frac / F.lit(_SQRT_2PI))
        return _let(tail, lambda t: F.when(z.isNotNull(), F.when(z > 0, F.lit(1.0) - t).otherwise(t)))

    return _let(_c(z), body)


def normal_ppf(p: Column | str) -> Column:
    """Standard normal quantile; missing outside (0, 1)."""

    def size(r: Column) -> Column:
        near, far = r - 1.6, r - 5.0
        return F.when(r <= 5.0, _poly(near, _PPF_TAIL_NUM) / _poly(near, _PPF_TAIL_DEN)).otherwise(
            _poly(far, _PPF_FAR_NUM) / _poly(far, _PPF_FAR_DEN)
        )

    def body(p: Column) -> Column:
        q = p - 0.5
        centre = _let(F.lit(0.180625) - q * q, lambda m: _poly(m, _PPF_MID_NUM) / _poly(m, _PPF_MID_DEN)) * q
        tail = _let(F.sqrt(-F.ln(F.when(q <= 0, p).otherwise(F.lit(1.0) - p))), size)
        inside = F.when(F.abs(q) <= 0.425, centre).when(q < 0, -tail).otherwise(tail)
        return F.when((p > 0) & (p < 1), inside)

    return _let(_c(p), body)
