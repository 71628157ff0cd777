"""Normal quantiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerators and denominators of Wichura's algorithm AS 241 (Applied
# Statistics 37, 1988, 477-484), highest power first: centre, tails, far tails.
CENTRE = (
    (2.509080928730122672e3, 3.343057558358812810e4, 6.726577092700870085e4, 4.592195393154987145e4,
     1.373169376550946112e4, 1.971590950306551442e3, 1.331416678917843774e2, 3.387132872796366608e0),
    (5.226495278852854561e3, 2.872908573572194267e4, 3.930789580009271061e4, 2.121379430158659586e4,
     5.394196021424751107e3, 6.871870074920579083e2, 4.231333070160091125e1, 1.0),
)
TAIL = (
    (7.745450142783414076e-4, 2.272384498926918458e-2, 2.417807251774506117e-1, 1.270458252452368382e0,
     3.647848324763204605e0, 5.769497221460691405e0, 4.630337846156545295e0, 1.423437110749683577e0),
    (1.050750071644416843e-9, 5.475938084995344946e-4, 1.519866656361645719e-2, 1.481039764274800745e-1,
     6.897673349851000045e-1, 1.676384830183803849e0, 2.053191626637758821e0, 1.0),
)
FAR_TAIL = (
    (2.010334399292288132e-7, 2.711555568743487578e-5, 1.242660947388078438e-3, 2.653218952657612309e-2,
     2.965605718285048912e-1, 1.784826539917291335e0, 5.463784911164114369e0, 6.657904643501103777e0),
    (2.044263103389939785e-15, 1.421511758316445888e-7, 1.846318317510054681e-5, 7.868691311456132591e-4,
     1.487536129085061485e-2, 1.369298809227358053e-1, 5.998322065558879376e-1, 1.0),
)


def _ratio(x: Column, polynomials: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    values = []
    for first, *others in polynomials:
        value = F.lit(first)
        for coefficient in others:
            value = value * x + F.lit(coefficient)
        values.append(value)
    return values[0] / values[1]


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability between 0 and 1, to about 1e-15;
    missing for any other value."""
    middle = p - F.lit(0.5)
    depth = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(depth <= 5, _ratio(depth - F.lit(1.6), TAIL)).otherwise(_ratio(depth - F.lit(5.0), FAR_TAIL))
    value = F.when(F.abs(middle) <= 0.425, middle * _ratio(F.lit(0.180625) - middle * middle, CENTRE)).otherwise(
        tail * F.signum(middle))
    return F.when((p > 0) & (p < 1), value)
