"""Columns for shares, intervals, weights of evidence and array distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def share(a: Column, b: Column, least: float = EPS) -> Column:
    return a / F.greatest(b.cast("double"), F.lit(least))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval for k of n."""
    n = n.cast("double")
    p = k / n
    middle = p + z * z / (2 * n)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)


def smoothed_lift(f: Column, of_f: Column, g: Column, of_g: Column) -> Column:
    return ((f + 0.5) / (of_f + 1.0)) / ((g + 0.5) / (of_g + 1.0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def clr(a: Column, least: float = 1e-6) -> Column:
    """Centred log-ratios of an array of shares."""
    logs = F.transform(a, lambda x: F.ln(F.greatest(x, F.lit(least))))
    return F.transform(logs, lambda x: x - total(logs) / F.size(logs))


def entropy(a: Column, least: float = 1e-12) -> Column:
    return -total(F.transform(a, lambda p: p * F.ln(F.greatest(p, F.lit(least)))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def hellinger(p: Column, q: Column) -> Column:
    return F.sqrt(total(F.zip_with(p, q, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), 2)))) / F.sqrt(F.lit(2.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """In bits, of arrays of positive shares."""
    def half(a, b):
        return total(F.zip_with(a, b, lambda x, y: x * F.log2(x / ((x + y) / 2))))

    return (half(p, q) + half(q, p)) / 2


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2))))


# The published rational approximation of the normal quantile (Wichura, Algorithm AS 241), highest power first:
# the middle (|p - 1/2| <= 0.425), the flanks (sqrt(-ln p) <= 5) and the tails; numerator, then denominator.
MIDDLE = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080), (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0))
FLANK = ((7.74545014278341407640e-4, 2.27238449892691845833e-2, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734), (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0))
TAIL = ((2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 0.296560571828504891230, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720), (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 0.136929880922735805310, 0.599832206555887937690, 1.0))


def _ratio(parts: tuple, r: Column) -> Column:
    def poly(c: tuple) -> Column:
        out = F.lit(c[0])
        for x in c[1:]:
            out = out * r + F.lit(x)
        return out

    return poly(parts[0]) / poly(parts[1])


def inverse_normal(p: Column) -> Column:
    """The quantile of the standard normal distribution for 0 < p < 1, as a column expression."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    side = F.when(r <= 5, _ratio(FLANK, r - 1.6)).otherwise(_ratio(TAIL, r - 5))
    return F.when(F.abs(q) <= 0.425, _ratio(MIDDLE, F.lit(0.180625) - q * q) * q).otherwise(F.when(q < 0, -side).otherwise(side))


def normal_quantile_sql(p: str) -> str:
    """The same in SQL."""
    def poly(c: tuple, r: str) -> str:
        out = f"{c[0]!r}::DOUBLE"
        for x in c[1:]:
            out = f"({out} * {r} + {x!r}::DOUBLE)"
        return out

    def ratio(parts: tuple, r: str) -> str:
        return f"({poly(parts[0], r)} / {poly(parts[1], r)})"

    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    side = f"(CASE WHEN {r} <= 5 THEN {ratio(FLANK, f'({r} - 1.6::DOUBLE)')} ELSE {ratio(TAIL, f'({r} - 5)')} END)"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN {ratio(MIDDLE, f'(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))')} * ({p} - 0.5) WHEN {p} < 0.5 THEN -{side} ELSE {side} END)"
