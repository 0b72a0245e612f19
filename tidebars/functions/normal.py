"""Normal distribution in column arithmetic, as SQL text that any engine reads.

Fixed values: the coefficients of Wichura's AS 241 (quantiles) and of Hart's form as given by West (distribution function).
"""

from __future__ import annotations

EULER_GAMMA = 0.5772156649015329
E = 2.718281828459045

# Highest power last.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
HART = (
    (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 3.52624965998911e-2),
    (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2),
)


def _double(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = _double(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * ({x}) + {_double(c)})"
    return out


def _ratio(x: str, pair: tuple[tuple[float, ...], tuple[float, ...]]) -> str:
    return f"{polynomial(x, pair[0])} / {polynomial(x, pair[1])}"


def quantile(p: str) -> str:
    """Value below which a standard normal draw falls with probability ``p`` (0 < p < 1)."""
    q = f"(({p}) - 0.5)"
    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    outer = f"CASE WHEN {r} <= 5 THEN {_ratio(f'({r} - 1.6)', MIDDLE)} ELSE {_ratio(f'({r} - 5)', TAIL)} END"
    return f"CASE WHEN abs{q} <= 0.425 THEN {q} * {_ratio(f'(0.180625 - {q} * {q})', CENTRE)} WHEN {q} < 0 THEN -({outer}) ELSE {outer} END"


def distribution(x: str) -> str:
    """Probability that a standard normal draw is at most ``x``."""
    a = f"abs({x})"
    bell = f"exp(-({x}) * ({x}) / 2)"
    far = f"{a} + {_double(0.65)}"
    for k in (4, 3, 2, 1):
        far = f"{a} + {k} / ({far})"
    upper = f"CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {_double(7.07106781186547)} THEN {bell} * {_ratio(a, HART)} ELSE {bell} / ({far}) / {_double(2.506628274631)} END"
    return f"CASE WHEN ({x}) > 0 THEN 1 - ({upper}) ELSE {upper} END"


def expected_maximum(trials: str) -> str:
    """Expected maximum of that many standard normal draws (extreme-value form); 0 for one trial."""
    t = f"CAST({trials} AS DOUBLE)"
    g = _double(EULER_GAMMA)
    return f"CASE WHEN {t} <= 1 THEN 0.0 ELSE (1 - {g}) * ({quantile(f'(1 - 1 / ({t}))')}) + {g} * ({quantile(f'(1 - 1 / ({t} * {_double(E)}))')}) END"
