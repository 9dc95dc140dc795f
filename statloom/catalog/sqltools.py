"""Pieces of comparison SQL: tail probabilities by Simpson's rule over plain densities."""

STEPS = 4000


def _simpson(density: str, upper: str, arg: str = "u") -> str:
    """Integral of `density` (an expression in `u`) from 0 to `upper`, as a correlated subquery."""
    weight = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    body = density.replace("{u}", f"(i * ({upper}) / {STEPS}.0)")
    return f"(SELECT sum({weight} * ({body})) * ({upper}) / {STEPS}.0 / 3 FROM range(0, {STEPS + 1}) AS g(i))"


def t_two_sided(t: str, df: str) -> str:
    density = (f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) "
               f"* pow(1 + {{u}} * {{u}} / ({df}), -(({df}) + 1) / 2.0)")
    return f"greatest(0.0, 1 - 2 * {_simpson(density, f'least(abs({t}), 40.0)')})"


def normal_two_sided(z: str) -> str:
    return f"greatest(0.0, 1 - 2 * {_simpson('exp(-{u} * {u} / 2) / sqrt(2 * pi())', f'least(abs({z}), 40.0)')})"


def chi2_upper(x: str, df: str) -> str:
    """For two or more degrees of freedom."""
    density = (f"CASE WHEN {{u}} = 0 THEN CASE WHEN ({df}) = 2 THEN 0.5 ELSE 0 END ELSE "
               f"exp((({df}) / 2.0 - 1) * ln(greatest({{u}}, 1e-300)) - {{u}} / 2 - lgamma(({df}) / 2.0) "
               f"- ({df}) / 2.0 * ln(2.0)) END")
    return f"greatest(0.0, 1 - {_simpson(density, f'least({x}, 200.0)')})"


def f_upper(f: str, d1: str, d2: str) -> str:
    """For two or more numerator degrees of freedom."""
    density = (f"CASE WHEN {{u}} = 0 AND ({d1}) > 2 THEN 0 ELSE exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) "
               f"- lgamma(({d2}) / 2.0) + ({d1}) / 2.0 * ln(({d1}) / (1.0 * ({d2}))) + (({d1}) / 2.0 - 1) "
               f"* ln(greatest({{u}}, 1e-300)) - (({d1}) + ({d2})) / 2.0 * ln(1 + ({d1}) * {{u}} / ({d2}))) END")
    return f"greatest(0.0, 1 - {_simpson(density, f'least({f}, 60.0)')})"


def t_quantile_975(df: str) -> str:
    """Upper 2.5 % point for large df, by its expansion in 1/df."""
    z = 1.959963984540054
    a = (z**3 + z) / 4
    b = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    c = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return f"({z!r} + {a!r} / ({df}) + {b!r} / pow({df}, 2) + {c!r} / pow({df}, 3))"


def stars(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"


def p_text(p: str) -> str:
    return f"CASE WHEN {p} < 0.001 THEN 'p < .001' ELSE printf('p = %.3f', {p}) END"


def average_ranks(table: str, value: str) -> str:
    """Subquery of (v, n, r): distinct values with counts and average ranks."""
    return (f"(SELECT v, n, sum(n) OVER (ORDER BY v) - n + (n + 1) / 2.0 AS r FROM "
            f"(SELECT {value} AS v, count(*) AS n FROM {table} GROUP BY 1))")


# Coefficients of the rational approximations of the normal quantile of algorithm AS 241, lowest power first.
_NEAR = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
          3.3430575583588128105e4, 2.5090809287301226727e3),
         (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4,
          2.8729085735721942674e4, 5.2264952788528545610e3))
_TAIL = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0,
          2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
         (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2,
          5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2,
         1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5,
         1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _power_sum(coefficients, x: str) -> str:
    out = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {float(c)!r})"
    return out


def normal_quantile(p: str) -> str:
    def ratio(pair, x):
        return f"{_power_sum(pair[0], x)} / {_power_sum(pair[1], x)}"

    q, r = f"(({p}) - 0.5)", f"sqrt(-ln(least({p}, 1 - ({p}))))"
    side = f"CASE WHEN {q} < 0 THEN -1 ELSE 1 END"
    return (f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(_NEAR, f'(0.180625 - {q} * {q})')} WHEN {r} <= 5 THEN ({side}) * {ratio(_TAIL, f'({r} - 1.6)')} "
            f"ELSE ({side}) * {ratio(_FAR, f'({r} - 5)')} END")


def shapiro_wilk(rows: str, by: str) -> str:
    """Subquery (by, n, w, p) after Royston for samples of more than eleven values; `rows` selects the columns of `by` and x."""
    def poly(coefficients, x):
        return _power_sum(tuple(reversed(coefficients)), x)

    a1 = poly((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0), "u")
    a2 = poly((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0), "u")
    mean, spread = poly((0.0038915, -0.083751, -0.31082, -1.5861), "ln(n)"), poly((0.0030302, -0.082676, -0.4803), "ln(n)")
    half = normal_two_sided("z")
    return f"""(SELECT {by}, n, w, CASE WHEN z >= 0 THEN half / 2 ELSE 1 - half / 2 END AS p FROM (SELECT *, {half} AS half FROM (
SELECT *, (ln(1 - w) - {mean}) / exp({spread}) AS z FROM (
SELECT {by}, n, pow((t - m1 * (y1 - x1) - m2 * (y2 - x2)) / sqrt((ssq - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * (y1 - x1) + a2 * (y2 - x2), 2) / ss AS w FROM (
SELECT *, m1 / sqrt(ssq) + {a1} AS a1, m2 / sqrt(ssq) + {a2} AS a2 FROM (
SELECT {by}, count(*) AS n, 1 / sqrt(count(*)) AS u, sum(m * x) AS t, sum(m * m) AS ssq, var_samp(x) * (count(*) - 1) AS ss, max(m) AS m1, max(m) FILTER (i = k - 1) AS m2,
  min(x) AS x1, max(x) FILTER (i = 2) AS x2, max(x) FILTER (i = k - 1) AS y2, max(x) AS y1 FROM (
SELECT *, {normal_quantile('(i - 0.375) / (k + 0.25)')} AS m FROM (
SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x) AS i, count(*) OVER (PARTITION BY {by}) AS k FROM ({rows}) WHERE x IS NOT NULL)) GROUP BY {by}))))))"""
