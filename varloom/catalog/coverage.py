"""Coverage tests of prediction intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.catalog.base import query, tidy
from varloom.catalog.sql import chi2, define, phi, r, rs
from varloom.operators import coverage as cv, timing as tm
from varloom.plans import study

K = "asset, method, level_pct, side"
KEYS = ["asset", "method", "level_pct", "side"]

define("t_hits", """
  SELECT asset, date, method, level_pct, lo, hi, 'both' AS side, CASE WHEN y_true < lo OR y_true > hi THEN 1.0::DOUBLE ELSE 0.0 END AS hit, (100-level_pct)/100 AS alpha FROM t_iv
  UNION ALL SELECT asset, date, method, level_pct, lo, hi, 'upper', CASE WHEN y_true > hi THEN 1.0 ELSE 0.0 END, (100-level_pct)/200 FROM t_iv""")
define("t_counts", f"""
  SELECT {K}, max(alpha) AS a, count(*) AS n, CAST(sum(hit) AS BIGINT) AS x, {', '.join(f'count(*) FILTER (p = {i} AND hit = {j}) AS n{i}{j}' for i in (0, 1) for j in (0, 1))}
  FROM (SELECT *, lag(hit) OVER (PARTITION BY {K} ORDER BY date) AS p FROM t_hits) GROUP BY {K}""")


def xl(c: str, p: str) -> str:
    return f"(CASE WHEN {c} = 0 THEN 0 ELSE {c}*ln(greatest({p}, 1e-16)) END)"


define("t_lr", f"""
  SELECT *, uc + ind AS cc FROM (SELECT *, x/n AS rate,
    greatest(-2*({xl('x', 'a')}+{xl('(n-x)', '(1-a)')}-{xl('x', 'x/n')}-{xl('(n-x)', '(1-x/n)')}), 0) AS uc,
    (n00+n01 = 0 OR n10+n11 = 0) AS degenerate,
    CASE WHEN n00+n01 = 0 OR n10+n11 = 0 THEN 0 ELSE greatest(-2*({xl('(n00+n10)', '(1-(n01+n11)/(n00+n01+n10+n11))')}+{xl('(n01+n11)', '((n01+n11)/(n00+n01+n10+n11))')}
      -{xl('n00', '(1-n01/(n00+n01))')}-{xl('n01', '(n01/(n00+n01))')}-{xl('n10', '(1-n11/(n10+n11))')}-{xl('n11', '(n11/(n10+n11))')}), 0) END AS ind FROM t_counts)""")


def hits(spark, sf_dir):
    return cv.interval_hits(study.intervals(spark, sf_dir))


@query("X7_interval_hits", f"SELECT {K}, count(*) AS n, CAST(sum(hit) AS BIGINT) AS n_violations, {r('max(alpha)', 8, 'expected')} FROM t_hits GROUP BY {K}")
def interval_hits(spark, sf_dir):
    out = hits(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("n_violations"), F.max("alpha").alias("expected"))
    return tidy(out, [*KEYS, "n", "n_violations"], expected=8)


@query("T10_unconditional_coverage", f"""
  SELECT {K}, n, x AS n_violations, CASE WHEN abs(rate - a) <= 1e-8 + 1e-5*a THEN 'exact' WHEN rate > a THEN 'under-covers' ELSE 'over-covers' END AS direction,
    {r('rate', 8, 'violation_rate')}, {r('uc', 6, 'lr_uc')}, {r(chi2('uc', 1), 8, 'p_uc')} FROM t_lr""")
def unconditional_coverage(spark, sf_dir):
    out = cv.likelihood_ratio_tests(cv.hit_counts(hits(spark, sf_dir)))
    return tidy(out, [*KEYS, "n", "n_violations", "direction"], violation_rate=8, lr_uc=6, p_uc=8)


@query("T11_independence", f"""
  SELECT {K}, n00, n01, n10, n11, degenerate, {r('ind', 6, 'lr_ind')}, {r(f"CASE WHEN degenerate THEN 1 ELSE {chi2('ind', 1)} END", 8, 'p_ind')},
    {r('cc', 6, 'lr_cc')}, {r(chi2('cc', 2), 8, 'p_cc')} FROM t_lr""")
def independence(spark, sf_dir):
    out = cv.likelihood_ratio_tests(cv.hit_counts(hits(spark, sf_dir)))
    return tidy(out, [*KEYS, "n00", "n01", "n10", "n11", "degenerate"], lr_ind=6, p_ind=8, lr_cc=6, p_cc=8)


# The oracle of the regression tests factorises the moment matrix step by step in SQL: with L L' = X'X and
# L z = X'y the quadratic form y'X (X'X)^-1 X'y is the sum of the squared z, and its first terms belong to
# the restricted design.


def quadratic_form(source: str, names, y: str, by: str) -> str:
    k = len(names)
    sums = [f"sum({a}*{b}) AS a{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    sums += [f"sum({a}*{y}) AS b{i}" for i, a in enumerate(names)]
    text = f"SELECT {by}, count(*) AS n, {', '.join(sums)} FROM {source} GROUP BY {by}"
    for j in range(k):
        inner = "".join(f"-l{j}_{m}*l{j}_{m}" for m in range(j))
        text = f"SELECT *, sqrt(a{j}_{j}{inner}) AS l{j}_{j} FROM ({text})"
        below = [f"(a{i}_{j}{''.join(f'-l{i}_{m}*l{j}_{m}' for m in range(j))})/l{j}_{j} AS l{i}_{j}" for i in range(j + 1, k)]
        zj = f"(b{j}{''.join(f'-l{j}_{m}*z{m}' for m in range(j))})/l{j}_{j} AS z{j}"
        text = f"SELECT *, {', '.join([*below, zj])} FROM ({text})"
    return text


LAGS = ", ".join(f"lag(hit - alpha, {k}) OVER (PARTITION BY {K} ORDER BY date) AS l{k}" for k in range(1, 5))
define("t_dq", quadratic_form(
    f"(SELECT {K}, alpha, hit - alpha AS y, 1.0 AS one, {LAGS} FROM t_hits QUALIFY l4 IS NOT NULL)", ["one", "l1", "l2", "l3", "l4"], "y", f"{K}, alpha"))
SQ = lambda a, b: "+".join(f"z{i}*z{i}" for i in range(a, b))
AA = "(alpha*(1-alpha))"


@query("T12_dynamic_quantile", f"""
  SELECT {K}, n, {r('q', 6, 'dq_full')}, {r(chi2('q', 5), 8, 'p_full')} FROM (SELECT {K}, n, ({SQ(0, 5)})/{AA} AS q FROM t_dq)""")
def dynamic_quantile(spark, sf_dir):
    return tidy(cv.dynamic_quantile(hits(spark, sf_dir)), [*KEYS, "n"], dq_full=6, p_full=8)


define("t_cond", """
  SELECT h.*, s1, s2, CAST(s1 = 0 AS INT)::DOUBLE AS state0, CAST(s1 = 1 AS INT)::DOUBLE AS state1, CAST(s1 = 2 AS INT)::DOUBLE AS state2,
         CAST(s1 <> s2 AS INT)::DOUBLE AS transition, ln(hi - lo) AS log_width FROM t_hits h LEFT JOIN t_lagged USING (asset, date)""")


def incremental(name: str, cols) -> None:
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    define(f"t_dq{name}", quadratic_form(
        f"(SELECT {K}, alpha, hit - alpha AS y, 1.0 AS one, {', '.join(cols)}, {LAGS} FROM t_cond WHERE {known} QUALIFY l4 IS NOT NULL)",
        ["one", "l1", "l2", "l3", "l4", *cols], "y", f"{K}, alpha"))


incremental("reg", ["state1", "state2"])
incremental("tra", ["transition"])
incremental("wid", ["log_width"])


def conditioned(spark, sf_dir):
    return cv.with_conditioners(hits(spark, sf_dir), tm.lag_states(study.states(spark, sf_dir), (1, 2)))


@query("T13_incremental_quantile", f"""
  SELECT {K}, n, {r('q0', 6, 'dq_restricted')}, {r('q', 6, 'dq_full')}, {r('q1', 6, 'dq_incremental')}, {r(chi2('q1', 2), 8, 'p_incremental')} FROM (
    SELECT {K}, n, ({SQ(0, 7)})/{AA} AS q, ({SQ(0, 5)})/{AA} AS q0, ({SQ(5, 7)})/{AA} AS q1 FROM t_dqreg)""", branches=True)
def incremental_quantile(spark, sf_dir):
    out = cv.dynamic_quantile(conditioned(spark, sf_dir).where("state1 is not null"), ["state1", "state2"])
    return tidy(out, [*KEYS, "n"], dq_restricted=6, dq_full=6, dq_incremental=6, p_incremental=8)


def two_sample(flag: str) -> str:
    return f"""
  SELECT {K}, n, n1, n0, p1, p0, (p1-p0) AS diff, (p1-p0)/sqrt(pool*(1-pool)*(1/n1+1/n0)) AS z_iid, (p1-p0)/sqrt(lrv/((n1/n)*(n0/n))/((n1/n)*(n0/n))/n) AS z_hac FROM (
    SELECT {', '.join('x.' + c for c in KEYS)}, any_value(x.n) AS n, any_value(x.n1) AS n1, any_value(x.n0) AS n0, any_value(x.p1) AS p1, any_value(x.p0) AS p0, any_value(x.pool) AS pool,
      sum(CASE WHEN k = 0 THEN x.u*y.u ELSE 2*(1-k/(x.lg+1))*x.u*y.u END)/any_value(x.n) AS lrv
    FROM t_u{flag} x, (SELECT unnest(range(0, 35)) AS k), t_u{flag} y
    WHERE k <= x.lg AND y.asset = x.asset AND y.method = x.method AND y.level_pct = x.level_pct AND y.side = x.side AND y.i = x.i - k
    GROUP BY {', '.join('x.' + c for c in KEYS)})"""


for _flag in ("state0", "state1", "state2", "transition"):
    define(f"t_u{_flag}", f"""
  SELECT *, floor(power(n, 1/3) + 1e-9) AS lg, (hit - CASE WHEN g = 1 THEN p1 ELSE p0 END)*(g - n1/n) AS u FROM (
    SELECT {K}, date, hit, {_flag} AS g, row_number() OVER (PARTITION BY {K} ORDER BY date) AS i, count(*) OVER k AS n, sum({_flag}) OVER k AS n1, sum(1-{_flag}) OVER k AS n0,
      avg(hit) FILTER ({_flag} = 1) OVER k AS p1, avg(hit) FILTER ({_flag} = 0) OVER k AS p0, avg(hit) OVER k AS pool
    FROM t_cond WHERE {_flag} IS NOT NULL WINDOW k AS (PARTITION BY {K}))""")
    define(f"t_two{_flag}", two_sample(_flag))


@query("T14_coverage_difference", f"""
  SELECT {K}, n, CAST(n1 AS BIGINT) AS n_flagged, CAST(n0 AS BIGINT) AS n_rest, {r('p1', 8, 'rate_flagged')}, {r('p0', 8, 'rate_rest')}, {r('diff', 8, 'diff')},
    {r('z_iid', 7, 'z_iid')}, {r('z_hac', 7, 'z_hac')}, {r('2*' + phi('-abs(z_iid)'), 8, 'p_iid')}, {r('2*' + phi('-abs(z_hac)'), 8, 'p_hac')} FROM t_twostate2""", branches=True)
def coverage_difference(spark, sf_dir):
    out = cv.two_sample_difference(conditioned(spark, sf_dir), "state2")
    return tidy(out, [*KEYS, "n", "n_flagged", "n_rest"], rate_flagged=8, rate_rest=8, diff=8, z_iid=7, z_hac=7, p_iid=8, p_hac=8)


@query("T15_coverage_suite", f"""
  SELECT {K}, test, n, n_violations, df, direction, {rs(violation_rate=8, stat=6, p_value=8)} FROM (
    SELECT {K}, 'LR_uc' AS test, n, x AS n_violations, rate AS violation_rate, 1 AS df, uc AS stat, {chi2('uc', 1)} AS p_value,
      CASE WHEN abs(rate - a) <= 1e-8 + 1e-5*a THEN 'exact' WHEN rate > a THEN 'under-covers' ELSE 'over-covers' END AS direction FROM t_lr
    UNION ALL SELECT {K}, 'LR_ind', n, x, rate, 1, ind, p, CASE WHEN p < 0.05 THEN 'clustered' ELSE 'unclustered' END FROM (
      SELECT *, CASE WHEN degenerate THEN 1 ELSE {chi2('ind', 1)} END AS p FROM t_lr)
    UNION ALL SELECT {K}, 'LR_cc', n, x, rate, 2, cc, {chi2('cc', 2)}, '' FROM t_lr
    UNION ALL SELECT {K}, 'DQ', l.n, x, rate, 5, q, {chi2('q', 5)}, '' FROM t_lr l JOIN (SELECT {K}, ({SQ(0, 5)})/{AA} AS q FROM t_dq) USING ({K}))""", branches=True)
def coverage_suite(spark, sf_dir):
    return tidy(cv.suite(hits(spark, sf_dir)), [*KEYS, "test", "n", "n_violations", "df", "direction"], violation_rate=8, stat=6, p_value=8)


@query("T16_conditioners", f"SELECT {K}, date, state0, state1, state2, transition, {rs(log_width=7)} FROM t_cond WHERE s2 IS NOT NULL", branches=True)
def conditioners(spark, sf_dir):
    return tidy(conditioned(spark, sf_dir).where("s2 is not null"), [*KEYS, "date", "state0", "state1", "state2", "transition"], log_width=7)


define("t_ct", f"""
  SELECT {K}, n, 'DQ incremental' AS kind, 'regime' AS conditioner, ({SQ(5, 7)})/{AA} AS stat, 2 AS df FROM t_dqreg
  UNION ALL SELECT {K}, n, 'DQ incremental', 'transition', ({SQ(5, 6)})/{AA}, 1 FROM t_dqtra
  UNION ALL SELECT {K}, n, 'DQ incremental', 'width', ({SQ(5, 6)})/{AA}, 1 FROM t_dqwid
  """ + "".join(f"UNION ALL SELECT {K}, n, 'difference in coverage', '{f}', z_hac, 0 FROM t_two{f} WHERE n1 >= 5 AND n0 >= 5 "
                for f in ("state0", "state1", "state2", "transition")))
define("t_ctp", f"""
  SELECT *, CASE df WHEN 2 THEN {chi2('stat', 2)} WHEN 1 THEN {chi2('greatest(stat,0)', 1)} ELSE 2*{phi('-abs(stat)')} END AS p_value FROM t_ct""")
define("t_holm", f"""
  SELECT *, least(max((m - rk + 1)*p_value) OVER (PARTITION BY {K} ORDER BY p_value, kind, conditioner ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS p_holm FROM (
    SELECT *, count(*) OVER (PARTITION BY {K}) AS m, row_number() OVER (PARTITION BY {K} ORDER BY p_value, kind, conditioner) AS rk FROM t_ctp)""")


@query("T17_conditional_table", f"SELECT {K}, kind, conditioner, n, m AS n_tests_in_family, {rs(stat=6, p_value=7, p_holm=7)} FROM t_holm", branches=True)
def conditional_table(spark, sf_dir):
    out = cv.conditional_table(conditioned(spark, sf_dir))
    return tidy(out, [*KEYS, "kind", "conditioner", "n", "n_tests_in_family"], stat=6, p_value=7, p_holm=7)


@query("W18_holm_step_down", f"""
  SELECT {K}, m AS n_tests_in_family, {r('least(max((m - rk + 1)*p) OVER (PARTITION BY level_pct, side ORDER BY p, asset, method ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1)', 8, 'p_holm')} FROM (
    SELECT {K}, p, count(*) OVER (PARTITION BY level_pct, side) AS m, row_number() OVER (PARTITION BY level_pct, side ORDER BY p, asset, method) AS rk FROM (
      SELECT {K}, {chi2('uc', 1)} AS p FROM t_lr))""")
def holm_step_down(spark, sf_dir):
    lr = cv.likelihood_ratio_tests(cv.hit_counts(hits(spark, sf_dir)))
    return tidy(cv.holm(lr, "p_uc", ("level_pct", "side"), ("asset", "method")), [*KEYS, "n_tests_in_family"], p_holm=8)
