"""Shared common table expressions in DuckDB SQL: the independent statement of the same study.

``compose`` prefixes a statement with just the expressions it names, in dependency order.
"""

from __future__ import annotations

import re
from math import pi, sqrt

from varloom.functions.math import HART_DENOMINATOR, HART_LIMIT, HART_NUMERATOR, HART_SPLIT, normal_quantile

CTES: dict[str, str] = {}


def define(name: str, body: str) -> None:
    if name in CTES:
        raise KeyError(f"common table expression {name!r} defined twice")
    CTES[name] = body.strip()


_WORD = re.compile(r"\bt_\w+")


def compose(statement: str) -> str:
    """WITH-prefix holding the needed expressions; recursion is allowed throughout."""
    ordered: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in _WORD.findall(text):
            if name == me or name in ordered:
                continue
            if name not in CTES:
                raise KeyError(f"unknown common table expression {name!r}")
            visit(CTES[name], name)
            if name not in ordered:
                ordered.append(name)

    visit(statement)
    if not ordered:
        return statement.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered)
    body = statement.strip()
    return f"WITH RECURSIVE {parts}\n{body}"


def r(expr: str, digits: int, name: str | None = None) -> str:
    """Rounded value without negative zero."""
    text = f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
    return f"{text} AS {name}" if name else text


def rs(**digits: int) -> str:
    """Rounded columns by name."""
    return ", ".join(r(c, d, c) for c, d in digits.items())


def finite(*names: str) -> str:
    return " AND ".join(f"({n} IS NOT NULL AND isfinite({n}))" for n in names)


def num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def phi(x: str) -> str:
    """Normal distribution function of an expression, as text."""

    def h(coefficients):
        out = num(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out}*v.a+{num(c)})"
        return out

    near = f"exp(-v.a*v.a/2)*{h(HART_NUMERATOR)}/{h(HART_DENOMINATOR)}"
    far = f"exp(-v.a*v.a/2)/(v.a+1/(v.a+2/(v.a+3/(v.a+4/(v.a+0.65::DOUBLE)))))/{num(sqrt(2 * pi))}"
    low = f"CASE WHEN v.a>{num(HART_LIMIT)} THEN 0.0 WHEN v.a<{num(HART_SPLIT)} THEN {near} ELSE {far} END"
    return (
        f"(SELECT CASE WHEN v.x IS NULL THEN NULL WHEN v.x>0 THEN 1.0-({low}) ELSE ({low}) END "
        f"FROM (SELECT CAST({x} AS DOUBLE) AS x, abs(CAST({x} AS DOUBLE)) AS a) v)"
    )


def chi2(x: str, df: int) -> str:
    """Upper chi-square tail with literal degrees of freedom, as text."""
    if df % 2 == 0:
        terms, f = [], 1.0
        for i in range(df // 2):
            f = f * i if i else 1.0
            terms.append(f"power(({x})/2,{i})/{num(f)}")
        return f"(exp(-({x})/2)*({'+'.join(terms)}))"
    out = f"2*{phi(f'-sqrt({x})')}"
    terms, odd = [], 1.0
    for i in range(1, (df - 1) // 2 + 1):
        odd *= 2 * i - 1
        terms.append(f"power({x},{i - 0.5})/{num(odd)}")
    if terms:
        out += f"+{num(sqrt(2 / pi))}*exp(-({x})/2)*({'+'.join(terms)})"
    return f"({out})"


def student(t: str, df: str) -> str:
    """Two-sided Student tail: the finite series summed through gamma functions, as text."""
    return f"""(SELECT CASE WHEN u.nu % 2 = 0
      THEN greatest(1 - sin(u.th) * list_sum(list_transform(range(CAST(u.nu/2 AS BIGINT)),
             lambda k: exp(lgamma(k+0.5)-lgamma(k+1)-lgamma(0.5)) * power(cos(u.th), 2*k))), 0.0)
      ELSE greatest(1 - {num(2 / pi)} * (u.th + sin(u.th) * coalesce(list_sum(list_transform(range(CAST((u.nu-1)/2 AS BIGINT)),
             lambda k: exp(lgamma(k+1)-lgamma(k+1.5)+lgamma(0.5)) / 2 * power(cos(u.th), 2*k+1))), 0.0)), 0.0) END
      FROM (SELECT CAST({df} AS BIGINT) AS nu, atan(abs({t})/sqrt({df})) AS th) u)"""


def z(p: float) -> str:
    return num(normal_quantile(p))


QLIKE = "(greatest(y_true,1e-16)/greatest(yhat,1e-16) - ln(greatest(y_true,1e-16)/greatest(yhat,1e-16)) - 1)"

# ---------------------------------------------------------------------------------------------- inputs
ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, px"
define("t_trades", """
  SELECT l_returnflag AS asset, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem WHERE l_quantity > 0""")
define("t_ohlc", f"""
  SELECT asset, date, first(px ORDER BY {ORDER}) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY {ORDER}) AS close
  FROM t_trades GROUP BY asset, date""")
define("t_rv", f"""
  SELECT asset, date, count(x) AS n_returns, sum(x*x) AS rv
  FROM (SELECT asset, date, ln(px) - ln(lag(px) OVER (PARTITION BY asset, date ORDER BY {ORDER})) AS x FROM t_trades)
  GROUP BY asset, date HAVING count(x) >= 2 AND sum(x*x) > 0""")
define("t_bars", "SELECT event_type AS asset, ts, value AS price, event_id AS seq FROM events WHERE value > 0")
define("t_second", "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS vix_close FROM orders GROUP BY 1")
define("t_registry", """
  SELECT asset, '^' || asset AS symbol, '.' || lower(asset) AS measure_symbol, r_name AS session, asset <> 'N' AS vix_feature
  FROM (SELECT DISTINCT l_returnflag AS asset FROM lineitem) LEFT JOIN nation ON n_nationkey = ascii(asset) % 25 LEFT JOIN region ON n_regionkey = r_regionkey""")

# ------------------------------------------------------------------------------------------- features
W = "PARTITION BY asset ORDER BY date"
define("t_daily", f"""
  SELECT *, ln(close) - ln(lag(close) OVER ({W})) AS log_return, ln(close/open) AS oc_log_return,
         ln(open / lag(close) OVER ({W})) AS overnight,
         ln(high/close)*ln(high/open) + ln(low/close)*ln(low/open) AS rs
  FROM t_ohlc""")
K_YZ = 0.34 / (1.34 + 22 / 20)
define("t_yzall", f"""
  SELECT asset, date, log_return, oc_log_return,
         CASE WHEN count(overnight) OVER w21 = 21 THEN greatest(var_samp(overnight) OVER w21
           + {num(K_YZ)} * var_samp(oc_log_return) OVER w21 + {num(1 - K_YZ)} * avg(rs) OVER w21, 0.0) END AS rv
  FROM t_daily WINDOW w21 AS ({W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
define("t_yz", "SELECT asset, date, rv, log_return, oc_log_return FROM t_yzall WHERE rv > 0")


def lags_of(source: str) -> str:
    return f"""
  SELECT *, lag(rv) OVER ({W}) AS rv_d,
         CASE WHEN count(rv) OVER w5 = 5 THEN avg(rv) OVER w5 END AS rv_w,
         CASE WHEN count(rv) OVER w22 = 22 THEN avg(rv) OVER w22 END AS rv_m
  FROM {source} WINDOW w5 AS ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
                       w22 AS ({W} ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING)"""


define("t_lags", lags_of("t_yz"))
define("t_rvlags", lags_of("t_rv"))
define("t_frame", f"""
  SELECT asset, date, log_return, oc_log_return, rv, rv_d, rv_w, rv_m FROM t_lags
  WHERE {finite('log_return', 'oc_log_return', 'rv', 'rv_d', 'rv_w', 'rv_m')}""")

# ---------------------------------------------------------------------------------------- walk-forward
TRAIN_END, VAL_START, VAL_END, TEST_START = "1998-12-31", "1999-01-01", "1999-12-31", "2000-01-01"


def folds_of(source: str, lo: str, hi: str, scheme: str = "anchored", every: int = 21, minimum: int = 252) -> str:
    length = "te + 1" if scheme == "anchored" else "least(te + 1, pos - oos_pos)"
    return f"""
  SELECT *, CASE WHEN ok THEN te END AS train_end_pos, CASE WHEN ok THEN tl END AS train_len,
         CASE WHEN ok THEN oos_pos // {every} END AS fold_idx
  FROM (SELECT *, is_oos AND te >= 0 AND tl >= {minimum} AS ok FROM (SELECT *, {length} AS tl FROM (
    SELECT *, pos - oos_pos % {every} - 1 AS te FROM (
      SELECT *, row_number() OVER ({W}) - 1 AS pos, (date BETWEEN DATE '{lo}' AND DATE '{hi}') AS is_oos,
        CASE WHEN date BETWEEN DATE '{lo}' AND DATE '{hi}' THEN
          row_number() OVER (PARTITION BY asset, (date BETWEEN DATE '{lo}' AND DATE '{hi}') ORDER BY date) - 1 END AS oos_pos
      FROM {source}))))"""


define("t_folded", folds_of("t_frame", TEST_START, "2099-12-31"))
define("t_folds", """
  SELECT f.asset, f.fold_idx, s.date AS train_start, e.date AS train_end, f.predict_start, f.predict_end, f.n_train, f.n_predict
  FROM (SELECT asset, fold_idx, min(date) AS predict_start, max(date) AS predict_end, min(train_end_pos) AS tep,
               min(train_len) AS n_train, count(*) AS n_predict
        FROM t_folded WHERE fold_idx IS NOT NULL GROUP BY asset, fold_idx) f
  JOIN t_folded e ON e.asset = f.asset AND e.pos = f.tep
  JOIN t_folded s ON s.asset = f.asset AND s.pos = f.tep - f.n_train + 1""")

_X = ("rv_d", "rv_w", "rv_m")


def _moments() -> str:
    cols = []
    for a in _X:
        cols.append(f"avg({a}) OVER run AS m_{a}")
        for y in ("rv", "lrv"):
            cols.append(f"covar_pop({a}, {y}) OVER run AS c_{a}_{y}")
        for b in _X[_X.index(a):]:
            cols.append(f"covar_pop({a}, {b}) OVER run AS c_{a}_{b}")
    for y in ("rv", "lrv"):
        cols += [f"avg({y}) OVER run AS m_{y}", f"var_pop({y}) OVER run AS v_{y}"]
    cols += ["count(rv) OVER run AS n", "stddev_pop(lstep) OVER run AS sd_step"]
    return ", ".join(cols)


define("t_moments", f"""
  SELECT asset, pos, {_moments()}
  FROM (SELECT asset, date, pos, rv, rv_d, rv_w, rv_m, ln(greatest(rv, 1e-12)) AS lrv, ln(rv) - ln(rv_d) AS lstep FROM t_folded)
  WINDOW run AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


def _slopes(y: str, tag: str) -> str:
    aa, ab, ac, bb, bc, cc = "c_rv_d_rv_d", "c_rv_d_rv_w", "c_rv_d_rv_m", "c_rv_w_rv_w", "c_rv_w_rv_m", "c_rv_m_rv_m"
    ya, yb, yc = f"c_rv_d_{y}", f"c_rv_w_{y}", f"c_rv_m_{y}"
    det = f"({aa}*({bb}*{cc}-{bc}*{bc})-{ab}*({ab}*{cc}-{bc}*{ac})+{ac}*({ab}*{bc}-{bb}*{ac}))"
    return f"""
      ({ya}*({bb}*{cc}-{bc}*{bc})-{ab}*({yb}*{cc}-{bc}*{yc})+{ac}*({yb}*{bc}-{bb}*{yc}))/{det} AS {tag}_rv_d,
      ({aa}*({yb}*{cc}-{bc}*{yc})-{ya}*({ab}*{cc}-{bc}*{ac})+{ac}*({ab}*{yc}-{yb}*{ac}))/{det} AS {tag}_rv_w,
      ({aa}*({bb}*{yc}-{yb}*{bc})-{ab}*({ab}*{yc}-{yb}*{ac})+{ya}*({ab}*{bc}-{bb}*{ac}))/{det} AS {tag}_rv_m"""


define("t_coefs", f"""
  SELECT *, n*(v_rv-lev_ex)/(n-4) AS lev_s2, n*(v_lrv-log_ex)/(n-4) AS log_s2, lev_ex/v_rv AS lev_r2, log_ex/v_lrv AS log_r2,
     m_rv-(lev_rv_d*m_rv_d+lev_rv_w*m_rv_w+lev_rv_m*m_rv_m) AS lev_const,
     m_lrv-(log_rv_d*m_rv_d+log_rv_w*m_rv_w+log_rv_m*m_rv_m) AS log_const
  FROM (SELECT *, lev_rv_d*c_rv_d_rv+lev_rv_w*c_rv_w_rv+lev_rv_m*c_rv_m_rv AS lev_ex,
                  log_rv_d*c_rv_d_lrv+log_rv_w*c_rv_w_lrv+log_rv_m*c_rv_m_lrv AS log_ex
        FROM (SELECT *, {_slopes('rv', 'lev')}, {_slopes('lrv', 'log')} FROM t_moments))""")
define("t_fits", """
  SELECT f.asset, f.date, f.pos, f.fold_idx, f.rv, f.rv_d, f.rv_w, f.rv_m, c.* EXCLUDE (asset, pos),
     c.log_const+c.log_rv_d*f.rv_d+c.log_rv_w*f.rv_w+c.log_rv_m*f.rv_m AS log_lin,
     c.lev_const+c.lev_rv_d*f.rv_d+c.lev_rv_w*f.rv_w+c.lev_rv_m*f.rv_m AS lev_lin
  FROM t_folded f JOIN t_coefs c ON c.asset = f.asset AND c.pos = f.train_end_pos""")
define("t_boardw", """
  SELECT asset, date, fold_idx, rv AS y_true, greatest(rv_d, 1e-12) AS f_rw, greatest(lev_lin, 1e-12) AS f_har,
         greatest(exp(log_lin + log_s2/2), 1e-12) AS f_loghar FROM t_fits""")
define("t_board", """
  SELECT asset, date, y_true, 'RW-RV' AS model, f_rw AS yhat FROM t_boardw
  UNION ALL SELECT asset, date, y_true, 'HAR-RV', f_har FROM t_boardw
  UNION ALL SELECT asset, date, y_true, 'HAR-RV-log', f_loghar FROM t_boardw""")
define("t_law", """
  SELECT asset, date, rv AS y_true, 'log-regression' AS method, log_lin AS mu, sqrt(log_s2) AS sigma FROM t_fits
  UNION ALL SELECT asset, date, rv, 'log-walk', ln(rv_d), sd_step FROM t_fits""")
define("t_iv", "\n UNION ALL ".join(
    f"SELECT asset, date, method, y_true, {L} AS level_pct, greatest(exp(mu + {z((100 - L) / 200)}*sigma),1e-14) AS lo, "
    f"greatest(exp(mu + {z(1 - (100 - L) / 200)}*sigma),1e-14) AS hi FROM t_law" for L in (50, 80, 90, 95)))

# ---------------------------------------------------------------------------------------------- states
define("t_cuts", f"""
  SELECT asset, quantile_cont(rv, {num(1 / 3)}) AS q1, quantile_cont(rv, {num(2 / 3)}) AS q2
  FROM t_frame WHERE date <= DATE '{TRAIN_END}' GROUP BY asset""")
define("t_states", """
  SELECT f.asset, f.date, CAST(rv > q1 AS INT) + CAST(rv > q2 AS INT) AS state, rv, log_return
  FROM t_frame f JOIN t_cuts c USING (asset)""")
define("t_lagged", f"""
  SELECT asset, date, state, lag(state, 1) OVER ({W}) AS s1, lag(state, 2) OVER ({W}) AS s2 FROM t_states""")
