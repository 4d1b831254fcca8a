"""DuckDB SQL with the rows of each registered query, written independently of the DataFrame code."""

from __future__ import annotations

PANEL = """
cells AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS symbol, AVG(l_extendedprice) AS price, SUM(l_quantity) AS volume
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
names AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS sym_ord FROM (SELECT DISTINCT symbol FROM cells)),
dense AS (SELECT d.date, n.symbol, n.sym_ord, c.price, c.volume FROM (SELECT DISTINCT date FROM cells) d CROSS JOIN names n
          LEFT JOIN cells c ON c.date = d.date AND c.symbol = n.symbol),
padded AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM dense),
rets AS (SELECT *, pad / NULLIF(lag(pad) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM padded),
complete AS (SELECT date FROM rets GROUP BY date HAVING count(ret) = count(*)),
panel AS (SELECT date, symbol, sym_ord, price, volume, ret, AVG(ret) OVER (PARTITION BY date) AS mkt FROM rets SEMI JOIN complete USING (date))"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int) -> str:
    return f"(CASE WHEN count({x}) {over(n)} >= {least} THEN {agg}({x}) {over(n)} END)"


def fwd(h: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"(CASE WHEN count(ret) {w} = {h} THEN sum(ret) {w} END)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY date)"


def avg_rank(x: str, keys: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0 END)"


def z(x: str) -> str:
    return f"(({x} - AVG({x}) OVER (PARTITION BY date)) / NULLIF(stddev_samp({x}) OVER (PARTITION BY date), 0))"


def rounded(**values: str) -> str:
    return ", ".join(f"round({x}, 6) + 0.0 AS {name}" for name, x in values.items())


def on_panel(**values: str) -> str:
    return f"WITH {PANEL} SELECT date, symbol, {rounded(**values)} FROM panel"


def corr(x: str, y: str, n: int) -> str:
    """Pairwise-complete rolling correlation."""
    px, py = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    w = over(n)
    return f"covar_samp({px}, {py}) {w} / NULLIF(stddev_samp({px}) {w} * stddev_samp({py}) {w}, 0)", f"count({px}) {w}"  # type: ignore[return-value]


def corr_value(x: str, y: str, n: int, least: int) -> str:
    r, c = corr(x, y, n)
    return f"(CASE WHEN {c} >= {least} THEN {r} END)"


FACTOR = PANEL + f""",
fac AS (SELECT date, symbol, sym_ord, ret, round({roll('AVG', 'ret', 20, 1)}, 10) + 0.0 AS f, {fwd(5)} AS fwd FROM panel)"""
_WIN = """(CASE WHEN f IS NOT NULL THEN greatest(quantile_cont(f, 0.01) OVER (PARTITION BY date), least(quantile_cont(f, 0.99) OVER (PARTITION BY date), f)) END)"""
PREPARED = FACTOR + f""",
win AS (SELECT date, symbol, sym_ord, ret, {_WIN} AS f, fwd FROM fac),
prep AS (SELECT date, symbol, sym_ord, ret, {z('f')} AS f, fwd FROM win)"""


def pairs(src: str, least: int) -> str:
    return f"(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM {src} WHERE f IS NOT NULL AND fwd IS NOT NULL) WHERE n >= {least})"


def ic(src: str) -> str:
    return f"""(SELECT date, ic FROM (SELECT date, covar_samp(rf, rr) / NULLIF(stddev_samp(rf) * stddev_samp(rr), 0) AS ic FROM
      (SELECT date, {avg_rank('f', 'date')} AS rf, {avg_rank('fwd', 'date')} AS rr FROM {pairs(src, 5)}) GROUP BY date) WHERE ic IS NOT NULL)"""


def ic_stats(src: str) -> str:
    return f"""(SELECT m AS ic_mean, s AS ic_std, CASE WHEN s > 0 THEN m / (s / sqrt(n)) ELSE 0 END AS ic_t_stat, CASE WHEN s > 0 THEN m / s ELSE 0 END AS icir, n AS n_days
      FROM (SELECT AVG(ic) AS m, stddev_samp(ic) AS s, count(*) AS n FROM {ic(src)}))"""


def ls(src: str) -> str:
    return f"""(SELECT date, ls FROM (SELECT date, AVG(CASE WHEN r > 0.5 THEN fwd END) - AVG(CASE WHEN r <= 0.5 THEN fwd END) AS ls FROM
      (SELECT *, {avg_rank('f', 'date')} / n AS r FROM {pairs(src, 10)}) GROUP BY date) WHERE ls IS NOT NULL)"""


def drawdown(src: str, r: str) -> str:
    return f"""(SELECT coalesce(min((c - p) / NULLIF(p, 0)), 0.0) AS max_drawdown FROM (SELECT c, max(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS p FROM
      (SELECT date, product(1 + {r}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM {src})))"""


def deciles(src: str) -> str:
    return f"""(SELECT bucket, AVG(m) * 252 AS ret FROM (SELECT date, bucket, AVG(fwd) AS m FROM
      (SELECT date, fwd, CAST(greatest(0, ((k - 1) * 10 + n - 2) // (n - 1) - 1) AS INTEGER) AS bucket FROM
        (SELECT *, row_number() OVER (PARTITION BY date ORDER BY f, sym_ord) AS k FROM {pairs(src, 20)})) GROUP BY 1, 2) GROUP BY 1)"""


def turned(src: str) -> str:
    return f"""(WITH held AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY f, sym_ord) AS k FROM
        (SELECT date, symbol, sym_ord, f, count(*) OVER (PARTITION BY date) AS n FROM {src} WHERE f IS NOT NULL) WHERE n >= 10),
      days AS (SELECT date, n // 2 AS c, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date, n FROM held)),
      legs AS (SELECT i, c, symbol, CASE WHEN k <= c THEN 'low' ELSE 'high' END AS leg FROM held JOIN days USING (date) WHERE k <= c OR k > n - c),
      stay AS (SELECT a.i, count(*) AS s FROM legs a JOIN legs b ON b.i = a.i - 1 AND a.symbol = b.symbol AND a.leg = b.leg GROUP BY 1)
      SELECT coalesce(AVG((2 * (d.c + p.c) - 2 * coalesce(s, 0)) / (4.0 * d.c)), 0) AS turnover FROM days d JOIN days p ON p.i = d.i - 1 LEFT JOIN stay ON stay.i = d.i)"""


def _decay() -> str:
    parts = [f"SELECT {h} AS horizon, date, f, {fwd(h)} AS fwd FROM fac" for h in range(1, 8)]
    return f"""WITH {FACTOR}, tall AS ({' UNION ALL '.join(parts)}),
      ok AS (SELECT *, count(*) OVER (PARTITION BY horizon, date) AS n FROM tall WHERE f IS NOT NULL AND fwd IS NOT NULL),
      r AS (SELECT *, {avg_rank('f', 'horizon, date')} / n AS r FROM ok WHERE n >= 10),
      d AS (SELECT horizon, date, AVG(CASE WHEN r > 0.5 THEN fwd END) - AVG(CASE WHEN r <= 0.5 THEN fwd END) AS ls FROM r GROUP BY 1, 2)
      SELECT CAST(horizon AS INTEGER) AS horizon, round(CASE WHEN stddev_samp(ls) > 0 THEN sqrt(252.0 / horizon) * AVG(ls) / stddev_samp(ls) ELSE 0 END, 6) + 0.0 AS sharpe FROM d GROUP BY horizon"""


LINEAR = PANEL + f""",
two AS (SELECT date, symbol, {roll('AVG', 'ret', 20, 1)} AS a, {roll('stddev_samp', 'ret', 20, 2)} AS b FROM panel),
zs AS (SELECT date, symbol, {z('a')} AS za, {z('b')} AS zb FROM two),
combined AS (SELECT date, symbol, (coalesce(za, 0) + coalesce(zb, 0)) / NULLIF((za IS NOT NULL)::INT + (zb IS NOT NULL)::INT, 0) AS value FROM zs)"""

SERIES = """
series AS (SELECT CAST(l_shipdate AS DATE) AS date, AVG(l_extendedprice) AS close FROM lineitem GROUP BY 1),
logs AS (SELECT *, ln(close / lag(close) OVER (ORDER BY date)) AS lr FROM series),
ind AS (SELECT date, close,
  CASE WHEN count(close) OVER a = 100 THEN AVG(close) OVER a END AS sma_fast, CASE WHEN count(close) OVER b = 200 THEN AVG(close) OVER b END AS sma_slow,
  CASE WHEN count(lr) OVER v = 20 THEN stddev_samp(lr) OVER v END * sqrt(252.0) AS rv20 FROM logs
  WINDOW a AS (ORDER BY date ROWS 99 PRECEDING), b AS (ORDER BY date ROWS 199 PRECEDING), v AS (ORDER BY date ROWS 19 PRECEDING))"""


def debounced(sma: str, out: str) -> str:
    """CTEs that end in one named ``out`` (date, above)."""
    return f"""
{out}_raw AS (SELECT date, (close > {sma})::INT AS raw FROM ind WHERE {sma} IS NOT NULL),
{out}_new AS (SELECT *, CASE WHEN raw <> lag(raw) OVER (ORDER BY date) THEN 1 ELSE 0 END AS fresh, row_number() OVER (ORDER BY date) AS i FROM {out}_raw),
{out}_run AS (SELECT *, sum(fresh) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM {out}_new),
{out}_len AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY date) AS len FROM {out}_run),
{out} AS (SELECT date, last_value(CASE WHEN len >= 3 OR i = 1 THEN raw END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM {out}_len)"""


EXPOSURE = SERIES + "," + debounced("sma_fast", "af") + "," + debounced("sma_slow", "slow") + """,
expo AS (SELECT *, gate * w_vol AS exposure, 1 - gate * w_vol AS cash FROM (SELECT i.date, i.close, i.rv20, i.sma_fast, i.sma_slow,
  CASE af.above + slow.above WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 WHEN 0 THEN 0.0 END AS gate,
  CASE WHEN rv20 = 0 THEN 1.5 WHEN rv20 IS NOT NULL THEN least(3.0 / rv20, 1.5) END AS w_vol,
  CASE WHEN rv20 = 0 THEN true WHEN rv20 IS NOT NULL THEN 3.0 / rv20 >= 1.5 END AS leverage_capped
  FROM ind i LEFT JOIN af USING (date) LEFT JOIN slow USING (date)))"""


def _stats(r: str, label: str) -> str:
    return f"""{label}_rows AS (SELECT date, {r} AS r, product(1 + {r}) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM tested WHERE {r} IS NOT NULL),
{label}_dd AS (SELECT r, cum / NULLIF(max(cum) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM {label}_rows),
{label} AS (SELECT AVG(r) * 252 AS ret, stddev_samp(r) * sqrt(252.0) AS vol, min(dd) AS dd, (SELECT arg_max(cum, date) - 1 FROM {label}_rows) AS total FROM {label}_dd)"""


def _backtest() -> str:
    stat = lambda t: {f"{t}_annual_return": f"{t}.ret", f"{t}_annual_vol": f"{t}.vol", f"{t}_sharpe": f"CASE WHEN {t}.vol > 0 THEN {t}.ret / {t}.vol ELSE 0 END", f"{t}_max_dd": f"{t}.dd", f"{t}_calmar": f"CASE WHEN {t}.dd <> 0 THEN {t}.ret / abs({t}.dd) ELSE 0 END", f"{t}_total_return": f"{t}.total"}
    use = {"mean_exposure": "u.e", "mean_w_vol": "u.w", "pct_in_cash": "u.lo", "pct_levered": "u.hi", "pct_at_leverage_cap": "u.cap"}
    more = {"dd_reduction": "buyhold.dd - portfolio.dd", "return_cost": "portfolio.ret - buyhold.ret", "target_vol": "CAST(3 AS DOUBLE)"}
    return f"""WITH {EXPOSURE},
t AS (SELECT *, close / lag(close) OVER (ORDER BY date) - 1 AS ret, lag(exposure) OVER (ORDER BY date) AS held FROM expo),
tested AS (SELECT *, held * ret + (1 - held) * (0.02 / 252) AS pr FROM t),
{_stats('pr', 'portfolio')}, {_stats('ret', 'buyhold')},
u AS (SELECT AVG(exposure) AS e, AVG(w_vol) AS w, AVG((exposure < 1)::INT) AS lo, AVG((exposure > 1)::INT) AS hi, AVG(leverage_capped::INT) AS cap FROM tested)
SELECT 'market' AS series_id, {rounded(**stat('portfolio'), **stat('buyhold'), **use, **more)} FROM portfolio, buyhold, u"""


def _positions(most: int) -> str:
    return f"""
pos AS (SELECT p_brand AS symbol, l_returnflag, SUM(l_extendedprice) AS mv, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 2 = 1 AS odd
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 4),
act AS (SELECT * FROM pos WHERE symbol <> 'Brand#12'),
net AS (SELECT upper(symbol) AS symbol, sum(CASE WHEN odd THEN -mv ELSE mv END / (SELECT sum(mv) FROM act)) AS w FROM act WHERE upper(symbol) <> 'BRAND#11' GROUP BY 1),
top AS (SELECT * FROM net WHERE w <> 0 ORDER BY abs(w) DESC, symbol LIMIT {most}),
book AS (SELECT symbol, w / (SELECT sum(abs(w)) FROM top) AS weight, sign(w) / (SELECT count(*) FROM top) AS equal FROM top)"""


POSITIONS = _positions(60)
BOOK_RETURNS = PANEL + "," + POSITIONS + """,
priced AS (SELECT b.symbol, weight / sum(abs(weight)) OVER () AS w, count(*) OVER () AS names, weight FROM book b SEMI JOIN panel p ON upper(p.symbol) = b.symbol),
br AS (SELECT date, sum(w * ret) AS r FROM panel JOIN priced ON upper(panel.symbol) = priced.symbol GROUP BY date HAVING count(ret) = max(names)),
nav AS (SELECT date, product(1 + r) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) * 100 AS nav FROM br)"""
MONTHS = "months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of FROM orders)"
_RSI_G, _RSI_L = "(CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) END)", "(CASE WHEN ret IS NOT NULL THEN greatest(-ret, 0.0) END)"
_SMA = {n: roll("AVG", "price", n, m) for n, m in ((50, 30), (100, 60), (200, 120))}


def _ewma(x: str, span: int, y: str, span_y: int) -> str:
    """By the recursion: weights age by a constant with every row, present or not."""
    a, b = (f"CAST({1 - 2 / (s + 1)!r} AS DOUBLE)" for s in (span, span_y))
    return f"""WITH RECURSIVE {PANEL}, p AS MATERIALIZED (SELECT date, symbol, {x} AS x, {y} AS y, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM panel),
r AS (SELECT date, symbol, i, coalesce(x, 0.0) AS n, (x IS NOT NULL)::DOUBLE AS d, coalesce(y, 0.0) AS m, (y IS NOT NULL)::DOUBLE AS e FROM p WHERE i = 1
  UNION ALL SELECT p.date, p.symbol, p.i, {a} * n + coalesce(x, 0.0), {a} * d + (x IS NOT NULL)::DOUBLE, {b} * m + coalesce(y, 0.0), {b} * e + (y IS NOT NULL)::DOUBLE FROM r JOIN p ON p.i = r.i + 1 AND p.symbol = r.symbol)
SELECT date, symbol, {rounded(v='n / NULLIF(d, 0)', w='m / NULLIF(e, 0)')} FROM r"""


_LS_STATS = f"""WITH {FACTOR}, l AS (SELECT * FROM {ls('fac')}), s AS (SELECT AVG(ls) AS m, stddev_samp(ls) AS sd, stddev_samp(CASE WHEN ls < 0 THEN ls END) AS dn FROM l),
d AS (SELECT * FROM {drawdown('l', 'ls')})
SELECT {rounded(ls_annual_return='m * 50.4', ls_annual_vol='sd * sqrt(50.4)', ls_sharpe='CASE WHEN sd > 0 THEN sqrt(50.4) * m / sd ELSE 0 END', ls_sortino='CASE WHEN dn > 0 THEN sqrt(50.4) * m / dn ELSE 0 END', ls_max_drawdown='round(max_drawdown, 3)', ls_calmar='CASE WHEN max_drawdown <> 0 THEN m * 50.4 / abs(max_drawdown) ELSE 0 END')} FROM s, d"""

def _evaluated() -> str:
    tall = " UNION ALL ".join(f"SELECT {h} AS horizon, date, f, {fwd(h)} AS fwd FROM prep" for h in range(1, 8))
    one = lambda kind, by, n: ", ".join(f"max(CASE WHEN {by} = {i} THEN x END) AS {kind}_{i - n + 1}" for i in range(n, n + (10 if n == 0 else 7)))
    ratio = lambda d: f"CASE WHEN {d} > 0 THEN sqrt(50.4) * m / {d} ELSE 0 END"
    values = dict(
        ic_mean="ic_mean", ic_std="ic_std", ic_t_stat="ic_t_stat", icir="icir", ls_annual_return="m * 50.4", ls_annual_vol="sd * sqrt(50.4)", ls_sharpe=ratio("sd"), ls_sortino=ratio("dn"),
        ls_max_drawdown="round(max_drawdown, 3)", ls_calmar="CASE WHEN max_drawdown <> 0 THEN m * 50.4 / abs(max_drawdown) ELSE 0 END", turnover="turnover", n_stocks_avg="c", max_corr_with_existing="rho",
        **{f"decile_{i}": f"decile_{i}" for i in range(1, 11)}, **{f"decay_{h}": f"decay_{h}" for h in range(1, 8)},
    )
    return f"""WITH {PREPARED}, i AS (SELECT * FROM {ic_stats('prep')}), lsr AS (SELECT * FROM {ls('prep')}),
l AS (SELECT AVG(ls) AS m, stddev_samp(ls) AS sd, stddev_samp(CASE WHEN ls < 0 THEN ls END) AS dn FROM lsr), dd AS (SELECT * FROM {drawdown('lsr', 'ls')}),
t AS (SELECT * FROM {turned('prep')}), n AS (SELECT AVG(c) AS c FROM (SELECT date, count(f) AS c FROM prep GROUP BY 1)),
dec AS (SELECT bucket, ret, lag(ret) OVER (ORDER BY bucket) AS before FROM {deciles('prep')}),
ten AS (SELECT {one('decile', 'bucket', 0)}, count(*) >= 3 AND sum((x < before)::INT) <= 1 AS monotonic FROM (SELECT bucket, ret AS x, before FROM dec)),
tall AS ({tall}), ok AS (SELECT *, count(*) OVER (PARTITION BY horizon, date) AS n FROM tall WHERE f IS NOT NULL AND fwd IS NOT NULL),
ranked AS (SELECT *, {avg_rank('f', 'horizon, date')} / n AS r FROM ok WHERE n >= 10),
spread AS (SELECT horizon, date, AVG(CASE WHEN r > 0.5 THEN fwd END) - AVG(CASE WHEN r <= 0.5 THEN fwd END) AS ls FROM ranked GROUP BY 1, 2),
seven AS (SELECT {one('decay', 'horizon', 1)} FROM (SELECT horizon, CASE WHEN stddev_samp(ls) > 0 THEN sqrt(252.0 / horizon) * AVG(ls) / stddev_samp(ls) ELSE 0 END AS x FROM spread GROUP BY 1)),
o AS (SELECT date, symbol, round({roll('stddev_samp', 'ret', 20, 2)}, 10) + 0.0 AS g FROM panel), b AS (SELECT 1 AS one, f, g FROM prep JOIN o USING (date, symbol) WHERE f IS NOT NULL AND g IS NOT NULL),
rk AS (SELECT {avg_rank('f', 'one')} AS rf, {avg_rank('g', 'one')} AS rg FROM b), rho AS (SELECT abs(covar_samp(rf, rg) / NULLIF(stddev_samp(rf) * stddev_samp(rg), 0)) AS rho FROM rk)
SELECT n_days, monotonic, {rounded(**values)} FROM i, l, dd, t, n, ten, seven, rho"""


def _report() -> str:
    percent = lambda x: f"printf('%.1f%%', {x} * 100)"
    digits = lambda x, n: f"CAST(round(CAST({x} AS DECIMAL(30, 10)), {n}) AS DOUBLE) + 0.0"  # noqa: E731  halves up, as written
    fields = {
        "exposure": digits("exposure", 4), "exposure_pct": percent("exposure") + " || ' invested'", "cash": digits("cash", 4),
        "cash_pct": f"CASE WHEN cash >= 0 THEN {percent('cash')} || ' cash' ELSE {percent('-cash')} || ' leverage' END", "gate": "CAST(gate AS DOUBLE)",
        "regime": "CASE gate WHEN 1 THEN 'risk-on' WHEN 0.5 THEN 'half' WHEN 0 THEN 'cash' END", "w_vol": digits("w_vol", 4), "leverage_capped": "leverage_capped", "rv20": digits("rv20", 4),
        "rv20_pct": percent("rv20"), "close": digits("close", 2), "sma100": digits("sma_fast", 2), "sma200": digits("sma_slow", 2),
    }
    shown = ", ".join(f"CASE WHEN exposure IS NOT NULL THEN {x} END AS {n}" for n, x in fields.items())
    exposure = EXPOSURE.replace("AVG(l_extendedprice) AS close", "round(AVG(l_extendedprice), 6) AS close")
    return f"""WITH {exposure}, {MONTHS}, asked AS (SELECT as_of FROM months UNION ALL SELECT DATE '1900-01-01')
SELECT 'market' AS series_id, as_of AS requested_date, date AS as_of_date, CAST(300 AS DOUBLE) AS vt, CAST(3 AS DOUBLE) AS target_vol, {shown}, 'qqq' AS vol_source,
CASE WHEN date IS NULL THEN 'No trading day on or before ' || as_of WHEN exposure IS NULL THEN 'Insufficient history to compute the signal as of ' || date || ' (need >= 200 sessions of data).' END AS error
FROM asked ASOF LEFT JOIN expo ON asked.as_of >= expo.date"""


def _book_summary() -> str:
    return f"""WITH {_positions(20)}, c AS (SELECT sum(mv) AS cash, (SELECT sum(mv) FROM act) AS whole FROM act WHERE upper(symbol) = 'BRAND#11')
SELECT 1 AS book_id, CAST(NULL AS VARCHAR) AS book_name, (SELECT count(*) FROM top) AS n_constituents, (SELECT count(*) FROM pos WHERE symbol = 'Brand#12') AS n_dropped_options,
  CAST(1 AS INTEGER) AS n_dropped_cash, 'BRAND#11' AS dropped_cash, greatest(0, (SELECT count(*) FROM net WHERE w <> 0) - 20) AS n_truncated,
  {rounded(cash_weight='round(cash / whole, 4)', gross_market_value='round(whole, 2)', net_exposure='round((SELECT sum(weight) FROM book), 6)')}, CAST(NULL AS VARCHAR) AS error FROM c
UNION ALL SELECT 2, NULL, 0, 0, 1, 'BRAND#11', 0, 1.0, round(cash, 2), NULL, 'book 2: no risk constituents after excluding cash [''BRAND#11''] (100% of gross)' FROM c
UNION ALL SELECT 3, NULL, 0, 0, 0, NULL, 0, 0.0, NULL, NULL, 'book 3 has no active equity constituents'"""


def prepared(i: int, x: str, h: int, digits: int | None = None, end: str | None = None) -> str:
    """CTEs fac{i}, win{i} and prep{i} of one factor."""
    value = f"round({x}, {digits}) + 0.0" if digits else x
    sample = f" WHERE date <= DATE '{end}'" if end else ""
    return f"""
fac{i} AS (SELECT * FROM (SELECT date, symbol, sym_ord, ret, {value} AS f, {fwd(h)} AS fwd FROM panel){sample}),
win{i} AS (SELECT date, symbol, sym_ord, ret, {_WIN} AS f, fwd FROM fac{i}),
prep{i} AS MATERIALIZED (SELECT date, symbol, sym_ord, ret, {z('f')} AS f, fwd FROM win{i})"""


def _board() -> str:
    std20 = roll("stddev_samp", "ret", 20, 2)
    board = {
        "mean20": roll("AVG", "ret", 20, 1), "std20": std20, "lag3": lag("price", 3), "momentum20": roll("sum", "ret", 20, 10), "momentum60": roll("sum", "ret", 60, 30),
        "vol": roll("stddev_samp", "ret", 20, 5), "to_ma": f"price / NULLIF({roll('AVG', 'price', 20, 5)}, 0)", "volume_rank": f"{avg_rank('volume', 'date')} / count(volume) OVER (PARTITION BY date)",
        "change": f"price - {lag('price', 2)}", "calm": "-" + std20,
    }
    one = []
    for i, name in enumerate(board):
        values = rounded(ic_mean="ic_mean", ic_t_stat="ic_t_stat", ls_annual_return="m * 50.4", ls_sharpe="CASE WHEN sd > 0 THEN sqrt(50.4) * m / sd ELSE 0 END", turnover="turnover", n_stocks_avg="c")
        one.append(f"""SELECT '{name}' AS factor, n_days, {values} FROM {ic_stats(f'prep{i}')}, (SELECT AVG(ls) AS m, stddev_samp(ls) AS sd FROM {ls(f'prep{i}')}), {turned(f'prep{i}')},
  (SELECT AVG(c) AS c FROM (SELECT date, count(f) AS c FROM prep{i} GROUP BY 1))""")
    return f"WITH {PANEL}, {', '.join(prepared(i, x, 5, 10) for i, x in enumerate(board.values()))} " + " UNION ALL ".join(one)


def _rounds() -> str:
    mean = roll("AVG", "ret", 20, 1)
    tried = (mean, mean, roll("stddev_samp", "ret", 20, 2), roll("sum", "ret", 60, 30))
    metrics = " UNION ALL ".join(
        f"SELECT {i + 1} AS k, ic_t_stat AS t, CASE WHEN sd > 0 THEN sqrt(50.4) * m / sd ELSE 0 END AS s FROM {ic_stats(f'prep{i}')}, (SELECT AVG(ls) AS m, stddev_samp(ls) AS sd FROM {ls(f'prep{i}')})" for i in range(len(tried))
    )
    pairs = " UNION ALL ".join(
        f"SELECT {i + 1} AS k, {j + 1} AS j, a.f AS x, b.f AS y FROM prep{i} a JOIN prep{j} b USING (date, symbol) WHERE a.f IS NOT NULL AND b.f IS NOT NULL" for i in range(len(tried)) for j in range(i)
    )
    return f"""WITH RECURSIVE {PANEL}, {', '.join(prepared(i, x, 5, end='1996-12-31') for i, x in enumerate(tried))}, m AS MATERIALIZED ({metrics}), p AS ({pairs}),
c AS MATERIALIZED (SELECT k, j, abs(covar_samp(rx, ry) / NULLIF(stddev_samp(rx) * stddev_samp(ry), 0)) AS rho FROM (SELECT k, j, {avg_rank('x', 'k, j')} AS rx, {avg_rank('y', 'k, j')} AS ry FROM p) GROUP BY 1, 2),
-- the rounds in turn; held: those promoted so far
r AS (
  SELECT 0 AS k, [0] AS held, CAST(NULL AS VARCHAR) AS decision, 0.0::DOUBLE AS t, 0.0::DOUBLE AS s, 0.0::DOUBLE AS x
  UNION ALL
  SELECT k, CASE WHEN decision = 'promote' THEN list_append(held, k) ELSE held END, decision, t, s, x
  FROM (SELECT k, held, t, s, x, CASE WHEN t >= -50 AND s >= -50 THEN (CASE WHEN x > 0.7 THEN 'hold' ELSE 'promote' END) WHEN t < -60 THEN 'retire' ELSE 'hold' END AS decision
    FROM (SELECT m.k, r.held, m.t, m.s, coalesce(max(c.rho), 0.0) AS x FROM r JOIN m ON m.k = r.k + 1 LEFT JOIN c ON c.k = m.k AND list_contains(r.held, c.j) GROUP BY ALL)))
SELECT CAST(k AS INTEGER) AS round, decision, {rounded(ic_t_stat='t', ls_sharpe='s', max_corr_with_existing='x')} FROM r WHERE k > 0
UNION ALL SELECT {len(tried) + 1}, 'error', NULL, NULL, NULL"""


_BENCHMARK = PANEL.replace("dense AS (", "names25 AS (SELECT symbol, sym_ord FROM names WHERE symbol <> 'Brand#11'), own AS (SELECT * FROM cells WHERE symbol <> 'Brand#11'), dense AS (").replace(
    "(SELECT DISTINCT date FROM cells) d CROSS JOIN names n\n          LEFT JOIN cells c", "(SELECT DISTINCT date FROM own) d CROSS JOIN names25 n\n          LEFT JOIN own c"
)

ORACLE_SQL: dict[str, str] = {
    "panel_benchmark": f"""WITH {_BENCHMARK}, b AS (SELECT date, price / NULLIF(lag(price) OVER (ORDER BY date), 0) - 1 AS m FROM cells WHERE symbol = 'Brand#11' AND price IS NOT NULL)
SELECT date, symbol, {rounded(ret='ret', mkt='m')} FROM panel LEFT JOIN b USING (date)""",
    "factor_board": _board(),
    "discovery_rounds": _rounds(),
    "panel_returns": on_panel(price="price", volume="volume", ret="ret", mkt="mkt"),
    "sparse_prices": f"""WITH {PANEL}, enough AS (SELECT symbol FROM dense GROUP BY 1 HAVING count(price) >= 0.5 * count(*)),
filled AS (SELECT date, symbol, last_value(price IGNORE NULLS) OVER w AS price, coalesce(last_value(volume IGNORE NULLS) OVER w, 0) AS volume,
  last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS whole FROM dense SEMI JOIN enough USING (symbol)
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
moved AS (SELECT *, whole / NULLIF(lag(whole) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM filled)
SELECT date, symbol, {rounded(price='price', volume='volume', ret='ret')} FROM moved WHERE date > (SELECT min(date) FROM dense)""",
    "prim_turnover": on_panel(turnover=f"volume / NULLIF({roll('AVG', 'volume', 60, 20)}, 0)"),
    "prim_volume_ratio": on_panel(volume_ratio=f"volume / NULLIF({roll('AVG', 'volume', 20, 5)}, 0)"),
    "prim_realized_vol": on_panel(realized_vol=roll("stddev_samp", "ret", 20, 5), high_low_range=f"{roll('stddev_samp', 'ret', 20, 5)} * sqrt(1 / 252.0)", market_vol=roll("stddev_samp", "mkt", 20, 5)),
    "prim_price_to_ma": on_panel(price_to_ma=f"price / NULLIF({roll('AVG', 'price', 20, 5)}, 0)"),
    "prim_sma": f"WITH {PANEL} SELECT date, symbol, "
    + ", ".join(f"CAST(round(CAST({x} AS DECIMAL(30, 10)), 6) AS DOUBLE) AS sma_{n}" for n, x in _SMA.items()) + ", "
    + rounded(**{f"price_to_sma{n}": f"price / NULLIF({x}, 0)" for n, x in _SMA.items()}, sma50_to_sma200=f"{_SMA[50]} / NULLIF({_SMA[200]}, 0)") + " FROM panel",
    "prim_rsi14": on_panel(rsi_14=f"100 - 100.0 / NULLIF(1 + {roll('AVG', _RSI_G, 14, 10)} / NULLIF({roll('AVG', _RSI_L, 14, 10)}, 0), 0)"),
    "prim_momentum": on_panel(return_10d=roll("sum", "ret", 10, 5), return_20d=roll("sum", "ret", 20, 10), return_60d=roll("sum", "ret", 60, 30)),
    "prim_beta60": on_panel(beta_60d=f"(CASE WHEN count(ret) {over(60)} >= 30 THEN covar_samp(ret, mkt) {over(60)} END) / NULLIF({roll('var_samp', 'mkt', 60, 30)}, 0)"),
    "prim_corr60": on_panel(corr_market_60d=corr_value("ret", "mkt", 60, 30)),
    "prim_52w_high": on_panel(distance_from_52w_high=f"(price - {roll('max', 'price', 252, 60)}) / NULLIF({roll('max', 'price', 252, 60)}, 0)"),
    "op_lag": on_panel(v=lag("price", 3), w=lag("ret", 1)),
    "op_rolling_mean": on_panel(v=roll("AVG", "price", 10, 1), w=roll("AVG", "ret", 20, 1)),
    "op_rolling_std": on_panel(v=roll("stddev_samp", "price", 10, 2)),
    "op_rolling_max": on_panel(v=roll("max", "price", 10, 1)),
    "op_rolling_min": on_panel(v=roll("min", "price", 10, 1)),
    "op_rolling_sum": on_panel(v=roll("sum", "volume", 10, 1)),
    "op_rolling_corr": on_panel(v=corr_value("price", "volume", 40, 20)),
    "op_diff": on_panel(v=f"price - {lag('price', 2)}"),
    "op_ewma": _ewma("price", 10, "ret", 252),
    "op_rank": on_panel(v=f"{avg_rank('volume', 'date')} / count(volume) OVER (PARTITION BY date)"),
    "op_zscore": on_panel(v=z("volume")),
    "sql_factor": f"""WITH {PANEL}, v AS (SELECT date, symbol, {avg_rank('volume', 'date')} / count(volume) OVER (PARTITION BY date) AS f1, price - {lag('price', 2)} AS f2, {roll('MAX', 'price', 10, 1)} AS f FROM panel)
SELECT symbol, count(*) AS n_dates, {rounded(mean_place='AVG(f1)', mean_diff='AVG(f2)', top_price='MAX(f)')} FROM v WHERE f1 > 0.5 GROUP BY symbol""",
    "op_ratio_log_sign_abs_neg": on_panel(a="volume / NULLIF(price, 0)", b="ln(abs(NULLIF(ret, 0)))", c="CAST(sign(ret) AS DOUBLE)", d="abs(ret)", e="-ret"),
    "op_add_sub_mul": on_panel(a="price + volume", b="price - volume", c="ret * volume", d="ret + 2"),
    "op_clip": on_panel(v="CASE WHEN ret IS NOT NULL THEN greatest(-1.0, least(2.0, ret)) END", w="CASE WHEN ret IS NOT NULL THEN greatest(-3.0, least(3.0, ret)) END"),
    "op_minmax": on_panel(v="CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN greatest(ret, mkt) END", w="CASE WHEN ret IS NOT NULL AND mkt IS NOT NULL THEN least(ret, mkt) END"),
    "formula_depth4": f"WITH {PANEL}, q AS (SELECT date, symbol, volume / NULLIF(price, 0) AS q FROM panel), m AS (SELECT date, symbol, {roll('AVG', 'q', 5, 1)} AS m FROM q) SELECT date, symbol, {rounded(v='-' + z('m'))} FROM m",
    "forward_returns": f"WITH {FACTOR} SELECT date, symbol, {rounded(fwd='fwd')} FROM fac",
    "winsorize": f"WITH {PREPARED} SELECT date, symbol, {rounded(f='f')} FROM win",
    "preprocess": f"WITH {PREPARED} SELECT date, symbol, {rounded(f='f')} FROM prep",
    "rank_ic_daily": f"WITH {FACTOR} SELECT date, {rounded(ic='ic')} FROM {ic('fac')}",
    "rank_ic_stats": f"WITH {FACTOR} SELECT n_days, {rounded(ic_mean='ic_mean', ic_std='ic_std', ic_t_stat='ic_t_stat', icir='icir')} FROM {ic_stats('fac')}",
    "ls_returns": f"WITH {FACTOR} SELECT date, {rounded(ls='ls')} FROM {ls('fac')}",
    "ls_stats": _LS_STATS,
    "max_drawdown": f"WITH {FACTOR}, l AS (SELECT * FROM {ls('fac')}) SELECT {rounded(max_drawdown='round(max_drawdown, 3)')} FROM {drawdown('l', 'ls')}",
    "decile_returns": f"WITH {FACTOR} SELECT bucket, {rounded(ret='ret')} FROM {deciles('fac')}",
    "decile_monotonic": f"WITH {FACTOR} SELECT count(*) >= 3 AND sum((ret < before)::INT) <= 1 AS monotonic FROM (SELECT ret, lag(ret) OVER (ORDER BY bucket) AS before FROM {deciles('fac')})",
    "turnover": f"WITH {FACTOR} SELECT {rounded(turnover='turnover')} FROM {turned('fac')}",
    "signal_decay": _decay(),
    "redundancy": f"""WITH {FACTOR}, o AS (SELECT date, symbol, round({roll('stddev_samp', 'ret', 20, 2)}, 10) + 0.0 AS g FROM panel),
b AS (SELECT 1 AS one, f, g FROM fac JOIN o USING (date, symbol) WHERE f IS NOT NULL AND g IS NOT NULL), r AS (SELECT {avg_rank('f', 'one')} AS rf, {avg_rank('g', 'one')} AS rg FROM b)
SELECT {rounded(redundancy='abs(covar_samp(rf, rg) / NULLIF(stddev_samp(rf) * stddev_samp(rg), 0))')} FROM r""",
    "evaluate_factor": _evaluated(),
    "gate_decision": """WITH m AS (SELECT l_suppkey AS factor, round(AVG(l_quantity) / 8, 6) AS t, round(AVG(l_discount) * 25, 6) AS s, round(AVG(l_tax) * 14, 6) AS o, round(max(l_discount) * 7, 6) AS c FROM lineitem GROUP BY 1)
SELECT factor, decision, CASE decision WHEN 'promote' THEN printf('Promoted: t_IC=%.2f >= 3.0 AND Sharpe=%.2f >= 1.0', t, s) WHEN 'retire' THEN printf('Retired: t_IC=%.2f < 1.0 (below minimum statistical threshold)', t)
  ELSE 'Hold: ' || coalesce(NULLIF(concat_ws('; ', CASE WHEN t < 3 THEN printf('t_IC=%.2f < 3.0', t) END, CASE WHEN s < 1 THEN printf('Sharpe=%.2f < 1.0', s) END, CASE WHEN o > 0.6 THEN printf('turnover=%.2f > 0.6', o) END,
    CASE WHEN c > 0.7 THEN printf('redundant (corr=%.2f with existing factor)', c) END), ''), 'borderline') END AS reason
FROM (SELECT factor, t, s, o, c, CASE WHEN t >= 3 AND s >= 1 THEN (CASE WHEN o > 0.6 OR c > 0.7 THEN 'hold' ELSE 'promote' END) WHEN t < 1 THEN 'retire' ELSE 'hold' END AS decision FROM m)""",
    "aggregate_linear": f"WITH {LINEAR} SELECT date, symbol, {rounded(value='value')} FROM combined",
    "composite_summary": f"""WITH {LINEAR}, s AS (SELECT symbol, AVG(value) AS m, stddev_samp(value) AS s FROM combined GROUP BY 1)
SELECT round(AVG(m), 6) AS mean, round(AVG(s), 6) AS std, count(*) AS n_symbols, (SELECT count(DISTINCT date) FROM combined) AS n_dates FROM s""",
    "topk_latest": f"""WITH {LINEAR}, r AS (SELECT *, row_number() OVER (ORDER BY value DESC, symbol) AS hi, row_number() OVER (ORDER BY value, symbol) AS lo FROM combined WHERE value IS NOT NULL AND date = (SELECT max(date) FROM panel))
SELECT 'top' AS side, CAST(hi AS INTEGER) AS place, symbol, {rounded(value='value')} FROM r WHERE hi <= 5 UNION ALL SELECT 'bottom', CAST(lo AS INTEGER), symbol, {rounded(value='value')} FROM r WHERE lo <= 5""",
    "hedge_indicators": f"WITH {SERIES} SELECT date, {rounded(close='close', sma_fast='sma_fast', sma_slow='sma_slow', rv20='rv20')} FROM ind",
    "hedge_debounced_gate": f"WITH {SERIES}, {debounced('sma_fast', 'af')} SELECT ind.date, af.above FROM ind LEFT JOIN af USING (date)",
    "hedge_exposure": f"WITH {EXPOSURE} SELECT date, leverage_capped, {rounded(gate='CAST(gate AS DOUBLE)', w_vol='w_vol', exposure='exposure', cash='cash')} FROM expo",
    "hedge_backtest_stats": _backtest(),
    "hedge_scans": f"""WITH {SERIES}, {debounced('sma_fast', 'af')}, t AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM series),
c AS (SELECT date, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS curve FROM t), d AS (SELECT date, curve, curve / max(curve) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c)
SELECT 'market' AS series_id, date, above, {rounded(curve='curve', drawdown='dd')} FROM d LEFT JOIN af USING (date)""",
    "hedge_asof": f"WITH {EXPOSURE}, {MONTHS} SELECT as_of, date, {rounded(exposure='exposure')} FROM months ASOF JOIN expo ON months.as_of >= expo.date",
    "hedge_recent_exposures": f"WITH {EXPOSURE} SELECT 'market' AS series_id, date, round(exposure, 4) AS exposure FROM expo WHERE exposure IS NOT NULL ORDER BY date DESC LIMIT 10",
    "hedge_parameters": _report(),
    "book_weights_largest": f"WITH {_positions(20)} SELECT 1 AS book_id, symbol, {rounded(weight='weight')} FROM book",
    "book_summary": _book_summary(),
    "book_weights_equal": f"WITH {POSITIONS} SELECT 1 AS book_id, symbol, {rounded(weight='equal')} FROM book",
    "book_weights_gross": f"WITH {POSITIONS} SELECT 1 AS book_id, symbol, {rounded(weight='weight')} FROM book",
    "portfolio_returns": f"WITH {BOOK_RETURNS} SELECT 1 AS book_id, date, {rounded(r='r')} FROM br",
    "portfolio_nav": f"WITH {BOOK_RETURNS} SELECT 1 AS book_id, date, {rounded(sign='CAST(sign(nav) AS DOUBLE)', log_nav='ln(abs(nav))')} FROM nav",
    "portfolio_vol30": f"""WITH {BOOK_RETURNS}, g AS (SELECT date, CASE WHEN nav > 0 THEN ln(nav) END AS g FROM nav), l AS (SELECT date, g - lag(g) OVER (ORDER BY date) AS lr FROM g), last AS (SELECT lr FROM l WHERE lr IS NOT NULL ORDER BY date DESC LIMIT 30)
SELECT 1 AS book_id, (SELECT max(date) FROM nav) AS as_of_date, (SELECT count(*) FROM nav) AS n_aligned_days, (SELECT count(*) FROM priced) AS n_priced,
CASE WHEN (SELECT count(*) FROM last) = 30 THEN round((SELECT stddev_samp(lr) FROM last) * sqrt(252.0), 6) + 0.0 END AS portfolio_vol, 1.0::DOUBLE AS coverage,
CASE WHEN (SELECT count(*) FROM last) < 30 THEN 'too many non-finite returns' END AS error, round(round((SELECT sum(weight) FROM priced), 6), 6) + 0.0 AS net_exposure""",
    "portfolio_vol_ewma": f"""WITH RECURSIVE {BOOK_RETURNS}, n AS (SELECT date, r, row_number() OVER (ORDER BY date) AS i FROM br),
v AS (SELECT i, date, r * r AS v FROM n WHERE i = 1 UNION ALL SELECT n.i, n.date, 0.94 * v.v + 0.06 * n.r * n.r FROM v JOIN n ON n.i = v.i + 1)
SELECT 1 AS book_id, date, round(sqrt(v * 252), 6) + 0.0 AS vol FROM v""",
}
