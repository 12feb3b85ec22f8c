"""DuckDB oracle text for the registered queries (same tables, same column names).

Dialect pairs: ``try_divide(a, b)`` ~ ``a / nullif(b, 0)``; ``log1p(x)`` ~
``ln(1 + x)``; ``percentile`` ~ ``quantile_cont``.  Integer sums are cast to
BIGINT (DuckDB widens them to HUGEINT), ``year``/``rank`` to INTEGER.
"""

from __future__ import annotations

from kindling.models.leafwise import POISSON
from kindling.schema import LEAF_GRID

_SPLIT = ("select *, row_number() over (order by md5(concat('1:', cast(o_orderkey as varchar))), o_orderkey) rn, "
          "count(*) over () c from orders")

_PRED = f"""
with k as ({_SPLIT}),
f as (select regr_slope(o_totalprice, o_custkey) b, regr_intercept(o_totalprice, o_custkey) a,
             avg(o_totalprice) mu from k where rn > ceil(0.25 * c)),
p as (select 'linear' model, o_orderkey, o_totalprice y, a + b * o_custkey yh from k, f where rn <= ceil(0.25 * c)
      union all
      select 'mean' model, o_orderkey, o_totalprice y, mu yh from k, f where rn <= ceil(0.25 * c))
"""

_SCORES = _PRED + """,
r as (select model, avg(abs(y - yh)) mae, sqrt(avg((y - yh) * (y - yh))) rmse,
             1 - sum((y - yh) * (y - yh)) / (var_pop(y) * count(*)) r2,
             1 - var_pop(y - yh) / var_pop(y) ev
      from p group by model)
"""

_REGISTRY = """
with reg as (select cast(year(o_orderdate) as varchar) run_id, o_orderpriority model,
                    max(o_orderdate) modified_at,
                    'runs/' || cast(year(o_orderdate) as varchar) || '/' || o_orderpriority path
             from orders group by 1, 2, 4)
"""

_RUNS = """
with r as (select cast(year(o_orderdate) as integer) run_id, o_orderpriority model,
                  round(avg(abs(o_totalprice - 250000)), 4) mae
           from orders group by 1, 2)
"""


def _hist(table: str, col: str, bins: int = 30) -> str:
    x = f"cast({col} as double)"
    return (f"select '{col}' as \"column\", cast(least(floor(({x} - lo) * {bins} / (hi - lo)), {bins - 1}) as integer) bin, "
            f"count(*) as \"count\" from {table}, (select min({x}) lo, max({x}) hi from {table}) m "
            f"where {col} is not null group by 2")


_LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                     "l_discount", "l_tax"]


def _stats(col: str) -> str:
    return (f"select '{col}' as \"column\", count({col}) as \"count\", round(avg({col}), 4) mean, "
            f"round(stddev_samp({col}), 4) std, min({col}) as \"min\", max({col}) as \"max\" from lineitem")


_CORR = ["l_quantity", "l_extendedprice", "l_discount"]


def _corr_cells(lower_only: bool) -> str:
    parts = []
    for i, a in enumerate(_CORR):
        for j, b in enumerate(_CORR):
            if lower_only and not i > j:
                continue
            val = f"case when stddev_samp({a}) > 0 then 1.0 end" if i == j else f"round(corr({a}, {b}), 6)"
            ij = "" if lower_only else f", {i} i, {j} j"
            parts.append(f"select '{a}' a, '{b}' b{ij}, cast({val} as double) corr from lineitem")
    return " union all ".join(parts)


_CELLS = ("select o_orderkey, cast(substr(o_orderpriority, 1, 1) as double) p, cast(quarter(cast(o_orderdate as date)) as double) q, "
          "cast(o_totalprice as double) y from orders")
_OLS = """select avg(y) - b1 * avg(p) - b2 * avg(q) a, b1, b2 from {0}, (
  select (cp * vq - cq * c) / (vp * vq - c * c) b1, (cq * vp - cp * c) / (vp * vq - c * c) b2
  from (select var_samp(p) vp, var_samp(q) vq, covar_samp(p, q) c, covar_samp(p, y) cp, covar_samp(q, y) cq from {0})) group by b1, b2"""
#: Poisson(1) weight of a row in a tree from 52 bits of md5('42:<tree>:<key>').
_POISSON = " + ".join(f"cast(u >= {b} as int)" for b in POISSON)


def _cell_models(source: str, columns: str) -> str:
    """Scores of a linear model, a tree of all cells and a forest of five such trees on Poisson resamples."""
    return f"""
with s as ({source}),
k as (select *, row_number() over (order by md5(concat('1:', cast(o_orderkey as varchar))), o_orderkey) rn, count(*) over () c from s),
tr as (select * from k where rn > ceil(0.25 * c)), te as (select * from k where rn <= ceil(0.25 * c)),
ols as ({_OLS.format('tr')}),
cell as (select p, q, avg(y) mu from tr group by 1, 2),
u as (select tr.*, t, cast('0x' || substr(md5(concat('42:', cast(t as varchar), ':', cast(o_orderkey as varchar))), 1, 13) as bigint) u from tr, range(5) r(t)),
w as (select p, q, t, sum(({_POISSON}) * y) / sum({_POISSON}) mu from u group by 1, 2, 3),
forest as (select p, q, avg(mu) mu from w group by 1, 2),
m as (select 'linear_regression' model, y, a + b1 * p + b2 * q yh from te, ols
      union all select 'decision_tree', y, mu from te join cell using (p, q)
      union all select 'random_forest', y, mu from te join forest using (p, q)),
r as (select model, count(*) n, avg(abs(y - yh)) mae, sqrt(avg((y - yh) * (y - yh))) rmse, 1 - sum((y - yh) * (y - yh)) / (var_pop(y) * count(*)) r2,
             1 - var_pop(y - yh) / var_pop(y) ev from m group by model)
select model, model = 'random_forest' is_default, round(mae, 4) mae, round(rmse, 4) rmse, round(r2, 6) r2{columns} from r"""


def _wide_correlations() -> str:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"] * 10
    cols = ", ".join(f"case when l_linenumber % 7 <> {i % 7} then {c} * {1 + i % 3} + l_quantity * {i % 5} end v{i}" for i, c in enumerate(names))
    cells = ", ".join(f"{{'a': 'v{i}', 'b': 'v{j}', 'corr': round(corr(v{i}, v{j}), 6)}}" for i in range(40) for j in range(i))
    return f"select unnest(cells, recursive := true) from (select [{cells}] cells from (select {cols} from lineitem))"


def _group_fits(source: str, over: str, name: str) -> str:
    """Two-feature least squares of each group ``a`` over the rows of the groups ``b`` with ``over``."""
    return f"""
with z as ({source}), v as (
  select a.g, count(*) n, avg(p) mp, avg(q) mq, avg(y) my, covar_samp(p, q) c, var_samp(p) vp, var_samp(q) vq, covar_samp(p, y) cp, covar_samp(q, y) cq, var_samp(y) vy
  from (select distinct g from z) a join z b on {over} group by 1),
f as (select *, (cp * vq - cq * c) / (vp * vq - c * c) b1, (cq * vp - cp * c) / (vp * vq - c * c) b2 from v)
select g as {name}, n, t.term, round(case t.term when 'priority' then b1 when 'quarter' then b2 else my - b1 * mp - b2 * mq end, 4) coefficient,
       round((b1 * cp + b2 * cq) / vy, 6) r2
from f, (values ('priority'), ('quarter'), ('intercept')) t(term)
"""


ORACLE_SQL: dict[str, str] = {
    "drop_missing": "select count(*) n, round(sum(d), 4) s from (select nullif(l_discount, 0.0) d from lineitem) "
                    "where d is not null",
    "null_audit": "select 'd' as \"column\", count(*) - count(d) nulls "
                  "from (select nullif(l_discount, 0.0) d from lineitem) "
                  "union all select 'l_quantity', count(*) - count(l_quantity) from lineitem",
    "filter_region": "select count(*) n, round(sum(l_extendedprice), 2) s from lineitem "
                     "where l_quantity between 10 and 20 and l_discount between 0.02 and 0.05",
    "filter_outliers": "with m as (select avg(value) mu, stddev_samp(value) sd from events) "
                       "select count(*) n, round(sum(value), 4) v from events, m "
                       "where value > mu - 3 * sd and value < mu + 3 * sd",
    "clean_detections": """
with d as (select -8.0 - l_discount * 400 latitude, 110.0 + l_quantity longitude, l_extendedprice / 200 brightness,
                  1.0 + l_tax * 10 scan, 1.0 + l_discount * 10 track, cast(l_shipdate as date) acq_date
           from lineitem),
r as (select * from d where latitude is not null and longitude is not null and brightness is not null
        and scan is not null and track is not null
        and latitude between -44 and -10 and longitude between 112 and 154),
m as (select avg(brightness) mu, stddev_samp(brightness) sd from r)
select count(*) n, round(avg(brightness), 4) b, min(latitude) lat_lo, max(latitude) lat_hi,
       min(longitude) lon_lo, max(longitude) lon_hi, strftime(min(acq_date), '%Y-%m-%d') first_day
from r, m where brightness > mu - 3 * sd and brightness < mu + 3 * sd
""",
    "create_dataset": "with r as (select l_returnflag, l_extendedprice, cast(l_shipdate as date) l_shipdate "
                      "from lineitem where l_quantity is not null and l_discount is not null "
                      "and l_quantity between 5 and 45 and l_discount between 0.01 and 0.09), "
                      "m as (select avg(l_extendedprice) mu, stddev_samp(l_extendedprice) sd from r) "
                      "select l_returnflag, count(*) n, round(sum(l_extendedprice), 2) s, strftime(min(l_shipdate), '%Y-%m-%d') first_day "
                      "from r, m where l_extendedprice > mu - 2 * sd and l_extendedprice < mu + 2 * sd "
                      "group by l_returnflag",
    "ratio_diff": "select l_orderkey, l_linenumber, l_partkey, "
                  "l_extendedprice / nullif(l_quantity * (1 + l_tax), 0) r, l_extendedprice - l_quantity d "
                  "from lineitem",
    "log_transform": "select l_orderkey, l_partkey, round(ln(1 + l_extendedprice), 6) r from lineitem",
    "minmax": "with m as (select min(l_quantity) lo, max(l_quantity) hi from lineitem) "
              "select l_orderkey, l_partkey, (l_quantity - lo) / nullif(hi - lo, 0) r from lineitem, m",
    "zscore": "with m as (select avg(l_quantity) mu, stddev_samp(l_quantity) sd from lineitem) "
              "select l_orderkey, l_partkey, round((l_quantity - mu) / nullif(sd, 0), 6) r from lineitem, m",
    "date_from_doy": "select o_orderkey, strftime(cast(make_date(cast(year(o_orderdate) as int), 1, 1) "
                     "+ cast(dayofyear(o_orderdate) - 1 as int) as date), '%Y-%m-%d') acq_date from orders",
    "date_from_text": "select o_orderkey, strftime(cast(o_orderdate as date), '%Y-%m-%d') acq_date from orders",
    "intensity_band": "select case when o_totalprice > 400000 then 'High' when o_totalprice > 350000 then 'Moderate' "
                      "else 'Low' end b, count(*) n, round(max(o_totalprice * 50), 2) r from orders group by 1",
    "range_check": "select count(*) n, "
                   "cast(sum(case when l_quantity between 5 and 45 then 0 else 1 end) as bigint) bad_l_quantity, "
                   "cast(sum(case when l_discount between 0.01 and 0.09 then 0 else 1 end) as bigint) bad_l_discount "
                   "from lineitem",
    "range_flags": "select (l_quantity between 5 and 45) and (l_discount between 0.01 and 0.09) valid, "
                   "concat_ws(',', case when not (l_quantity between 5 and 45) then 'l_quantity' end, "
                   "case when not (l_discount between 0.01 and 0.09) then 'l_discount' end) rules, count(*) n "
                   "from lineitem group by 1, 2",
    "filter_dates": "select count(*) n, min(l_shipdate) lo, max(l_shipdate) hi from lineitem "
                    "where cast(l_shipdate as date) between date '1997-01-01' and date '1998-12-31'",
    "column_stats": " union all ".join(_stats(c) for c in _CORR),
    "describe": "select 'value' as \"column\", count(value) as \"count\", round(avg(value), 6) mean, "
                "round(stddev_samp(value), 6) std, min(value) as \"min\", round(quantile_cont(value, 0.25), 6) p25, "
                "round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.75), 6) p75, "
                "max(value) as \"max\" from events",
    "quantile_levels": " union all ".join(
        f"select '{c}' as \"column\", cast({q} as double) q, round(quantile_cont({c}, {q}), 6) \"value\" from lineitem"
        for c in _CORR for q in (0.01, 0.5, 0.99)),
    "correlations": _corr_cells(False),
    "lower_triangle": _corr_cells(True),
    "top_correlates": "select feature, c from ("
                      "select 'l_quantity' feature, round(corr(l_extendedprice, l_quantity), 6) c from lineitem "
                      "union all select 'l_discount', round(corr(l_extendedprice, l_discount), 6) from lineitem "
                      "union all select 'l_tax', round(corr(l_extendedprice, l_tax), 6) from lineitem) "
                      "order by c desc, feature limit 2",
    "histogram": " union all ".join(_hist("lineitem", c) for c in _CORR),
    "numeric_histograms": " union all ".join(_hist("lineitem", c) for c in _LINEITEM_NUMERIC),
    "histogram_events": "with m as (select min(value) lo, max(value) hi from events) "
                        "select cast(least(floor((value - lo) * 30 / (hi - lo)), 29) as integer) bin, count(*) n "
                        "from events, m where value is not null group by 1",
    "density_curve": """
with s as (select count(value) n, min(value) lo, max(value) hi, stddev_samp(value) sd,
                  stddev_samp(value) * pow(count(value), -0.2) h from events),
fine as (select cast(least(floor((value - lo) / ((hi - lo) / 1024)), 1023) as integer) b, count(*) w
         from events, s where value is not null group by 1),
k as (select g.range i, lo + g.range * ((hi - lo) / 199) x,
             w * exp(-0.5 * ((lo + g.range * ((hi - lo) / 199) - (lo + (b + 0.5) * ((hi - lo) / 1024))) / h)
                          * ((lo + g.range * ((hi - lo) / 199) - (lo + (b + 0.5) * ((hi - lo) / 1024))) / h))
               / (h * sqrt(2 * pi())) kern, n
      from fine, s, range(0, 200) g)
select cast(i as integer) i, round(x, 8) x, round(sum(kern) / any_value(n), 10) density from k group by i, x
""",
    "scatter_density": "with m as (select min(l_quantity) xl, max(l_quantity) xh, min(l_extendedprice) yl, "
                       "max(l_extendedprice) yh from lineitem) "
                       "select cast(least(floor((l_quantity - xl) * 10 / (xh - xl)), 9) as integer) xb, "
                       "cast(least(floor((l_extendedprice - yl) * 10 / (yh - yl)), 9) as integer) yb, count(*) n "
                       "from lineitem, m where l_quantity is not null and l_extendedprice is not null "
                       "group by 1, 2",
    "daily_summary": "select strftime(cast(ts as date), '%Y-%m-%d') d, count(*) n, round(avg(value), 4) a, "
                     "round(quantile_cont(value, 0.5), 4) m, max(value) mx from events group by 1",
    "exact_split": f"select count(*) n, cast(sum(o_orderkey) as bigint) k from ({_SPLIT}) where rn <= ceil(0.25 * c)",
    "linear_fit": "select 'o_custkey' feature, round(regr_slope(o_totalprice, o_custkey), 6) coefficient from orders "
                  "union all select 'intercept', round(regr_intercept(o_totalprice, o_custkey), 4) from orders",
    "model_metrics": _SCORES + "select model, round(mae, 4) mae, round(rmse, 4) rmse, round(r2, 6) r2, "
                               "round(ev, 6) ev from r",
    "train_test_r2": f"""
with k as ({_SPLIT}),
f as (select regr_slope(o_totalprice, o_custkey) b, regr_intercept(o_totalprice, o_custkey) a
      from k where rn > ceil(0.25 * c)),
p as (select case when rn <= ceil(0.25 * c) then 'test' else 'train' end split, o_totalprice y,
             a + b * o_custkey yh from k, f)
select 'linear' model, split, count(*) n,
       round(1 - sum((y - yh) * (y - yh)) / (var_pop(y) * count(*)), 6) r2 from p group by split
""",
    "best_model": _SCORES + "select min_by(model, mae) best, round(min(mae), 4) mae from r",
    "improvement_pct": _SCORES + "select round((b.mae - o.mae) / nullif(b.mae, 0) * 100, 4) pct "
                                 "from r b join r o on b.model = 'mean' and o.model = 'linear'",
    "model_comparison": _SCORES + "select model, round(mae, 4) mae, round(r2, 6) r2 from r "
                                  "where mae is not null and r2 is not null",
    "prediction_bounds": _PRED + "select model, round(least(min(y), min(yh)), 4) lo, "
                                 "round(greatest(max(y), max(yh)), 4) hi from p group by model",
    "predictions_vs_actual": _PRED + ", b as (select model, least(min(y), min(yh)) lo, greatest(max(y), max(yh)) hi "
                                     "from p group by model) "
                                     "select model, "
                                     "cast(case when hi = lo then 0 else least(floor((y - lo) * 20 / (hi - lo)), 19) end "
                                     "as integer) actual_bin, "
                                     "cast(case when hi = lo then 0 else least(floor((yh - lo) * 20 / (hi - lo)), 19) end "
                                     "as integer) predicted_bin, round(lo, 4) lo, round(hi, 4) hi, count(*) n "
                                     "from p join b using (model) group by all",
    "residuals": _PRED + "select o_orderkey, round(y - yh, 4) residual from p where model = 'mean'",
    "default_model": """
with s as (select cast(year(o_orderdate) as integer) run_id, o_orderpriority model,
                  bool_or(o_totalprice > 499000) is_default,
                  cast(substr(o_orderpriority, 1, 1) as integer) - 1 position
           from orders group by 1, 2)
select r.run_id,
       coalesce((select model from s s2 where s2.run_id = r.run_id and s2.is_default
                 order by position desc limit 1),
                (select model from s s2 where s2.run_id = r.run_id order by position limit 1)) default_model
from (select distinct run_id from s) r
""",
    "compare_runs": _RUNS + "select run_id, model, mae, "
                            "cast(rank() over (partition by run_id order by mae, model) as integer) rk, "
                            "round(mae - lag(mae) over (partition by model order by run_id), 4) d from r",
    "best_run": _RUNS + "select model, best_run, mae from (select model, run_id best_run, mae, "
                        "row_number() over (partition by model order by mae, run_id desc) rn from r) where rn = 1",
    "list_runs": "select distinct cast(year(o_orderdate) as varchar) run_id from orders",
    "preview": "select * from orders order by o_orderkey limit 5",
    "resolve_model": _REGISTRY + "select run_id, model, path, 'priority' rule from reg "
                                 "where model = '1-URGENT' and run_id in ('1990', '2003', '1998', '1997') "
                                 "order by case run_id when '1990' then 0 when '2003' then 1 when '1998' then 2 "
                                 "else 3 end limit 1",
    "resolve_latest": _REGISTRY + "select run_id, model, path, 'most_recent' rule from reg "
                                  "where model like '%URGENT%' order by modified_at desc, run_id desc limit 1",
}


def _positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``.

    DuckDB's ``round`` keeps the sign of a tiny negative value (-1e-16 -> -0.0)
    while Spark's decimal rounding gives 0.0; adding 0.0 maps -0.0 to +0.0 (IEEE)
    and leaves every other value, and NULL, unchanged.
    """
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = _positive_zero_rounds(sql[j + len("round("):k - 1])
        out.append(f"{sql[i:j]}(round({inner}) + 0.0)")
        i = k
    out.append(sql[i:])
    return "".join(out)


ORACLE_SQL |= {
    "leafwise_tree": f"with k as (select *, row_number() over (order by md5(concat('1:', cast(o_orderkey as varchar))), o_orderkey) rn, count(*) over () c from ({_CELLS})) "
                     "select p as \"priority\", q as \"quarter\", count(*) n, round(avg(y), 4) prediction from k where rn > ceil(0.25 * c) group by 1, 2",
    "model_scores": _cell_models(_CELLS, ", round(ev, 6) explained_variance, n, mae = min(mae) over () is_best"),
    "workflow": _cell_models(f"with z as ({_CELLS}), m as (select avg(y) mu, stddev_samp(y) sd from z) select z.* from z, m where y > mu - 3 * sd and y < mu + 3 * sd", ""),
    "wide_correlations": _wide_correlations(),
    "group_correlations": " union all ".join(f"select l_returnflag, l_linestatus, '{a}' a, '{b}' b, round(corr({a}, {b}), 6) corr from lineitem group by 1, 2"
                                             for i, a in enumerate(_CORR) for b in _CORR[:i]),
    "linear_by_year": _group_fits(f"select z.*, cast(year(cast(o_orderdate as date)) as integer) g from ({_CELLS}) z join orders using (o_orderkey)", "b.g = a.g", '"year"'),
    "linear_leave_fold_out": _group_fits(f"select *, cast(ntile(5) over (order by md5(concat('1:', cast(o_orderkey as varchar))), o_orderkey) - 1 as integer) g from ({_CELLS})", "b.g <> a.g", "fold"),
    "csv_round_trip": """
with o as (select o_orderkey, case when o_orderkey % 9 <> 0 then o_custkey end o_custkey, o_totalprice, o_orderpriority, (o_orderkey % 2 = 0) even from orders)
select 'o_orderkey' as "column", 'bigint' as "type", count(*) n, round(sum(o_orderkey)::double, 2) total from o
union all select 'o_custkey', 'bigint', count(o_custkey), round(sum(o_custkey)::double, 2) from o
union all select 'o_totalprice', 'double', count(*), round(sum(o_totalprice)::double, 2) from o
union all select 'o_orderpriority', 'string', count(*), round(sum(length(o_orderpriority))::double, 2) from o
union all select 'even', 'boolean', count(*), round(sum(even::int)::double, 2) from o
""",
    "csv_rejects": """
select * from (select 'o_totalprice' as "column", 'not a double' reason, count(*) filter (o_orderkey % 5 <> 0 and (o_orderkey % 7 = 0 or o_orderkey % 11 = 0)) n from orders
union all select 'o_custkey', 'not a int', count(*) filter (o_orderkey % 3 <> 0 and o_orderkey % 13 = 0) from orders) where n > 0
""",
    "csv_stream": """
select o_orderkey, case when o_orderkey % 3 = 0 or o_orderkey % 13 <> 0 then o_custkey::integer end o_custkey,
       case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 then round(o_totalprice::double, 2) end o_totalprice,
       case when o_orderkey % 4 <> 0 then month(o_orderdate::date) > 6 end late, o_orderpriority || ', "' || o_orderstatus || '"' said
from orders
""",
    "contiguous_folds": "select fold, count(*) n, cast(sum(o_orderkey) as bigint) \"keys\" from (select o_orderkey, cast(ntile(5) over "
                        "(order by md5(concat('1:', cast(o_orderkey as varchar))), o_orderkey) - 1 as integer) fold from orders) group by 1",
    "tune_tree_folds": f"""
with k as (select *, row_number() over (order by md5(concat('1:', cast(o_orderkey as varchar))), o_orderkey) rn, count(*) over () c from ({_CELLS})),
f as (select *, ntile(5) over (order by rn) - 1 fold from k where rn > ceil(0.25 * c)),
h as (select a.fold, a.y, (select avg(b.mu * b.n) / avg(b.n) from (select fold, p, q, avg(y) mu, count(*) n from f group by 1, 2, 3) b
                           where b.p = a.p and b.q = a.q and b.fold <> a.fold) yh from f a),
m as (select avg(e) e from (select fold, avg(abs(y - yh)) e from h group by 1))
select cast(l as integer) max_leaf_nodes, round(e, 4) cv_mae, l = {LEAF_GRID[0]} is_best from m, (select unnest([{", ".join(map(str, LEAF_GRID))}]) l)
""",
    "stream_score": f"""
with s as ({_CELLS}), ols as ({_OLS.format('s')}),
r as (select o_orderkey, q between 1 and 3 and p between 1 and 5 valid, case when q between 1 and 3 and p between 1 and 5 then a + b1 * p + b2 * q end yh from s, ols)
select o_orderkey, valid, round(yh, 2) prediction, case when yh > 400 then 'High' when yh > 350 then 'Moderate' when yh is not null then 'Low' end intensity,
       round(yh * 50, 2) radius from r
""",
}

ORACLE_SQL |= {
    "scatter_sample": " union all ".join(f"""
select * from (select '{x}' feature, cast(least(floor(({x} - xl) * 10 / (xh - xl)), 9) as integer) bin, cast({x} as double) x, round(cast(l_extendedprice as double), 2) y, l_orderkey, l_linenumber
  from lineitem, (select min({x}) xl, max({x}) xh from lineitem) where {x} is not null and l_extendedprice is not null
  qualify row_number() over (partition by bin order by md5(concat('1:', cast(l_orderkey as varchar), ':', cast(l_linenumber as varchar))), l_orderkey, l_linenumber, {x}, l_extendedprice) <= 20)"""
                                         for x in ("l_quantity", "l_discount")),
    "stored_quantiles": " union all ".join(f"""
select '{c}' "column", cast({q} as integer) "level", true "within", count({c}) n, round(avg({c}), 4) mean, round(stddev_samp({c}), 4) std,
       min(cast({c} as double)) lo, max(cast({c} as double)) hi
from lineitem where cast(l_shipdate as date) between '1994-01-01' and '1995-12-31'""" for c in ("l_extendedprice", "l_quantity") for q in (25, 50, 75)),
    "daily_from_states": " union all ".join(f"""
select strftime(cast(l_shipdate as date), '%Y-%m-%d') "day", '{c}' "column", count({c}) n, round(sum({c})::double, 2) total, round(stddev_samp({c}), 4) std,
       min(cast({c} as double)) lo, max(cast({c} as double)) hi from lineitem group by 1""" for c in ("l_extendedprice", "l_quantity")),
    "stream_two_way": f"""
with s as ({_CELLS}), ols as ({_OLS.format('s')}),
r as (select q, p, q between 1 and 3 and p between 2 and 5 ok, a + b1 * p + b2 * q yh from s, ols)
select * from (
select 'accepted' kind, 'rows' "name", count(*) filter (ok) n, '1' model_run, round(avg(yh) filter (ok), 4) prediction from r
union all select 'rejected', 'rows', count(*) filter (not ok), null, null from r
union all select 'violation', 'quarter', count(*) filter (q not between 1 and 3), null, null from r
union all select 'violation', 'priority', count(*) filter (p not between 2 and 5), null, null from r) where n > 0
""",
    "published_runs": """
with y as (select distinct year(cast(o_orderdate as date)) y from orders)
select cast(y as varchar) run_id, 'mean' model, 'models/' || y path, y = max(y) over () latest from y where y % 2 = 0
""",
}

ORACLE_SQL = {name: _positive_zero_rounds(text) for name, text in ORACLE_SQL.items()}
