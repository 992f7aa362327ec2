"""The tools as SQL table functions with named, checked arguments, over views of the stored facts.

Arguments are literals of the calling query, so that days fold into filters of the scans as they do in Python. An
argument that is not allowed is refused when the function's rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import periods as P
from ..operators import ads, sales
from .report import Tables

VALUES = {"revenue": "DOUBLE", "pairs_sold": "BIGINT", "units_sold_amazon": "BIGINT"}
PRICES = {"aov": "orders", "avg_unit_price": "units_sold_amazon", "avg_price_per_pair": "pairs_sold"}
SHARES = {"acos": ("spend", "sales"), "roas": ("sales", "spend"), "cvr": ("orders", "clicks"), "ctr": ("clicks", "impressions"), "cpc": ("spend", "clicks")}


def _if(when: str | None, value: str) -> str:
    return value if when is None else f"CASE WHEN {when} THEN {value} END"


def _sums(when: str | None = None, p: str = "") -> str:
    return ", ".join(f"CAST(coalesce(sum({_if(when, c)}), 0) AS {kind}) AS {p}{c}" for c, kind in VALUES.items()) + f", count(DISTINCT {_if(when, 'order_id')}) AS {p}orders"


def _ad_sums(when: str | None = None, p: str = "", columns: tuple[str, ...] = ads.COUNTS) -> str:
    return ", ".join(f"CAST(coalesce(sum({_if(when, c)}), 0) AS DOUBLE) AS {p}{c}" for c in columns)


def _div(a: str, b: str) -> str:
    return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


def _div0(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {_div(a, b)} ELSE 0.0D END"


def _prices(p: str = "") -> str:
    return ", ".join(f"{_div0(p + 'revenue', p + c)} AS {p}{n}" for n, c in PRICES.items())


def _ad_shares(p: str = "", names: tuple[str, ...] = tuple(SHARES), zero: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{(_div0 if n in zero else _div)(p + SHARES[n][0], p + SHARES[n][1])} AS {p}{n}" for n in names)


def _change(a: str, b: str) -> str:
    return f"{_div(f'({a} - {b})', b)} * 100"


def _changes(names: tuple[str, ...]) -> str:
    return ", ".join(f"{_change('current_' + n, 'prior_' + n)} AS {n}_change_pct" for n in names)


def _one_of(argument: str, values: dict[str, str], default: str | None = None) -> str:
    """SQL for what an argument names; other values are refused, null too if there is no default."""
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {argument if default is None else f"coalesce({argument}, '{default}')"} {cases} ELSE raise_error('{argument} is ' || coalesce({argument}, 'null') || '; it may be {', '.join(values)}') END"


def _whole(argument: str) -> str:
    """A number of days, rows or weeks, from 1 on."""
    return f"CASE WHEN {argument} >= 1 THEN {argument} ELSE raise_error('{argument} has to be 1 or more') END"


def _bodies(spark: SparkSession, tables: Tables, s: str, a: str) -> dict[str, tuple[str, str, str]]:
    """By tool: parameters, columns and query, over the views s of sales and a of ads."""
    day = {n: spark.range(1).select(P.day_of(tables[t]).alias("d")).first()["d"] for n, t in (("s", "sales"), ("a", "ppc"))}
    last, ad_last = (f"DATE'{day[n]}'" if day[n] else "CAST(NULL AS DATE)" for n in ("s", "a"))
    four = {p: spark.range(1).select(*(c.alias(n) for n, c in P.four_days(p, P.day_of(tables["sales"])).items())).first() for p in P.PERIODS}
    bound = lambda n: _one_of("period", {p: f"DATE'{four[p][n]}'" if four[p][n] else "CAST(NULL AS DATE)" for p in P.PERIODS})
    start, prior_start, prior_end = bound("current_start"), bound("prior_start"), bound("prior_end")

    def within(df: DataFrame, first: str, end: str) -> str:
        month = P.month_name("date")
        return f"date BETWEEN {first} AND {end}" + (f" AND {month} BETWEEN trunc({first}, 'MM') AND trunc({end}, 'MM')" if month in df.columns else "")

    days = _whole("days")
    sold = lambda n: within(tables["sales"], f"date_sub({last}, {n} - 1)", last)
    seen = lambda n: within(tables["ppc"], f"date_sub({ad_last}, {n} - 1)", ad_last)
    now, ad_now = f"date > date_sub({last}, days)", f"date > date_sub({ad_last}, days)"
    in_period = within(tables["sales"], start, last)
    both_periods = f"{within(tables['sales'], prior_start, last)} AND (date >= {start} OR date <= {prior_end})"
    group = {g: g for g in sales.GROUPS}
    by = _one_of("group_by", group)
    of = lambda p="": _one_of("metric", {m: f"CAST({p}{m} AS DOUBLE)" for m in sales.METRICS})
    first = lambda order: f"row_number() OVER (ORDER BY {order}) AS pos"
    top = f"pos <= {_whole('top_n')}"
    period, metric, top_n = "period STRING DEFAULT 'LAST_7_DAYS'", "metric STRING DEFAULT 'revenue'", "top_n INT DEFAULT 10"
    pairs = ", ".join(f"{p}_{c} {VALUES.get(c, 'BIGINT')}" for p in ("current", "prior") for c in sales.METRICS)
    numbers = lambda *names: ", ".join(f"{n} DOUBLE" for n in names)
    each = lambda names: tuple(f"{p}_{n}" for p in ("current", "prior") for n in names)
    totals = f"{', '.join(f'{c} {VALUES.get(c, "BIGINT")}' for c in sales.METRICS)}"
    recent = f"date >= {start}"
    long = [*sales.METRICS, *PRICES]
    stacked = "stack({}, {}) AS (name, current, prior)".format(len(long), ", ".join(f"'{n}', CAST(current_{n} AS DOUBLE), CAST(prior_{n} AS DOUBLE)" for n in long))

    def largest(groups: str, keys: str = "name", named: str = "name IS NOT NULL") -> str:
        """The largest changes of a metric by keys, which are columns of `groups`, with their share of the change of all groups."""
        rows = f"SELECT {groups}, {recent} AS is_now, * FROM {s} WHERE {both_periods}"
        sums = f"SELECT {keys}, {_sums('is_now', 'current_')}, {_sums('NOT is_now', 'prior_')} FROM ({rows}) WHERE {named} GROUP BY {keys}"
        changes = f"SELECT *, current - prior AS change_abs, {_change('current', 'prior')} AS change_pct FROM (SELECT {keys}, {of('current_')} AS current, {of('prior_')} AS prior FROM ({sums}))"
        whole = f"SELECT {keys}, grouping_id() AS gid, max(current) AS current, max(prior) AS prior, sum(change_abs) AS change_abs, max(change_pct) AS change_pct FROM ({changes}) GROUP BY GROUPING SETS (({keys}), ())"
        few = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY IF(gid = 0, 1, 0), change_abs DESC, {keys}) AS pos FROM ({whole})) WHERE pos <= {_whole('top_n')} + 1"
        shares = f"SELECT *, coalesce({_div('change_abs', 'max(CASE WHEN gid > 0 THEN change_abs END) OVER ()')}, 0) * 100 AS contribution_pct FROM ({few})"
        return f"SELECT {keys}, current, prior, change_abs, change_pct, contribution_pct FROM ({shares}) WHERE gid = 0"

    zero = ("ctr", "cvr", "cpc")
    daily = f"SELECT d.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ads.COUNTS)} FROM (SELECT date, CAST(sum(revenue) AS DOUBLE) AS total_sales, count(DISTINCT order_id) AS total_orders FROM {s} WHERE {sold('2 * days')} GROUP BY date) d LEFT JOIN (SELECT date AS ad_date, {_ad_sums()} FROM {a} WHERE {within(tables['ppc'], f'date_sub({last}, 2 * days - 1)', last)} GROUP BY date) ON date = ad_date"
    market = ("total_sales", "total_orders", *ads.COUNTS)
    market_shares = lambda p: f"{_div(p + 'spend', p + 'total_sales')} AS {p}tacos, {_div(p + 'sales', p + 'total_sales')} AS {p}ad_sales_share, {_ad_shares(p, ('acos', 'roas', 'ctr'))}"
    keywords = f"SELECT *, {_ad_shares()} FROM (SELECT keyword, match_type, {_ad_sums()} FROM {a} WHERE {seen('days')} AND keyword IS NOT NULL AND match_type IS NOT NULL GROUP BY keyword, match_type)"
    at_target = f"cpc * coalesce({_div('target_acos', 'acos')}, 1.0D)"
    # Actions, reasons and the factor of a reduced bid.
    rules = [
        ("clicks < min_clicks AND spend < min_spend", "Hold", "Not enough data yet", "cpc"), ("clicks >= pause_clicks AND sales = 0", "Pause", "Enough clicks with no sales", "0.0D"),
        ("sales = 0 AND spend >= min_spend", "Reduce bid", "Spend present but no sales yet", "cpc * 0.7D"), ("acos > target_acos", "Reduce bid", "ACOS above target", at_target),
        ("acos <= target_acos AND cvr >= scale_cvr", "Increase bid", "Profitable keyword with strong conversion", at_target), ("TRUE", "Hold", "Borderline or stable performance", "cpc"),
    ]
    advice = f"CASE {' '.join(f'''WHEN {when} THEN struct('{action}' AS action, '{why}' AS reason, {bid} AS suggested_cpc)''' for when, action, why, bid in rules)} END"

    def mixed(column: str) -> tuple[str, str, str]:
        part = f"SELECT {column}, {_sums()} FROM {s} WHERE {sold(days)} AND {column} IS NOT NULL GROUP BY {column}"
        return "days INT DEFAULT 7", f"{column} STRING, revenue DOUBLE, pairs_sold BIGINT, orders BIGINT, {numbers('revenue_pct', 'pairs_pct')}", f"SELECT {column}, revenue, pairs_sold, orders, {_div('revenue', 'sum(revenue) OVER ()')}, {_div('pairs_sold', 'sum(pairs_sold) OVER ()')} FROM ({part})"

    five = ("revenue", "orders", "pairs_sold", "units_sold_amazon", "aov")
    # An argument may not stand beside a column inside an aggregate, so what depends on it is a column first.
    slices = f"SELECT *, {_prices('current_')}, {_prices('prior_')} FROM (SELECT {_sums('is_now', 'current_')}, {_sums('NOT is_now', 'prior_')} FROM (SELECT *, {{}} AS is_now FROM {s} WHERE {{}}))"
    return {
        "get_sales_summary": ("days INT DEFAULT 7", f"{pairs}, {numbers(*each(PRICES), *(f'{n}_change_pct' for n in five))}", f"SELECT *, {_changes(five)} FROM ({slices.format(now, sold(f'2 * {days}'))})"),
        "get_ppc_summary": (
            "days INT DEFAULT 7", numbers(*each(ads.COUNTS), *each(SHARES), *(f"{n}_change_pct" for n in ("spend", "sales", "acos", "roas"))),
            f"SELECT *, {_changes(('spend', 'sales', 'acos', 'roas'))} FROM (SELECT *, {_ad_shares('current_', zero=zero)}, {_ad_shares('prior_', zero=zero)} FROM (SELECT {_ad_sums('is_now', 'current_')}, {_ad_sums('NOT is_now', 'prior_')} FROM (SELECT *, {ad_now} AS is_now FROM {a} WHERE {seen(f'2 * {days}')})))",
        ),
        "get_marketing_summary": (
            "days INT DEFAULT 7", numbers(*each(market), *each(("tacos", "ad_sales_share", "acos", "roas", "ctr")), *(f"{n}_change_pct" for n in ("total_sales", "spend", "sales", "tacos"))),
            f"SELECT *, {_changes(('total_sales', 'spend', 'sales', 'tacos'))} FROM (SELECT *, {market_shares('current_')}, {market_shares('prior_')} FROM (SELECT {_ad_sums('is_now', 'current_', market)}, {_ad_sums('NOT is_now', 'prior_', market)} FROM (SELECT *, {now} AS is_now FROM ({daily}))))",
        ),
        "get_top_keywords": (f"days INT DEFAULT 7, min_clicks INT DEFAULT 5, {top_n}", f"keyword STRING, match_type STRING, {numbers(*ads.COUNTS, *SHARES)}", f"SELECT * EXCEPT (pos) FROM (SELECT *, {first('sales DESC, keyword, match_type')} FROM ({keywords}) WHERE clicks >= min_clicks) WHERE {top}"),
        "get_top_products": (
            f"days INT DEFAULT 7, {metric}, {top_n}", f"asin STRING, item_name STRING, type STRING, color STRING, size STRING, {totals}, {numbers('aov', 'avg_price_per_pair')}",
            f"SELECT * EXCEPT (pos, value) FROM (SELECT *, {first('value DESC, asin, item_name, type, color, size')} FROM (SELECT *, {_div('revenue', 'orders')} AS aov, {_div('revenue', 'pairs_sold')} AS price, {of()} AS value FROM (SELECT asin, item_name, type, color, size, {_sums()} FROM {s} WHERE {sold(days)} AND {' AND '.join(f'{c} IS NOT NULL' for c in ('asin', 'item_name', 'type', 'color', 'size'))} GROUP BY ALL))) WHERE {top}",
        ),
        "get_product_mix": mixed("type"),
        "get_color_performance": mixed("color"),
        "get_sales_summary_period": (period, f"{totals}, {numbers(*PRICES)}", f"SELECT *, {_prices()} FROM (SELECT {_sums()} FROM {s} WHERE {in_period})"),
        "get_sales_breakdown": (
            f"{period}, group_by STRING DEFAULT 'color', {metric}, {top_n}", f"name STRING, {totals}, share DOUBLE, start_date DATE, end_date DATE",
            f"WITH g AS (SELECT *, {of()} AS value FROM (SELECT name, {_sums()} FROM (SELECT {by} AS name, * FROM {s} WHERE {in_period}) WHERE name IS NOT NULL GROUP BY name)), r AS (SELECT name, grouping_id() AS gid, {', '.join(f'max({m}) AS {m}' for m in sales.METRICS)}, sum(value) AS value FROM g GROUP BY GROUPING SETS ((name), ())), f AS (SELECT *, row_number() OVER (ORDER BY IF(gid = 0, 1, 0), value DESC, name) AS pos FROM r), w AS (SELECT *, max(CASE WHEN gid > 0 THEN value END) OVER () AS whole FROM f WHERE pos <= {_whole('top_n')} + 1) SELECT name, {', '.join(sales.METRICS)}, {_div0('value', 'whole')}, {start}, {last} FROM w WHERE gid = 0",
        ),
        "compare_periods": (
            f"{period}, {metric}, group_by STRING DEFAULT NULL, {top_n}", f"kind STRING, name STRING, {numbers('current', 'prior', 'change_abs', 'change_pct', 'contribution_pct')}",
            f"SELECT 'metric', name, current, prior, current - prior, {_change('current', 'prior')}, CAST(NULL AS DOUBLE) FROM (SELECT {stacked} FROM ({slices.format(recent, both_periods)})) "
            f"UNION ALL SELECT 'driver', * FROM ({largest(f"{_one_of('group_by', group, 'color')} AS name")}) WHERE group_by IS NOT NULL",
        ),
        "explain_change": (
            f"{period}, {metric}, group_by STRING DEFAULT 'asin', {top_n}", f"name STRING, item_name STRING, {numbers('current', 'prior', 'change_abs', 'change_pct', 'contribution_pct')}, current_start DATE, current_end DATE, prior_start DATE, prior_end DATE",
            f"SELECT *, {start}, {last}, {prior_start}, {prior_end} FROM ({largest(f"{by} AS name, IF(group_by = 'asin', item_name, NULL) AS product", 'name, product', "name IS NOT NULL AND (product IS NOT NULL OR group_by <> 'asin')")})",
        ),
        "get_keyword_bid_recommendations": (
            "days INT DEFAULT 30, target_acos DOUBLE DEFAULT 0.25D, min_clicks INT DEFAULT 10, min_spend DOUBLE DEFAULT 15.0D, pause_clicks INT DEFAULT 20, scale_cvr DOUBLE DEFAULT 0.12D, top_n INT DEFAULT 50",
            f"keyword STRING, match_type STRING, {numbers(*ads.COUNTS, *SHARES)}, action STRING, reason STRING, suggested_cpc DOUBLE, period_days INT, target DOUBLE",
            f"SELECT * EXCEPT (pos, advice), advice.*, days, target_acos FROM (SELECT *, {advice} AS advice, {first('spend DESC, clicks DESC, keyword, match_type')} FROM ({keywords})) WHERE {top}",
        ),
    }


def create_functions(spark: SparkSession, tables: Tables, prefix: str = "") -> list[str]:
    """Creates a temporary table function for each tool but the trend, which is a view of tool_views(), and gives their names.

    The functions read temporary views of the tables, and take the latest days as they are now; after new facts are
    stored, create them again. Of get_sales_breakdown, compare_periods and explain_change the group is the column `name`.
    """
    s, a = f"{prefix}facts_sales", f"{prefix}facts_ppc"
    tables["sales"].createOrReplaceTempView(s)
    tables["ppc"].createOrReplaceTempView(a)
    names = []
    for name, (parameters, columns, body) in _bodies(spark, tables, s, a).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
        names.append(prefix + name)
    return names
