"""Daily and monthly profit models, scenario forecasts and running cash, for every entity at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, total

# Shares of revenue by scenario, the fees' share, and the cost of a pair.
SCENARIOS = {"stress": 0.75, "conservative": 0.85, "base": 1.0, "upside": 1.10}
FEE_SHARE, PAIR_COST = 0.35, 2.59


def _costs(df: DataFrame) -> DataFrame:
    c = F.col
    costs = df.withColumns({"fees": c("revenue") * FEE_SHARE, "cogs": c("pairs_sold") * PAIR_COST})
    return costs.withColumn("net", c("revenue") - c("fees") - c("cogs"))


def daily_model(sales: DataFrame) -> DataFrame:
    """By day: revenue, pairs, orders, fees, cost of goods, net, and the month."""
    rows = sales.where("date is not null").groupBy("date")
    daily = rows.agg(total(F.col("revenue")).cast("double").alias("revenue"), total(F.col("pairs_sold")).cast("long").alias("pairs_sold"), F.count_distinct("order_id").alias("orders"))
    return _costs(daily).withColumn("month", F.trunc("date", "month"))


def monthly_model(daily: DataFrame) -> DataFrame:
    """The sums of daily_model() by month; money is summed in decimals, so that the order of days does not matter."""
    money = lambda c: F.sum(F.col(c).cast("decimal(24,6)")).cast("double").alias(c)
    return daily.groupBy("month").agg(money("revenue"), F.sum("pairs_sold").alias("pairs_sold"), F.sum("orders").alias("orders"), *map(money, ("fees", "cogs", "net")))


def scenario_forecast(sales: DataFrame, months: int = 6, entity: list[str] | None = None, scenarios: dict[str, float] | None = None) -> DataFrame:
    """By entity, scenario and coming month: revenue (the mean of the last three months, scaled), pairs, fees, cogs, net.

    Without entity columns there is one series. The last month is used as it is, though it may be partial.
    """
    keys = entity or []
    rows = sales.where("date is not null").dropna(subset=keys) if keys else sales.where("date is not null")
    monthly = rows.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(total(F.col("revenue")).alias("revenue"), total(F.col("pairs_sold")).cast("long").alias("pairs"))
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("month"))
    last = F.col("at") <= 3
    base = monthly.withColumn("at", F.row_number().over(order)).groupBy(*keys).agg(
        ratio(F.sum(F.when(last, F.col("revenue"))), F.count_if(last)).alias("mean"), ratio(F.sum("pairs"), F.sum("revenue")).alias("per"), F.max("month").alias("last")
    )
    shares = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(float(s)).alias("scale")) for n, s in (scenarios or SCENARIOS).items())))
    table = base.withColumn("_s", shares).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(months))))
    revenue = F.col("mean") * F.col("_s.scale")
    out = table.select(*keys, "_s.scenario", F.expr("add_months(last, k)").alias("month"), revenue.alias("revenue"), (revenue * F.col("per")).alias("pairs_sold"))
    return _costs(out)


def cashflow(forecast: DataFrame, beginning: float, loan: float = 0, inventory: float = 0, loan_payment: float = 0, card_payment: float = 0, entity: list[str] | None = None) -> DataFrame:
    """A forecast with its cash flow by month and the running cash; the loan comes and inventory is paid in the first month."""
    order = Window.partitionBy(*(entity or []), "scenario").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    flow = forecast.withColumn("cash_flow", F.col("net") - loan_payment - card_payment)
    return flow.withColumn("cash", F.sum("cash_flow").over(order) + float(beginning + loan - inventory))


def cash_decision_check(flow: DataFrame, entity: list[str] | None = None) -> DataFrame:
    return flow.groupBy(*(entity or []), "scenario").agg(F.min("cash").alias("min_cash"), F.max_by("cash", "month").alias("final_cash"), F.count_if(F.col("cash") < 0).alias("months_negative"))
