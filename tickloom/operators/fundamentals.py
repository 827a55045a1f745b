"""Fundamental ratios, growth, scores, valuation and screening: expressions over wide snapshots.

A missing value is null; a quotient with a null or zero operand's zero denominator is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ratio

c = F.col
FIELDS = (
    "revenue cogs gross_profit operating_income ebit ebitda net_income interest_expense tax_rate total_assets current_assets cash inventory receivables ppe"
    " total_liabilities current_liabilities total_debt long_term_debt equity retained_earnings operating_cash_flow capex free_cash_flow dividends depreciation sga shares price market_cap"
).split()


def _average(name: str, before: str | None) -> Column:
    return c(name) if before is None else F.when(c(before + name).isNotNull(), (c(name) + c(before + name)) / 2).otherwise(c(name))


def market_cap() -> Column:
    return F.coalesce("market_cap", c("price") * c("shares"))


def net_debt() -> Column:
    return c("total_debt") - c("cash")


def free_cash_flow() -> Column:
    """Given, or operating cash flow plus capital expenditure (which is negative)."""
    return F.coalesce("free_cash_flow", c("operating_cash_flow") + c("capex"))


def ratios(before: str | None = None) -> dict[str, Column]:
    """The twenty ratios; ``before`` is the prefix of the previous period's columns, for averages."""
    average = lambda name: _average(name, before)
    taxed = c("ebit") * (1 - F.coalesce("tax_rate", F.lit(0.0)))
    return {
        "gross_margin": ratio(F.coalesce("gross_profit", c("revenue") - c("cogs")), c("revenue")),
        "operating_margin": ratio(c("operating_income"), c("revenue")),
        "net_margin": ratio(c("net_income"), c("revenue")),
        "ebitda_margin": ratio(c("ebitda"), c("revenue")),
        "return_on_assets": ratio(c("net_income"), average("total_assets")),
        "return_on_equity": ratio(c("net_income"), average("equity")),
        "return_on_invested_capital": ratio(taxed, average("equity") + average("total_debt")),
        "current_ratio": ratio(c("current_assets"), c("current_liabilities")),
        "quick_ratio": ratio(c("current_assets") - c("inventory"), c("current_liabilities")),
        "cash_ratio": ratio(c("cash"), c("current_liabilities")),
        "debt_to_equity": ratio(c("total_debt"), c("equity")),
        "debt_to_assets": ratio(c("total_debt"), c("total_assets")),
        "net_debt_to_ebitda": ratio(net_debt(), c("ebitda")),
        "interest_coverage": ratio(c("ebit"), c("interest_expense")),
        "asset_turnover": ratio(c("revenue"), average("total_assets")),
        "inventory_turnover": ratio(c("cogs"), average("inventory")),
        "receivables_turnover": ratio(c("revenue"), average("receivables")),
        "eps": ratio(c("net_income"), c("shares")),
        "book_value_per_share": ratio(c("equity"), c("shares")),
        "fcf_per_share": ratio(free_cash_flow(), c("shares")),
    }


def multiples() -> dict[str, Column]:
    cap = market_cap()
    ev = cap + net_debt()
    return {
        "enterprise_value": ev,
        "pe_ratio": ratio(cap, c("net_income")),
        "pb_ratio": ratio(cap, c("equity")),
        "ps_ratio": ratio(cap, c("revenue")),
        "ev_to_ebitda": ratio(ev, c("ebitda")),
        "ev_to_sales": ratio(ev, c("revenue")),
        "earnings_yield": ratio(c("net_income"), cap),
        "fcf_yield": ratio(free_cash_flow(), cap),
        "dividend_yield": ratio(F.abs("dividends"), cap),
    }


def peg_ratio(growth: Column) -> Column:
    return ratio(ratio(market_cap(), c("net_income")), growth * 100)


def dupont() -> dict[str, Column]:
    """Three and five factors of return on equity."""
    pre_tax = c("ebit") - c("interest_expense")
    return {"net_margin": ratio(c("net_income"), c("revenue")), "asset_turnover": ratio(c("revenue"), c("total_assets")), "leverage": ratio(c("total_assets"), c("equity")), "tax_burden": ratio(c("net_income"), pre_tax), "interest_burden": ratio(pre_tax, c("ebit")), "operating_margin": ratio(c("ebit"), c("revenue"))}


def previous(snapshots: DataFrame, keys: Sequence[str] = ("ticker",), period: str = "period", prefix: str = "prev_", fields: Sequence[str] | None = None) -> DataFrame:
    """Adds the previous period's fields under a prefix."""
    w = Window.partitionBy(*keys).orderBy(period)
    have = [f for f in (fields or FIELDS) if f in snapshots.columns]
    return snapshots.withColumns({prefix + f: F.lag(f).over(w) for f in have})


def growth(field: str, before: str = "prev_") -> Column:
    return ratio(c(field) - c(before + field), F.abs(before + field))


def cagr(begin: Column, end: Column, periods: Column) -> Column:
    return F.when((begin > 0) & (end > 0) & (periods > 0), F.pow(end / begin, 1 / F.nullif(periods.cast("double"), F.lit(0.0))) - 1)


def piotroski(before: str = "prev_") -> dict[str, Column]:
    """Nine signals of improvement and their number; a comparison with a missing value is false."""
    of = lambda a, b, p="": ratio(c(p + a), c(p + b))
    p = before
    gross = lambda q: ratio(F.coalesce(c(q + "gross_profit"), c(q + "revenue") - c(q + "cogs")), c(q + "revenue"))
    signals = {
        "f_roa": of("net_income", "total_assets") > 0,
        "f_cfo": c("operating_cash_flow") > 0,
        "f_delta_roa": of("net_income", "total_assets") > of("net_income", "total_assets", p),
        "f_accruals": c("operating_cash_flow") > c("net_income"),
        "f_leverage": of("long_term_debt", "total_assets") < of("long_term_debt", "total_assets", p),
        "f_liquidity": of("current_assets", "current_liabilities") > of("current_assets", "current_liabilities", p),
        "f_shares": c("shares") <= c(p + "shares"),
        "f_margin": gross("") > gross(p),
        "f_turnover": of("revenue", "total_assets") > of("revenue", "total_assets", p),
    }
    signals = {k: F.coalesce(v, F.lit(False)) for k, v in signals.items()}
    return signals | {"f_score": sum((v.cast("int") for v in signals.values()), F.lit(0))}


def altman_z() -> dict[str, Column]:
    """Score and zone, of the original model and of the one for firms outside manufacturing."""
    assets = c("total_assets")
    x1, x2, x3 = (ratio(v, assets) for v in (c("current_assets") - c("current_liabilities"), c("retained_earnings"), c("ebit")))
    z = 1.2 * x1 + 1.4 * x2 + 3.3 * x3 + 0.6 * ratio(market_cap(), c("total_liabilities")) + ratio(c("revenue"), assets)
    z2 = 6.56 * x1 + 3.26 * x2 + 6.72 * x3 + 1.05 * ratio(c("equity"), c("total_liabilities"))
    zone = lambda v, high, low: F.when(v > high, "safe").when(v > low, "grey").otherwise("distress")
    return {"z_score": z, "z_zone": zone(z, 2.99, 1.81), "z2_score": z2, "z2_zone": zone(z2, 2.6, 1.1)}


def beneish_m(before: str = "prev_") -> dict[str, Column]:
    """Eight indices, the score, and whether it points to manipulated earnings."""
    p = before
    of = lambda a, b, q="": ratio(c(q + a), c(q + b))
    gross = lambda q: ratio(F.coalesce(c(q + "gross_profit"), c(q + "revenue") - c(q + "cogs")), c(q + "revenue"))
    soft = lambda q: 1 - ratio(c(q + "current_assets") + c(q + "ppe"), c(q + "total_assets"))
    worn = lambda q: ratio(c(q + "depreciation"), c(q + "depreciation") + c(q + "ppe"))
    debt = lambda q: ratio(c(q + "current_liabilities") + c(q + "long_term_debt"), c(q + "total_assets"))
    index = {
        "dsri": ratio(of("receivables", "revenue"), of("receivables", "revenue", p)),
        "gmi": ratio(gross(p), gross("")),
        "aqi": ratio(soft(""), soft(p)),
        "sgi": ratio(c("revenue"), c(p + "revenue")),
        "depi": ratio(worn(p), worn("")),
        "sgai": ratio(of("sga", "revenue"), of("sga", "revenue", p)),
        "lvgi": ratio(debt(""), debt(p)),
        "tata": ratio(c("net_income") - c("operating_cash_flow"), c("total_assets")),
    }
    weights = {"dsri": 0.92, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "lvgi": -0.327, "tata": 4.679}
    score = sum((w * index[k] for k, w in weights.items()), F.lit(-4.84))
    return index | {"m_score": score, "manipulator": F.coalesce(score > -1.78, F.lit(False))}


# Valuation --------------------------------------------------------------------------------------


def wacc(equity: Column, debt: Column, cost_of_equity: Column, cost_of_debt: Column, tax_rate: Column) -> Column:
    total = equity + debt
    return ratio(equity * cost_of_equity + debt * cost_of_debt * (1 - tax_rate), total)


def gordon_growth(d1: Column, rate: float, g: float) -> Column:
    if rate <= g:
        raise ValueError("the discount rate must exceed the growth rate")
    return d1 / (rate - g)


def multi_stage_ddm(dividends: Sequence[Column], terminal_growth: float, rate: float) -> Column:
    value = sum((d / (1 + rate) ** (i + 1) for i, d in enumerate(dividends)), F.lit(0.0))
    return value + gordon_growth(dividends[-1] * (1 + terminal_growth), rate, terminal_growth) / (1 + rate) ** len(dividends)


def two_stage_dcf(fcf: Column, growth_rate: float, years: int, terminal_growth: float, rate: float) -> Column:
    """Enterprise value of cash flows that grow fast for some years, then slowly for ever."""
    flows = [fcf * (1 + growth_rate) ** (i + 1) for i in range(years)]
    return multi_stage_ddm(flows, terminal_growth, rate)


def residual_income(book: Column, roe: float, cost: float, growth_rate: float, years: int, terminal_growth: float) -> Column:
    if cost <= terminal_growth:
        raise ValueError("the cost of equity must exceed the terminal growth")
    factor = sum((roe - cost) * (1 + growth_rate) ** i / (1 + cost) ** (i + 1) for i in range(years))
    tail = (roe - cost) * (1 + growth_rate) ** years / (cost - terminal_growth) / (1 + cost) ** years
    return book * (1 + factor + tail)


def sustainable_growth(roe: Column, payout: Column) -> Column:
    return roe * (1 - payout)


# Screening ---------------------------------------------------------------------------------------


def zscore(df: DataFrame, columns: Sequence[str], winsorize: tuple[float, float] | None = None) -> DataFrame:
    """Adds z_<column>: a column over the whole frame, standardised; limits first if ``winsorize``."""
    stats = []
    if winsorize:
        bounds = df.agg(*(F.percentile(x, F.lit(q)).alias(f"_{x}_{k}") for x in columns for k, q in zip("lh", winsorize, strict=True)))
        df = df.join(F.broadcast(bounds))  # one row
        df = df.withColumns({x: F.when(c(x).isNotNull(), F.least(F.greatest(c(x), c(f"_{x}_l")), c(f"_{x}_h"))) for x in columns}).drop(*(f"_{x}_{k}" for x in columns for k in "lh"))
    for x in columns:
        stats += [F.avg(x).alias(f"_{x}_m"), F.stddev_samp(x).alias(f"_{x}_s")]
    df = df.join(F.broadcast(df.agg(*stats)))  # one row
    return df.withColumns({f"z_{x}": ratio(c(x) - c(f"_{x}_m"), c(f"_{x}_s")) for x in columns}).drop(*(f"_{x}_{k}" for x in columns for k in "ms"))


def percentile_rank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds pr_<column>: the average rank of a value over the number of values.

    Ranks come from counts of equal values, so that ordering them is the only thing done in one place.
    """
    for x in columns:
        counts = df.filter(c(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
        ranks = counts.select(c(x).alias("_v"), (F.sum("_n").over(w) - (c("_n") - 1) / 2).alias("_r"))
        total = counts.agg(F.sum("_n").alias("_all"))
        ranks = ranks.join(F.broadcast(total)).select("_v", (c("_r") / c("_all")).alias(f"pr_{x}"))
        df = df.join(ranks, c(x) == c("_v"), "left").drop("_v")
    return df


def composite_score(df: DataFrame, weights: dict[str, float], lower_is_better: Sequence[str] = (), winsorize: tuple[float, float] | None = None) -> DataFrame:
    """Adds score: the weighted z-scores, a missing one counting 0."""
    df = zscore(df, list(weights), winsorize)
    total = sum((w * (-1 if x in lower_is_better else 1) * F.coalesce(f"z_{x}", F.lit(0.0)) for x, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", total)


def rank_universe(df: DataFrame, weights: dict[str, float], tie: str, lower_is_better: Sequence[str] = (), winsorize: tuple[float, float] | None = None) -> DataFrame:
    """Rows with score and rank, best first."""
    rows = composite_score(df, weights, lower_is_better, winsorize)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc_nulls_last(), tie)))
