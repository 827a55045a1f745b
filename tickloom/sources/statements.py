"""Financial statements from labelled lines, and index membership from CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col

# Labels of each statement's lines and the field they stand for; of two labels of one field the first that a statement has counts.
INCOME = {
    "Total Revenue": "revenue", "Operating Revenue": "revenue", "Cost Of Revenue": "cogs", "Gross Profit": "gross_profit", "Operating Income": "operating_income", "EBIT": "ebit", "EBITDA": "ebitda",
    "Normalized EBITDA": "ebitda", "Interest Expense": "interest_expense", "Pretax Income": "pretax_income", "Tax Provision": "tax_expense", "Net Income": "net_income",
    "Net Income Common Stockholders": "net_income", "Selling General And Administration": "sga_expense", "Diluted Average Shares": "shares_outstanding",
}
BALANCE = {
    "Total Assets": "total_assets", "Current Assets": "current_assets", "Cash And Cash Equivalents": "cash", "Cash Cash Equivalents And Short Term Investments": "cash", "Inventory": "inventory",
    "Accounts Receivable": "receivables", "Receivables": "receivables", "Total Liabilities Net Minority Interest": "total_liabilities", "Current Liabilities": "current_liabilities", "Total Debt": "total_debt",
    "Long Term Debt": "long_term_debt", "Net PPE": "ppe_net", "Stockholders Equity": "total_equity", "Common Stock Equity": "total_equity", "Retained Earnings": "retained_earnings",
}
CASH_FLOW = {
    "Operating Cash Flow": "operating_cash_flow", "Cash Flow From Continuing Operating Activities": "operating_cash_flow", "Capital Expenditure": "capex", "Free Cash Flow": "free_cash_flow",
    "Depreciation And Amortization": "depreciation", "Depreciation Amortization Depletion": "depreciation", "Cash Dividends Paid": "dividends_paid", "Common Stock Dividend Paid": "dividends_paid",
}
STATEMENTS = {"income": INCOME, "balance": BALANCE, "cash_flow": CASH_FLOW}
#: End of a membership that still holds.
OPEN_END = "2200-01-01"


def fields() -> list[str]:
    """All fields, in the order of the labels."""
    return list(dict.fromkeys(f for labels in STATEMENTS.values() for f in labels.values()))


def financial_statements(lines: DataFrame, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """(keys, period, all fields) from lines (keys, statement, line, label, period, value): statement is income, balance or cash_flow, line
    the label's place in it.

    A field takes the first of its labels that the statement has for any period, also where that one's value is missing; of repeated labels
    the first line. Values that are no numbers are null, unknown labels are passed over. Only periods that all statements of the key share are
    kept; a statement without any line doesn't count. One exchange on the key serves both windows and the sums by period.
    """
    known = [(f"{name}\t{label}", field, i) for name, labels in STATEMENTS.items() for i, (label, field) in enumerate(labels.items())]
    field_of = F.create_map(*(F.lit(x) for full, field, _ in known for x in (full, field)))
    place_of = F.create_map(*(F.lit(x) for full, _, i in known for x in (full, i)))
    full = F.concat_ws("\t", "statement", "label")
    rows = lines.select(*keys, "statement", "line", "period", F.try_element_at(field_of, full).alias("_field"), F.try_element_at(place_of, full).alias("_place"), c("value").try_cast("double").alias("_value"))
    rows = rows.filter(c("statement").isin(list(STATEMENTS)))
    rows = rows.withColumn("_first", F.min("_place").over(Window.partitionBy(*keys, "statement", "_field")) == c("_place"))
    has = {f"_has_{name}": F.bool_or(c("statement") == name) for name in STATEMENTS}
    values = (F.min_by("_value", F.when((c("_field") == f) & c("_first"), c("line"))).alias(f) for f in fields())
    out = rows.groupBy(*keys, "period").agg(*(v.alias(n) for n, v in has.items()), *values)
    shared = F.lit(True)
    for name in has:
        shared = shared & (c(name) == F.bool_or(name).over(Window.partitionBy(*keys)))
    return out.withColumn("_shared", shared).filter("_shared").drop("_shared", *has)


def _utc(text: Column, strict: bool) -> Column:
    """An ISO time as UTC without zone; one that names no zone is UTC."""
    zoned = F.convert_timezone(None, F.lit("UTC"), (text.cast("timestamp") if strict else text.try_cast("timestamp")).cast("timestamp_ntz"))
    plain = text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")
    return F.when(text.rlike(r"\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$"), zoned).otherwise(plain)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, index, start, end) from CSV files with these headers, others passed over. An empty end, or one that is no time, is open;
    a start that is no time fails."""
    raw = spark.read.csv(path, header=True)
    missing = {"symbol", "index", "start", "end"} - set(raw.columns)
    if missing:
        raise ValueError(f"membership lacks {', '.join(sorted(missing))}")
    end = F.coalesce(_utc(c("end"), False), F.lit(OPEN_END).cast("timestamp_ntz"))
    return raw.select("symbol", "index", _utc(c("start"), True).alias("start"), end.alias("end"))
