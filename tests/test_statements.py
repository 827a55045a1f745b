"""Statements from labelled lines, membership files."""

import datetime as dt

import pytest

from tickloom.sources.statements import fields, financial_statements, read_membership

SCHEMA = "ticker string, statement string, line int, label string, period date, value string"
A, B = dt.date(2023, 12, 31), dt.date(2024, 12, 31)


def test_labels_periods_and_values(spark):
    rows = [
        ("X", "income", 0, "Total Revenue", A, "100"), ("X", "income", 0, "Total Revenue", B, None), ("X", "income", 1, "Operating Revenue", B, "7"), ("X", "income", 2, "Net Income", B, "n/a"),
        ("X", "income", 3, "EBITDA", A, "5"), ("X", "income", 4, "EBITDA", A, "6"), ("X", "income", 9, "Odd Item", A, "1"), ("X", "balance", 0, "Receivables", A, "3"), ("X", "balance", 0, "Receivables", B, "4"),
        ("X", "balance", 1, "Total Revenue", B, "999"), ("Y", "income", 0, "Operating Revenue", A, "8"), ("Y", "income", 0, "Operating Revenue", B, "9"), ("Y", "cash_flow", 0, "Capital Expenditure", B, "-2"),
    ]
    out = {(r.ticker, r.period): r for r in financial_statements(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {("X", A), ("X", B), ("Y", B)}
    x, y = out["X", A], out["X", B]
    # the first label counts even where its value is missing; the first of repeated lines; a label only in its own statement
    assert (x.revenue, y.revenue, x.ebitda, x.receivables, y.net_income) == (100, None, 5, 3, None)
    assert (out["Y", B].revenue, out["Y", B].capex) == (9, -2)
    assert financial_statements(spark.createDataFrame([], SCHEMA)).columns == ["ticker", "period", *fields()]


def test_membership_file(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("note,symbol,index,start,end\nx,A,I,2020-01-02,\ny,B,I,2020-01-02T03:00:00+02:00,2021-05-06T00:00:00Z\nz,C,J,2020-01-02 03:04:05,soon\n")
    out = {r.symbol: (r["index"], r.start, r.end) for r in read_membership(spark, str(path)).collect()}
    end = dt.datetime(2200, 1, 1)
    assert out == {"A": ("I", dt.datetime(2020, 1, 2), end), "B": ("I", dt.datetime(2020, 1, 2, 1), dt.datetime(2021, 5, 6)), "C": ("J", dt.datetime(2020, 1, 2, 3, 4, 5), end)}
    (tmp_path / "bad.csv").write_text("symbol,index,start\nA,I,2020-01-02\n")
    with pytest.raises(ValueError, match="end"):
        read_membership(spark, str(tmp_path / "bad.csv"))
