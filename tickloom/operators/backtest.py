"""Backtests: orders at one bar fill on the next; account, trades and evaluation.

A run is one book of orders over many symbols in order of time, so it is the unit of work;
grids and walks are many runs side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import Series, ratio
from .portfolio import metrics

c = F.col


@dataclass(frozen=True)
class Costs:
    """Slippage in basis points and commission for each share and each order."""

    slippage_bps: float = 0.0
    per_share: float = 0.0
    per_order: float = 0.0

    def price(self, price: float, quantity: float) -> float:
        return price * (1 + np.sign(quantity) * self.slippage_bps / 1e4)

    def commission(self, quantity: float) -> float:
        return self.per_order + abs(quantity) * self.per_share


@dataclass
class Order:
    """kind: market, limit, stop or stop_limit; quantity is signed."""

    symbol: str
    quantity: float
    kind: str = "market"
    limit: float | None = None
    stop: float | None = None

    def __post_init__(self) -> None:
        if not self.quantity:
            raise ValueError("an order needs a quantity")
        if self.kind in ("limit", "stop_limit") and self.limit is None or self.kind in ("stop", "stop_limit") and self.stop is None:
            raise ValueError(f"a {self.kind} order needs its price")


def fill_price(order: Order, bar) -> float | None:
    """Price at which an order fills on a bar, None if it doesn't; gaps fill at the open."""
    up = order.quantity > 0
    if order.kind == "market":
        return bar.open
    start = bar.open
    if order.kind in ("stop", "stop_limit"):
        if (bar.high < order.stop) if up else (bar.low > order.stop):
            return None
        start = max(bar.open, order.stop) if up else min(bar.open, order.stop)
        if order.kind == "stop":
            return start
    if up:
        return min(start, order.limit) if bar.low <= order.limit else None
    return max(start, order.limit) if bar.high >= order.limit else None


@dataclass
class Book:
    """Cash and positions at average cost."""

    cash: float
    quantity: dict = field(default_factory=dict)
    cost: dict = field(default_factory=dict)
    mark: dict = field(default_factory=dict)
    realized: float = 0.0

    def apply(self, symbol: str, quantity: float, price: float, commission: float) -> None:
        held, cost = self.quantity.get(symbol, 0.0), self.cost.get(symbol, 0.0)
        self.cash -= quantity * price + commission
        if held * quantity < 0:
            closed = min(abs(held), abs(quantity)) * np.sign(held)
            self.realized += closed * (price - cost)
        after = held + quantity
        if held * after <= 0:
            cost = price
        elif abs(after) > abs(held):
            cost = (held * cost + quantity * price) / after
        self.quantity[symbol], self.cost[symbol] = after, cost

    @property
    def equity(self) -> float:
        return self.cash + sum(q * self.mark.get(s, self.cost[s]) for s, q in self.quantity.items())


def run_book(bars: pd.DataFrame, decide: Callable, cash: float, costs: Costs) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Equity by time and trades. At each time: fill pending orders, mark, then ``decide`` on new ones."""
    book, pending, equity, trades = Book(cash), [], [], []
    for ts, step in bars.sort_values(["ts", "symbol"], kind="stable").groupby("ts", sort=True):
        now = {b.symbol: b for b in step.itertuples(index=False)}
        waiting = []
        for order in pending:
            bar = now.get(order.symbol)
            price = fill_price(order, bar) if bar is not None else None
            if price is None:
                waiting.append(order)
                continue
            price, fee = costs.price(price, order.quantity), costs.commission(order.quantity)
            book.apply(order.symbol, order.quantity, price, fee)
            trades.append((ts, order.symbol, order.quantity, price, fee))
        pending = waiting
        book.mark.update({s: b.close for s, b in now.items()})
        equity.append((ts, book.cash, book.equity, book.realized))
        pending += decide(ts, now, book)
    return pd.DataFrame(equity, columns=["ts", "cash", "equity", "realized"]), pd.DataFrame(trades, columns=["ts", "symbol", "quantity", "price", "commission"])


def weight_orders(weights: Callable[[object], float | None]) -> Callable:
    """Orders that bring a symbol to its target weight; None leaves it alone."""

    def decide(ts, now, book):
        out, equity = [], book.equity
        for symbol, bar in now.items():
            w = weights(bar)
            if w is None or np.isnan(w):
                continue
            change = np.trunc(w * equity / bar.close) - book.quantity.get(symbol, 0.0)
            if change:
                out.append(Order(symbol, float(change)))
        return out

    return decide


def backtest(signals: DataFrame, run_col: str = "run_id", cash: float = 100_000.0, costs: Costs = Costs()) -> DataFrame:
    """(run, ts, cash, equity, realized) of runs whose bars carry a target ``weight`` (null: no order)."""
    kind = signals.schema[run_col].dataType.simpleString()
    time = signals.schema["ts"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        equity, _ = run_book(part, weight_orders(lambda bar: bar.weight), cash, costs)
        equity.insert(0, run_col, part[run_col].iloc[0])
        return equity

    rows = signals.select(run_col, "symbol", "ts", "open", "high", "low", "close", "weight")
    return rows.groupBy(run_col).applyInPandas(run, f"{run_col} {kind}, ts {time}, cash double, equity double, realized double")


def trades(signals: DataFrame, run_col: str = "run_id", cash: float = 100_000.0, costs: Costs = Costs()) -> DataFrame:
    kind, time, symbol = (signals.schema[x].dataType.simpleString() for x in (run_col, "ts", "symbol"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        _, out = run_book(part, weight_orders(lambda bar: bar.weight), cash, costs)
        out.insert(0, run_col, part[run_col].iloc[0])
        return out

    rows = signals.select(run_col, "symbol", "ts", "open", "high", "low", "close", "weight")
    return rows.groupBy(run_col).applyInPandas(run, f"{run_col} {kind}, ts {time}, symbol {symbol}, quantity double, price double, commission double")


def symbol_pnl(made: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Cash flow, commission and net of each symbol."""
    flow = F.sum(-c("quantity") * c("price"))
    return made.groupBy(run_col, "symbol").agg(flow.alias("gross"), F.sum("commission").alias("commission"), (flow - F.sum("commission")).alias("net"))


def equity_returns(equity: DataFrame, run_col: str = "run_id") -> DataFrame:
    s = Series((run_col,), ("ts",))
    return equity.withColumn("ret", ratio(c("equity"), s.lag("equity")) - 1).filter("ret is not null")


def tearsheet(equity: DataFrame, run_col: str = "run_id", periods: int = 252) -> DataFrame:
    """Metrics of each run with hit rate and profit factor."""
    rets = equity_returns(equity, run_col)
    s = Series((run_col,), ("ts",))
    up, down = F.sum(F.when(c("ret") > 0, c("ret")).otherwise(0.0)), F.sum(F.when(c("ret") < 0, -c("ret")).otherwise(0.0))
    more = rets.groupBy(run_col).agg((F.count(F.when(c("ret") > 0, 1)) / F.nullif(F.count(F.when(c("ret") != 0, 1)), F.lit(0))).alias("hit_rate"), F.when(down > 0, up / F.when(down > 0, down)).alias("profit_factor"))
    return metrics(rets, "ret", periods=periods, s=s).join(more, run_col)


def monthly(equity: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Last over first equity of each month, less one."""
    rows = equity.withColumn("month", F.date_trunc("month", "ts")).groupBy(run_col, "month").agg(F.min_by("equity", "ts").alias("a"), F.max_by("equity", "ts").alias("b"))
    return rows.select(run_col, "month", (ratio(c("b"), c("a")) - 1).alias("ret"))


def rolling_sharpe(equity: DataFrame, window: int = 63, periods: int = 252, run_col: str = "run_id") -> DataFrame:
    s = Series((run_col,), ("ts",))
    rets = equity_returns(equity, run_col)
    return rets.withColumn("sharpe", ratio(s.rolling(F.avg("ret"), window), s.rolling(F.stddev_samp("ret"), window)) * periods**0.5)


def grid(parameters: dict[str, Iterable]) -> list[dict]:
    return [dict(zip(parameters, values, strict=True)) for values in product(*parameters.values())]


def grid_search(bars: DataFrame, strategy: Callable[[DataFrame, dict], DataFrame], parameters: dict[str, Iterable], objective: str = "sharpe", costs: Costs = Costs()) -> DataFrame:
    """Tear sheet of each point of the grid, with its rank by the objective; the first wins ties. All runs are one plan."""
    runs = None
    for i, point in enumerate(grid(parameters)):
        one = strategy(bars, point).withColumn("run_id", F.lit(i))
        runs = one if runs is None else runs.unionByName(one)
    out = tearsheet(backtest(runs, costs=costs))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(c(objective).desc_nulls_last(), "run_id")))


def folds(n: int, train: int, test: int, embargo: int = 0, expanding: bool = False) -> list[tuple[range, range]]:
    """Training and test places of a walk forward; a fold needs its whole test."""
    out, start = [], 0
    while start + train + embargo + test <= n:
        out.append((range(0 if expanding else start, start + train), range(start + train + embargo, start + train + embargo + test)))
        start += test
    return out


def walk_forward(spark: SparkSession, bars: DataFrame, strategy: Callable[[DataFrame, dict], DataFrame], parameters: dict[str, Iterable], train: int, test: int, objective: str = "sharpe") -> DataFrame:
    """(fold, run_id, objective) of the best point of each training window on its test window."""
    times = bars.select("ts").distinct().withColumn("_t", F.row_number().over(Window.orderBy("ts")) - 1)
    rows, points = bars.join(times, "ts"), grid(parameters)
    out = None
    for i, (a, b) in enumerate(folds(times.count(), train, test)):
        part = lambda r: rows.filter((c("_t") >= r.start) & (c("_t") < r.stop)).drop("_t")
        best = grid_search(part(a), strategy, parameters, objective).orderBy("rank").first()["run_id"]
        made = strategy(part(b), points[best]).withColumn("run_id", F.lit(best))
        one = tearsheet(backtest(made)).select(F.lit(i).alias("fold"), "run_id", objective)
        out = one if out is None else out.unionByName(one)
    return out
