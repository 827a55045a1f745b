"""Entries by five votes, exits by priority, and defence by dealers' gamma; nothing at a bar uses a later one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.windows import Series
from . import options, phases, trend
from .indicators import BARS, volume_flow
from .temporal import asof_join

c = F.col

#: Fixed names of the reasons to leave, in their priority.
REASONS = ("wyckoff_bearish", "hull_flip", "swing_stop", "chandelier", "gex_defense", "regime_defense")
VOTES = ("w1_wyckoff_event", "w2_effort_result", "h_hull", "m_momentum", "v_volume")


@dataclass(frozen=True)
class Rules:
    """Lengths of the votes and exits; ``least`` votes of five enter."""

    lookback: int = 5
    recovery: int = 5
    ahead: int = 5
    swing: int = 5
    hull_fast: int = 50
    hull_slow: int = 60
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    slope: int = 20
    flow: int = 20
    atr: int = 22
    trail: int = 22
    reach: float = 3.0
    range_bars: int = 20
    least: int = 3

    def __post_init__(self) -> None:
        if self.lookback < 0 or min(self.swing, self.trail, self.atr) < 1 or not 1 <= self.least <= len(VOTES):
            raise ValueError("lengths must be positive and the least number of votes from 1 to 5")

    @property
    def ribbon(self) -> int:
        """Bars before the ribbon counts."""
        return 2 * max(self.hull_fast, self.hull_slow)

    @property
    def warm_up(self) -> int:
        return max(2 * self.hull_slow, self.macd[1] + self.macd[2], self.atr + 1, self.range_bars, self.slope)


def event_masks(bars: DataFrame, ranges: DataFrame, rules: Rules = Rules(), s: Series = BARS) -> DataFrame:
    """(keys, place, bull, bear): bars within ``lookback`` of an event of the ranges, from the bar on that shows it.

    A Spring (UT) shows once a close is back inside its edge, all others on their own bar. Ranges are those of ``phases.range_events``;
    that their edges are known at their start is up to the caller.
    """
    places = bars.withColumn("place", s.number - 1)
    before = F.collect_list("close").over(s.window.rowsBetween(1 - max(rules.lookback, 1), 0))
    places = places.select(*s.keys, "place", before.alias("_closes"))
    found = phases.range_events(bars, ranges, recovery=rules.recovery, s=s).select(*s.keys, "range", "kind", "place")
    found = found.join(ranges.select(*s.keys, "range", "support", "resistance"), [*s.keys, "range"])
    found = found.withColumn("_ago", F.explode(F.sequence(F.lit(0), F.lit(rules.lookback)))).withColumn("place", (c("place") + c("_ago")).cast("int"))
    near = found.join(places, [*s.keys, "place"])
    since = F.when(c("_ago") > 0, F.slice("_closes", -c("_ago"), c("_ago"))).otherwise(F.array().cast("array<double>"))
    shows = F.when(c("kind") == "Spring", F.exists(since, lambda x: x > c("support"))).when(c("kind") == "UT", F.exists(since, lambda x: x < c("resistance"))).otherwise(True)
    up = c("kind").isin("Spring", "SOS", "LPS")
    return near.filter(shows).groupBy(*s.keys, "place").agg(F.bool_or(up).alias("bull"), F.bool_or(~up).alias("bear"))


def votes(bars: DataFrame, ranges: DataFrame, rules: Rules = Rules(), s: Series = BARS) -> DataFrame:
    """Adds the five votes, their count ``confluences``, ``long_entry``, and the four exits that bars show themselves.

    The events of ranges, absorption followed by a rise (known ``ahead`` bars later) or a fall on light volume, for the rest of ``lookback`` bars, price above a rising
    ribbon, momentum (MACD above its signal, or RSI crossing 50), volume (rising OBV, or positive Chaikin flow). Exits: a bearish event, the slow
    Hull average falling twice, a close below the last swing low (known ``swing`` bars later), a close below the highest high less
    ``reach`` ranges. Null votes count as no.
    """
    kept = bars.columns
    rows = phases.shift_divergence(bars.withColumn("place", s.number - 1), rules.ahead, s=s)
    rows = trend.hull_ribbon(phases.harmony(rows, s=s), rules.hull_fast, rules.hull_slow, s=s)
    names = ["_rsi", "_hist", "_atr"]

    def run(high, low, close):
        fast, slow, last = rules.macd
        macd = k.ema(close, fast) - k.ema(close, slow)
        return dict(zip(names, (k.rsi(close, rules.rsi), macd - k.ema_tail(macd, last), k.atr(high, low, close, rules.atr)), strict=True))

    rows = s.kernel(rows, ["high", "low", "close"], dict.fromkeys(names, "double"), run)
    rows = volume_flow(rows, rules.flow, s=s).join(event_masks(bars, ranges, rules, s), [*s.keys, "place"], "left")

    before, after = s.window.rowsBetween(-rules.swing, -1), s.window.rowsBetween(1, rules.swing)
    whole = (F.count("low").over(before) == rules.swing) & (F.count("low").over(after) == rules.swing)
    top = (c("high") > F.max("high").over(before)) & (c("high") > F.max("high").over(after))
    low = whole & ~top & (c("low") < F.min("low").over(before)) & (c("low") < F.min("low").over(after))
    rows = rows.withColumns({"_swing": F.when(low, c("low")), "_n": c("place").cast("double")})
    # n * sum(xy) - sum(x) * sum(y) has the slope's sign, without a rounding where volumes are whole
    roll = lambda x: s.rolling(F.sum(x), rules.slope)
    rows = rows.withColumns(
        {
            "_known": s.lag("_swing", rules.swing),
            "_rise": rules.slope * roll(c("_n") * c("obv")) - roll(c("_n")) * roll(c("obv")),
            "_shown": s.lag(c("shift_kind") == 1, rules.ahead),
            "_trail": s.rolling(F.max("high"), rules.trail) - rules.reach * c("_atr"),
            "_down": c("slow_slope") < 0,
            "_cross": (c("_rsi") >= 50) & (s.lag("_rsi") < 50),
        }
    )
    ready = c("place") >= rules.ribbon - 1
    back = lambda x, n: F.coalesce(F.max(x).over(s.window.rowsBetween(-n, 0)), F.lit(False))
    risen = back(c("_shown"), rules.lookback - rules.ahead) if rules.lookback >= rules.ahead else F.lit(False)
    light = back((c("harmony") == -1) & (c("trend_sign") == -1), rules.lookback)
    made: dict[str, Column] = {
        "w1_wyckoff_event": c("bull"), "w2_effort_result": risen | light, "h_hull": ready & (c("ribbon") == "above") & (c("slow_slope") > 0),
        "m_momentum": F.coalesce(c("_hist") > 0, F.lit(False)) | F.coalesce("_cross", F.lit(False)), "v_volume": F.coalesce(c("_rise") > 0, F.lit(False)) | F.coalesce(c("cmf") > 0, F.lit(False)),
        "wyckoff_bearish": c("bear"), "hull_flip": ready & c("_down") & s.lag("_down"), "swing_stop": c("close") < s.carried(c("_known")), "chandelier": c("close") < c("_trail"),
    }
    rows = rows.withColumns({name: F.coalesce(value, F.lit(False)) for name, value in made.items()})
    count = sum((c(v).cast("int") for v in VOTES[1:]), c(VOTES[0]).cast("int"))
    rows = rows.withColumns({"confluences": count, "long_entry": (count >= rules.least) & (c("place") >= rules.warm_up)})
    return rows.select(*kept, *made, "confluences", "long_entry")


def gex_levels(chain: DataFrame, span: float = 0.2, n: int = 401, sigma: str = "iv") -> DataFrame:
    """(underlying, zero_gamma, put_wall) of each chain; an underlying may be a struct, such as of name and day."""
    return options.zero_gamma(chain, span, n, sigma).join(options.walls(chain, sigma).select("underlying", "put_wall"), "underlying")


def gex_defence(bars: DataFrame, levels: DataFrame, within: str | None = None, buffer: float = 0.01, keys: tuple[str, ...] = ("symbol",), s: Series = BARS) -> DataFrame:
    """Adds zero_gamma, put_wall, expansion (the close is below zero gamma), near_put_wall (falling, within ``buffer`` of the wall), size
    (0.5 in expansion, else 1) from the latest levels (keys, ts) at or before the bar, not older than ``within``; none: no defence."""
    rows = asof_join(bars, levels, ["zero_gamma", "put_wall"], keys, "ts", within=within)
    falling = F.coalesce(c("close") < s.lag("close"), F.lit(True))
    near = falling & (F.abs(c("close") - c("put_wall")) <= buffer * F.greatest(c("close"), F.lit(1e-9)))
    flags = {"expansion": c("close") < c("zero_gamma"), "near_put_wall": near}
    rows = rows.withColumns({name: F.coalesce(value, F.lit(False)) for name, value in flags.items()})
    return rows.withColumn("size", F.when(c("expansion"), 0.5).otherwise(1.0))


def persistent(flag: Column, bars_held: int, s: Series = BARS) -> Column:
    """True where the flag holds on this bar and the ``bars_held`` - 1 before."""
    return F.coalesce(s.rolling(F.min(F.coalesce(flag, F.lit(False)).cast("int")), bars_held) == 1, F.lit(False))


def held(rows: DataFrame, enter: str, leave: str, out: str = "long", s: Series = BARS) -> DataFrame:
    """Adds whether a position is held after the bar: flat, it is opened where ``enter``; held, it is closed where ``leave``.

    A bar with both turns the state over, one with only one of them sets it, so the state is what was set last, turned over as often
    as such bars came since: windows over one sort, no recursion. Null conditions count as false.
    """
    opens, closes = (F.coalesce(c(x), F.lit(False)) for x in (enter, leave))
    rows = rows.withColumn("_turns", s.running(F.sum((opens & closes).cast("int"))))
    last = s.carried(F.when(opens != closes, F.struct(opens.cast("int").alias("on"), c("_turns").alias("turns"))))
    rows = rows.withColumn("_set", last)
    state = F.coalesce(c("_set.on"), F.lit(0)) + c("_turns") - F.coalesce(c("_set.turns"), F.lit(0))
    return rows.withColumn(out, state % 2 == 1).drop("_turns", "_set")


def decisions(rows: DataFrame, s: Series = BARS) -> DataFrame:
    """Adds exit_reason (the first reason of the bar by priority, "none" without) and long from the columns of ``votes``, with near_put_wall
    and cash_defence where they are there. Both defences bar entries, too."""
    bars_only = {name: c(name) for name in REASONS[:4]}
    defences = {name: F.coalesce(c(col), F.lit(False)) if col in rows.columns else F.lit(False) for name, col in (("gex_defense", "near_put_wall"), ("regime_defense", "cash_defence"))}
    masks = bars_only | defences
    rows = rows.withColumn("exit_reason", F.coalesce(*(F.when(masks[name], name) for name in REASONS), F.lit("none")))
    rows = rows.withColumns({"_enter": c("long_entry") & ~defences["gex_defense"] & ~defences["regime_defense"], "_leave": c("exit_reason") != "none"})
    return held(rows, "_enter", "_leave", "long", s).drop("_enter", "_leave")
