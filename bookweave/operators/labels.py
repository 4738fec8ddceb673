"""Sliding-window labels without range joins.

Windows are ``[start + k*stride, +width)``. Events are summed once per cell (the common divisor of width and
stride); windows then add up their cells, a short integer range, so every label is a hash aggregate that
pre-aggregates on the map side. Successive returns come from one ordered pass over the stream: a return counts
in a window when both of its ends lie in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookweave.functions.scalars import floor_div, int_div
from bookweave.operators.ordered import last_of, row_numbers, running
from bookweave.schemas import DAY_NS


@dataclass(frozen=True)
class Windows:
    """Window grid over one stream; ``last`` is the highest window number (-1: no window fits)."""

    start: int
    last: int
    width: int
    stride: int

    @classmethod
    def over(cls, events: DataFrame, width: int, stride: int) -> Windows:
        low, high = events.agg(F.min("ts_exchange_ns"), F.max("ts_exchange_ns")).first()
        if low is None or high - low < width:
            return cls(low or 0, -1, width, stride)
        return cls(low, (high - low - width) // stride, width, stride)

    def numbers(self, first_ts: Column, last_ts: Column, shift: int = 0) -> Column:
        """Numbers of the windows (moved ``shift`` widths later) that hold both times."""
        moved = self.start + shift * self.width
        lo = F.greatest(
            F.lit(0).cast("bigint"), floor_div(last_ts - F.lit(moved + self.width), self.stride) + 1
        )
        hi = F.least(F.lit(self.last).cast("bigint"), floor_div(first_ts - F.lit(moved), self.stride))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    def cell(self, ts: Column) -> Column:
        """Number of the cell that holds a time; windows are runs of whole cells."""
        return floor_div(ts - F.lit(self.start), math.gcd(self.width, self.stride))

    def span(self, first: Column, last: Column) -> tuple[Column, Column]:
        """First and last moment of a run of cells."""
        size = math.gcd(self.width, self.stride)
        return first * size + self.start, (last + 1) * size + (self.start - 1)


MARKET_ORDER = ["ts_exchange_ns", "seq", "event_id"]


def stream_returns(events: DataFrame) -> DataFrame:
    """Every event with the previous positive price and its time, and the return between them."""
    price = F.when(F.col("price_fp") > 0, F.struct(F.col("price_fp").alias("p"), F.col("ts_exchange_ns").alias("t")))
    slim = events.select(*MARKET_ORDER, "event_type", "price_fp")
    rows = running(slim, [], MARKET_ORDER, prev=last_of(price))
    ret = F.when(
        F.col("price_fp") > 0,
        (F.col("price_fp") - F.col("prev.p")).cast("double") / F.col("prev.p").cast("double"),
    )
    return rows.withColumn("ret", ret).drop("_chunk")


def cell_statistics(events: DataFrame, grid: Windows) -> tuple[DataFrame, DataFrame]:
    """Sums per cell, and the returns from one cell to a later one.

    A cell is the greatest common divisor of width and stride wide, so every window is a run of whole cells. Events
    are summed once per cell; a return with both ends in a cell is summed there, and of the others a cell has one at
    most, at its first price."""
    returns = stream_returns(events).withColumns({"cell": grid.cell(F.col("ts_exchange_ns")), "from_cell": grid.cell(F.col("prev.t"))})
    quoted = F.when(F.col("price_fp") > 0, F.col("price_fp").cast("double"))
    inner = F.when(F.col("from_cell") == F.col("cell"), F.col("ret"))
    cells = returns.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(quoted).alias("prices"),
        F.count(quoted).alias("n_prices"),
        F.bool_or(F.col("event_type") == 3).alias("fill"),
        F.bool_or(F.col("event_type") == 2).alias("cancel"),
        *_sums(inner),
    )
    crossing = returns.filter((F.col("from_cell") < F.col("cell")) & F.col("ret").isNotNull())
    return cells, crossing.select("from_cell", "cell", *[c.alias(n) for n, c in zip(RETURNS, [F.lit(1), F.col("ret"), F.col("ret") * F.col("ret"), F.col("ret"), F.col("ret")])])


RETURNS = ["n_returns", "ret_sum", "ret_squares", "ret_min", "ret_max"]


def _sums(ret: Column) -> list[Column]:
    parts = [F.count(ret), F.sum(ret), F.sum(ret * ret), F.min(ret), F.max(ret)]
    return [c.alias(n) for n, c in zip(RETURNS, parts)]


def window_statistics(events: DataFrame, grid: Windows) -> DataFrame:
    """All per-window sums: own events, next window's prices, inner returns. Windows add up cells, so an event costs
    one row, not one for each window that holds it."""
    cells, crossing = cell_statistics(events, grid)
    first, last = grid.span(F.col("cell"), F.col("cell"))
    tag = lambda numbers, name: F.transform(numbers, lambda k: F.struct(k.alias("window_index"), F.lit(name).alias("role")))
    rows = cells.select("*", F.inline(F.concat(tag(grid.numbers(first, last), "own"), tag(grid.numbers(first, last, 1), "next"))))
    begin, end = grid.span(F.col("from_cell"), F.col("cell"))
    across = crossing.select(*RETURNS, F.explode(grid.numbers(begin, end)).alias("window_index")).withColumn("role", F.lit("own"))
    both = rows.drop("cell").unionByName(across, allowMissingColumns=True)
    own, nxt = (F.col("role") == r for r in ("own", "next"))
    of = lambda role, c: F.when(role, F.col(c))
    n, total, squares = (F.coalesce(F.sum(of(own, c)), F.lit(0)) for c in RETURNS[:3])
    stats = both.groupBy("window_index").agg(
        F.coalesce(F.sum(of(own, "n_events")), F.lit(0)).alias("n_events"),
        F.try_divide(F.sum(of(own, "prices")), F.sum(of(own, "n_prices"))).alias("mid"),
        F.coalesce(F.sum(of(own, "n_prices")), F.lit(0)).alias("n_prices"),
        F.coalesce(F.bool_or(of(own, "fill")), F.lit(False)).alias("fill_occurred"),
        F.coalesce(F.bool_or(of(own, "cancel")), F.lit(False)).alias("cancel_occurred"),
        F.coalesce(F.sum(of(nxt, "n_events")), F.lit(0)).alias("n_next"),
        F.try_divide(F.sum(of(nxt, "prices")), F.sum(of(nxt, "n_prices"))).alias("next_mid"),
        n.alias("n_returns"),
        F.try_divide(total, n).alias("ret_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(squares, n) - F.try_divide(total, n) * F.try_divide(total, n))).alias("ret_std"),
        F.min(of(own, "ret_min")).alias("ret_min"),
        F.max(of(own, "ret_max")).alias("ret_max"),
    )
    zero = F.lit(0.0)
    stats = stats.withColumn("ret_std", F.when(F.col("n_returns") > 0, F.col("ret_std")))
    return stats.filter("n_events > 0").withColumns(
        {"mid": F.coalesce("mid", zero), "next_mid": F.coalesce("next_mid", zero)}
    )


def trade_slippage(events: DataFrame, stats: DataFrame, grid: Windows) -> DataFrame:
    """Mean distance of trades from the window mid in bp. Trades are first counted per (cell, price), then per
    (window, price), so a busy window joins its mid with few rows."""
    trades = events.filter("event_type = 3").groupBy(grid.cell(F.col("ts_exchange_ns")).alias("cell"), "price_fp").agg(F.count(F.lit(1)).alias("n"))
    first, last = grid.span(F.col("cell"), F.col("cell"))
    traded = (
        trades.select("price_fp", "n", F.explode(grid.numbers(first, last)).alias("window_index"))
        .groupBy("window_index", "price_fp")
        .agg(F.sum("n").alias("n"))
    )
    distance = F.abs(F.col("price_fp") - F.col("mid"))
    joined = stats.join(traded, "window_index", "left")
    rest = [c for c in stats.columns if c != "window_index"]
    total = F.sum(distance * F.col("n"))
    count = F.sum("n")
    return joined.groupBy("window_index").agg(
        *[F.first(c).alias(c) for c in rest],
        F.coalesce(
            F.when((F.first("mid") > 0) & (count > 0), total / count / F.first("mid") * 10_000), F.lit(0.0)
        ).alias("slippage_bp"),
    )


def mid_move_bp() -> Column:
    nxt = F.when(F.col("n_next") > 0, F.col("next_mid")).otherwise(F.col("mid"))
    return F.when(F.col("mid") > 0, (nxt - F.col("mid")) / F.col("mid") * 10_000).otherwise(F.lit(0.0))


def vol_jump() -> Column:
    far = F.greatest(F.col("ret_max") - F.col("ret_mean"), F.col("ret_mean") - F.col("ret_min"))
    enough = (F.col("n_prices") >= 3) & (F.col("n_returns") >= 2) & (F.col("ret_std") != 0)
    return F.coalesce(enough & (far > 2 * F.col("ret_std")), F.lit(False))


def regime_label() -> Column:
    """0 below 0.0005, 1 below 0.002, else 2; 1 when there are fewer than two prices."""
    vol = F.col("ret_std")
    return F.when((F.col("n_prices") < 2) | vol.isNull(), 1).when(vol < 0.0005, 0).when(vol < 0.002, 1).otherwise(2)


def label_rows(events: DataFrame, width: int, stride: int, grid: Windows | None = None) -> DataFrame:
    """Six labels per non-empty window, of the grid over the events unless another is given."""
    grid = grid or Windows.over(events, width, stride)
    stats = trade_slippage(events, window_statistics(events, grid), grid)
    return stats.select(
        "window_index",
        mid_move_bp().alias("mid_price_move_bp"),
        "fill_occurred",
        "cancel_occurred",
        "slippage_bp",
        vol_jump().alias("vol_jump"),
        regime_label().alias("regime_label"),
    )


def window_members(events: DataFrame, width: int, stride: int) -> DataFrame:
    """Events of every overlapping window."""
    grid = Windows.over(events, width, stride)
    ts = F.col("ts_exchange_ns")
    return events.select("*", F.explode(grid.numbers(ts, ts)).alias("window_index"))


def next_window_counts(events: DataFrame, width: int, stride: int) -> DataFrame:
    """Per non-empty window: its events and those of the window right after it."""
    grid = Windows.over(events, width, stride)
    ts = F.col("ts_exchange_ns")
    both = F.concat(
        F.transform(grid.numbers(ts, ts), lambda k: F.struct(k.alias("k"), F.lit(1).alias("own"))),
        F.transform(grid.numbers(ts, ts, 1), lambda k: F.struct(k.alias("k"), F.lit(0).alias("own"))),
    )
    rows = events.select(F.explode(both).alias("m"))
    return (
        rows.groupBy(F.col("m.k").alias("window_index"))
        .agg(F.sum("m.own").alias("n_events"), F.sum(1 - F.col("m.own")).alias("n_next"))
        .filter("n_events > 0")
    )


def split_train_val(windows: DataFrame, val_share: float, order: str = "window_index") -> DataFrame:
    """The first floor(n*(1-share)) windows train, the rest validate."""
    n = windows.select(F.count(F.lit(1))).scalar()
    ranked = row_numbers(windows, [], [order])
    cut = F.floor(n * F.lit(1 - val_share))
    return ranked.withColumn("split", F.when(F.col("rn") <= cut, "train").otherwise("val")).drop("rn", "_chunk")


def mini_batches(windows: DataFrame, size: int, order: str = "window_index") -> DataFrame:
    ranked = row_numbers(windows, [], [order])
    return ranked.withColumn("batch_id", int_div(F.col("rn") - 1, size)).drop("rn", "_chunk")


def walk_forward(rows: DataFrame, ts: str, train_days: int = 5, val_days: int = 1) -> DataFrame:
    """Folds that move on by the validation length: each row with its (fold, role) pairs."""
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    first_day = low // DAY_NS
    days = high // DAY_NS - first_day + 1
    last_fold = (days - train_days - val_days) // val_days
    day = int_div(F.col(ts), DAY_NS) - F.lit(first_day)

    def folds(offset: int, length: int, role: str) -> Column:
        # day in [fold*val + offset, + length)
        lo = F.greatest(F.lit(0).cast("bigint"), floor_div(day - (offset + length), val_days) + 1)
        hi = F.least(F.lit(last_fold).cast("bigint"), floor_div(day - offset, val_days))
        numbers = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda f: F.struct(f.alias("fold"), F.lit(role).alias("role")))

    member = F.concat(folds(0, train_days, "train"), folds(train_days, val_days, "val"))
    return rows.select("*", F.inline(member))
