"""Prices, costs, margin and sizes as exact column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_ticks(price: Column, tick_size: Column) -> Column:
    """A price as whole ticks; null where it is not on the grid."""
    return F.when(F.pmod(price, tick_size) == 0, F.floor(F.try_divide(price, tick_size)).cast("bigint"))


def to_price(ticks: Column, tick_size: Column) -> Column:
    return ticks * tick_size


def normalize_volume(lots: Column, low: Column, high: Column, step: Column) -> Column:
    """Lots clamped to the most and floored onto low + k * step; null below the least."""
    return F.when(lots >= low, low + F.floor((F.least(lots, high) - low) / step) * step)


def spread_ticks(points: Column, points_per_tick: int, fixed: int | None = None, least: int = 0, most: int | None = None, fallback: int | None = None) -> Column:
    """Fixed, or the bar's own: zero becomes the fallback, then at least and at most; points round up to ticks."""
    if fixed is not None:
        if fixed % points_per_tick:
            raise ValueError("a fixed spread must be whole ticks")
        return F.lit(fixed // points_per_tick).cast("bigint")
    p = F.when(points == 0, F.lit(fallback)).otherwise(points) if fallback is not None else points
    p = F.greatest(p, F.lit(least))
    p = F.least(p, F.lit(most)) if most is not None else p
    return F.floor((p + points_per_tick - 1) / points_per_tick).cast("bigint")


def ask(bar_ticks: Column, spread: Column) -> Column:
    """Bars are bids; the ask is the bid and the spread."""
    return bar_ticks + spread


def tick_value(favorable: Column, value: Column, on_profit: Column | None = None, on_loss: Column | None = None) -> Column:
    up = F.coalesce(on_profit, value) if on_profit is not None else value
    down = F.coalesce(on_loss, value) if on_loss is not None else value
    return F.when(favorable, up).otherwise(down)


def price_pnl(side: Column, entry: Column, exit_: Column, lots: Column, value: Column, on_profit: Column | None = None, on_loss: Column | None = None) -> Column:
    """Signed money of the move, with separate tick values for gain and loss."""
    move = F.when(side == "LONG", exit_ - entry).otherwise(entry - exit_)
    return move * tick_value(move > 0, value, on_profit, on_loss) * lots


def half_spread_cost(spread: Column, lots: Column, loss_value: Column) -> Column:
    return spread / 2 * loss_value * lots


def slippage_cost(ticks: Column, lots: Column, loss_value: Column) -> Column:
    return F.abs(ticks) * loss_value * lots


def commission(mode: Column, amount: Column, lots: Column, price: Column, contract: Column) -> Column:
    """Per side: none, fixed per order, per lot and side, per lot round turn, or basis points of the notional."""
    return (
        F.when(mode == "NONE", F.lit(0.0))
        .when(mode == "PER_ORDER", amount)
        .when(mode == "PER_LOT_SIDE", amount * lots)
        .when(mode == "PER_LOT_ROUND_TURN", amount * lots / 2)
        .when(mode == "NOTIONAL_BPS", price * contract * lots * amount / 10_000)
    )


def margin(mode: Column, price: Column, contract: Column, lots: Column, leverage: Column, initial: Column) -> Column:
    """Fixed per lot where the profile has it; else by mode. Null where futures lack it or the mode is unknown."""
    return (
        F.when(initial > 0, initial * lots)
        .when(mode.isin("CFD", "CFD_INDEX"), price * contract * lots / leverage)
        .when(mode == "FOREX", contract * lots / leverage)
    )


def size(mode: Column, equity: Column, entry: Column, stop: Column, amount: Column, requested: Column, loss_value: Column, low: Column, high: Column, step: Column) -> Column:
    """Lots by fixed size, percent of equity, fixed cash or as requested; null where it is rejected."""
    distance = F.abs(entry - stop)
    risk = F.when(mode == "RISK_PERCENT", equity * amount / 100).when(mode == "FIXED_CASH", amount)
    lots = F.when(mode == "FIXED_LOT", amount).when(mode == "STRATEGY_DEFINED", requested).when(distance > 0, F.try_divide(risk, distance * loss_value))
    return normalize_volume(lots, low, high, step)
