"""Execution cases with hand-computed values."""

from decimal import Decimal as D

import pytest

from barlume.operators.book import Ambiguous, Book, Profile, Refused, Rules

GOLD = Profile("XAUUSD")
S = 1_000_000_000


def book(**rules):
    return Book(Rules(**({"spread_points": 7, "commission": ("PER_LOT_SIDE", D("3.5"))} | rules)), {"XAUUSD": GOLD})


def bar(b, n, o, h, low, c, points=0):
    b.bar("XAUUSD", n * 60 * S, (n + 1) * 60 * S, o, h, low, c, points, n)


def rows(b, kind):
    return [r[3] for r in b.rows if r[0] == kind]


def buy(b, n=1, kind="MARKET", lots=1, buy=True, **more):
    return b.submit(f"c{b.next_id['order']}", "XAUUSD", buy, kind, D(lots), n * 60 * S, **more)


def test_market_buy_pays_ask_and_commission():
    b = book()
    buy(b)
    bar(b, 1, 260000, 260020, 259990, 260010)
    f = rows(b, "fill")[0]
    assert f["price"] == 260007 and f["commission"] == D("3.5")
    assert b.balance == D("99996.5") and b.equity == D("99999.5") and b.margin == D("2600.10")


def test_buy_limit_takes_the_gap():
    b = book()
    buy(b, kind="LIMIT", price=260000)
    bar(b, 1, 259990, 260000, 259980, 259995)
    assert rows(b, "fill")[0]["price"] == 259997


def test_stop_slips_and_limit_never_beyond_its_price():
    b = book(slip_stop=3, slip_limit=5, spread_points=0)
    buy(b, kind="STOP", price=260010)
    buy(b, kind="LIMIT", price=259990)
    bar(b, 1, 260000, 260020, 259980, 260000)
    assert [f["price"] for f in rows(b, "fill")] == [260013, 259990]


@pytest.mark.parametrize(("policy", "reason", "price"), [("CONSERVATIVE", "stop_loss", 259950), ("STOP_FIRST", "stop_loss", 259950), ("OPTIMISTIC", "take_profit", 260100), ("TARGET_FIRST", "take_profit", 260100), ("NEAREST_OPEN", "stop_loss", 259950)])
def test_both_ends_in_one_bar(policy, reason, price):
    b = book(intrabar=policy, spread_points=0)
    buy(b, stop=259950, target=260100)
    bar(b, 1, 260000, 260010, 259990, 260000)
    bar(b, 2, 260000, 260110, 259940, 260000)
    t = rows(b, "trade")[0]
    assert (t["exit_reason"], t["exit_price"], t["ambiguous"]) == (reason, price, True)
    with pytest.raises(Ambiguous):
        b = book(intrabar="REJECT_AMBIGUOUS", spread_points=0)
        buy(b, stop=259950, target=260100)
        bar(b, 1, 260000, 260010, 259990, 260000)
        bar(b, 2, 260000, 260110, 259940, 260000)


def test_gap_through_the_stop_fills_at_the_open():
    b = book(spread_points=0)
    buy(b, stop=259950)
    bar(b, 1, 260000, 260010, 259990, 260000)
    bar(b, 2, 259900, 259910, 259890, 259900)
    assert rows(b, "trade")[0]["exit_price"] == 259900 and not b.positions


def test_trade_identity_and_r():
    b = book()
    buy(b, stop=259907, target=260107)
    bar(b, 1, 260000, 260020, 259990, 260010)
    bar(b, 2, 260010, 260120, 260000, 260110)
    t = rows(b, "trade")[0]
    assert t["net_pnl"] == t["gross_pnl"] - t["commission"] - t["spread_cost"] - t["slippage_cost"] == D(93)
    assert t["initial_risk"] == 100 and t["realized_r"] == D("0.93") and t["mfe"] >= 0
    assert b.balance == D(100_093)
    assert [r[0] for r in b.rows if r[0].startswith("order.can")] == ["order.cancelled"]


def test_one_cancels_other():
    b = book(spread_points=0)
    buy(b, kind="STOP", price=260010, extra={"oco": "g"})
    buy(b, kind="STOP", buy=False, price=259990, extra={"oco": "g"})
    bar(b, 1, 260000, 260020, 259995, 260000)
    assert len(rows(b, "fill")) == 1 and rows(b, "order.cancelled")[0]["reason"] == "oco_sibling_terminal"
    b = book(spread_points=0)
    for side in (True, False):
        buy(b, kind="STOP", buy=side, price=260010 if side else 259990, extra={"oco": "g", "oco_cancel_all": True})
    bar(b, 1, 260000, 260020, 259980, 260000)
    assert not rows(b, "fill") and len(rows(b, "order.cancelled")) == 2


def test_stop_and_reverse_opens_opposite_at_the_stop_price():
    b = book(spread_points=0)
    buy(b, stop=259950, target=260100, extra={"reverse_stop": 260000, "reverse_reward": "2", "chain": "k"})
    bar(b, 1, 260000, 260010, 259990, 260000)
    bar(b, 2, 260000, 260010, 259940, 259960)
    assert rows(b, "trade")[0]["exit_reason"] == "stop_loss"
    (pos,) = b.positions.values()
    assert (pos.long, int(pos.entry), pos.stop, pos.target, pos.mfe) == (False, 259950, 260000, 259850, 0)
    bar(b, 3, 259960, 259970, 259840, 259850)
    assert [t["exit_reason"] for t in rows(b, "trade")] == ["stop_loss", "take_profit"] and not b.positions
    assert rows(b, "trade")[1]["chain"] == "k"


def test_execution_resize_from_risk():
    b = book(spread_points=0, sizing=("RISK_PERCENT", D(1)))
    buy(b, stop=259900, target=260100, extra={"reward_risk": "1.5"})
    bar(b, 1, 260000, 260010, 259990, 260000)
    (pos,) = b.positions.values()
    assert pos.lots == 10 and pos.target == 260150


def test_netting_reversal_and_partial_close():
    b = book(hedging=False, spread_points=0)
    buy(b, lots=2)
    bar(b, 1, 260000, 260010, 259990, 260000)
    buy(b, 2, lots=3, buy=False)
    bar(b, 2, 260010, 260020, 260000, 260010)
    (pos,) = b.positions.values()
    assert not pos.long and pos.lots == 1 and rows(b, "trade")[0]["lots"] == 2
    assert sum(f["commission"] for f in rows(b, "fill")) == D("17.5")
    b = book(spread_points=0)
    buy(b, lots=2, stop=259900)
    bar(b, 1, 260000, 260010, 259990, 260000)
    buy(b, 2, lots="0.5", buy=False, reduce_only=True, position=1)
    bar(b, 2, 260010, 260020, 260000, 260010)
    assert b.positions[1].lots == D("1.5") and b.positions[1].risk == 150 and rows(b, "trade")[0]["exit_reason"] == "strategy_exit"


def test_margin_rejection_and_stop_out():
    b = book(spread_points=0, balance=D(2000))
    buy(b)
    bar(b, 1, 260000, 260010, 259990, 260000)
    assert rows(b, "order.rejected")[0]["reason"] == "insufficient_free_margin"
    b = book(spread_points=0, balance=D(3000), commission=("NONE", D(0)))
    buy(b)
    bar(b, 1, 260000, 260010, 259990, 260000)
    bar(b, 2, 259000, 259000, 258200, 258200)
    assert rows(b, "account.margin_call") and rows(b, "account.stop_out") and rows(b, "trade")[0]["exit_reason"] == "stop_out"
    assert b.balance == 1200
    b = book(spread_points=0, balance=D(3000), commission=("NONE", D(0)))
    buy(b)
    bar(b, 1, 260000, 260010, 259990, 260000)
    bar(b, 2, 250000, 250000, 250000, 250000)
    assert b.balance == 0


def test_submission_reasons():
    b = book(spread_points=0)
    bar(b, 1, 260000, 260010, 259990, 260000)
    reason = lambda **k: b.submit(**({"client": "x", "symbol": "XAUUSD", "buy": True, "kind": "MARKET", "lots": D(1), "created": 120 * S} | k)).reason
    assert reason(created=60 * S) == "stale_order_time"
    assert reason(symbol="EURUSD") == "unknown_symbol"
    assert reason(lots=D("0.015")) == "volume_not_aligned"
    assert reason(kind="LIMIT", price=100, stop=200) == "long_stop_loss_must_be_below_entry"
    assert reason(reduce_only=True, position=9) == "reduce_only_position_not_found"
    assert reason() is None and reason() == "duplicate_client_order_id"


def test_expiry_activation_cancel_modify():
    b = book(spread_points=0)
    o = buy(b, 1, kind="LIMIT", price=259000, expires=180 * S)
    bar(b, 1, 260000, 260010, 259990, 260000)
    b.modify(o.id, 120 * S, price=259100)
    assert o.price == 259100 and o.state == "ACTIVE"
    bar(b, 3, 260000, 260010, 259000, 260000)
    assert o.state == "EXPIRED"
    o = buy(b, 5, kind="LIMIT", price=259000)
    b.cancel(o.id, 300 * S)
    with pytest.raises(Refused):
        b.cancel(o.id, 300 * S)
    late = buy(b, 9)
    bar(b, 5, 260000, 260010, 259990, 260000)
    assert late.state == "ACCEPTED"


def test_require_flat_and_reevaluation_at_the_close():
    b = book(spread_points=0)
    buy(b, stop=259950)
    bar(b, 1, 260000, 260010, 259990, 260000)
    w = buy(b, 2, kind="STOP", price=260005, extra={"require_flat": True, "reevaluate": True})
    bar(b, 2, 260000, 260010, 259940, 260000)
    assert w.state == "FILLED" and w.ended == 180 * S and [p.order for p in b.positions.values()] == [w.id]


def test_historical_spread_is_bounded_and_rounded_up():
    p = Profile("XAUUSD", points_per_tick=2)
    r = Rules(spread_points=None, spread_least=2, spread_most=8, spread_fallback=3)
    assert [r.spread(x, p) for x in (0, 1, 5, 99)] == [2, 1, 3, 4]


def test_end_of_data():
    b = book(spread_points=2)
    buy(b, buy=False)
    bar(b, 1, 260000, 260010, 259990, 260000)
    b.finish(120 * S)
    t = rows(b, "trade")[0]
    assert t["exit_reason"] == "end_of_data" and t["exit_price"] == 260002 and not b.positions and not b.live
