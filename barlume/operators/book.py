"""The account of one run: orders, positions, fills and trades, bar by bar.

A run is a strictly sequential fold, so this is plain Python state with a fixed order of steps per bar;
``fold.py`` runs one such book per run inside Spark tasks. Prices are whole ticks, money is Decimal.

Steps per bar: expire, activate, entries (single orders by id, then one-cancels-other groups), protections
by position, a second round at the close if the symbol just became flat, excursions, revaluation, margin
call and stop-out, the floor at zero balance, the account row.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal
from typing import Any

D = Decimal
ZERO, HUNDRED = D(0), D(100)

#: Allowed order states; fixed values of the order life cycle.
NEXT = {
    "CREATED": {"ACCEPTED", "CANCELLED", "REJECTED"},
    "ACCEPTED": {"ACTIVE", "CANCELLED", "EXPIRED", "REJECTED"},
    "ACTIVE": {"PARTIALLY_FILLED", "FILLED", "CANCELLED", "EXPIRED", "REJECTED"},
    "PARTIALLY_FILLED": {"PARTIALLY_FILLED", "FILLED", "CANCELLED", "EXPIRED", "REJECTED"},
    "FILLED": set(),
    "CANCELLED": set(),
    "EXPIRED": set(),
    "REJECTED": set(),
}
LIVE = ("ACCEPTED", "ACTIVE")
#: Ended orders that a snapshot shows.
RECENT = 512
POLICIES = ("CONSERVATIVE", "STOP_FIRST", "OPTIMISTIC", "TARGET_FIRST", "NEAREST_OPEN", "REJECT_AMBIGUOUS")


class Why:
    """Why an order is refused or cancelled; fixed values of the order contract."""

    BELOW_MIN = "calculated volume is below volume_min"
    NO_VOLUME = "strategy-defined sizing requires requested volume"
    NO_STOP = "risk-based sizing requires stop_loss_ticks"
    NO_DISTANCE = "risk-based sizing requires non-zero stop distance"
    NO_RISK = "risk per lot must be positive"
    STOP_LEVEL = "stop loss violates stops_level_points"
    TARGET_LEVEL = "take profit violates stops_level_points"
    STALE = "stale_order_time"
    UNKNOWN = "unknown_symbol"
    DUPLICATE = "duplicate_client_order_id"
    OFF_GRID = "volume_not_aligned"
    OCO_GROUP = "OCO ambiguous policy requires an OCO group"
    CLOSE_NONE = "reduce_only_position_not_found"
    CLOSE_SYMBOL = "reduce_only_symbol_mismatch"
    CLOSE_SIDE = "reduce_only_side_mismatch"
    CLOSE_VOLUME = "reduce_only_volume_exceeds_position"
    MODIFY_EARLY = "modification time precedes order creation"
    MODIFY_MARKET = "market order price cannot be modified"
    MODIFY_EXPIRY = "expiration must be later than modification time"
    MODIFY_NOTHING = "order modification contains no changes"
    REWARD_STOP = "execution risk/reward requires non-zero stop distance"
    REWARD_TARGET = "execution risk/reward target distance is zero"
    LATE_CLOSE_NONE = "reduce-only position does not exist"
    LATE_CLOSE_VOLUME = "reduce-only volume exceeds current position"
    LATE_CLOSE_SIDE = "reduce-only side does not close the position"
    PYRAMID = "pyramiding is disabled"
    MOST_POSITIONS = "max_open_positions exceeded"
    MOST_SYMBOL = "max_symbol_positions exceeded"
    FREE_MARGIN = "insufficient_free_margin"
    MOST_MARGIN = "max_margin_usage_percent exceeded"
    OCO_AMBIGUOUS = "oco_intrabar_ambiguous"
    OCO_SIBLING = "oco_sibling_terminal"
    REPLACED = "protection_replaced_or_position_closed"
    STOP_SIDE = "{} stop loss must be {} entry"
    TARGET_SIDE = "{} take profit must be {} entry"
    SIDE_OFF = "{} trading is disabled"


class Refused(Exception):
    """An order that cannot be carried out; its text is the reason."""


class Ambiguous(Exception):
    """Both ends of a position in one bar under the policy that forbids it."""


@dataclass(frozen=True)
class Profile:
    """One symbol. A point is the price unit of spreads and slippage."""

    symbol: str
    tick_size: Decimal = D("0.01")
    tick_value: Decimal = D(1)
    tick_value_profit: Decimal | None = None
    tick_value_loss: Decimal | None = None
    contract: Decimal = D(100)
    volume_min: Decimal = D("0.01")
    volume_max: Decimal = D(100)
    volume_step: Decimal = D("0.01")
    points_per_tick: int = 1
    stops_level_points: int = 0
    margin_initial: Decimal = ZERO
    calculation: str = "CFD"

    def volume(self, lots: Decimal) -> Decimal:
        """Clamped and floored onto the grid."""
        if lots < self.volume_min:
            raise Refused(Why.BELOW_MIN)
        steps = ((min(lots, self.volume_max) - self.volume_min) / self.volume_step).to_integral_value(ROUND_FLOOR)
        return self.volume_min + steps * self.volume_step

    def money(self, ticks: Decimal, lots: Decimal, gain: bool) -> Decimal:
        own = self.tick_value_profit if gain else self.tick_value_loss
        return abs(ticks) * (self.tick_value if own is None else own) * lots

    def pnl(self, long: bool, entry: Decimal, exit_: Decimal, lots: Decimal) -> Decimal:
        move = exit_ - entry if long else entry - exit_
        if not move:
            return ZERO
        return self.money(move, lots, True) if move > 0 else -self.money(move, lots, False)

    def margin(self, price: Decimal, lots: Decimal, leverage: Decimal) -> Decimal:
        if self.margin_initial > 0:
            return self.margin_initial * lots
        if self.calculation in ("CFD", "CFD_INDEX"):
            return price * self.tick_size * self.contract * lots / leverage
        if self.calculation == "FOREX":
            return self.contract * lots / leverage
        raise ValueError(f"{self.calculation} needs margin_initial")

    def ticks(self, points: int) -> int:
        n, rest = divmod(points, self.points_per_tick)
        if rest:
            raise ValueError("points are not whole ticks")
        return n


@dataclass(frozen=True)
class Rules:
    """How a run is executed."""

    balance: Decimal = D(100_000)
    leverage: Decimal = D(100)
    hedging: bool = True
    commission: tuple[str, Decimal] = ("NONE", ZERO)
    spread_points: int | None = 0  # None: the bar's own
    spread_least: int = 0
    spread_most: int | None = None
    spread_fallback: int | None = None
    slip_market: int = 0
    slip_limit: int = 0
    slip_stop: int = 0
    intrabar: str = "CONSERVATIVE"
    same_bar_exit: bool = True
    allow_long: bool = True
    allow_short: bool = True
    pyramiding: bool = True
    max_positions: int = 1_000_000
    max_symbol_positions: int = 1_000_000
    max_margin_percent: Decimal = HUNDRED
    margin_call_percent: Decimal = HUNDRED
    stop_out_percent: Decimal = D(50)
    negative_balance: bool = False
    sizing: tuple[str, Decimal] = ("STRATEGY_DEFINED", ZERO)

    def size(self, equity: Decimal, entry: int, stop: int | None, p: Profile, wanted: Decimal | None) -> Decimal:
        mode, amount = self.sizing
        if mode == "STRATEGY_DEFINED":
            if wanted is None:
                raise Refused(Why.NO_VOLUME)
            return p.volume(wanted)
        if mode == "FIXED_LOT":
            return p.volume(amount)
        if stop is None:
            raise Refused(Why.NO_STOP)
        if entry == stop:
            raise Refused(Why.NO_DISTANCE)
        cash = equity * amount / HUNDRED if mode == "RISK_PERCENT" else amount
        per_lot = p.money(D(entry - stop), D(1), False)
        if per_lot <= 0:
            raise Refused(Why.NO_RISK)
        return p.volume(cash / per_lot)

    def spread(self, points: int, p: Profile) -> int:
        if self.spread_points is not None:
            return p.ticks(self.spread_points)
        if not points and self.spread_fallback is not None:
            points = self.spread_fallback
        points = max(points, self.spread_least)
        if self.spread_most is not None:
            points = min(points, self.spread_most)
        return -(-points // p.points_per_tick)


@dataclass(slots=True)
class Order:
    """``extra``: oco, oco_cancel_all, reward_risk, reverse_stop, reverse_reward, chain, require_flat, reevaluate, intrabar_target."""

    id: int
    client: str
    symbol: str
    buy: bool
    kind: str  # MARKET, LIMIT, STOP
    lots: Decimal
    created: int
    price: int | None = None
    stop: int | None = None
    target: int | None = None
    expires: int | None = None
    reduce_only: bool = False
    position: int | None = None
    extra: dict = field(default_factory=dict)
    owned: str = ""  # protection or exit: made by the book itself
    state: str = "CREATED"
    revision: int = 0
    filled: Decimal = ZERO
    average: Decimal | None = None
    ended: int | None = None
    reason: str | None = None


@dataclass(slots=True)
class Position:
    id: int
    symbol: str
    long: bool
    lots: Decimal
    entry: Decimal
    opened: int
    order: int
    stop: int | None
    target: int | None
    commission: Decimal
    spread: Decimal
    slippage: Decimal
    margin: Decimal
    risk: Decimal | None
    extra: dict
    mark: int
    mae: Decimal = ZERO
    mfe: Decimal = ZERO
    stop_order: int | None = None
    target_order: int | None = None


@dataclass(frozen=True, slots=True)
class Quote:
    """A bar as bid and ask; the ask is the bid and the spread."""

    open: int
    high: int
    low: int
    close: int
    spread: int

    def side(self, ask: bool) -> tuple[int, int, int, int]:
        s = self.spread if ask else 0
        return self.open + s, self.high + s, self.low + s, self.close + s


#: An execution: price, distance from the undisturbed price, why, whether at the bar's open.
Hit = tuple[int, int, str, bool]


class Book:
    def __init__(self, rules: Rules, profiles: dict[str, Profile], keep_rows: bool = True):
        self.rules, self.profiles, self.keep = rules, profiles, keep_rows
        self.orders: dict[int, Order] = {}
        self.recent: deque[Order] = deque(maxlen=RECENT)
        self.live: dict[int, Order] = {}  # in LIVE states, by id
        self.positions: dict[int, Position] = {}
        self.clients: set[str] = set()
        self.quotes: dict[str, Quote] = {}
        self.seen: dict[str, tuple[int, int]] = {}
        self.now = 0
        self.balance = self.equity = self.peak = rules.balance
        self.floating = self.margin = self.drawdown = ZERO
        self.level: Decimal | None = None
        self.called = False
        self.next_id = {"order": 0, "position": 0, "fill": 0, "trade": 0}
        self.totals = {"bars": 0, "orders": 0, "fills": 0, "trades": 0, "wins": 0, "losses": 0, "net_pnl": ZERO, "commission": ZERO, "max_drawdown": ZERO}
        self.rows: list[tuple[str, int, int, dict[str, Any]]] = []  # kind, time, id, values

    # --- small parts ---------------------------------------------------------------------------------

    def _id(self, what: str) -> int:
        self.next_id[what] += 1
        return self.next_id[what]

    def _row(self, kind: str, time: int, ref: int, **values: Any) -> None:
        if self.keep:
            self.rows.append((kind, time, ref, values))

    def snapshot(self) -> dict[str, Any]:
        """What a strategy may see at once: active orders, the last ``RECENT`` that ended, positions and account."""
        active = sorted(self.orders.values(), key=lambda o: o.id)
        return {
            "orders": [*active, *self.recent],
            "active": len(active),
            "positions": sorted(self.positions.values(), key=lambda p: p.id),
            "balance": self.balance,
            "equity": self.equity,
        }

    def drain(self) -> list[tuple[str, int, int, dict[str, Any]]]:
        out, self.rows = self.rows, []
        return out

    def _to(self, o: Order, state: str, time: int, reason: str | None = None) -> None:
        if state not in NEXT[o.state]:
            raise ValueError(f"an order cannot go from {o.state} to {state}")
        o.state, o.revision = state, o.revision + 1
        if state in LIVE:
            self.live[o.id] = o
        elif state != "PARTIALLY_FILLED":
            o.ended, o.reason = time, reason
            self.live.pop(o.id, None)
            if self.orders.pop(o.id, None):  # of terminal orders the last ones; all live on in the rows
                self.recent.append(o)
        self._row(f"order.{state.lower()}", time, o.id, client=o.client, symbol=o.symbol, side="BUY" if o.buy else "SELL", order_type=o.kind, lots=o.lots, price=o.price, owned=o.owned, reason=reason)

    def _commission(self, lots: Decimal, price: int, p: Profile) -> Decimal:
        mode, amount = self.rules.commission
        if mode == "NONE":
            return ZERO
        if mode == "PER_ORDER":
            return amount
        if mode == "PER_LOT_SIDE":
            return amount * lots
        if mode == "PER_LOT_ROUND_TURN":
            return amount * lots / 2
        return price * p.tick_size * p.contract * lots * amount / 10_000

    def _costs(self, lots: Decimal, price: int, slip: int, spread: int, p: Profile) -> tuple[Decimal, Decimal, Decimal]:
        return self._commission(lots, price, p), p.money(D(spread) / 2, lots, False), p.money(D(slip), lots, False)

    def _check_levels(self, long: bool, entry: int, stop: int | None, target: int | None, p: Profile) -> None:
        name, least = ("long" if long else "short"), p.ticks(p.stops_level_points)
        sign = 1 if long else -1
        if stop is not None and (entry - stop) * sign <= 0:
            raise Refused(Why.STOP_SIDE.format(name, "below" if long else "above"))
        if target is not None and (target - entry) * sign <= 0:
            raise Refused(Why.TARGET_SIDE.format(name, "above" if long else "below"))
        if stop is not None and abs(entry - stop) < least:
            raise Refused(Why.STOP_LEVEL)
        if target is not None and abs(entry - target) < least:
            raise Refused(Why.TARGET_LEVEL)

    # --- commands ------------------------------------------------------------------------------------

    def submit(self, client: str, symbol: str, buy: bool, kind: str, lots: Decimal, created: int, **more: Any) -> Order:
        """A new order, accepted or rejected with its reason."""
        o = Order(self._id("order"), client, symbol, buy, kind, lots, created, **more)
        self.orders[o.id] = o
        self.totals["orders"] += 1
        self._row("order.created", created, o.id, client=client, symbol=symbol, side="BUY" if buy else "SELL", order_type=kind, lots=lots, price=o.price, owned="", reason=None)
        try:
            self._check_submission(o)
        except Refused as e:
            self._to(o, "REJECTED", created, str(e).replace(" ", "_"))
            return o
        self.clients.add(client)
        self._to(o, "ACCEPTED", created)
        return o

    def _check_submission(self, o: Order) -> None:
        p = self.profiles.get(o.symbol)
        if o.created < self.now:
            raise Refused(Why.STALE)
        if p is None:
            raise Refused(Why.UNKNOWN)
        if o.client in self.clients:
            raise Refused(Why.DUPLICATE)
        if p.volume(o.lots) != o.lots:
            raise Refused(Why.OFF_GRID)
        if o.price is not None:
            self._check_levels(o.buy, o.price, o.stop, o.target, p)
        x = o.extra
        if x.get("oco_cancel_all") and not x.get("oco"):
            raise Refused(Why.OCO_GROUP)
        for ratio in ("reward_risk", "reverse_reward"):
            if x.get(ratio) is not None and (D(x[ratio]) <= 0 or o.reduce_only or o.stop is None):
                raise Refused(f"{ratio} needs a positive ratio and a stop loss")
        if x.get("reverse_stop") is not None and ((x["reverse_stop"] - o.stop) * (1 if o.buy else -1)) <= 0:
            raise Refused("reverse stop must lie beyond the initial stop")
        if o.reduce_only:
            pos = self.positions.get(o.position)
            if pos is None:
                raise Refused(Why.CLOSE_NONE)
            if pos.symbol != o.symbol:
                raise Refused(Why.CLOSE_SYMBOL)
            if pos.long == o.buy:
                raise Refused(Why.CLOSE_SIDE)
            if o.lots > pos.lots:
                raise Refused(Why.CLOSE_VOLUME)

    def _own(self, order_id: int) -> Order:
        o = self.live.get(order_id)
        if o is None or o.owned:
            raise Refused(f"order {order_id} cannot be changed")
        return o

    def cancel(self, order_id: int, time: int, reason: str = "requested") -> None:
        self._to(self._own(order_id), "CANCELLED", time, reason)

    def modify(self, order_id: int, time: int, price: int | None = None, stop: int | None = None, target: int | None = None, expires: int | None = None) -> None:
        o = self._own(order_id)
        if time < o.created:
            raise Refused(Why.MODIFY_EARLY)
        if price is not None and o.kind == "MARKET":
            raise Refused(Why.MODIFY_MARKET)
        if expires is not None and expires <= time:
            raise Refused(Why.MODIFY_EXPIRY)
        new = {k: v for k, v in (("price", price), ("stop", stop), ("target", target), ("expires", expires)) if v is not None}
        if not new:
            raise Refused(Why.MODIFY_NOTHING)
        if new.get("price", o.price) is not None:
            self._check_levels(o.buy, new.get("price", o.price), new.get("stop", o.stop), new.get("target", o.target), self.profiles[o.symbol])
        for k, v in new.items():
            setattr(o, k, v)
        o.revision += 1
        self._row("order.modified", time, o.id, **new)

    def protect(self, position_id: int, time: int, stop: int | None, target: int | None) -> None:
        pos = self.positions.get(position_id)
        if pos is None:
            raise Refused("position not found")
        self._check_levels(pos.long, int(pos.entry), stop, target, self.profiles[pos.symbol])
        pos.stop, pos.target = stop, target
        self._guard(pos, time)
        self._row("position.updated", time, pos.id, stop=stop, target=target)

    # --- a bar ---------------------------------------------------------------------------------------

    def bar(self, symbol: str, open_ns: int, close_ns: int, o: int, h: int, low: int, c: int, spread_points: int = 0, sequence: int | None = None) -> None:
        p, before = self.profiles[symbol], self.seen.get(symbol)
        if before is not None and (open_ns < before[0] or (sequence is not None and sequence <= before[1])):
            raise ValueError("bars must come in order")
        q = self.quotes[symbol] = Quote(o, h, low, c, self.rules.spread(spread_points, p))
        self.now = open_ns
        self.totals["bars"] += 1
        if self.live or self.positions:
            self._trade(symbol, q, open_ns, close_ns)
        else:
            self.called = False
        self.seen[symbol] = (close_ns, sequence if sequence is not None else -1)
        self.now = close_ns
        self._row("account", close_ns, self.totals["bars"], balance=self.balance, equity=self.equity, floating=self.floating, margin=self.margin, drawdown=self.drawdown)

    def _trade(self, symbol: str, q: Quote, open_ns: int, close_ns: int) -> None:
        old = set(self.positions)
        held = self._holds(symbol)
        for x in sorted(self.live):
            order = self.live[x]
            if order.expires is not None and order.expires <= open_ns:
                self._to(order, "EXPIRED", open_ns)
        for x in sorted(self.live):
            order = self.live[x]
            if order.state == "ACCEPTED" and order.symbol == symbol and order.created <= open_ns:
                self._to(order, "ACTIVE", open_ns)
        inside = self._entries(symbol, q, open_ns, close_ns)
        late = self._exits(symbol, q, close_ns, old, inside)
        if held and not self._holds(symbol):
            self._revalue()
            old = set(self.positions)
            inside = self._entries(symbol, q, close_ns, close_ns, again=True)
            late |= self._exits(symbol, q, close_ns, old, inside)
        self._excursions(symbol, q, late)
        self._revalue()
        self._margin_state(close_ns)
        if not self.positions and not self.rules.negative_balance:
            self.balance = max(self.balance, ZERO)
            self._revalue()
            self.called = False

    def _holds(self, symbol: str) -> bool:
        return any(x.symbol == symbol for x in self.positions.values())

    def _hit(self, o: Order, q: Quote) -> Hit | None:
        """Whether and where the bar fills the order."""
        op, hi, lo, _ = q.side(o.buy)
        p, r, sign = self.profiles[o.symbol], self.rules, 1 if o.buy else -1
        if o.kind == "MARKET":
            slip = p.ticks(r.slip_market)
            return op + sign * slip, slip, "market_open", True
        limit = o.kind == "LIMIT"
        # a buy limit waits for a low, a buy stop for a high; sells the other way round
        reached = (lo <= o.price if o.buy else hi >= o.price) if limit else (hi >= o.price if o.buy else lo <= o.price)
        if not reached:
            return None
        gap = (op <= o.price if o.buy else op >= o.price) if limit else (op >= o.price if o.buy else op <= o.price)
        base = op if gap else o.price
        price = base + sign * p.ticks(r.slip_limit if limit else r.slip_stop)
        if limit:
            price = min(price, o.price) if o.buy else max(price, o.price)
        return price, abs(price - base), "limit_fill" if limit else "stop_fill", gap

    def _entries(self, symbol: str, q: Quote, open_ns: int, close_ns: int, again: bool = False) -> set[int]:
        """Positions opened inside the bar. ``again``: the round after the symbol became flat, at the close."""
        inside: set[int] = set()
        single, groups = [], {}
        for i in sorted(self.live):
            o = self.live[i]
            if o.state != "ACTIVE" or o.symbol != symbol or o.owned or (again and not o.extra.get("reevaluate")):
                continue
            if o.extra.get("require_flat") and self._holds(symbol):
                continue
            if o.extra.get("oco"):
                groups.setdefault(o.extra["oco"], []).append(o)
            else:
                single.append(o)

        def fill(o: Order, hit: Hit) -> int:
            at = open_ns if hit[3] or again else close_ns
            opened = self._execute(o, hit, q.spread, at)
            if not hit[3]:
                inside.update(opened)
            return at

        for o in single:
            if o.state == "ACTIVE" and (hit := self._hit(o, q)):
                fill(o, hit)
        for g in sorted(groups):
            members = groups[g]
            if any(o.extra.get("require_flat") for o in members) and self._holds(symbol):
                continue
            hits = [(o, hit) for o in members if (hit := self._hit(o, q))]
            if not hits:
                continue
            opening = [x for x in hits if x[1][3]]
            if not opening and len(hits) > 1 and members[0].extra.get("oco_cancel_all"):
                for o in members:
                    self._to(o, "CANCELLED", close_ns, Why.OCO_AMBIGUOUS)
                continue
            o, hit = (opening or hits)[0]
            at = fill(o, hit)
            if o.state in ("FILLED", "REJECTED"):
                for other in members:
                    if other is not o and other.state in LIVE:
                        self._to(other, "CANCELLED", at, Why.OCO_SIBLING)
        return inside

    def _execute(self, o: Order, hit: Hit, spread: int, at: int) -> list[int]:
        price, slip, why, _ = hit
        p = self.profiles[o.symbol]
        try:
            if o.extra.get("reward_risk") is not None:
                self._resize(o, price, at)
            self._check_levels(o.buy, price, o.stop, o.target, p)
            self._check_capacity(o, price)
        except Refused as e:
            self._to(o, "REJECTED", at, str(e))
            return []
        costs = self._costs(o.lots, price, slip, spread, p)
        self._fill(o, price, at, costs, why)
        return self._book(o, price, at, costs)

    def _fill(self, o: Order, price: int, at: int, costs: tuple[Decimal, Decimal, Decimal], why: str) -> None:
        o.average = ((o.average or ZERO) * o.filled + D(price) * o.lots) / (o.filled + o.lots)
        o.filled += o.lots
        self.balance -= costs[0]
        self.totals["fills"] += 1
        self.totals["commission"] += costs[0]
        self._row("fill", at, self._id("fill"), order_id=o.id, symbol=o.symbol, side="BUY" if o.buy else "SELL", price=price, lots=o.lots, commission=costs[0], spread_cost=costs[1], slippage_cost=costs[2], reason=why)
        self._to(o, "FILLED", at, why)

    def _resize(self, o: Order, price: int, at: int) -> None:
        """Target and size again from the price of execution."""
        distance = abs(price - o.stop)
        if not distance:
            raise Refused(Why.REWARD_STOP)
        reach = int((D(distance) * D(o.extra["reward_risk"])).to_integral_value(ROUND_HALF_UP))
        if not reach:
            raise Refused(Why.REWARD_TARGET)
        target = price + reach if o.buy else price - reach
        lots = self.rules.size(self.equity, price, o.stop, self.profiles[o.symbol], o.lots)
        if (lots, target) != (o.lots, o.target):
            o.lots, o.target, o.revision = lots, target, o.revision + 1
            self._row("order.modified", at, o.id, lots=lots, target=target)

    def _net(self, symbol: str) -> Position | None:
        return next((x for x in self.positions.values() if x.symbol == symbol), None)

    def _check_capacity(self, o: Order, price: int) -> None:
        r = self.rules
        if o.reduce_only:
            pos = self.positions.get(o.position)
            if pos is None:
                raise Refused(Why.LATE_CLOSE_NONE)
            if o.lots > pos.lots:
                raise Refused(Why.LATE_CLOSE_VOLUME)
            if pos.long == o.buy:
                raise Refused(Why.LATE_CLOSE_SIDE)
            return
        if not (r.allow_long if o.buy else r.allow_short):
            raise Refused(Why.SIDE_OFF.format("long" if o.buy else "short"))
        mine = [x for x in self.positions.values() if x.symbol == o.symbol]
        same = [x for x in mine if x.long == o.buy]
        opening = o.lots if r.hedging or not mine or same else max(ZERO, o.lots - mine[0].lots)
        if not opening:
            return
        if same and not r.pyramiding:
            raise Refused(Why.PYRAMID)
        if r.hedging:
            if len(self.positions) >= r.max_positions:
                raise Refused(Why.MOST_POSITIONS)
            if len(mine) >= r.max_symbol_positions:
                raise Refused(Why.MOST_SYMBOL)
        needed = sum((x.margin for x in self.positions.values()), ZERO) + self.profiles[o.symbol].margin(D(price), opening, r.leverage)
        if self.equity <= 0 or needed > self.equity:
            raise Refused(Why.FREE_MARGIN)
        if needed / self.equity * HUNDRED > r.max_margin_percent:
            raise Refused(Why.MOST_MARGIN)

    # --- positions -----------------------------------------------------------------------------------

    def _book(self, o: Order, price: int, at: int, costs: tuple[Decimal, Decimal, Decimal]) -> list[int]:
        """Applies a fill; the ids of positions it opened."""
        if self.rules.hedging:
            if o.reduce_only:
                self._close(self.positions[o.position], o.lots, price, at, o.id, costs, "strategy_exit", False)
                return []
            return [self._open(o, o.lots, price, at, costs)]
        pos = self._net(o.symbol)
        if pos is None:
            return [self._open(o, o.lots, price, at, costs)]
        if pos.long == o.buy:
            self._grow(pos, o, price, at, costs)
            return []
        lots = min(o.lots, pos.lots)
        part = lots / o.lots
        self._close(pos, lots, price, at, o.id, tuple(c * part for c in costs), "netting_reduction", False)
        rest = o.lots - lots
        if not rest or o.reduce_only:
            return []
        part = rest / o.lots
        return [self._open(o, rest, price, at, tuple(c * part for c in costs))]

    def _open(self, o: Order, lots: Decimal, price: int, at: int, costs: tuple[Decimal, Decimal, Decimal]) -> int:
        p = self.profiles[o.symbol]
        risk = None if o.stop is None else p.money(D(price - o.stop), lots, False)
        pos = Position(self._id("position"), o.symbol, o.buy, lots, D(price), at, o.id, o.stop, o.target, *costs, p.margin(D(price), lots, self.rules.leverage), risk, o.extra | {"client": o.client}, price)
        self.positions[pos.id] = pos
        self._row("position.opened", at, pos.id, symbol=pos.symbol, side="LONG" if pos.long else "SHORT", lots=lots, price=price, stop=o.stop, target=o.target)
        self._guard(pos, at)
        return pos.id

    def _grow(self, pos: Position, o: Order, price: int, at: int, costs: tuple[Decimal, Decimal, Decimal]) -> None:
        p, lots = self.profiles[pos.symbol], pos.lots + o.lots
        pos.entry = (pos.entry * pos.lots + D(price) * o.lots) / lots
        pos.lots = lots
        pos.commission, pos.spread, pos.slippage = pos.commission + costs[0], pos.spread + costs[1], pos.slippage + costs[2]
        pos.margin += p.margin(D(price), o.lots, self.rules.leverage)
        pos.stop = o.stop if o.stop is not None else pos.stop
        pos.target = o.target if o.target is not None else pos.target
        if pos.stop is not None:
            pos.risk = p.money(pos.entry - pos.stop, lots, False)
        self._guard(pos, at)
        self._row("position.updated", at, pos.id, lots=lots, price=pos.entry)

    def _guard(self, pos: Position, at: int) -> None:
        """Replaces the position's own stop and target orders."""
        self._unguard(pos, at)
        for name, level, kind in (("stop_order", pos.stop, "STOP"), ("target_order", pos.target, "LIMIT")):
            if level is not None:
                o = Order(self._id("order"), f"protection-{self.next_id['order']}", pos.symbol, not pos.long, kind, pos.lots, at, price=level, reduce_only=True, position=pos.id, owned="protection")
                self.orders[o.id] = o
                self._to(o, "ACCEPTED", at)
                self._to(o, "ACTIVE", at)
                setattr(pos, name, o.id)

    def _unguard(self, pos: Position, at: int, but: int | None = None) -> None:
        for name in ("stop_order", "target_order"):
            o = self.live.get(getattr(pos, name) or 0)
            if o is not None and o.id != but:
                self._to(o, "CANCELLED", at, Why.REPLACED)
            setattr(pos, name, None)

    def _close(self, pos: Position, lots: Decimal, price: int, at: int, order: int, costs: tuple[Decimal, Decimal, Decimal], why: str, ambiguous: bool) -> None:
        p, part = self.profiles[pos.symbol], lots / pos.lots
        actual = p.pnl(pos.long, pos.entry, D(price), lots)
        paid = [a * part for a in (pos.commission, pos.spread, pos.slippage)]
        commission, spread, slippage = (a + b for a, b in zip(paid, costs, strict=True))
        risk = None if pos.risk is None else pos.risk * part
        gross = actual + spread + slippage
        net = gross - commission - spread - slippage
        self.balance += actual
        t = self.totals
        t["trades"] += 1
        t["wins"] += net > 0
        t["losses"] += net < 0
        t["net_pnl"] += net
        self._row(
            "trade", at, self._id("trade"), position_id=pos.id, symbol=pos.symbol, side="LONG" if pos.long else "SHORT", lots=lots, entry_time_ns=pos.opened, exit_time_ns=at, entry_price=pos.entry, exit_price=price,
            stop=pos.stop, target=pos.target, gross_pnl=gross, commission=commission, spread_cost=spread, slippage_cost=slippage, net_pnl=net, initial_risk=risk, realized_r=net / risk if risk else None,
            mae=pos.mae * part, mfe=pos.mfe * part, ambiguous=ambiguous, exit_reason=why, chain=pos.extra.get("chain"), client=pos.extra.get("client"),
        )
        keep = 1 - part
        pos.lots -= lots
        pos.commission, pos.spread, pos.slippage = pos.commission - paid[0], pos.spread - paid[1], pos.slippage - paid[2]
        pos.margin, pos.mae, pos.mfe = pos.margin * keep, pos.mae * keep, pos.mfe * keep
        if pos.risk is not None:
            pos.risk -= risk
        if pos.lots:
            self._guard(pos, at)
            self._row("position.updated", at, pos.id, lots=pos.lots)
        else:
            self._unguard(pos, at, order)
            del self.positions[pos.id]
            self._row("position.liquidated" if why == "stop_out" else "position.closed", at, pos.id, reason=why)

    # --- protections ---------------------------------------------------------------------------------

    def _exits(self, symbol: str, q: Quote, at: int, old: set[int], inside: set[int]) -> set[int]:
        """Stops and targets of the symbol's positions; the ids of reversals, whose excursions start with the next bar."""
        late: set[int] = set()
        for i in sorted(self.positions):
            pos = self.positions.get(i)
            if pos is None or pos.symbol != symbol or (i not in old and not self.rules.same_bar_exit):
                continue
            found = self._exit(pos, q, i in inside)
            if found is None:
                continue
            (price, slip, why, _), ambiguous = found
            o = self.orders[pos.stop_order if why == "stop_loss" else pos.target_order]
            costs = self._costs(pos.lots, price, slip, q.spread, self.profiles[symbol])
            self._fill(o, price, at, costs, why)
            lots, extra = pos.lots, pos.extra
            self._close(pos, lots, price, at, o.id, costs, why, ambiguous)
            if why == "stop_loss" and extra.get("reverse_stop") is not None:
                self._revalue()
                late.update(self._reverse(pos, lots, price, slip, q.spread, at))
        return late

    def _exit(self, pos: Position, q: Quote, inside: bool) -> tuple[Hit, bool] | None:
        op, hi, lo, _ = q.side(not pos.long)
        if pos.long:
            stop, target = pos.stop is not None and lo <= pos.stop, pos.target is not None and hi >= pos.target
        else:
            stop, target = pos.stop is not None and hi >= pos.stop, pos.target is not None and lo <= pos.target
        if not stop and not target:
            return None
        policy = self.rules.intrabar
        cautious, hopeful = policy in ("CONSERVATIVE", "STOP_FIRST"), policy in ("OPTIMISTIC", "TARGET_FIRST")
        if policy == "REJECT_AMBIGUOUS" and (inside or (stop and target)):
            raise Ambiguous("the bar does not tell the order of its prices")
        if inside:
            # the entry came within the bar, so what the bar touched may have come before it
            if cautious:
                if stop:
                    return self._level(pos, op, True), True
                return (self._level(pos, op, False), False) if pos.extra.get("intrabar_target") else None
            if hopeful:
                return (self._level(pos, op, False), True) if target else None
        if stop and target:
            first = cautious or (not hopeful and abs(op - pos.stop) <= abs(op - pos.target))
        else:
            first = stop
        return self._level(pos, op, first), inside or (stop and target)

    def _level(self, pos: Position, op: int, stop: bool) -> Hit:
        """The price at the stop or target: the open if the bar starts beyond it, with slippage."""
        level, p, sign = (pos.stop if stop else pos.target), self.profiles[pos.symbol], -1 if pos.long else 1
        beyond = (op - level) * sign >= 0 if stop else (op - level) * sign <= 0
        base = op if beyond else level
        price = base + sign * p.ticks(self.rules.slip_stop if stop else self.rules.slip_limit)
        if not stop:
            price = max(price, level) if pos.long else min(price, level)
        return price, abs(price - base), "stop_loss" if stop else "take_profit", beyond

    def _reverse(self, pos: Position, lots: Decimal, price: int, slip: int, spread: int, at: int) -> list[int]:
        """The opposite position at the stop's price."""
        stop, buy, p = pos.extra["reverse_stop"], not pos.long, self.profiles[pos.symbol]
        reach = int((D(abs(price - stop)) * D(pos.extra["reverse_reward"])).to_integral_value(ROUND_HALF_UP))
        if not reach:
            return []
        target = price + reach if buy else price - reach
        try:
            lots = self.rules.size(self.equity, price, stop, p, lots)
        except Refused:
            return []
        before, self.now = self.now, min(self.now, at)
        o = self.submit(f"reverse-{self.next_id['order'] + 1}", pos.symbol, buy, "MARKET", lots, at, stop=stop, target=target, extra={k: v for k, v in (("chain", pos.extra.get("chain")), ("leg", 2)) if v is not None})
        self.now = before
        if o.state == "REJECTED":
            return []
        self._to(o, "ACTIVE", at)
        return self._execute(o, (price, slip, "stop_and_reverse", False), spread, at)

    # --- account -------------------------------------------------------------------------------------

    def _excursions(self, symbol: str, q: Quote, late: set[int]) -> None:
        for pos in self.positions.values():
            if pos.symbol != symbol:
                continue
            _, hi, lo, close = q.side(not pos.long)
            p = self.profiles[symbol]
            good, bad = (hi - pos.entry, pos.entry - lo) if pos.long else (pos.entry - lo, hi - pos.entry)
            if pos.id not in late:
                if good > 0:
                    pos.mfe = max(pos.mfe, p.money(good, pos.lots, True))
                if bad > 0:
                    pos.mae = max(pos.mae, p.money(bad, pos.lots, False))
            pos.mark = close

    def _revalue(self) -> None:
        floating = margin = ZERO
        for pos in self.positions.values():
            q, p = self.quotes.get(pos.symbol), self.profiles[pos.symbol]
            mark = D(pos.mark if q is None else q.close + (0 if pos.long else q.spread))
            floating += p.pnl(pos.long, pos.entry, mark, pos.lots)
            pos.margin = p.margin(mark, pos.lots, self.rules.leverage)
            margin += pos.margin
        self.floating, self.margin, self.equity = floating, margin, self.balance + floating
        self.level = self.equity / margin * HUNDRED if margin > 0 else None
        self.peak = max(self.peak, self.equity)
        self.drawdown = self.peak - self.equity
        self.totals["max_drawdown"] = max(self.totals["max_drawdown"], self.drawdown)

    def _margin_state(self, at: int) -> None:
        r = self.rules
        if self.level is None:
            self.called = False
            return
        call = self.level <= r.margin_call_percent
        if call and not self.called:
            self._row("account.margin_call", at, 0, level=self.level)
        self.called = call
        if self.level > r.stop_out_percent:
            return
        self._row("account.stop_out", at, 0, level=self.level)
        while self.positions and self.level is not None and self.level <= r.stop_out_percent:
            worst = min(self.positions.values(), key=lambda x: (self.profiles[x.symbol].pnl(x.long, x.entry, D(x.mark), x.lots), x.id))
            self._liquidate(worst, at, "stop_out")
            self._revalue()

    def _liquidate(self, pos: Position, at: int, why: str) -> None:
        """Closes at the last close on the position's exit side."""
        p, q = self.profiles[pos.symbol], self.quotes[pos.symbol]
        slip = p.ticks(self.rules.slip_market)
        base = q.side(not pos.long)[3]
        price = base - slip if pos.long else base + slip
        costs = self._costs(pos.lots, price, slip, q.spread, p)
        o = Order(self._id("order"), f"exit-{self.next_id['order']}", pos.symbol, not pos.long, "MARKET", pos.lots, at, reduce_only=True, position=pos.id, owned="exit")
        self.orders[o.id] = o
        self._to(o, "ACCEPTED", at)
        self._to(o, "ACTIVE", at)
        self._fill(o, price, at, costs, why)
        self._close(pos, pos.lots, price, at, o.id, costs, why, False)

    def finish(self, at: int, why: str = "end_of_data") -> None:
        """Closes every position at its last price."""
        for i in sorted(self.positions):
            self._liquidate(self.positions[i], at, why)
        self._revalue()
        self.now = at
        self._row("account", at, self.totals["bars"], balance=self.balance, equity=self.equity, floating=self.floating, margin=self.margin, drawdown=self.drawdown)
