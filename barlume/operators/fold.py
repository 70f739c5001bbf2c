"""Runs as folds: one book per run over its bars and commands, inside Spark tasks.

Bars and commands of all runs are one stream of rows, dealt by run and sorted by time within. A task
reads its rows as a stream and holds only the state of the run at hand, so a run may be of any length;
a run itself is sequential and never split. Parallelism comes from many runs.

Rows: (run_id, at_ns, rank, kind, tie, body), by the time at which they are known. Of one time, bars that are
only seen and forming bars come first, then bars that execute, then commands: a command made at t is there
before the bar that opens at t. Callbacks see all that closed at their time: events first, then bars.
Output: (run_id, seq, kind, time_ns, ref, payload) with the payload as JSON; ``trades``, ``fills`` and
``equity`` read it back as columns.

A strategy that raises, or whose callback takes longer than the time limit, ends its own run: what the
run put out stays, a row of kind ``run.failed`` says why, and the other runs of the task go on.
"""

from __future__ import annotations

import json
import signal
import threading
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal as D
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlume.operators.book import Book, Position, Profile, Refused, Rules

OUT = "run_id string, seq long, kind string, time_ns long, ref long, payload string"
_OUT = pa.schema([("run_id", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("time_ns", pa.int64()), ("ref", pa.int64()), ("payload", pa.string())])
#: Bars per series that a strategy can look back on unless a run says otherwise.
DEPTH = 5_000
BAR = ("symbol", "timeframe", "open_time_ns", "close_time_ns", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "source_spread_points", "sequence")


@dataclass(frozen=True, slots=True)
class Bar:
    symbol: str
    timeframe: str
    open_time_ns: int
    close_time_ns: int
    open_ticks: int
    high_ticks: int
    low_ticks: int
    close_ticks: int
    source_spread_points: int
    sequence: int


# --- what strategies see -------------------------------------------------------------------------------


class Market:
    """Closed bars per series, the newest last; never one that has not closed."""

    def __init__(self, depth: int | None = DEPTH):
        """``depth``: bars kept per series, None for all; asking for more than are kept is an error."""
        self.depth, self.series, self.unfinished = depth, {}, {}

    def add(self, bar: Bar) -> None:
        s = self.series.setdefault((bar.symbol, bar.timeframe), deque(maxlen=self.depth))
        if s and s[-1].close_time_ns == bar.close_time_ns:
            if s[-1] != bar:
                raise ValueError("two different bars close at one time")
            return
        s.append(bar)

    def latest(self, symbol: str, timeframe: str, offset: int = 0) -> Bar | None:
        self._held(offset + 1)
        s = self.series.get((symbol, timeframe), ())
        return s[-1 - offset] if offset < len(s) else None

    def _held(self, n: int) -> None:
        if self.depth is not None and n > self.depth:
            raise ValueError(f"{n} bars asked for, {self.depth} are kept: raise the run's history")

    def history(self, symbol: str, timeframe: str, n: int) -> list[Bar]:
        self._held(n)
        s = self.series.get((symbol, timeframe), ())
        return [s[i] for i in range(max(0, len(s) - n), len(s))]

    def forming(self, symbol: str, timeframe: str, now: int) -> dict[str, int] | None:
        """The unfinished bar of a longer timeframe as last observed, while it is unfinished."""
        f = self.unfinished.get((symbol, timeframe))
        return f if f and f["observed_time_ns"] <= now < f["boundary_close_ns"] else None

    def count(self, symbol: str, timeframe: str) -> int:
        return len(self.series.get((symbol, timeframe), ()))


class Context:
    """A strategy's hands: market, portfolio (the book), orders, chart and log."""

    MOST_ACTIONS = 1_000  # per callback

    def __init__(self, book: Book, depth: int | None = DEPTH):
        self.book, self.market, self.now = book, Market(depth), 0
        self.made: list[tuple[str, dict[str, Any]]] = []
        self.actions, self.revisions, self.numbers = 0, {}, 0

    def _act(self) -> None:
        self.actions += 1
        if self.actions > self.MOST_ACTIONS:
            raise RuntimeError("too many actions in one callback")

    # orders
    def order(self, symbol: str, buy: bool, lots: D, kind: str = "MARKET", client: str | None = None, **more: Any) -> int:
        self._act()
        self.numbers += 1
        return self.book.submit(client or f"s{self.numbers}", symbol, buy, kind, D(lots), self.now, **more).id

    def cancel(self, order_id: int) -> None:
        self._act()
        self.book.cancel(order_id, self.now, "strategy_requested")

    def modify(self, order_id: int, **changes: int) -> None:
        self._act()
        self.book.modify(order_id, self.now, **changes)

    def protect(self, position_id: int, stop: int | None, target: int | None) -> None:
        self._act()
        self.book.protect(position_id, self.now, stop, target)

    def close(self, position_id: int, lots: D | None = None) -> int:
        p = self.book.positions[position_id]
        return self.order(p.symbol, not p.long, lots or p.lots, reduce_only=True, position=p.id)

    def positions(self, symbol: str | None = None, long: bool | None = None) -> list[Position]:
        return [p for p in self.book.positions.values() if (symbol is None or p.symbol == symbol) and (long is None or p.long == long)]

    # chart: declare, plot, draw, delete, clear
    def chart(self, command: str, drawing: str | None = None, **values: Any) -> None:
        self._act()
        if drawing is not None:
            self.revisions[drawing] = values["revision"] = self.revisions.get(drawing, 0) + 1
            values["drawing_id"] = drawing
        self.made.append(("chart", {"command": command} | values))

    def log(self, level: str, message: str, **details: Any) -> None:
        self.made.append(("log", {"level": level, "message": message} | details))


class Strategy:
    """Override what is needed; callbacks come in event order."""

    def __init__(self, **parameters: Any):
        self.parameters = parameters

    def on_start(self, context: Context) -> None: ...

    def on_bar(self, context: Context, bar: Bar) -> None: ...

    def on_order(self, context: Context, kind: str, ref: int, values: dict[str, Any]) -> None: ...

    def on_stop(self, context: Context, reason: str) -> None: ...


class Observer:
    """Sees a run without acting on it: every bar that executes, and every row the run puts out."""

    def on_bar(self, run_id: str, bar: Bar, snapshot: dict[str, Any]) -> None: ...

    def on_result(self, run_id: str, time_ns: int, kind: str, ref: int, values: dict[str, Any], snapshot: dict[str, Any]) -> None: ...


class TooSlow(RuntimeError):
    """A callback passed its time limit."""


@contextmanager
def time_limit(seconds: float | None) -> Iterator[None]:
    """Raises ``TooSlow`` in the block when it takes longer. Only the main thread, which is where
    Spark's workers run, can be interrupted; elsewhere there is no limit."""
    if not seconds or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: Any) -> None:
        raise TooSlow(f"a callback took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def load(path: str) -> Callable[..., Strategy]:
    """``module:object``."""
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


# --- the fold ---------------------------------------------------------------------------------------------


class Run:
    """One run: feeds rows to the book and the strategy, collects output rows."""

    ROUNDS = 8

    def __init__(
        self,
        run_id: str,
        rules: Rules,
        profiles: dict[str, Profile],
        strategy: Strategy | None,
        account_every: int,
        start_ns: int = 0,
        history: int | None = DEPTH,
        limit: float | None = None,
        observer: Observer | None = None,
    ):
        self.run_id, self.book, self.start = run_id, Book(rules, profiles), start_ns
        self.limit, self.observer, self.failed = limit, observer, False
        self.seen: list[Bar] = []  # closed, not yet called back
        self.strategy, self.context = strategy, Context(self.book, history)
        self.seq, self.every, self.last = 0, account_every, 0
        self.out: list[tuple] = []
        if strategy:
            self.begin(lambda: strategy)

    def begin(self, make: Callable[[], Strategy]) -> None:
        """Takes a strategy that ``make`` makes."""
        self._guarded(self._start, make)

    def _start(self, make: Callable[[], Strategy]) -> None:
        with time_limit(self.limit):
            self.strategy = make()
        self._call("on_start", self.context)
        self._flush(0)

    def _call(self, name: str, *values: Any) -> None:
        with time_limit(self.limit):
            getattr(self.strategy, name)(*values)

    def _guarded(self, step: Callable[..., Any], *values: Any) -> None:
        """Does a step of the run; an error ends this run alone."""
        if self.failed:
            return
        try:
            step(*values)
        except Exception as e:  # whatever strategy code raises
            self.failed = True
            self._put("run.failed", self.last, 0, {"error": type(e).__name__, "message": str(e)})

    def _put(self, kind: str, time: int, ref: int, values: dict[str, Any]) -> None:
        self.seq += 1
        self.out.append((self.run_id, self.seq, kind, time, ref, json.dumps({k: (str(v) if isinstance(v, D) else v) for k, v in values.items() if v is not None}, sort_keys=True, separators=(",", ":"))))
        if self.observer:
            self.observer.on_result(self.run_id, time, kind, ref, values, self.book.snapshot())

    def _flush(self, now: int) -> list[tuple[str, int, int, dict[str, Any]]]:
        """Takes over the book's and the strategy's rows; returns the order and position events."""
        events = []
        for kind, time, ref, values in self.book.drain():
            if kind == "account" and ref % self.every and ref != 1:
                continue
            self._put(kind, time, ref, values)
            if kind.startswith(("order.", "position.", "fill")):
                events.append((kind, time, ref, values))
        for kind, values in self.context.made:
            self._put(kind, now, 0, values)
        self.context.made.clear()
        self.context.actions = 0
        return events

    def _feedback(self, now: int) -> None:
        """Events first, then the bars; orders that callbacks make come back as events, a bounded number of rounds."""
        bars, self.seen = self.seen, []
        events = self._flush(now)
        if not self.strategy:
            return
        for _ in range(self.ROUNDS):
            for kind, _time, ref, values in events:
                self._call("on_order", self.context, kind, ref, values)
            for b in bars:
                self._call("on_bar", self.context, b)
            bars = []
            events = self._flush(now)
            if not events:
                return
        raise RuntimeError("callbacks keep answering each other")

    def bar(self, b: Bar, execute: bool) -> None:
        """Bars that close by the start only warm up the market."""
        self.catch_up(b.close_time_ns)
        self.context.market.add(b)
        if b.close_time_ns <= self.start:
            return
        self.context.now = self.last = max(self.last, b.close_time_ns)
        self.seen.append(b)
        if execute:
            self.book.bar(b.symbol, b.open_time_ns, b.close_time_ns, b.open_ticks, b.high_ticks, b.low_ticks, b.close_ticks, b.source_spread_points, b.sequence)
            if self.observer:
                self.observer.on_bar(self.run_id, b, self.book.snapshot())
            self._feedback(b.close_time_ns)

    def forming(self, f: dict[str, Any]) -> None:
        self.context.market.unfinished[f["symbol"], f["timeframe"]] = f

    def catch_up(self, now: int) -> None:
        """Calls back bars of an earlier time at which nothing executed."""
        if self.seen and self.seen[-1].close_time_ns < now:
            self._feedback(self.seen[-1].close_time_ns)

    def row(self, at: int, kind: str, body: str) -> None:
        self._guarded(self._row, at, kind, body)

    def _row(self, at: int, kind: str, body: str) -> None:
        values = json.loads(body)
        if kind == "bar":
            self.bar(Bar(*(values.get(k) for k in BAR)), values["x"])
        elif kind == "forming":
            self.forming(values)
        else:
            self.command(at, values)

    def command(self, at: int, c: dict[str, Any]) -> None:
        self.catch_up(at + 1)
        what = c.pop("do", "submit")
        try:
            if what == "submit":
                c["lots"] = D(str(c["lots"]))
                self.book.submit(created=at, **c)
            elif what == "close":
                p = self.book.positions[c["position"]]
                self.book.submit(c.get("client", f"close-{at}"), p.symbol, not p.long, "MARKET", p.lots, at, reduce_only=True, position=p.id)
            else:
                getattr(self.book, {"cancel": "cancel", "modify": "modify", "protect": "protect"}[what])(time=at, **c)
        except (Refused, KeyError) as e:
            self._put("command.refused", at, 0, {"command": what, "reason": str(e)})
        self._flush(at)

    def finish(self, liquidate: bool) -> list[tuple]:
        """The rows not yet taken; a failed run has no report."""
        self._guarded(self._finish, liquidate)
        return self.out

    def _finish(self, liquidate: bool) -> None:
        self.catch_up(self.last + 1)
        if liquidate and self.book.positions:
            self.book.finish(self.last)
        self._feedback(self.last)
        if self.strategy:
            self._call("on_stop", self.context, "end_of_data")
            self._flush(self.last)
        b = self.book
        self._put("report", self.last, 0, b.totals | {"balance": b.balance, "equity": b.equity})


def bar_rows(bars: DataFrame, execution_timeframe: str | None = None) -> DataFrame:
    """Bars (run_id and ``BAR``) as stream rows at their close; those of the execution timeframe (default: all) execute."""
    execute = F.lit(True) if execution_timeframe is None else F.col("timeframe") == execution_timeframe
    tie = F.concat_ws("/", F.lpad(F.col("open_time_ns").cast("string"), 20, "0"), "symbol", "timeframe")
    return bars.select("run_id", F.col("close_time_ns").alias("at_ns"), F.when(execute, 2).otherwise(0).alias("rank"), F.lit("bar").alias("kind"), tie.alias("tie"), F.to_json(F.struct(execute.alias("x"), *BAR)).alias("body"))


def forming_rows(forming: DataFrame, timeframe: str) -> DataFrame:
    """Unfinished bars (``bars.forming`` with run_id) as stream rows at the time they were observed."""
    body = F.to_json(F.struct("symbol", F.lit(timeframe).alias("timeframe"), "boundary_open_ns", "boundary_close_ns", "observed_time_ns", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "tick_volume"))
    return forming.select("run_id", F.col("observed_time_ns").alias("at_ns"), F.lit(1).alias("rank"), F.lit("forming").alias("kind"), F.concat_ws("/", "symbol", F.lit(timeframe)).alias("tie"), body.alias("body"))


def command_rows(commands: DataFrame) -> DataFrame:
    """Commands (run_id, at_ns, tie, body: JSON of the book's arguments, ``do`` for all but submissions)."""
    return commands.select("run_id", "at_ns", F.lit(3).alias("rank"), F.lit("command").alias("kind"), F.col("tie").cast("string").alias("tie"), "body")


def simulate(
    rows: DataFrame,
    rules: Rules,
    profiles: dict[str, Profile],
    strategy: str | None = None,
    parameters: Callable[[str], dict] | None = None,
    account_every: int = 1,
    liquidate: bool = True,
    start_ns: int = 0,
    history: int | None = DEPTH,
    limit: float | None = None,
    observer: str | None = None,
) -> DataFrame:
    """Folds stream rows of any number of runs. ``parameters`` makes a run's strategy parameters from its id,
    ``history`` is how many bars a strategy can look back (None: all), ``limit`` the seconds a callback may take,
    ``observer`` (module:object, made once a run) sees bars and rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: Run | None = None
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _OUT, strict=True)], schema=_OUT)

        for b in batches:
            for run_id, at, kind, body in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 5)), strict=True):
                if run is None or run.run_id != run_id:
                    if run is not None:
                        out += run.finish(liquidate)
                    run = Run(run_id, rules, profiles, None, account_every, start_ns, history, limit, load(observer)() if observer else None)
                    if strategy:
                        run.begin(lambda name=run_id: load(strategy)(**(parameters(name) if parameters else {})))
                run.row(at, kind, body)
                out += run.out
                run.out.clear()
            if len(out) >= 10_000:
                yield batch()
        if run is not None:
            out += run.finish(liquidate)
        if out:
            yield batch()

    dealt = rows.repartition("run_id").sortWithinPartitions("run_id", "at_ns", "rank", "tie")
    return dealt.mapInArrow(work, OUT)


_TRADE = (
    "position_id bigint, symbol string, side string, lots decimal(18,4), entry_time_ns bigint, exit_time_ns bigint, entry_price decimal(20,8), exit_price bigint, gross_pnl decimal(20,8), commission decimal(20,8), "
    "spread_cost decimal(20,8), slippage_cost decimal(20,8), net_pnl decimal(20,8), initial_risk decimal(20,8), realized_r decimal(20,8), mae decimal(20,8), mfe decimal(20,8), ambiguous boolean, exit_reason string, chain string, client string"
)


def _typed(out: DataFrame, kind: str, schema: str) -> DataFrame:
    return out.where(F.col("kind") == kind).select("run_id", "seq", "time_ns", F.col("ref").alias(f"{kind}_id"), F.from_json("payload", schema).alias("p")).select("run_id", "seq", "time_ns", f"{kind}_id", "p.*")


def trades(out: DataFrame) -> DataFrame:
    return _typed(out, "trade", _TRADE)


def fills(out: DataFrame) -> DataFrame:
    return _typed(out, "fill", "order_id bigint, symbol string, side string, price bigint, lots decimal(18,4), commission decimal(20,8), spread_cost decimal(20,8), slippage_cost decimal(20,8), reason string")


def equity(out: DataFrame) -> DataFrame:
    return _typed(out, "account", "balance decimal(20,8), equity decimal(20,8), floating decimal(20,8), margin decimal(20,8), drawdown decimal(20,8)")


def reports(out: DataFrame) -> DataFrame:
    return _typed(out, "report", "bars bigint, orders bigint, fills bigint, trades bigint, wins bigint, losses bigint, net_pnl decimal(20,8), commission decimal(20,8), max_drawdown decimal(20,8), balance decimal(20,8), equity decimal(20,8)")


def orders(out: DataFrame) -> DataFrame:
    """The last state of every order."""
    from barlume.operators.joins import latest_by

    rows = out.where("kind like 'order.%' and kind <> 'order.modified'").select("run_id", F.col("ref").alias("order_id"), "seq", F.upper(F.substring("kind", 7, 20)).alias("state"), F.get_json_object("payload", "$.reason").alias("reason"), "time_ns")
    return latest_by(rows, ["run_id", "order_id"], ["seq"])


def transition_errors(events: DataFrame) -> DataFrame:
    """Order events (run_id, order_id, seq, state) that do not follow from the one before."""
    from pyspark.sql import Window

    from barlume.operators.book import NEXT

    allowed = events.sparkSession.createDataFrame([(a, b) for a, to in NEXT.items() for b in sorted(to)], "before string, state string")
    w = Window.partitionBy("run_id", "order_id").orderBy("seq")
    steps = events.withColumn("before", F.lag("state").over(w)).where("before is not null")
    return steps.join(F.broadcast(allowed), ["before", "state"], "left_anti")  # a fixed table of 16 rows
