import bisect
import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane.operators.book import (
    CostAware, Costs, equity_curve, fill_log, fold_rows, marked_positions, orders_by_status, positions, simulate,
)
from pitlane.operators.covariance import (
    cost_aware_inputs, cost_aware_step, covariance_rows, cut_weights, project_capped_simplex, return_windows, solve_long_only,
)
from pitlane.operators import frontier
from pitlane.operators.frontier import (
    basket_status, centred, covariance_pairs, mean_variance_weights, solve_baskets,
)
from pitlane.operators.weights import (
    bad_weights, buy_and_hold, default_momentum_k, equal_weight, every_nth, momentum_weights, repeated_symbols, run_timeline,
    score_proportional, trades,
)
from pitlane.plans.fixtures import Tables
from pitlane.plans.queries_books import buy_and_hold_fills
from pitlane.plans.registry import ENTRIES
from pitlane.session import cut
from tests.helpers import day, frame, tuples

RUN = "run_id string, start date, end date"
BAR = "ticker string, date date, open double, close double"
WEIGHT = "run_id string, date date, ticker string, weight double"


def _days(n, start="2026-01-01"):
    first = day(start)
    return [first + dt.timedelta(days=i) for i in range(n)]


def test_two_price_run(spark):
    days = _days(3)
    bars = frame(spark, [("A", d, p, p) for d, p in zip(days, (100.0, 100.0, 110.0))], BAR)
    runs = frame(spark, [("r", days[0], days[-1])], RUN)
    targets = buy_and_hold(run_timeline(runs, bars), frame(spark, [("r", "A")], "run_id string, ticker string"))
    ledger = simulate(fold_rows(runs, targets, bars), costs=Costs(starting_cash=1000.0, cash_buffer=0.0))
    curve = {r["ts"]: r["equity"] for r in equity_curve(ledger, runs, bars, bars, starting_cash=1000.0).collect()}
    assert [curve[d] for d in days] == [1000.0, 1000.0, 1100.0]
    assert fill_log(ledger).count() == 1


def test_held_book_and_its_twin_when_buys_fail(spark, tmp_path):
    """Opens far above the close: a buy beyond the cash fails, a name that ends hands its money back."""
    line = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date")

    def sold(name, when, price):
        return (1, 1, name, 1, 1.0, price, 0.05, 0.0, "A", "F", day(when))

    rows = [sold(n, d, 100.0) for n in range(5) for d in ("1995-06-01", "1996-01-01")]
    rows += [sold(0, "1996-01-02", 100.0), sold(1, "1996-01-02", 600.0), sold(2, "1996-01-02", 500.0),
             sold(3, "1996-01-04", 45.0), sold(4, "1996-01-02", 250.0), sold(4, "1996-01-08", 260.0), sold(0, "1996-01-09", 80.0)]
    frame(spark, rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    tables = Tables(spark, str(tmp_path))
    for name in ("buy_and_hold_fills", "buy_and_hold_equity"):
        got = ENTRIES[name].build(tables)
        want = con.execute(ENTRIES[name].sql)
        order = [c[0] for c in want.description]
        assert tuples(got.select(*order)) == sorted(want.fetchall())
    assert {r["ticker"] for r in buy_and_hold_fills(tables).collect()} == {"S0", "S1", "S4", "S3"}


def brute_force(bars, timeline, targets, costs, delist=lambda p: p):
    """The event rules day by day, over plain lists."""
    history = {}
    for t, d, o, c in sorted(bars):
        history.setdefault(t, []).append((d, o, c))
    dates = {t: [d for d, _, _ in h] for t, h in history.items()}

    def close(t, now):
        i = bisect.bisect_right(dates[t], now) - 1
        return history[t][i][2] if i >= 0 else None

    cash, held, orders, curve, log = costs.starting_cash, {}, [], {}, []
    for now in timeline:
        waiting = []
        for made, t, side, qty in orders:
            i = bisect.bisect_right(dates[t], made)
            if i >= len(dates[t]) or dates[t][i] > now:
                waiting.append((made, t, side, qty))
                continue
            slip = history[t][i][1] * costs.slippage_bps / 10_000
            if side == "buy":
                price = history[t][i][1] + slip
                if price * qty + costs.commission_per_share * qty > cash:
                    log.append((dates[t][i], t, side, "rejected"))
                    continue
                cash -= price * qty + costs.commission_per_share * qty
                held[t] = held.get(t, 0.0) + qty
            else:
                price = history[t][i][1] - slip
                qty = min(qty, held.get(t, 0.0))
                if qty <= 0:
                    continue
                cash += price * qty - costs.commission_per_share * qty
                held[t] -= qty
                if held[t] <= 0:
                    del held[t]
            log.append((dates[t][i], t, side, "filled"))
        orders = waiting
        for t in list(held):
            if dates[t][-1] < now:
                cash += held.pop(t) * delist(history[t][-1][2])
                log.append((now, t, "sell", "delisted"))
        equity = cash + sum(q * close(t, now) for t, q in held.items())
        if now in targets:
            want = {t: w for t, w in targets[now].items()}
            sells, buys = [], []
            for t in sorted(set(want) | set(held)):
                price = close(t, now)
                if price is None:
                    continue
                delta = equity * (1 - costs.cash_buffer) * want.get(t, 0.0) / price - held.get(t, 0.0)
                if delta < 0:
                    sells.append((now, t, "sell", -delta))
                elif delta > 0:
                    buys.append((now, t, "buy", delta))
            orders += sells + buys
        curve[now] = equity
    return curve, sorted(log)


@pytest.mark.parametrize("buffer", [0.0, 0.05])
def test_book_equals_day_by_day(spark, buffer):
    rng = random.Random(11)
    days = _days(80)
    names = [f"N{i}" for i in range(8)]
    bars = []
    for i, t in enumerate(names):
        last = 50 if i == 2 else 79
        price = 20.0 + i
        for j, d in enumerate(days[: last + 1]):
            price *= 1 + rng.uniform(-0.05, 0.05)
            if j in (0, last) or rng.random() < 0.6:
                bars.append((t, d, price * (1 + rng.uniform(-0.01, 0.01)), price))
    costs = Costs(starting_cash=10_000.0, commission_per_share=0.01, slippage_bps=5.0, cash_buffer=buffer)
    targets, rows, spans = {}, [], {"one": (days[0], days[-1]), "two": (days[10], days[60])}
    for run, (a, z) in spans.items():
        inside = [d for d in days if a <= d <= z]
        plan = {}
        for d in inside[::7]:
            chosen = rng.sample(names, 3)
            plan[d] = {t: 1 / 3 for t in chosen}
            rows += [(run, d, t, 1 / 3) for t in chosen]
        targets[run] = (inside, plan)
    df = frame(spark, bars, BAR)
    runs = frame(spark, [(r, *s) for r, s in spans.items()], RUN)
    ledger = simulate(
        fold_rows(runs, frame(spark, rows, WEIGHT), df), costs=costs, delisting_price=lambda p: p * 0.9
    )
    curve = {(r["run_id"], r["ts"]): r["equity"] for r in
             equity_curve(ledger, runs, df, df, starting_cash=costs.starting_cash).collect()}
    log = ledger.where("status <> 'waiting'").collect()
    for run, (inside, plan) in targets.items():
        own = [b for b in bars if spans[run][0] <= b[1] <= spans[run][1]]
        want, want_log = brute_force(own, inside, plan, costs, lambda p: p * 0.9)
        assert len(want) == len(inside)
        for d in inside:
            assert curve[(run, d)] == pytest.approx(want[d], rel=1e-12)
        mine = sorted((r["date"], r["ticker"], r["side"], "delisted" if r["kind"] == "delisted" else r["status"])
                      for r in log if r["run_id"] == run)
        assert mine == want_log
    assert orders_by_status(ledger, "rejected").count() > 0 or buffer
    marked = marked_positions(positions(ledger), run_timeline(runs, df), df, runs)
    assert marked.where("qty <= 0 OR current_price IS NULL").count() == 0


def test_weights_rules(spark):
    days = _days(7)
    timeline = frame(spark, [("r", d) for d in days], "run_id string, date date")
    steps = every_nth(timeline, 3)
    assert [r["date"] for r in steps.orderBy("date").collect()] == [days[0], days[3], days[6]]
    both = frame(spark, [("r", "A"), ("r", "B")], "run_id string, ticker string")
    assert equal_weight(steps, both).where("weight = 0.5").count() == 6
    closes = {"AAPL": (100.0, 110.0, 120.0), "MSFT": (100.0, 102.0, 105.0), "GOOG": (100.0, 95.0, 90.0)}
    bars = frame(spark, [(t, d, p, p) for t, ps in closes.items() for d, p in zip(days, ps)], BAR)
    symbols = frame(spark, [("r", t) for t in closes], "run_id string, ticker string")
    at = frame(spark, [("r", days[2])], "run_id string, date date")
    got = tuples(momentum_weights(at, symbols, bars, lookback=2, k=2).select("ticker", "weight"))
    assert got == [("AAPL", 0.5), ("MSFT", 0.5)]
    early = frame(spark, [("r", days[1])], "run_id string, date date")
    assert momentum_weights(early, symbols, bars, lookback=2, k=2).count() == 0
    assert default_momentum_k(5) == 2 and default_momentum_k(1) == 1
    for bad in (lambda: default_momentum_k(3, 4), lambda: every_nth(timeline, 0), lambda: Costs(cash_buffer=1.0),
                lambda: CostAware(max_weight=0.0), lambda: Costs(starting_cash=-1.0)):
        with pytest.raises(ValueError):
            bad()


def test_score_proportional(spark):
    d = day("2026-01-01")
    rows = [("a", d, "X", 0.03), ("a", d, "Y", 0.01), ("a", d, "Z", -0.02), ("b", d, "X", -1.0), ("b", d, "Y", 0.0),
            ("b", d, "Z", -2.0), ("c", d, "X", 0.035), ("c", d, "Y", 0.14)]
    got = {(r["run_id"], r["ticker"]): r["weight"] for r in
           score_proportional(frame(spark, rows, "run_id string, date date, ticker string, score double")).collect()}
    assert got == {("a", "X"): 0.75, ("a", "Y"): 0.25, ("b", "X"): 0.333333, ("b", "Y"): 0.333333, ("b", "Z"): 0.333333,
                   ("c", "X"): 0.2, ("c", "Y"): 0.8}


def test_trades_and_checks(spark):
    d = day("2026-01-01")
    targets = frame(spark, [("r", d, "A", 0.5), ("r", d, "B", 0.5)], WEIGHT)
    held = frame(spark, [("r", d, "B", 10.0), ("r", d, "C", 5.0)], "run_id string, date date, ticker string, qty double")
    equity = frame(spark, [("r", d, 1000.0)], "run_id string, date date, equity double")
    closes = frame(spark, [("A", d, 10.0), ("B", d, 50.0), ("C", d, 20.0)], "ticker string, date date, close double")
    got = tuples(trades(targets, held, equity, closes, cash_buffer=0.02).select("side_order", "ticker", "side", "qty"))
    assert got[0][:3] == (0, "B", "sell") and got[0][3] == pytest.approx(0.2)
    assert got[1] == (0, "C", "sell", 5.0) and got[2][:3] == (1, "A", "buy") and got[2][3] == pytest.approx(49.0)
    assert trades(targets, held, equity, closes, min_notional=50.0).count() == 2
    over = frame(spark, [("r", d, "A", 0.7), ("r", d, "B", 0.5), ("s", d, "A", -0.1), ("t", d, "A", 1.0)], WEIGHT)
    assert {r["run_id"] for r in bad_weights(over).collect()} == {"r", "s"}


def _priced(rets):
    days = _days(len(next(iter(rets.values()))) + 1)
    rows = []
    for t, rs in rets.items():
        price = 100.0
        rows.append((t, days[0], price, price))
        for d, r in zip(days[1:], rs):
            price *= 1 + r
            rows.append((t, d, price, price))
    return days, rows


def test_mean_variance(spark):
    sign = [1, -1] * 5
    days, rows = _priced({"A": [0.01 * s for s in sign], "B": [-0.01 * s for s in sign]})
    keys = frame(spark, [("r", days[-1], t) for t in "AB"], "run_id string, date date, ticker string")
    w = mean_variance_weights(return_windows(keys, frame(spark, rows, BAR), lookback=10), ridge=1e-6)
    assert all(abs(r["weight"] - 0.5) < 1e-4 for r in w.collect()) and w.count() == 2
    days, rows = _priced({"A": [0.001 * s for s in sign], "B": [0.05 * s for s in (1, 1, -1, -1) * 2 + (1, -1)]})
    calm = {r["ticker"]: r["weight"] for r in mean_variance_weights(
        return_windows(keys, frame(spark, rows, BAR), lookback=10)).collect()}
    assert calm["A"] > 0.9
    assert return_windows(keys, frame(spark, rows, BAR), lookback=11).count() == 0
    with pytest.raises(ValueError):
        mean_variance_weights(keys, mode="other")


def test_covariance_matches_numpy(spark):
    rng = np.random.default_rng(2)
    rets = {t: rng.normal(0, 0.02, 12).tolist() for t in "ABC"}
    days, rows = _priced(rets)
    keys = frame(spark, [("r", days[-1], t) for t in "ABC"], "run_id string, date date, ticker string")
    got = covariance_rows(return_windows(keys, frame(spark, rows, BAR), lookback=8), ridge=0.5, scale=2.0)
    m = np.array([r["cov"] for r in got.orderBy("pos").collect()])
    want = np.cov(np.array([rets[t][-8:] for t in "ABC"]), ddof=1) * 2 + 0.5 * np.eye(3)
    assert np.allclose(m, want, atol=1e-12)


def _baskets(spark, seed=3, names=23, observations=6):
    """Windows of three rebalances, one of them with a single name and one with more names than observations."""
    rng = np.random.default_rng(seed)
    common = rng.normal(0, 0.03, observations)
    rows = [("r", day(f"2020-0{d}-01"), f"N{i:02d}", (common * rng.random() + rng.normal(0.002 * (i % 5), 0.02, observations)).tolist())
            for d, n in ((1, names), (2, 3), (3, 1)) for i in range(n)]
    return rows, frame(spark, rows, "run_id string, date date, ticker string, rets array<double>").repartition(4)


def test_covariance_of_blocks(spark):
    rows, windows = _baskets(spark)
    got = {(r.date, r.i, r.j): r.cov for r in covariance_pairs(windows, ridge=0.5, scale=2.0, block=4).collect()}
    assert len(got) == 23 * 24 // 2 + 3 * 4 // 2
    for d, n in ((day("2020-01-01"), 23), (day("2020-02-01"), 3)):
        want = np.cov(np.array([r[3] for r in rows if r[1] == d]), ddof=1) * 2 + 0.5 * np.eye(n)
        for i in range(n):
            for j in range(i, n):
                assert abs(got[d, i, j] - want[i, j]) < 1e-12


def test_a_basket_travels_in_few_blocks(spark, monkeypatch):
    """Names of a basket go to their pairs in blocks, a few rows per basket, and every pair is there once."""
    rng, stored = np.random.default_rng(3), []

    def keep(df):
        stored.append(df.count())
        return cut(df)

    monkeypatch.setattr(frontier, "cut", keep)
    rets = rng.normal(0, 0.1, (600, 5))
    rows = [("b", day("2020-01-01"), f"T{i:04d}", [float(x) for x in r]) for i, r in enumerate(rets)]
    windows = frame(spark, rows, "run_id string, date date, ticker string, rets array<double>")
    out = covariance_pairs(windows, ridge=0.5)
    assert stored == [3] and dict(out.dtypes) == {"run_id": "string", "date": "date", "i": "bigint", "j": "int", "cov": "double"}
    got = out.toPandas().sort_values(["i", "j"])
    i, j = np.triu_indices(600)
    assert (got["i"] == i).all() and (got["j"] == j).all()
    assert np.abs(got["cov"].to_numpy() - (np.cov(rets, ddof=1) + 0.5 * np.eye(600))[i, j]).max() < 1e-12


def test_returns_travel_a_few_times_whatever_the_names(spark, monkeypatch):
    """A block goes to every block of its basket, so the number of blocks is what a name's returns are multiplied by."""
    stored = []

    def keep(df):
        stored.append(df.count())
        return cut(df)

    monkeypatch.setattr(frontier, "cut", keep)
    rets = np.random.default_rng(4).normal(0, 0.1, (2000, 3))
    windows = frame(spark, [("b", day("2020-01-01"), f"T{i:04d}", r.tolist()) for i, r in enumerate(rets)],
                    "run_id string, date date, ticker string, rets array<double>")
    out = covariance_pairs(windows).agg(F.count("*").alias("n"), F.sum("cov").alias("all")).first()
    assert stored == [4] and out.n == 2000 * 2001 // 2
    want = np.cov(rets, ddof=1)
    assert abs(out["all"] - np.triu(want).sum()) < 1e-6


@pytest.mark.parametrize("mode,aversion,ridge", [("min_var", 1.0, 1e-6), ("min_var", 1.0, 0.0), ("mean_var", 3.0, 1e-4),
                                                 ("mean_var", 50.0, 1e-6), ("mean_var", 0.0, 1e-6)])
def test_weights_reach_the_optimum(spark, mode, aversion, ridge):
    rows, windows = _baskets(spark)
    got = {(r.date, r.ticker): r.weight for r in mean_variance_weights(windows, mode=mode, risk_aversion=aversion, ridge=ridge).collect()}
    assert len(got) == 26
    for d in ("2020-01-01", "2020-02-01"):
        part = [r for r in rows if r[1] == day(d)]
        returns = np.array([r[3] for r in part])
        quad = np.cov(returns, ddof=1) + ridge * np.eye(len(part))
        quad, lin = (quad, np.zeros(len(part))) if mode == "min_var" else (aversion * quad, returns.mean(axis=1))
        w = np.array([got[r[1], r[2]] for r in part])
        assert w.min() >= 0 and abs(w.sum() - 1) < 3e-5
        w = w / w.sum()
        value = 0.5 * w @ quad @ w - lin @ w
        slopes = quad @ w - lin
        # Weights are cut to six digits; the gap bounds the distance to the optimum.
        assert w @ slopes - slopes.min() < 5e-5 * max(abs(w @ slopes), 1e-3)
        assert value <= 0.5 * quad.mean() - lin.mean() + 1e-12
    told = basket_status(windows, mode=mode, risk_aversion=aversion, ridge=ridge).collect()
    assert sorted(r.n_names for r in told) == [3, 23]
    assert all(r.converged and r.sums_to_one and r.long_only and r.optimal for r in told)


def test_unsolved_baskets_are_told(spark):
    _, windows = _baskets(spark)
    rows = centred(windows).cache()
    state = solve_baskets(rows, mode="mean_var", risk_aversion=3.0, ridge=1e-6, rounds=1)
    assert not any(r.done for r in state.collect())
    assert mean_variance_weights(windows.limit(0)).count() == 0


def test_a_step_may_be_far_too_long(spark):
    """Heavy tails leave few names held; the way to the others is then a tiny part of a Newton step."""
    rets = np.random.default_rng(211).lognormal(0, 2.0, (20, 6)) - 1
    windows = frame(spark, [("b", day("2020-01-01"), f"N{i:02d}", r.tolist()) for i, r in enumerate(rets)],
                    "run_id string, date date, ticker string, rets array<double>")
    told, = basket_status(windows, mode="mean_var", risk_aversion=3.0).collect()
    assert told.n_names == 20 and told.converged and told.sums_to_one and told.long_only and told.optimal


def test_weights_are_divided_by_their_own_sum(spark):
    """The total a solve ended with carries the rounding of another order of addition."""
    rows = frame(spark, [("b", day("2020-01-01"), t, mu, [0.1, -0.1]) for t, mu in (("A", 0.3), ("B", 0.2), ("C", -9.0))],
                 "run_id string, date date, ticker string, mu double, dev array<double>")
    state = frame(spark, [("b", day("2020-01-01"), [0.0, 0.0, 0.5], 1e-6, 1.5e6 * (1 + 1e-8), True)],
                  "run_id string, date date, held array<double>, p double, total double, done boolean")
    got = {r.ticker: r.weight for r in frontier._weights(rows, state).collect()}
    assert got["C"] == 0 and abs(got["A"] - 8 / 15) < 1e-12 and abs(sum(got.values()) - 1) < 1e-12


def test_names_are_added_up_in_blocks(spark, monkeypatch):
    _, windows = _baskets(spark)
    rows = centred(windows).cache()
    ends = []
    for names in (4, 4096):
        monkeypatch.setattr(frontier, "NAMES", names)
        ends.append({r.date: r.x for r in solve_baskets(rows, mode="mean_var", risk_aversion=3.0, ridge=1e-6, rounds=2).collect()})
    assert frontier._blocks(rows).count() == 2 and len(ends[0]) == 2
    for d, x in ends[0].items():
        assert np.allclose(x, ends[1][d], rtol=1e-9, atol=1e-12)


def test_windows_are_cut_from_one_row_of_closes(spark):
    """A key takes its stretch of its symbol's closes; no row per key and return is made or grouped."""
    closes = [1.0, 2.0, 3.0, 6.0, 0.0]
    bars = frame(spark, [(t, day(f"2020-01-0{i + 1}"), c) for t in "AB" for i, c in enumerate(closes)], "ticker string, date date, close double")
    keys = frame(spark, [("b", day(d), t, day(s)) for d, t, s in (
        ("2020-01-04", "A", "2020-01-02"), ("2020-01-04", "B", "2020-01-03"), ("2020-01-05", "A", "2020-01-01"),
        ("2020-01-02", "A", "2020-01-01"), ("2020-01-06", "B", "2020-01-01"))], "run_id string, date date, ticker string, start date")
    out = return_windows(keys, bars, lookback=2)
    assert sorted((str(r.date), r.ticker, r.rets) for r in out.collect()) == [
        ("2020-01-04", "A", [0.5, 1.0]), ("2020-01-05", "A", [1.0, -1.0]), ("2020-01-06", "B", [1.0, -1.0])]
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_solver_reaches_the_optimum():
    rng = np.random.default_rng(7)
    for n, upper in ((2, 1.0), (20, 1.0), (30, 0.1)):
        a = rng.normal(size=(n, n + 5))
        quad, lin = a @ a.T / n, rng.normal(size=n)
        w = solve_long_only(quad, lin, upper)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= upper + 1e-9
        # No feasible direction improves: compare with many random feasible points near and far.
        best = 0.5 * w @ quad @ w - lin @ w
        for _ in range(200):
            v = project_capped_simplex(w + rng.normal(scale=rng.choice([1e-3, 1.0]), size=n), upper)
            assert 0.5 * v @ quad @ v - lin @ v >= best - 1e-8
    assert cut_weights(np.array([0.0, -1.0])).tolist() == [0.5, 0.5]


def test_cost_aware_pulls_to_the_held_book(spark):
    cov, mu = 0.04 * np.eye(3), np.array([0.05, 0.0, -0.05])
    held = np.array([0.0, 0.0, 1.0])
    free = cost_aware_step(cov, mu, held, risk_aversion=1.0, turnover_aversion=0.0, max_weight=1.0)
    stuck = cost_aware_step(cov, mu, held, risk_aversion=1.0, turnover_aversion=1000.0, max_weight=1.0)
    capped = cost_aware_step(cov, mu, held, risk_aversion=1.0, turnover_aversion=0.0, max_weight=0.1)
    assert free[0] > 0.9 and stuck[2] > 0.99 and np.allclose(capped, 1 / 3, atol=1e-6)

    rng = np.random.default_rng(1)
    days, rows = _priced({t: rng.normal(0, 0.01, 12).tolist() for t in ("AAA", "BBB", "CCC")})
    bars = frame(spark, rows, BAR)
    chosen = [("r", days[i], t, s, k + 1) for i in (6, 9) for k, (t, s) in enumerate((("AAA", 0.3), ("BBB", 0.2), ("CCC", 0.1)))]
    picked = frame(spark, chosen, "run_id string, date date, ticker string, score double, rank int")
    runs = frame(spark, [("r", days[0], days[-1])], RUN)
    inputs = cost_aware_inputs(picked, bars, lookback=4)
    mu_sum = inputs.groupBy("date").agg(F.sum("mu").alias("s")).collect()
    assert len(mu_sum) == 2 and all(abs(r["s"]) < 1e-12 for r in mu_sum)
    ledger = simulate(fold_rows(runs, inputs, bars), choice=CostAware(turnover_aversion=1.0))
    fills = fill_log(ledger).collect()
    assert {r["decided_at"] for r in fills} == {days[6], days[9]}
    assert all(r["date"] == r["decided_at"] + dt.timedelta(days=1) for r in fills)


def test_repeated_symbols(spark):
    rows = [("a", "X"), ("a", "Y"), ("a", "X"), ("b", "X"), ("b", None), ("b", None)]
    assert tuples(repeated_symbols(frame(spark, rows, "run_id string, ticker string"))) == [("a", "X", 2), ("b", None, 2)]
