"""State machines of the continuous monitors; each takes a key's due rows as arrays."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

import numpy as np
import pandas as pd

from tidegauge.operators.forecast import MIN_VARIANCE
from tidegauge.streaming.inorder import SLOT, InOrder, packed, unpacked

#: Rows that the weighted average takes in one matrix product.
EWMA_BLOCK = 128
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def growths(state, rows: pd.DataFrame):
    """Growth of a counter since the row before; a fall is a reset."""
    value = rows["value"].to_numpy()
    before = np.append(np.nan if state is None else state[0], value[:-1])
    grown = np.where(value < before, value, value - before)
    known = ~np.isnan(before)
    return (float(value[-1]),), pd.DataFrame({"ts": pd.to_datetime(rows["us"][known], unit="us"), "increase": grown[known]})


def ewma(alpha: float, limit: float, tie: str):
    """Detect with the past, then update; the first row is not judged.

    A row's mean is a weighted sum of the rows before it in its block and of the
    block's start, with weights that only fall, so a block is one product.
    """
    step = np.arange(EWMA_BLOCK + 1)
    fall = (1 - alpha) ** step
    lag = step[:, None] - 1 - step[None, :-1]
    weights = np.where(lag >= 0, alpha * (1 - alpha) ** np.maximum(lag, 0), 0.0)

    def fold(state, rows: pd.DataFrame):
        value = rows["value"].to_numpy()
        start = 0
        if state is None:
            state, start = (float(value[0]), 0.0), 1
        means, spreads = [np.zeros(0)], [np.zeros(0)]
        for at in range(start, len(value), EWMA_BLOCK):
            some = value[at : at + EWMA_BLOCK]
            n = len(some)
            mean = weights[: n + 1, :n] @ some + fall[: n + 1] * state[0]
            var = weights[: n + 1, :n] @ (some - mean[:n]) ** 2 + fall[: n + 1] * state[1]
            means.append(mean[:n])
            spreads.append(np.sqrt(var[:n]))
            state = (float(mean[n]), float(var[n]))
        mean, spread = np.concatenate(means), np.concatenate(spreads)
        off = np.abs(value[start:] - mean)
        score = np.where(spread > 0, off / np.where(spread > 0, limit * spread, 1.0), (off != 0).astype(float))
        part = rows.iloc[start:]
        out = pd.DataFrame({tie: part["tie"].to_numpy(), "us": part["us"].to_numpy(), "mean_before": mean, "score": score, "is_anomaly": off > limit * spread})
        return state, out

    return fold


def refits(kept: int, every: int):
    """A model of the newest ``kept`` points whenever their number is a multiple of ``every``; once full, at each point."""

    def fold(state, rows: pd.DataFrame):
        us, value = (np.array(c) for c in (state if state is not None else ([], [])))
        held = len(us)
        us, value = np.append(us, rows["us"]).astype(np.int64), np.append(value, rows["value"])
        found = []
        for end in range(held + 1, len(us) + 1):
            if min(end, kept) % every == 0:
                some = slice(max(0, end - kept), end)
                found.append((int(us[end - 1]), min(end, kept), *fitted(us[some], value[some])))
        out = pd.DataFrame(found, columns=["at_us", "n", "slope", "intercept", "season", "variance"])
        return (us[-kept:].tolist(), value[-kept:].tolist()), out

    return fold


def fitted(us: np.ndarray, value: np.ndarray) -> tuple[float, float, list[float], float]:
    """Line, hours of the day and variance of points in order, as the batch forecast fits them."""
    x = np.arange(len(value)) - (len(value) - 1) / 2
    mean, spread = value.mean(), (x * x).sum()
    slope = float((x * (value - mean)).sum() / spread) if spread else 0.0
    left = value - mean - slope * x
    hour = us % DAY_US // HOUR_US
    count = np.bincount(hour, minlength=24)
    hours = np.bincount(hour, left, 24) / np.maximum(count, 1)
    season = hours - hours.mean()
    variance = float(((left - season[hour]) ** 2).mean())
    return slope, float(mean - slope * (len(value) - 1) / 2), season.tolist(), max(variance, MIN_VARIANCE)


def transitions(series: np.ndarray, us: np.ndarray, breach: np.ndarray, active: np.ndarray, fired: np.ndarray, hold_us: int | np.ndarray):
    """What happens to the alerts of one rule over rows sorted by (series, time).

    ``active`` and ``fired`` are the open alert of each series (-1 if none).
    Returns row numbers, transition names and alert starts of what happens, in
    row order, and the open alerts afterwards.  ``hold_us`` may differ by row.
    """
    n = len(us)
    row = np.arange(n)
    first = np.append(True, series[1:] != series[:-1])
    was = np.append(False, breach[:-1])
    was[first] = active[series[first]] >= 0
    start = breach & ~was
    # The run that a row belongs to begins at its latest start, or before these rows.
    opened = np.maximum.accumulate(np.where(start | first, row, 0))
    begun = np.where(start[opened], us[opened], active[series])
    run = np.cumsum(start | first)
    over = np.where(breach, us - begun >= hold_us, False)
    over &= ~(~start[opened] & fired[series])
    fire = np.flatnonzero(over)
    fire = fire[np.unique(run[fire], return_index=True)[1]]
    pending = np.flatnonzero(start & (hold_us > 0))
    resolved = np.flatnonzero(~breach & was)
    # The alert that ends at a row is the one of the row before it.
    ended = np.where(first[resolved], active[series[resolved]], begun[resolved - 1])
    rows = np.concatenate((pending, fire, resolved))
    names = np.repeat(["pending", "firing", "resolved"], [len(pending), len(fire), len(resolved)])
    starts = np.concatenate((begun[pending], begun[fire], ended))
    order = np.lexsort((np.repeat([0, 1, 2], [len(pending), len(fire), len(resolved)]), rows))
    last = np.flatnonzero(np.append(series[1:] != series[:-1], True))
    active, fired = active.copy(), fired.copy()
    announced = np.zeros(n + 2, bool)
    announced[run[fire]] = True
    fired[series[last]] = breach[last] & (announced[run[last]] | (~start[opened[last]] & fired[series[last]]))
    active[series[last]] = np.where(breach[last], begun[last], -1)
    return rows[order], names[order], starts[order], active, fired


def threshold(limit: float, hold_us: int):
    """One row whenever an alert of ``value > limit`` becomes pending, firing or resolved."""

    def fold(state, rows: pd.DataFrame):
        active, fired = (-1, False) if state is None else state
        us, value = rows["us"].to_numpy(), rows["value"].to_numpy()
        at, names, starts, open_since, announced = transitions(
            np.zeros(len(us), np.int64), us, value > limit, np.array([active]), np.array([fired]), hold_us
        )
        out = pd.DataFrame({"transition": names, "at_us": us[at], "active_us": starts, "value": value[at]})
        return (int(open_since[0]), bool(announced[0])), out

    return fold


def firing(limit: float, hold_us: int):
    """Only the rows at which such an alert fires."""
    every = threshold(limit, hold_us)

    def fold(state, rows: pd.DataFrame):
        state, log = every(state, rows)
        fired = log[log["transition"] == "firing"]
        return state, pd.DataFrame({"ts": pd.to_datetime(fired["at_us"], unit="us"), "at_us": fired["at_us"], "value": fired["value"]})

    return fold


# A hold that no run of breaches lasts.
_NEVER_US = np.iinfo(np.int64).max

#: Comparisons by operator; an unknown one never breaches.
_TESTS = {">": np.greater, "<": np.less, ">=": np.greater_equal, "<=": np.less_equal, "==": np.equal, "!=": np.not_equal}


class _Terms:
    """A rule before its changes (at 0) and after each of them.

    A put sets the terms and switches the rule on; after a delete only a put brings it back.
    """

    def __init__(self, before: tuple | None, changes: pd.DataFrame):
        operator, limit, hold_us, on = before if before is not None else (None, np.nan, np.nan, False)
        op = changes["op"].to_numpy(dtype=object)
        put = np.append(False, op == "put")
        place = np.arange(len(put))
        defined = np.maximum.accumulate(np.where(put | np.append(False, op == "delete"), place, 0))
        switch = put | np.append(False, op == "enable")
        switched = np.maximum.accumulate(np.where(switch | np.append(False, op == "disable"), place, 0))
        there = put.copy()
        there[0], switch[0] = before is not None, bool(on)
        self.there, self.on = there[defined], switch[switched]
        self.alive = self.there & self.on
        self.operator = np.append(np.array([operator], object), changes["operator"].to_numpy(dtype=object))[defined]
        self.limit = np.append(float(limit), changes["threshold"].to_numpy(dtype=float))[defined]
        hold = np.append(float(hold_us), changes["hold_us"].to_numpy(dtype=float))[defined]
        # Without a hold an alert stays pending.
        never = np.isnan(hold) | (hold >= _NEVER_US)
        self.hold_us = np.where(never, _NEVER_US, np.where(never, 0, hold).astype(np.int64))

    def last(self) -> tuple | None:
        """The rule as it is kept, None if it is deleted."""
        return (self.operator[-1], float(self.limit[-1]), int(self.hold_us[-1]), bool(self.on[-1])) if self.there[-1] else None

    def breached(self, value: np.ndarray, version: np.ndarray) -> np.ndarray:
        breach = np.zeros(len(value), bool)
        for symbol, test in _TESTS.items():
            some = (self.operator == symbol)[version]
            breach[some] = test(value[some], self.limit[version[some]])
        return breach & ~np.isnan(value)


class RuleTable(InOrder):
    """Rules of one metric over the series of one lane; rules change while samples go on.

    Rows are samples (``kind`` 1) and changes (0), which come first at equal
    times.  A change puts, deletes, enables or disables a rule; what it closes
    is resolved at its time, and a put goes on with the open alerts.
    """

    COLUMNS = ["us", "kind", "tie", "series", "value", "rule", "op", "operator", "threshold", "hold_us"]

    def __init__(self, keys: list[str], slot: timedelta = SLOT):
        super().__init__(keys, self.COLUMNS, ["us", "kind", "tie"], slot)

    def open(self, handle) -> None:
        self._rules = handle.getMapState("rules", "rule string", "operator string, threshold double, hold_us bigint, enabled boolean")
        self._alerts = handle.getMapState("alerts", "rule string", "series array<string>, active array<bigint>, fired array<boolean>")

    def advance(self, rows, now):
        if rows is None or rows.empty:
            return None
        rules = {k[0]: tuple(v) for k, v in self._rules.iterator()}
        place = np.arange(len(rows))
        changed = rows["kind"].to_numpy() == 0
        changes = rows[changed].assign(place=place[changed])
        by_rule = {None if pd.isna(rule) else rule: part for rule, part in changes.groupby("rule", sort=False, dropna=False)}
        samples = rows[~changed]
        series, names = pd.factorize(samples["series"])
        sampled = (series, names, place[~changed], samples["us"].to_numpy(), samples["value"].to_numpy(dtype=float))
        found = [self._judged(name, rules.get(name), by_rule.get(name, changes[:0]), *sampled) for name in {**rules, **by_rule}]
        found = [log for log in found if log is not None]
        return pd.concat(found, ignore_index=True) if found else None

    def _judged(self, name, before, changes: pd.DataFrame, series, names, place, us, value) -> pd.DataFrame | None:
        """What happens to one rule's alerts while it changes; rows are told apart by their place among all rows."""
        terms = _Terms(before, changes)
        if len(changes):
            after = terms.last()
            if after is not None:
                self._rules.updateValue((name,), after)
            elif before is not None:
                self._rules.removeKey((name,))
        since = changes["place"].to_numpy()
        version = np.searchsorted(since, place)
        on = terms.alive[version]
        series, place, us, value, version = series[on], place[on], us[on], value[on], version[on]
        breach = terms.breached(value, version)
        known = self._open(name)
        if not breach.any() and not known:
            return None
        # Series with an open alert may have no sample here.
        held = list(known)
        names = names.append(pd.Index(held, dtype=object).difference(names, sort=False))
        held = names.get_indexer(held)
        active, fired = np.full(len(names), -1, np.int64), np.zeros(len(names), bool)
        if len(held):
            active[held], fired[held] = zip(*known.values())
        # A change after which the rule is not there is a row that breaches nothing, for each series that it may find open.
        ends = np.flatnonzero(~terms.alive[1:])
        opened = np.concatenate((held, series[breach]))
        end = np.searchsorted(since[ends], np.concatenate((np.full(len(held), -1), place[breach])))
        pairs = np.unique(opened[end < len(ends)] * (len(ends) + 1) + end[end < len(ends)])
        closed, end = pairs // (len(ends) + 1), ends[pairs % (len(ends) + 1)]
        n = len(closed)
        series = np.concatenate((series, closed))
        if not len(series):
            return None
        order = np.lexsort((np.concatenate((place, since[end])), series))
        us = np.concatenate((us, changes["us"].to_numpy(np.int64)[end]))[order]
        value = np.concatenate((value, np.full(n, np.nan)))[order]
        breach = np.concatenate((breach, np.zeros(n, bool)))[order]
        hold_us = np.concatenate((terms.hold_us[version], np.zeros(n, np.int64)))[order]
        series = series[order]
        at, what, starts, active, fired = transitions(series, us, breach, active, fired, hold_us)
        left = np.flatnonzero(active >= 0)
        self._store(name, {names[i]: (int(active[i]), bool(fired[i])) for i in left})
        return _log(name, names[series[at]], what, us[at], starts, value[at]) if len(at) else None

    def _open(self, rule: str) -> dict[str, tuple[int, bool]]:
        """Open alerts of a rule by series."""
        stored = self._alerts.getValue((rule,))
        return {s: (a, f) for s, a, f in zip(*stored)} if stored is not None else {}

    def _store(self, rule: str, known: dict[str, tuple[int, bool]]) -> None:
        if known:
            self._alerts.updateValue((rule,), (list(known), [a for a, _ in known.values()], [f for _, f in known.values()]))
        elif self._alerts.containsKey((rule,)):
            self._alerts.removeKey((rule,))


def _log(rule, series, transition, us, active, value) -> pd.DataFrame:
    return pd.DataFrame({"rule": rule, "series": series, "transition": transition, "at_us": us, "active_us": active, "value": value})


class SlidingSums(InOrder):
    """Counter growth summed over look-back spans, from sums per pane.

    A pane is as long as the step between windows; a growth is added to its own
    pane once, and a window that ends is the sum of the panes before it.
    """

    def __init__(self, keys: list[str], span_us: int, every_us: int, origin_us: int, slot: timedelta = SLOT):
        super().__init__(keys, ["us", "tie", "value"], ["us", "tie"], slot)
        self._panes, self._every, self._origin = -(-span_us // every_us), every_us, origin_us

    def open(self, handle) -> None:
        self._state = handle.getValueState("state", "last double, ended bigint, pane array<bigint>, total array<double>")

    def wakes(self, rows: pd.DataFrame) -> Iterable[int]:
        panes = np.unique((rows["us"].to_numpy() - self._origin) // self._every)
        ends = np.unique(panes[:, None] + 1 + np.arange(self._panes)[None, :])
        return (int(e) * self._every + self._origin for e in ends)

    def advance(self, rows, now):
        last, ended, pane, total = self._state.get() if self._state.exists() else (None, None, [], [])
        pane, total = np.array(pane, np.int64), np.array(total, float)
        if rows is not None and len(rows):
            value = rows["value"].to_numpy()
            before = np.append(np.nan if last is None else last, value[:-1])
            known = ~np.isnan(before)
            grown = np.where(value < before, value, value - before)[known]
            pane = np.append(pane, (rows["us"].to_numpy()[known] - self._origin) // self._every)
            total = np.append(total, grown)
            last = float(value[-1])
        pane, inverse = np.unique(pane, return_inverse=True)
        total = np.bincount(inverse, total, len(pane)) if len(pane) else np.zeros(0)
        # Windows that end up to now and have not been given yet; window e holds the panes e - n .. e - 1.
        upto = (now - self._origin) // self._every
        ends = np.unique(pane[:, None] + 1 + np.arange(self._panes)[None, :]) if len(pane) else np.zeros(0, np.int64)
        ends = ends[(ends <= upto) & (ends > (ended if ended is not None else np.iinfo(np.int64).min))]
        sums = np.array([total[(pane >= e - self._panes) & (pane < e)].sum() for e in ends])
        ended = int(max(upto, ended if ended is not None else upto))
        kept = pane + self._panes > ended
        if last is not None:
            self._state.update((last, ended, pane[kept].tolist(), total[kept].tolist()))
        if not len(ends):
            return None
        return pd.DataFrame({"window_us": ends * self._every + self._origin, "increase": sums})


class Health(InOrder):
    """Status changes of a node: silence longer than one and than three timeouts, and the beat that ends it.

    Beats that are due settle the outages between them.  For each beat that
    arrives without another one within the timeout, timers are set at the ends of
    its two silences; one that a later beat has overtaken finds nothing to do.
    """

    def __init__(self, node: str, timeout_us: int, offline_after: int, slot: timedelta = SLOT):
        super().__init__([node], ["us"], ["us"], slot)
        self._steps = (("unhealthy", timeout_us), ("offline", timeout_us * offline_after))

    def open(self, handle) -> None:
        self._seen = handle.getValueState("seen", "us bigint, told int")

    def wakes(self, rows: pd.DataFrame) -> Iterable[int]:
        us = np.sort(rows["us"].to_numpy())
        quiet = us[np.append(np.diff(us) > self._steps[0][1], True)]
        return (int(at) + after + 1 for at in quiet for _, after in self._steps)

    def advance(self, rows, now):
        seen, told = self._seen.get() if self._seen.exists() else (None, 0)
        found = []
        if rows is not None and len(rows):
            us = rows["us"].to_numpy()
            if seen is None:
                found.append((us[:1], us[:1], "healthy"))
                seen, told = int(us[0]), 0
            before = np.append(seen, us[:-1])
            silence = us - before
            already = np.append(told, np.zeros(len(us) - 1, np.int64))
            for number, (status, after) in enumerate(self._steps, 1):
                late = (silence > after) & (already < number)
                found.append((before[late] + after, before[late], status))
            back = silence > self._steps[0][1]
            found.append((us[back], us[back], "healthy"))
            seen, told = int(us[-1]), 0
        if seen is None:
            return None
        for number, (status, after) in enumerate(self._steps, 1):
            if told < number and now > seen + after:
                found.append((np.array([seen + after]), np.array([seen]), status))
                told = number
        self._seen.update((seen, told))
        parts = [pd.DataFrame({"at_us": at, "status": status, "last_seen_us": last}) for at, last, status in found if len(at)]
        return pd.concat(parts, ignore_index=True) if parts else None


class FleetHealth(Health):
    """The same for all nodes of one lane.

    The first timer of a batch feeds all that is due, slot by slot, and then
    tells the outages that the watermark has passed; the next silence of the lane
    to end sets one timer.  Nodes are taken together as arrays, so a timer costs
    the same for one node as for thousands.
    """

    def __init__(self, keys: list[str], node: str, timeout_us: int, offline_after: int, slot: timedelta = SLOT):
        super().__init__(node, timeout_us, offline_after, slot)
        self._keys, self._columns, self._node = keys, [node, "us"], node

    def open(self, handle) -> None:
        # Nodes with their latest beat and how many steps of the silence since then are told.
        self._seen = handle.getValueState("seen", "nodes binary")
        self._settled = handle.getValueState("settled", "ms bigint")

    def wakes(self, rows: pd.DataFrame) -> Iterable[int]:
        return ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        if self._settled.exists() and self._settled.get()[0] >= watermark:
            return
        self._settled.update((watermark,))
        upto = watermark * 1000
        nodes = unpacked(self._seen.get()[0]) if self._seen.exists() else None
        for slot in self._buffer.slots(upto):
            rows, following = self._buffer.due(slot * self._width, upto)
            if following is not None:
                self._handle.registerTimer(following // 1000 + 1)
            if len(rows):
                nodes, output = self.fed(nodes, rows)
                yield from self._keyed(key, output)
        if nodes is not None:
            nodes, output, following = self.silent(nodes, upto)
            yield from self._keyed(key, output)
            if following is not None:
                self._handle.registerTimer(-(-following // 1000))
            self._seen.update((packed(nodes),))

    def fed(self, nodes: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        """Nodes after rows in order of time, and what these tell."""
        held = 0 if nodes is None else len(nodes)
        named = rows[self._node] if nodes is None else pd.concat([nodes[self._node], rows[self._node]])
        codes, names = pd.factorize(named.astype(object), use_na_sentinel=False)
        seen, told = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        if held:
            seen[:held], told[:held] = nodes["us"], nodes["told"]
        order = np.argsort(codes[held:], kind="stable")
        node, us = codes[held:][order], rows["us"].to_numpy(np.int64)[order]
        first = np.append(True, node[1:] != node[:-1])
        fresh = first & (node >= held)
        before = np.where(first, np.where(fresh, us, seen[node]), np.append(0, us[:-1]))
        already = np.where(first, told[node], 0)
        silence = us - before
        found = [(node[fresh], us[fresh], us[fresh], "healthy")]
        for number, (status, after) in enumerate(self._steps, 1):
            late = (silence > after) & (already < number)
            found.append((node[late], before[late] + after, before[late], status))
        back = silence > self._steps[0][1]
        found.append((node[back], us[back], us[back], "healthy"))
        last = np.append(first[1:], True)
        seen[node[last]], told[node[last]] = us[last], 0
        return pd.DataFrame({self._node: names, "us": seen, "told": told}), self._log(names, found)

    def silent(self, nodes: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame | None, int | None]:
        """Nodes once ``now`` has come, what has become of them, and the time at which the next step can be told."""
        seen, told = nodes["us"].to_numpy(), nodes["told"].to_numpy().copy()
        found, ends = [], []
        for number, (status, after) in enumerate(self._steps, 1):
            due = np.flatnonzero((told < number) & (seen + after < now))
            found.append((due, seen[due] + after, seen[due], status))
            told[due] = number
            ends.append(seen[told < number] + after + 1)
        ends = np.concatenate(ends)
        return nodes.assign(told=told), self._log(nodes[self._node], found), int(ends.min()) if len(ends) else None

    def _log(self, names, found: list[tuple]) -> pd.DataFrame | None:
        parts = [
            pd.DataFrame({self._node: names.take(node), "at_us": at, "status": status, "last_seen_us": last}) for node, at, last, status in found if len(at)
        ]
        return pd.concat(parts, ignore_index=True) if parts else None
