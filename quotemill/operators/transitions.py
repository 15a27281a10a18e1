"""States that pass from row to row, over series of any length: what a chunk of rows does to any state is worked out in
parallel, states at the starts of chunks follow from that, and then the chunks are walked in parallel."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import io
from .windows import blocked

#: What the rows of a chunk do to a state, as data; and the state after a chunk from the one before it and that.
Effect = Callable[[pd.DataFrame], object]
Then = Callable[[object, object], object]
#: Result rows of a chunk from the state before it.
Walk = Callable[[pd.DataFrame, object], pd.DataFrame]


def scanned(
    df: DataFrame, by: list[str], order: list[str], start: object, effect: Effect, then: Then, walk: Walk, schema: str, size: int = 20_000, sums: dict[str, str] | None = None,
) -> DataFrame:
    """``walk`` over ``df``, each chunk with the state that the rows before it leave.

    ``order`` begins with a time; chunks have ``size`` rows at most and get them sorted, with their number ``rn`` in the series and the running
    ``sums`` (a name and of what). States and effects pass as JSON, a row for each chunk, so these and one chunk are all that a task holds. The
    states are written, and rows are shuffled once for them and once for the walk.
    """
    rows = blocked(df, by, order, size, sums)
    parts = [*by, "__stretch", "chunk"]
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in parts)
    first = json.dumps(start)

    def effects(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[parts].head(1).assign(effect=json.dumps(effect(pdf.sort_values("rn"))))

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, found = pdf.sort_values(["__stretch", "chunk"]), json.loads(first), []
        for x in pdf["effect"]:
            found.append(json.dumps(state))
            state = then(state, json.loads(x))
        return pdf[parts].assign(state=found)

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        return walk(pdf.drop(columns=["__stretch", "chunk", "state"]), json.loads(pdf["state"].iloc[0]))

    states = io.settled(rows.groupBy(*parts).applyInPandas(effects, f"{keys}, effect string").groupBy(*by).applyInPandas(entries, f"{keys}, state string"), "states")
    met = [rows[c].eqNullSafe(states[c]) for c in parts]
    both = rows.join(states, met).select(*[rows[c] for c in rows.columns], "state")
    return both.groupBy(*parts).applyInPandas(walked, schema)


def held_back(wants: list[float], widths: list[float], entry: float) -> list[float]:
    """Positions that go to what is wanted only when that is at least the width away."""
    out, now = [], entry
    for want, width in zip(wants, widths, strict=True):
        if abs(want - now) >= width:
            now = want
        out.append(now)
    return out


def hold_effect(wants: list[float], widths: list[float]) -> list[tuple[float, float, float]]:
    """What ``held_back`` does to any entry, as (want, width, last position), in order: an entry that is at least the width away from the want of
    a step, the first such one, ends in that step's last position; an entry that no step moves stays.

    Only steps that some entry untouched so far can be moved by are kept; these entries are an interval that shrinks. Where a walk from a
    step ends is worked out once for each step at which walks meet.
    """
    ends: dict[int, float] = {}

    def end(at: int) -> float:
        path, k = [], at
        while k not in ends:
            path.append(k)
            nxt = next((m for m in range(k + 1, len(wants)) if abs(wants[m] - wants[k]) >= widths[m]), None)
            if nxt is None:
                ends[k] = wants[k]
            else:
                k = nxt
        for p in path:
            ends[p] = ends[k]
        return ends[at]

    low, high, out = -math.inf, math.inf, []
    for k, (want, width) in enumerate(zip(wants, widths, strict=True)):
        if width != width:  # not known, nothing moves
            continue
        near = 1e-9 * (abs(want) + width)
        if want - width > low - near or want + width < high + near:
            out.append((want, width, end(k)))
            low, high = max(low, want - width), min(high, want + width)
            if low > high + near:
                break
    return out


def after_hold(entry: float, effect: list[tuple[float, float, float]]) -> float:
    return next((last for want, width, last in effect if abs(want - entry) >= width), entry)


def average_cost(before: list[float], signed: list[float], prices: list[float]) -> tuple[float, float, float, float]:
    """(a, b, c, d): the average price after fills is a x + b and their realised profit c x + d, where x is the average price before them.

    ``before``: the position before each fill. An added quantity mixes its price in, a reduction realises against the average, and a fill
    that turns the position begins anew at its own price.
    """
    a, b, c, d = 1.0, 0.0, 0.0, 0.0
    for held, qty, price in zip(before, signed, prices, strict=True):
        size, own = abs(held), abs(qty)
        if held * qty >= 0:
            share = size / (size + own)
            a, b = a * share, b * share + price * own / (size + own)
        else:
            closed = math.copysign(min(size, own), held)
            c, d = c - closed * a, d + closed * (price - b)
            if own > size:
                a, b = 0.0, price
    return a, b, c, d
