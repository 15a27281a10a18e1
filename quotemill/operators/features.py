"""Causal features of bars. Each is one or more steps of window expressions and declares how far it looks back.

In the expressions ``{p}`` is the series in order of time and ``{nN}`` a frame of the last N bars, e.g. ``{n20}``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import K
from .windows import chunked

LN2 = math.log(2)


@dataclass(frozen=True)
class Feature:
    lookback: int
    steps: tuple[dict[str, str], ...]
    out: tuple[str, ...]


def framed(text: str, series: str) -> str:
    text = re.sub(r"\{n(\d+)\}", lambda m: f"({series} rows between {int(m[1]) - 1} preceding and current row)", text)
    return text.replace("{p}", f"({series})")


def _weights(d: float, n: int) -> list[float]:
    out = [1.0]
    for k in range(1, n):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


R1 = {"r1": "ln(close / lag(close, 1) over {p})"}
TR = {"tr": "greatest(high - low, abs(high - lag(close, 1) over {p}), abs(low - lag(close, 1) over {p}))"}
DC = {"dc": "close - lag(close, 1) over {p}"}
_FRAC = " + ".join(f"({w!r}) * lag(close, {k}) over {{p}}" if k else f"({w!r}) * close" for k, w in enumerate(_weights(0.4, 10)))
_LAGS = (1, 2, 4, 8)
_YZ = 0.34 / (1.34 + 21 / 19)

FEATURES: dict[str, Feature] = {
    "ft1_log_returns": Feature(60, ({f"r{n}": f"ln(close / lag(close, {n}) over {{p}})" for n in (1, 5, 20, 60)},), ("r1", "r5", "r20", "r60")),
    "ft2_rolling_moments": Feature(20, ({"mean20": "avg(close) over {n20}", "std20": "stddev_samp(close) over {n20}"},), ("mean20", "std20")),
    "ft3_zscore": Feature(200, ({f"z{n}": f"(close - avg(close) over {{n{n}}}) / nullif(stddev_samp(close) over {{n{n}}}, 0)" for n in (20, 50, 200)},), ("z20", "z50", "z200")),
    "ft5_donchian": Feature(20, ({"position": "(close - min(low) over {n20}) / nullif(max(high) over {n20} - min(low) over {n20}, 0)"},), ("position",)),
    "ft7_hurst": Feature(
        72, ({f"d{k}": f"ln(close / lag(close, {k}) over {{p}})" for k in _LAGS}, {f"y{k}": f"ln(nullif(stddev_samp(d{k}) over {{n64}}, 0))" for k in _LAGS}, {"hurst": f"(-1.5 * y1 - 0.5 * y2 + 0.5 * y4 + 1.5 * y8) / {5 * LN2!r}"}), ("hurst",)
    ),
    "ft8_fractional_difference": Feature(10, ({"frac": _FRAC},), ("frac",)),
    "ft9_atr": Feature(51, (TR, {"atr14": "avg(tr) over {n14}", "atr50": "avg(tr) over {n50}"}), ("atr14", "atr50")),
    "ft10_realised_vol": Feature(21, (R1, {"vol20": "stddev_samp(r1) over {n20}"}), ("vol20",)),
    "ft11_parkinson": Feature(20, ({"x": "ln(high / low) * ln(high / low)"}, {"parkinson": f"sqrt((avg(x) over {{n20}}) / {4 * LN2!r})"}), ("parkinson",)),
    "ft12_garman_klass": Feature(20, ({"x": f"0.5 * ln(high / low) * ln(high / low) - {2 * LN2 - 1!r} * ln(close / open) * ln(close / open)"}, {"garman_klass": "sqrt(greatest(avg(x) over {n20}, 0))"}), ("garman_klass",)),
    "ft13_yang_zhang": Feature(
        21,
        ({"o": "ln(open / lag(close, 1) over {p})", "c": "ln(close / open)", "rs": "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"}, {"yang_zhang": f"sqrt(greatest(var_samp(o) over {{n20}} + {_YZ!r} * var_samp(c) over {{n20}} + {1 - _YZ!r} * avg(rs) over {{n20}}, 0))"}),
        ("yang_zhang",),
    ),
    "ft14_vol_of_vol": Feature(61, (R1, {"v": "stddev_samp(r1) over {n20}", "ratio": "(stddev_samp(r1) over {n5}) / nullif(stddev_samp(r1) over {n60}, 0)"}, {"vol_of_vol": "stddev_samp(v) over {n20}"}), ("vol_of_vol", "ratio")),
    "ft15_spread_to_atr": Feature(15, (TR, {"spread_to_atr": "spread_mean / nullif(avg(tr) over {n14}, 0)"}), ("spread_to_atr",)),
    "ft16_rsi": Feature(15, (DC, {"rsi": "100 * (avg(greatest(dc, 0)) over {n14}) / nullif(avg(abs(dc)) over {n14}, 0)"}), ("rsi",)),
    "ft18_momentum": Feature(64, ({"roc10": "close / lag(close, 10) over {p} - 1", **{f"sign{n}": f"cast(sign(close - lag(close, {n}) over {{p}}) as double)" for n in (8, 16, 32, 64)}},), ("roc10", "sign8", "sign16", "sign32", "sign64")),
    "ft19_breakout_age": Feature(
        220, ({"mx": "max(close) over {n20}", "mn": "min(close) over {n20}"}, {"age": "cast(rn - max(case when close >= mx or close <= mn then rn end) over {n200} as bigint)"}), ("age",)
    ),
    "ft28_roll_spread": Feature(22, (DC, {"back": "lag(dc, 1) over {p}"}, {"cov": "covar_samp(dc, back) over {n20}"}, {"roll": "case when cov < 0 then 2 * sqrt(-cov) end"}), ("roll",)),
    "ft29_amihud": Feature(21, (R1, {"amihud": "avg(abs(r1) / n_ticks) over {n20}"}), ("amihud",)),
    "ft30_adf": Feature(
        32,
        ({"x": "lag(close, 1) over {p}", "y": "close - lag(close, 1) over {p}"}, {"cxy": "covar_samp(x, y) over {n30}", "vx": "var_samp(x) over {n30}", "vy": "var_samp(y) over {n30}", "m": "count(x) over {n30}"}, {"beta": "cxy / nullif(vx, 0)"}, {"adf": "case when m = 30 then beta / nullif(sqrt(greatest((vy - beta * cxy) * 29 / 28 / (29 * vx), 0)), 0) end"}),
        ("adf",),
    ),
    "ft31_adx": Feature(
        29,
        ({**TR, "up": "high - lag(high, 1) over {p}", "dn": "lag(low, 1) over {p} - low"}, {"dp": "avg(case when up > dn and up > 0 then up else 0 end) over {n14}", "dm": "avg(case when dn > up and dn > 0 then dn else 0 end) over {n14}"}, {"dx": "100 * abs(dp - dm) / nullif(dp + dm, 0)"}, {"adx": "avg(dx) over {n14}"}),
        ("adx",),
    ),
}


def compute(bars: DataFrame, feature: Feature, chunk: int = 20_000) -> DataFrame:
    """The feature on every bar; null until ``lookback`` bars have closed."""
    df = chunked(bars, K, "ts_event", feature.lookback, chunk)
    series = "partition by venue, instrument, chunk order by rn"
    for step in feature.steps:
        df = df.withColumns({name: F.expr(framed(text, series)) for name, text in step.items()})
    ready = F.col("rn") > feature.lookback
    return df.filter("not halo").select(*K, "ts_event", "rn", *[F.when(ready, F.col(c)).alias(c) for c in feature.out])


def compute_all(bars: DataFrame, features: dict[str, Feature], chunk: int = 20_000) -> DataFrame:
    """K, ts_event and for each feature a struct of its values, all over the same chunks."""
    own = chunked(bars, K, "ts_event", max(f.lookback for f in features.values()), chunk)
    base = own.columns
    df = own
    for name, f in features.items():
        for step in f.steps:
            df = df.withColumns({n: F.expr(framed(text, SERIES)) for n, text in step.items()})
        made = F.when(F.col("rn") > f.lookback, F.struct(*f.out)).alias(name)
        df = df.select(*base, *[c for c in features if c in df.columns], made)
    return df.filter("not halo").select(*K, "ts_event", *features)


def kernel(span: int) -> list[float]:
    """Weights, newest last, of an exponential mean cut at five spans."""
    a = 2 / (span + 1)
    w = [(1 - a) ** k for k in range(5 * span)][::-1]
    return w


def ema(column: str, span: int, series: str) -> str:
    """Exponential mean over a frame of five spans, with weights that sum to one over the bars there are."""
    n, keep = 5 * span, repr(1 - 2 / (span + 1))
    frame = f"(collect_list({column}) over ({series} rows between {n - 1} preceding and current row))"
    weights = f"transform(sequence(1, size({frame})), i -> pow({keep}, size({frame}) - i))"
    return f"aggregate(zip_with({frame}, {weights}, (x, w) -> x * w), 0D, (a, x) -> a + x) / aggregate({weights}, 0D, (a, x) -> a + x)"


SERIES = "partition by venue, instrument, chunk order by rn"


def with_ema(bars: DataFrame, columns: dict[str, tuple[str, int]], lookback: int) -> DataFrame:
    """``bars`` in chunks with exponential means: name to (column, span)."""
    df = chunked(bars, K, "ts_event", lookback)
    return df.withColumns({name: F.expr(ema(column, span, SERIES)) for name, (column, span) in columns.items()})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = with_ema(bars, {"fast": ("close", fast), "slow": ("close", slow)}, 5 * slow + 5 * signal)
    df = df.withColumn("macd", F.col("fast") - F.col("slow"))
    return df.withColumn("histogram", F.col("macd") - F.expr(ema("macd", signal, SERIES))).filter("not halo")
