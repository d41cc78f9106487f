"""Column functions on times, durations, losses and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference: duration units, band names and cuts in minutes.
NO_DURATION = "—"
DURATION_UNITS = ("seg", "min", "h", "dias")
OPENSTACK_CUTS = [1440, 60, 10, 1, 0]
OPENSTACK_BANDS = ["> 1 dia", "1h — 1 dia", "10 min — 1h", "1 — 10 min", "0 — 1 min", "Simultâneo", "Reativo (< 0)"]
HDFS_CUTS = [480, 60, 10, 1, 0]
HDFS_BANDS = ["> 8 horas", "1h — 8h", "10 min — 1h", "1 — 10 min", "0 — 1 min", "Simultâneo (0 min)", "Reativo (< 0)"]
LEAD_EDGES = [0, 1, 5, 15, 30, 60, 120, 300, 600]
SHORT_LEAD_EDGES = [0, 10, 20, 30]


def epoch_ts(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Signed minutes from ``earlier`` to ``later``."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(6e7)


def duration_text(minutes: Column) -> Column:
    """Readable duration with one decimal; null gives a dash."""
    seconds, mins, hours, days = DURATION_UNITS

    def text(value: Column, unit: str) -> Column:
        return F.concat(F.translate(F.format_number(value, 1), ",", ""), F.lit(f" {unit}"))

    size = F.abs(minutes)
    return (
        F.when(minutes.isNull() | F.isnan(minutes), F.lit(NO_DURATION))
        .when(size < 1, text(minutes * 60, seconds))
        .when(size < 60, text(minutes, mins))
        .when(size < 1440, text(minutes / 60, hours))
        .otherwise(text(minutes / 1440, days))
    )


def band(minutes: Column, cuts: list[float] = OPENSTACK_CUTS, names: list[str] = OPENSTACK_BANDS) -> Column:
    """Lead-time band: above each cut in turn, equal to the last, below it."""
    out = F.when(minutes.isNull(), F.lit(None).cast("string"))
    for cut, name in zip(cuts, names):
        out = out.when(minutes > cut, F.lit(name))
    return out.when(minutes == cuts[-1], F.lit(names[-2])).otherwise(F.lit(names[-1]))


def edges_below(value: Column, edges: list[float], strict: bool = False) -> Column:
    """How many of a short list of ``edges`` are <= value (< value when ``strict``)."""
    listed = F.lit([float(e) for e in edges])
    return F.when(
        value.isNotNull(), F.size(F.filter(listed, lambda e: e < value if strict else e <= value))
    )


def bucketize(value: Column, edges: list[float]) -> Column:
    """Text of the bin [edge, next edge); the last bin is open; below the first edge null."""
    names = [f"{lo:g}-{hi:g}" for lo, hi in zip(edges, edges[1:])] + [f"{edges[-1]:g}+"]
    n = edges_below(value, edges)
    return F.when(n > 0, F.element_at(F.array(*[F.lit(x) for x in names]), n))


def perplexity(loss: Column, cap: float = 20.0) -> Column:
    """exp(loss), infinite from ``cap`` on."""
    return F.when(loss < cap, F.exp(loss)).when(loss.isNotNull(), F.lit(float("inf")))


def position_pct(pos: Column, n: Column, capped: bool = True) -> Column:
    """Position as percent of the session length."""
    pct = F.when(n > 0, 100.0 * pos / n)
    return F.when(pct > 100, 100.0).otherwise(pct) if capped else pct
