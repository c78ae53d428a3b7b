"""Strokes, segments and pivot zones of the daily bars (ZEN); no SQL has such a fold, tests hold it against a plain walk."""

from __future__ import annotations

from ..operators import strokes
from ..sources.adapters import bars
from .catalog import query


def _bars(spark, sf_dir):
    """Bars in tasks of about 200,000 lines, as the fold costs more than their lines."""
    return bars(spark, sf_dir, rows_a_task=200_000)


@query()
def zen_factor(spark, sf_dir):
    """ZEN-1, U-3: every bar with its strokes, segments and zones, the state handed on from year to year."""
    return strokes.one_pass(_bars(spark, sf_dir), digits=6)


@query()
def zen_states(spark, sf_dir):
    """ZEN-2: the last five merged zones of each bar and the two rules on them."""
    return strokes.zones_in_one_pass(_bars(spark, sf_dir))


@query()
def shaking_factor(spark, sf_dir):
    """ZEN-3."""
    needed = [f"current_merged_{c}" for c in ("y0", "y1", "change", "level", "interval")]
    return strokes.shaking(strokes.one_pass(_bars(spark, sf_dir), ["entity_id", "day", "close", *needed]))
