"""Strokes, segments and pivot zones (ZEN): a fold over each entity's bars with a small state.

What becomes known at a bar is written once, as rows: what holds at the bar itself
(kind ``bar``), and facts about earlier bars, which name that bar in ``at`` and the
bar they became known at in ``seq``. Nothing is edited, so a run may stop after any
bar and go on from the state, a short JSON text: time chunks one after the other
(``in_chunks``) and the batches of a stream give the rows of one whole run.
``wide`` puts the facts back onto their bars. Where an entity's bars lie in one task,
``one_pass`` does both there: facts are put back while its years are folded one
after the other, so neither rows of facts nor states are shuffled or stored.

Rules: bars that contain a neighbour are shortened in the direction of the move;
comparisons use the bars as given. A top or bottom becomes a candidate where the
move first turns, and ends a stroke after 4 bars against it, or after 8 bars from
the candidate. Four ends whose first and last stroke overlap make a zone; zones
that overlap the merged zone before them are merged into it, a level up. A segment
begins where the first and third of three strokes overlap in a new direction.

Defined results: bars without high, low or close are dropped first; an entity has
rows only once a first top and bottom 4 bars apart are found among its first 11
bars or more; changes from 0 are NULL.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col

# Bars looked at for the first top and bottom and their least distance; bars against a candidate, or since it, that confirm it.
FIRST_BARS, FIRST_DISTANCE, AGAINST, SINCE = 11, 4, 4, 8

_ZONE = ["zone_from", "zone_to", "zone_y0", "zone_y1", "zone_change"]
_MERGED = ["merged_from", "merged_to", "merged_y0", "merged_y1", "merged_change", "merged_level", "merged_interval"]
_KINDS = {"kind": "string", "at": "long", "seq": "long", "day": "date", "side": "string", "until": "long"}
_NUMBERS = ["value", "change", "slope", "interval", "against_change", "against_slope", "against_interval", "low", "high"]
_COLUMNS = _KINDS | {c: "double" for c in _NUMBERS} | {"against": "string"} | {c: "date" if c.endswith(("_from", "_to")) else "double" for c in _ZONE + _MERGED} | {"state": "string"}
ROWS = ", ".join(f"{c} {t}" for c, t in _COLUMNS.items())
# by kind, the columns of a bar that its rows give
_FACTS = {"bar": {"side": "current_direction"} | {c: f"current_{c}" for c in ("interval", "change", "slope", *_ZONE[2:], *_MERGED[2:])} | {c: c for c in ("against", "against_interval", "against_change", "against_slope")}}
_FACTS |= {"shape": {c: f"cut_{c}" for c in ("high", "low")}, "turn": {"side": "turn", "value": "turn_power"}}
_FACTS |= {k: {c: f"{k}_{c}" for c in ("side", "value", "change", "slope", "interval", *more)} for k, more in (("stroke", _ZONE + _MERGED), ("segment", _ZONE))}
_WIDE = {"entity_id": "string", "day": "date", "at": "long"} | {name: _COLUMNS[c] for columns in _FACTS.values() for c, name in columns.items()} | {"segment_state": "string", "high": "double", "low": "double", "close": "double"}


def overlap(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float] | None:
    """What two ranges share; touching ranges share a point."""
    within = lambda x, r: r[0] <= x <= r[1]
    if within(a[0], b):
        return a[0], a[1] if within(a[1], b) else b[1]
    if within(b[0], a):
        return b[0], b[1] if within(b[1], a) else a[1]
    return None


def _change(new: float, old: float) -> float | None:
    return (new - old) / abs(old) if old else None


def _zone(points: list) -> tuple[list, dict | None, int | None]:
    """Of four ends (day, value, at): those that stay for the next zone, the zone, and the bars it spans."""
    if len(points) < 4:
        return points, None, None
    (d0, p0, i0), (_, p1, _), (_, p2, _), (d3, p3, i3) = points
    shared = overlap((p0, p1), (p2, p3)) if p0 < p1 else overlap((p1, p0), (p3, p2))
    if shared is None:
        return points[1:], None, i3 - i0
    return points[-1:], dict(zip(_ZONE, (d0, d3, *shared, abs(_change(*shared[::-1]) or 0.0) if shared[0] else None), strict=True)), i3 - i0


class Fold:
    """The state of one entity; ``rows`` collects what became known."""

    def __init__(self, state: str | None = None):
        self.s = json.loads(state) if state else {"n": 0, "head": [], "direction": None}
        self.rows: list[dict] = []

    def state(self) -> str:
        return json.dumps(self.s)

    def tell(self, kind: str, at: int, day: str | None = None, **what) -> None:
        self.rows.append({"kind": kind, "at": at, "seq": self.s["n"] - 1, "day": day} | what)

    def add(self, day: str, high: float, low: float, close: float) -> None:
        s = self.s
        s["n"] += 1
        if s["direction"]:
            self._step(day, high, low, close)
            return
        self.tell("bar", s["n"] - 1, day)
        self.rows[-1]["seq"] = -1  # told anew if the first stroke begins before it
        s["head"].append([s["n"] - 1, day, high, low, close])
        n = s["n"] - 1  # the bars before this one are looked at
        if n < FIRST_BARS:
            return
        top, bottom = (max((b for b in s["head"] if b[0] < n), key=k) for k in (lambda b: (b[2], b[0]), lambda b: (-b[3], b[0])))
        if abs(top[0] - bottom[0]) < FIRST_DISTANCE:
            s["head"] = [b for b in s["head"] if b[0] > n - 3 or b in (top, bottom)]  # a later start is the last bar looked at
            return
        up = top[0] > bottom[0]
        first, later = (bottom, top) if up else (top, bottom)
        start = later[0]
        head = {b[0]: b[1:] for b in s.pop("head")}
        d1, h1, lo1, c1 = head[start - 1]
        s |= {"direction": "up" if up else "down", "turned": "up" if up else "down", "interval": start - first[0], "against": 0, "candidate": None, "turn": None}
        s |= {"ends": [["bottom" if up else "top", first[3], first[2], first[0], first[1]]], "segment": "none", "points": [], "heads": [], "last_end": None, "last_head": None, "zone": None, "merged": None}
        s |= {"before": head[start - 2][1:3], "raw": [d1, h1, lo1, c1], "cut": [h1, lo1]}
        self.tell("stroke", first[0], first[1], side="bottom" if up else "top")
        s["n"] = start
        for i in range(start, n + 1):
            s["n"] += 1
            self._step(*head[i])

    def _step(self, day: str, high: float, low: float, close: float) -> None:
        # the only part that runs for each bar: its row is one dict, made in place
        s, i = self.s, self.s["n"] - 1
        was_day, was_high, was_low, was_close = s["raw"]
        turned = "up" if high > was_high else "down" if low < was_low else s["turned"]
        side = s["direction"]
        s["turned"] = turned
        s["interval"] = interval = s["interval"] + 1
        change = _change(high, s["ends"][0][1]) if side == "up" else _change(low, s["ends"][0][2])
        bar = {"kind": "bar", "at": i, "seq": i, "day": day, "side": side, "interval": interval, "change": change, "slope": None if change is None else change / interval}
        if s["zone"]:
            bar.update(s["zone"])
        if s["merged"]:
            bar.update(s["merged"])

        cut, was_cut = [high, low], s["cut"]  # shortened bars, as high and low
        if high >= was_high and low <= was_low:
            cut = [high, was_low] if turned == "up" else [was_high, low]
            if cut != [high, low]:
                self.tell("shape", i, day, high=cut[0], low=cut[1])
        elif was_high >= high and was_low <= low:
            was_cut = [was_cut[0], low] if turned == "down" else [high, was_cut[1]]
            if was_cut != s["cut"]:
                self.tell("shape", i - 1, was_day, high=was_cut[0], low=was_cut[1])

        if turned == side:
            s["against"] = 0
        else:
            s["against"] = s["interval"] = against = s["against"] + 1
            if against == 1:
                s["turn"] = was_cut
                self._turn(i, was_cut, high, low)
            change = _change(high, s["turn"][1]) if turned == "up" else _change(low, s["turn"][0])
            bar["against"], bar["against_interval"], bar["against_change"], bar["against_slope"] = turned, against, change, None if change is None else change / against
            if s["candidate"] and (against >= AGAINST or i - s["candidate"][0] >= SINCE):
                self._end_stroke()
        self.rows.append(bar)
        s["before"], s["raw"], s["cut"] = was_cut, [day, high, low, close], cut

    def _turn(self, i: int, was_cut: list, high: float, low: float) -> None:
        """The bar before is a passing top or bottom, and the candidate if it goes as far as the one there is."""
        s, (day, was_high, was_low, was_close), (left_high, left_low) = self.s, self.s["raw"], self.s["before"]
        top = s["direction"] == "up"
        if top:
            power = -((was_high - was_close) + (was_high - left_high) + (was_high - high))
        else:
            power = abs(was_low - was_close) + abs(was_low - left_low) + abs(was_low - low)
        self.tell("turn", i - 1, day, side="top" if top else "bottom", value=power / was_close if was_close else None)
        c = s["candidate"]
        if c is None or (was_high >= c[2] if top else was_low <= c[3]):
            s["candidate"] = [i - 1, day, was_high, was_low, *was_cut]

    def _end_stroke(self) -> None:
        s, (at, day, _, _, high, low) = self.s, self.s["candidate"]
        top = s["direction"] == "up"
        value = high if top else low
        row = self._measured("last_end", at, value) | {"side": "top" if top else "bottom"}
        s["points"], zone, spans = _zone([*s["points"], [day, value, at]])
        row |= zone or {}
        s["zone"] = zone or s["zone"]
        if zone:
            old, y0, y1 = s["merged"], zone["zone_y0"], zone["zone_y1"]
            own = dict(zip(_MERGED, (zone["zone_from"], zone["zone_to"], y0, y1, zone["zone_change"], 1, spans), strict=True))
            if old and overlap((old["merged_y0"], old["merged_y1"]), (y0, y1)):
                y0, y1 = min(old["merged_y0"], y0), max(old["merged_y1"], y1)
                own |= {"merged_from": old["merged_from"], "merged_y0": y0, "merged_y1": y1, "merged_change": abs(y0 - y1) / abs(y0) if y0 else None}
                own |= {"merged_level": old["merged_level"] + 1, "merged_interval": old["merged_interval"] + spans}
            row |= own if old else {}
            s["merged"] = own
        self.tell("stroke", at, day, **row)
        s |= {"against": 0, "direction": "down" if top else "up", "candidate": None}
        s["ends"].append(["top" if top else "bottom", low, high, at, day])
        if len(s["ends"]) == 4:
            self._segment()

    def _measured(self, last: str, at: int, value: float) -> dict:
        """The value of a new end, and its change, bars and slope from the last one."""
        row, old = {"value": value}, self.s[last]
        if old:
            change, bars = _change(value, old[1]), at - old[0]
            row |= {"change": change, "interval": bars, "slope": change / bars if change is not None and bars else None}
        self.s[last] = [at, value]
        return row

    def _segment(self) -> None:
        s = self.s
        (side, low, high, at, day), (_, low1, high1, _, _), (_, low2, high2, _, _), (_, low3, high3, last, _) = s["ends"]
        if side == "top":
            found = "down" if overlap((low1, high), (low3, high2)) else s["segment"]
        else:
            found = "up" if overlap((low, high1), (low2, high3)) else s["segment"]
        if found == s["segment"]:
            self.tell("state", at, day, until=at, state=found)
            s["ends"] = s["ends"][1:]
            return
        s["segment"] = found
        self.tell("state", at, day, until=last, state=found)
        value = low if found == "up" else high
        row = self._measured("last_head", at, value) | {"side": "bottom" if found == "up" else "top"}
        s["heads"], zone, _ = _zone([*s["heads"], [day, value, at]])
        self.tell("segment", at, day, **row, **(zone or {}))
        s["ends"] = s["ends"][-1:]


def folded(state: str | None, bars: pd.DataFrame) -> tuple[list[dict], str]:
    """The rows that an entity's next bars (day, high, low, close) bring, and the state after them."""
    fold = Fold(state)
    for day, high, low, close in zip(bars["day"], bars["high"], bars["low"], bars["close"], strict=True):
        fold.add(str(day)[:10], float(high), float(low), float(close))
    return fold.rows, fold.state()


def _frame(entity: str | list[str], rows: list[dict], columns: dict[str, str]) -> pd.DataFrame:
    """Rows as Spark's types: texts and dates as objects, so that missing ones stay NULL. ``entity``: one for all rows, or one a row."""
    kinds = {"double": "float64", "long": "Int64"}
    out = {"entity_id": pd.Series([entity] * len(rows) if isinstance(entity, str) else entity, dtype=object)}
    for c, t in columns.items():
        values = [r.get(c) for r in rows]
        out[c] = pd.Series([date.fromisoformat(x) if x else None for x in values] if t == "date" else values, dtype=kinds.get(t, object))
    return pd.DataFrame(out)


def _ready(bars: DataFrame) -> DataFrame:
    return bars.select("entity_id", "day", "high", "low", "close").dropna(subset=["high", "low", "close"])


def in_chunks(bars: DataFrame, path: str, edges: list, bucket_bars: int = 20_000) -> DataFrame:
    """The rows of all bars, folded chunk after chunk of days: [.., edges[0]), [edges[0], edges[1]), ... Only a chunk of some entities, about ``bucket_bars`` bars, is in one Python group (a group of one entity would mostly cost its frames); ``path`` keeps each chunk's rows and states."""
    ready, parts, spark = _ready(bars), [], bars.sparkSession
    schema = f"entity_id string, {ROWS}, carry string"
    buckets = max(1, -(-ready.count() // (bucket_bars * (len(edges) + 1))))
    bucket = F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).alias("bucket")

    def step(chunk: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        carried, names, rows = dict(zip(states["entity_id"], states["carry"], strict=True)), [], []
        for entity, own in chunk.sort_values(["entity_id", "day"]).groupby("entity_id", sort=False):
            new, state = folded(carried.get(entity), own)
            carried[entity] = state
            names += [entity] * len(new)
            rows += new
        names += carried
        rows += [{"kind": "carry", "carry": state} for state in carried.values()]
        return _frame(names, rows, _COLUMNS | {"carry": "string"})

    states = spark.createDataFrame([], "entity_id string, carry string")
    for n, (lo, hi) in enumerate(zip([None, *edges], [*edges, None])):
        chunk = ready.where((C("day") >= F.lit(lo) if lo is not None else F.lit(True)) & (C("day") < F.lit(hi) if hi is not None else F.lit(True)))
        chunk.groupBy(bucket).cogroup(states.groupBy(bucket)).applyInPandas(step, schema).write.partitionBy("kind").parquet(f"{path}/{n}")
        done = spark.read.schema(schema).parquet(f"{path}/{n}")
        states = done.where("kind = 'carry'").select("entity_id", "carry")
        parts.append(done.where("kind <> 'carry'").drop("carry"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


def per_batch(bars: DataFrame) -> DataFrame:
    """The same rows from a stream of bars, whose batches must bring each entity's bars in order; older bars than the last one are ignored."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, last = state.get if state.exists else (None, "")
        new = pd.concat(list(frames)).sort_values("day")
        new = new[new["day"].astype(str) > last]
        rows, carry = folded(carry, new)
        state.update((carry, max([last, *new["day"].astype(str)])))
        yield _frame(key[0], rows, _COLUMNS)

    return _ready(bars).groupBy("entity_id").applyInPandasWithState(step, f"entity_id string, {ROWS}", "carry string, last string", "append", GroupStateTimeout.NoTimeout)


def wide(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """One row a bar: what held at it, and the shapes, turns, stroke and segment ends, zones and segment states found on it later (the last one where there are several)."""
    is_ = lambda k: C("kind") == k
    last = lambda k, c: F.max_by(F.when(is_(k), C(c)), F.when(is_(k), C("seq")))
    state = rows.where(is_("state")).select("entity_id", F.explode(F.sequence("at", "until")).alias("at"), "seq", "state")
    states = state.groupBy("entity_id", "at").agg(F.max_by("state", "seq").alias("segment_state"))
    facts = [F.max(F.when(is_("bar"), C("day"))).alias("day")]
    facts += [last(k, c).alias(name) for k, columns in _FACTS.items() for c, name in columns.items()]
    table = rows.where(~is_("state")).groupBy("entity_id", "at").agg(*facts).join(states, ["entity_id", "at"], "left").withColumn("segment_state", F.coalesce("segment_state", F.lit("none")))
    found = rows.where(is_("stroke")).select("entity_id").distinct()
    whole = table.join(found, "entity_id", "left_semi").join(_ready(bars), ["entity_id", "day"])
    return whole.withColumns({"cut_high": F.coalesce("cut_high", "high"), "cut_low": F.coalesce("cut_low", "low")})


def _series(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, list, list, list]]:
    """Each entity with its days (since 1970), highs, lows and closes, from rows in the order of entities and days."""
    now, held = None, []
    whole = lambda: (now, *(c.to_numpy().tolist() for c in pa.Table.from_batches(held).columns[1:]))
    for batch in batches:
        runs, lo = pc.run_end_encode(batch.column(0)), 0
        for entity, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if entity != now:
                if held:
                    yield whole()
                now, held = entity, []
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield whole()


def _years(days: list[str], *numbers: list) -> Iterator[Fold]:
    """A fold of each year's bars, which goes on from the state that the year before left as text."""
    state = None
    for _, bars in groupby(zip(days, *numbers, strict=True), lambda b: b[0][:4]):
        fold = Fold(state)
        for bar in bars:
            fold.add(*bar)
        yield fold
        state = fold.state()


class _Days(dict):
    """ISO days by their number since 1970."""

    def __missing__(self, n: int) -> str:
        self[n] = (date(1970, 1, 1) + timedelta(n)).isoformat()
        return self[n]


def _in_order(bars: DataFrame) -> DataFrame:
    """Bars in the order of entities and days; where they are dealt by entity and sorted so (as aggregated ones are), nothing is shuffled or sorted for it."""
    rows = _ready(bars).dropna(subset=["entity_id", "day"])
    return rows.select("entity_id", F.unix_date("day").alias("day"), *(C(c).cast("double").alias(c) for c in ("high", "low", "close"))).sortWithinPartitions("entity_id", "day")


def _rounded(numbers: pa.Array, digits: int) -> pa.Array:
    """As Spark's ``round``: half up, by the shortest decimal that names the number; only what is near a half or large goes through decimals."""
    x, unit = numbers.to_numpy(zero_copy_only=False), 10.0**digits
    with np.errstate(all="ignore"):
        scaled = x * unit
        low = np.floor(scaled)
        out = np.floor(scaled + 0.5) / unit
        exactly = np.flatnonzero(np.isfinite(x) & ~((np.abs(scaled) < 1e12) & (np.abs(scaled - low - 0.5) > 1e-3)))
    for i in exactly:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0 if abs(x[i]) < 1e16 else x[i]
    return pa.array(out, pa.float64(), mask=numbers.is_null().to_numpy(zero_copy_only=False))


def one_pass(bars: DataFrame, columns: list[str] | None = None, digits: int | None = None, bars_a_batch: int = 10_000) -> DataFrame:
    """The table that ``wide`` makes of the rows of all bars, or these columns of it, with no shuffle: all bars of an entity must lie in one task, one a day. ``digits``: numbers are rounded in the task (Spark's generated code for rounding so many columns is too long to be compiled)."""
    kinds = {c: t for c, t in _WIDE.items() if columns is None or c in columns}
    arrow = pa.schema([(c, {"string": pa.string(), "date": pa.date32(), "long": pa.int64(), "double": pa.float64()}[t]) for c, t in kinds.items()])
    facts = {k: [(c, name) for c, name in named.items() if name in kinds] for k, named in _FACTS.items()}

    def of_entity(entity: str, days: list, numbers: list[list], iso: _Days) -> dict[str, list] | None:
        n, (high, low, close) = len(days), numbers
        table = {c: [None] * n for c in kinds}
        given = {"entity_id": [entity] * n, "day": days, "at": list(range(n)), "segment_state": ["none"] * n, "high": high, "low": low, "close": close, "cut_high": list(high), "cut_low": list(low)}
        table |= {c: v for c, v in given.items() if c in kinds}
        told = [None] * n
        for fold in _years([iso[d] for d in days], *numbers):
            for row in fold.rows:
                kind, at = row["kind"], row["at"]
                if kind == "bar":
                    told[at] = row  # a bar before the first stroke's start may be told anew
                elif kind != "state":
                    for c, name in facts[kind]:
                        table[name][at] = row.get(c)
                elif "segment_state" in kinds:
                    table["segment_state"][at : row["until"] + 1] = [row["state"]] * (row["until"] + 1 - at)
        table |= {name: [row.get(c) for row in told] for c, name in facts["bar"]}
        return table if fold.s["direction"] else None

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        iso, held, n = _Days(), {c: [] for c in kinds}, 0

        def column(c: str, values: list) -> pa.Array:
            if c == "day":
                return pa.array(values, pa.int32()).cast(pa.date32())
            made = pa.array([x and date.fromisoformat(x) for x in values] if kinds[c] == "date" else values, arrow.field(c).type)
            return _rounded(made, digits) if digits is not None and kinds[c] == "double" else made

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(c, v) for c, v in held.items()], schema=arrow)

        for entity, days, *numbers in _series(batches):
            table = of_entity(entity, days, numbers, iso)
            for c, v in (table or {}).items():
                held[c] += v
            n += len(days) if table else 0
            if n >= bars_a_batch:
                yield batch()
                held, n = {c: [] for c in kinds}, 0
        if n:
            yield batch()

    return _in_order(bars).mapInArrow(step, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def last_zones(table: DataFrame) -> DataFrame:
    """ZEN-2: at each bar the last five merged zones (of overlapping ones after each other the later), by width, level and distance from the one before, and the rules on them."""
    from pyspark.sql import Window

    by = Window.partitionBy("entity_id").orderBy("at")
    zone = F.struct(*(C(f"current_{c}").alias(c) for c in _MERGED[2:]))
    seen = table.where("current_merged_y0 is not null").select("entity_id", "at", zone.alias("z"))
    new = seen.withColumn("old", F.lag("z").over(by)).where(C("old").isNull() | (C("z") != C("old"))).drop("old")
    meets = lambda a, b: (F.greatest(a["merged_y0"], b["merged_y0"]) <= F.least(a["merged_y1"], b["merged_y1"]))
    stays = ~F.coalesce(meets(C("z"), F.lead("z").over(by)), F.lit(False))
    marked = new.withColumn("stays", stays)
    # before a zone, the four that stayed: a zone that the next one replaced is in no later list
    alike = Window.partitionBy("entity_id", "stays").orderBy("at")
    four = F.array(*(F.lag("z", k).over(alike) for k in (3, 2, 1)), C("z"))
    before = F.last(F.when(C("stays"), C("four")), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    lists = marked.withColumn("four", four).select("entity_id", "at", F.concat(before, F.array("z")).alias("zones"))
    lists = lists.where(C("zones")[0].isNotNull())
    kept = table.select("entity_id", "at", "day").join(lists, ["entity_id", "at"], "left").withColumn("zones", F.last("zones", True).over(by))
    return _zone_rules(kept, "day")


def zones_in_one_pass(bars: DataFrame, bars_a_batch: int = 10_000) -> DataFrame:
    """``last_zones`` of ``one_pass``, with no shuffle either: the fold gives each stretch of bars with the same zones once."""
    names = _MERGED[2:]
    zone = pa.struct([(c, pa.float64()) for c in names])
    arrow = pa.schema([("entity_id", pa.string()), ("days", pa.list_(pa.date32())), ("zones", pa.list_(zone))])
    meets = lambda a, b: max(a["merged_y0"], b["merged_y0"]) <= min(a["merged_y1"], b["merged_y1"])

    def of_entity(entity: str, days: list, numbers: list[list], iso: _Days) -> list[tuple]:
        was, zones, told, fold = None, [], {}, None
        for fold in _years([iso[d] for d in days], *numbers):
            for row in fold.rows:
                if row["kind"] != "bar":
                    continue
                if row.get("merged_y0") is not None:
                    now = {c: row[c] for c in names}
                    if now != was:
                        zones = [*(zones[:-1] if was and meets(was, now) else zones)[-4:], now]
                        was = now
                told[row["at"]] = zones if len(zones) == 5 else None  # a bar before the first stroke's start may be told anew
        if fold is None or not fold.s["direction"]:
            return []
        stretches = groupby(range(len(days)), lambda at: id(told[at]))
        return [(entity, [days[at] for at in (first, *rest)], told[first]) for first, *rest in (list(g) for _, g in stretches)]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        iso, held, n = _Days(), [], 0

        def batch() -> pa.RecordBatch:
            entities, days, zones = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(entities, pa.string()), pa.array(days, pa.list_(pa.int32())).cast(pa.list_(pa.date32())), pa.array(zones, pa.list_(zone))], schema=arrow)

        for entity, days, *numbers in _series(batches):
            held += of_entity(entity, days, numbers, iso)
            n += len(days)
            if held and n >= bars_a_batch:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()

    stretches = _in_order(bars).mapInArrow(step, f"entity_id string, days array<date>, zones array<struct<{', '.join(f'{c}: double' for c in names)}>>")
    return _zone_rules(stretches, "days").withColumn("day", F.explode("days")).select("entity_id", "day", "zen_state", "good_state", "trending_state")


def _zone_rules(kept: DataFrame, days: str) -> DataFrame:
    """The names of the last five zones, and the rules on them."""
    middle = lambda z: (z["merged_y0"] + z["merged_y1"]) / 2
    away = lambda i: F.try_divide(middle(C("zones")[i]) - middle(C("zones")[i - 1]), middle(C("zones")[i - 1]))
    # The limits and names of the zone categories.
    width = lambda z: F.when(z["merged_change"] <= 0.4, "small").otherwise("big")
    level = lambda z: F.when(z["merged_level"] <= 3, "level1").when(z["merged_level"] <= 7, "level2").otherwise("level3")
    far = lambda d: F.when(d.isNull() | (d == 0), None).when(d <= -0.5, "big_down").when(d < 0, "small_down").when(d <= 0.5, "small_up").otherwise("big_up")
    zones = [F.struct(width(C("zones")[i]).alias("w"), level(C("zones")[i]).alias("l"), (far(away(i)) if i else F.lit(None).cast("string")).alias("d")) for i in range(5)]
    named = kept.select("entity_id", days, F.when(C("zones").isNotNull(), F.array(*zones)).alias("n"))
    text = F.array_join(F.transform("n", lambda z: F.concat_ws(",", z["w"], z["l"], F.coalesce(z["d"], F.lit("None")))), ",")
    rose = lambda to: F.exists(F.slice("n", 2, to - 1), lambda z: F.coalesce(z["d"] == "big_up", F.lit(False)))
    narrow = (C("n")[3]["w"] == "small") & (C("n")[4]["w"] == "small")
    calm, new_ = ~rose(5) & narrow & (C("n")[4]["l"] != "level1"), ~rose(4) & narrow & (C("n")[4]["l"] == "level1")
    return named.select("entity_id", days, text.alias("zen_state"), F.coalesce(calm, F.lit(False)).alias("good_state"), F.coalesce(new_, F.lit(False)).alias("trending_state"))


def shaking(table: DataFrame, width: float = 0.5, level: int = 2, bars: int = 120, edge: float = 0.1) -> DataFrame:
    """ZEN-3: bars near an edge of a narrow, long merged zone of some level."""
    near = lambda y: C("close").between((1 - edge) * y, (1 + edge) * y)
    rule = (C("current_merged_change") <= width) & (C("current_merged_level") >= level) & (C("current_merged_interval") >= bars) & (near(C("current_merged_y0")) | near(C("current_merged_y1")))
    return table.select("entity_id", "day", F.coalesce(rule, F.lit(False)).alias("filter_result"))
