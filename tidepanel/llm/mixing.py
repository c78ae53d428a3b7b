"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Sources share ``share`` times all words by their weights. A source whose share is
above ``most`` times its own words is clamped there and its excess is shared anew
by weight, until none is above: turn after turn only the sum of the clamped caps
and of the open weights reaches the driver. A source's target is then taken in
whole repetitions of all its documents and a last, fractional one: its documents
in a seeded order until the words are reached, the last of them in part. The
order's running sums are taken within salted parts of a source, with the sums of
the parts before added, so that no source is ranked in one task.

Built-in functions only; nothing but one number a turn leaves the executors.

Defined results: a null or empty text has size 0 and takes nothing; a null source
is a source of its own, the last; where all sources are clamped each takes its
cap; rows with the same id are mixed each by itself (equal ones are
interchangeable); a null id takes its place in the order from its text; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, on_workers

_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def word_count(text: str | Column) -> Column:
    """Number of words: each word with the white space around it becomes one letter, so no array of words is built."""
    text = F.col(text) if isinstance(text, str) else text
    marks = F.regexp_replace(text, f"{_GAP}*+{_WORD}++{_GAP}*+", "x")
    return F.when(text.rlike(_WORD), F.length(marks)).otherwise(0).cast("long")


def _order(seed: int) -> Column:
    """A number below 2 ** 60 from the seed and the id (without one: the text)."""
    who = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), who)), 1, 15), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their ``place`` (from 0) by code point, null last: sorted by ranges, ranks added up over the ranges."""
    parted = keep(sources.orderBy(F.asc_nulls_last("source")).withColumn("id", F.monotonically_increasing_id()), "mix-sorted")
    part, own = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    counts = parted.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("part", part).join(counts.select("part", before.alias("before")), "part").withColumn("place", own + F.col("before")).drop("part", "before", "id")


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: weights share ``share`` of all sizes, none above ``most`` times its size."""
    cap = F.col("source_size") * F.lit(float(most))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * float(share)
    clamped = F.lit(False)
    known = -1
    while True:
        caps, weights, n = sources.agg(F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)), F.sum(F.when(~clamped, F.col("weight"))), F.count(F.when(clamped, 1))).first()
        if n == known or not weights:
            break
        known, rest = n, total - caps
        clamped = cap < F.col("weight") * F.lit(rest) / F.lit(weights)
    open_target = F.col("weight") * F.lit(total - caps) / F.lit(weights) if weights else cap
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.least(cap, open_target)) if weights else cap)


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", part_rows: int = 100_000
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row of ``docs``; ``weights`` repeat over the sources by code point."""
    on_workers(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    sized = keep(named.select("doc_id", "source", word_count("text").alias("size"), _order(seed).alias("at")), "mix-sizes")
    numbered = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    targets = keep(water_fill(keep(numbered.select("source", "source_size", weight.alias("weight")), "mix-sources"), share, most), "mix-targets")

    parts = max(64, -(-sized.count() // part_rows))
    dealt = sized.withColumn("part", F.shiftright(F.shiftright("at", 20) * parts, 40).cast("int"))  # parts follow the order
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    sums = dealt.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(earlier, F.lit(0))).drop("words").withColumnRenamed("source", "of")
    facts = targets.select(F.col("source").alias("name"), "source_size", "target", F.floor(rate).alias("whole"))
    sums = sums.join(facts, F.col("of").eqNullSafe(F.col("name"))).drop("name").withColumnRenamed("part", "of_part")
    own = F.sum("size").over(Window.partitionBy("source", "part").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("own", F.coalesce(own, F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    # words of the last, fractional repetition of the source that fall on this document
    left = F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size") - F.col("before") - F.col("own")
    taken = F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return placed.select("doc_id", "source", "size", "source_size", "target", F.least(taken, F.floor(F.col("size") * F.lit(float(most)))).cast("long").alias("taken"))


def repetitions(docs: DataFrame, taken: str = "taken", text_col: str = "text") -> DataFrame:
    """A row of ``docs`` for each repetition that its ``taken`` words make, numbered by ``repetition``; a last one in part has its first words, joined by one space."""
    size, times = word_count(text_col), F.ceil(F.col(taken) / word_count(text_col)).cast("int")
    each = docs.where(F.col(taken) > 0).withColumn("repetition", F.explode(F.sequence(F.lit(0), times - 1)))
    rest = (F.col(taken) - F.col("repetition") * size).cast("int")
    words = F.regexp_extract_all(F.col(text_col), F.lit(f"{_WORD}+"), F.lit(0))
    return each.withColumn(text_col, F.when(rest < size, F.array_join(F.slice(words, F.lit(1), rest), " ")).otherwise(F.col(text_col)))
