"""Packing: shortest-pack-first over the length histogram.

Each document's tokens are cut into pieces of at most ``most`` tokens. Only the
histogram of the piece lengths (at most ``most`` counts) reaches the driver;
there lengths are placed longest first, each into the emptiest packing pattern
that has room, whole counts at a time. The patterns, numbered, are then joined
back to the pieces by each piece's rank among those of its length. Ranks are
taken within salted parts of a length, with the sizes of the parts before added,
so that a length held by most pieces is not ranked in one task.

Defined results: a null or empty text is the end token alone; rows with the same
id (or a null one) are packed each by itself; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import id_text, keep, releasing

_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, row long"


def cuts(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    return [most] * (n // most) + ([n % most] if n % most else [])


def _piece_rows(tokenizer: str, end_id: int, most: int, with_ids: bool):
    def run(batches):
        encode, last = bpe.load(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text) + last
                n, start, row = len(ids) // 4, 0, zlib.crc32(ids)
                for size in cuts(n, most):
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((doc_id, start, size, zlib.crc32(part), n, row, *([part] if with_ids else [])))
                    start += size
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names)

    return run


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = 1, most: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of every document; ``with_ids`` adds their ids (little-endian unsigned 32-bit) as binary."""
    return id_text(docs, id_col, text_col).mapInArrow(releasing(_piece_rows(tokenizer, end_id, most, with_ids)), _PIECES + (", ids binary" if with_ids else ""))


def pack_histogram(counts: dict[int, int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern."""
    room: dict[int, list] = {}  # free space -> [[count, lengths], ...]
    spaces: list[int] = []

    def put(space: int, count: int, lengths: tuple) -> None:
        if space not in room:
            room[space] = []
            insort(spaces, space)
        for p in room[space]:
            if p[1] == lengths:
                p[0] += count
                return
        room[space].append([count, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not spaces or spaces[-1] < length:
                put(most - length, left, (length,))
                break
            space = spaces[-1]
            pattern = room[space][-1]
            fit = space // length  # so many of them at once
            used = min(left // fit, pattern[0]) if left >= fit else 1
            many = fit if left >= fit else left
            pattern[0] -= used
            if not pattern[0]:
                room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.remove(space)
            put(space - many * length, used, pattern[1] + (length,) * many)
            left -= used * many
    return sorted(((count, lengths) for ps in room.values() for count, lengths in ps), key=lambda p: (-p[0], p[1]))


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Arrays by slot, in order of (length, lo): pieces of ranks lo to hi - 1 go to sequences ``first`` on, at ``offset``."""
    rows, ranks, first = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            lo = ranks.get(length, 0)
            rows.append((length, lo, first, offset))
            ranks[length] = lo + count
            offset += length
        first += count
    rows.sort()
    return dict(zip(("length", "lo", "first", "offset"), (np.array(x, np.int64) for x in zip(*rows, strict=True)), strict=True)) if rows else {}


def _placed(table: dict[str, np.ndarray]):
    base = np.searchsorted(table["length"], np.arange(table["length"].max() + 2)) if table else None

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = base[n], base[n + 1]
                at[own] = lo + np.searchsorted(table["lo"][lo:hi], rank[own], "right") - 1
            sequence = table["first"][at] + rank - table["lo"][at]
            cols = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            cols[2] = cols[2].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(table["offset"][at])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, most: int = 2048, part_rows: int = 500_000) -> DataFrame:
    """A sequence_id and an offset for each row of ``cut_documents``."""
    pieces = keep(pieces.select(*(c.split()[0] for c in _PIECES.split(", "))), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    parts = max(8, -(-sum(counts.values()) // part_rows))
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "row")
    ranked = salted.withColumn("own", F.row_number().over(order)).join(sizes, ["length", "part"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    table = slots(pack_histogram(counts, most))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        _placed(table), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = 1, most: int = 2048) -> DataFrame:
    return pack(cut_documents(docs, id_col, text_col, tokenizer, end_id, most), most)
