"""MinHash near-dedup with ProbMinHash over weighted word shingles.

A document is the multiset of its word shingles. Each shingle starts a Poisson
process whose rate is its count; every arrival falls on one of the sketch's
components, a component keeps its earliest shingle, and a process ends once its
next arrival comes after the latest component (early termination). Two sketches
agree in a component with the probability Jaccard of the documents.

1. Documents of equal multisets form a class; only its smallest id goes on.
2. Bands of the sketch make buckets; each member is compared with the bucket's
   first by the exact probability Jaccard. The first of a bucket is its most
   central member, the one with the largest buckets in all bands: of copies that
   each differ a little from one text, that text.
3. Where a bucket's members are not yet one component, its most central member
   not yet compared with all others is compared with those of other components.
   After some such turns the remaining pairs across components are compared too,
   each in the first bucket that both are in, but for those that their sketches or
   the triangle inequality rule out (1 - J_P is a metric, and both distances to
   the bucket's first member are known). So every linked pair that shares a bucket
   is joined, and no bucket lists all its pairs or is gathered in one task.
4. Components of the links are the near-duplicate classes.

Defined results: a text of fewer words than a shingle is one shingle; a null
text or one without words, and a row with a null id, is a class of its own (its
class_id is its own id); rows with the same id and text are one document, and each
other text of an id is a document of its own, compared as any other; extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, keep, min_labels, packs, releasing, text_bytes
from .textkit import Words, mix, windows

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and their counts."""
    if 0 < len(h) < size:
        return windows(h, len(h)), np.ones(1, np.int64)
    return np.unique(windows(h, size), return_counts=True)


def sketch(elem: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """Shingle hash held by each of the m components, a row a document; ``doc`` numbers the documents of the elements.

    A turn draws a block of arrivals of each live process, in proportion to its
    share of the document, so that one heavy shingle doesn't take a turn for each
    of its arrivals.
    """
    time, held = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    at, drawn = np.zeros(len(elem)), np.zeros(len(elem), np.int64)
    share = weight / np.bincount(doc, weight, docs)[doc]
    block = np.maximum(1, (share * m * (np.log(m) + 2) / 2).astype(np.int64))
    while len(elem):
        first = np.cumsum(block) - block
        of = np.repeat(np.arange(len(elem)), block)
        turn = (np.arange(len(of)) - first[of] + drawn[of] + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            draw = mix(elem[of] + turn * _GOLD)
            part = (mix(draw) % np.uint64(m)).astype(np.int64)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight[of]
        when = np.cumsum(gap)
        when += (at - when[first] + gap[first])[of]
        place = doc[of] * m + part
        np.minimum.at(time, place, when)
        won = time[place] == when
        held[place[won]] = elem[of[won]]
        latest = time.reshape(docs, m).max(axis=1)
        at, drawn = when[first + block - 1], drawn + block
        live = at < latest[doc]
        elem, weight, doc, at, drawn, block = (x[live] for x in (elem, weight, doc, at, drawn, block))
    return held.reshape(docs, m)


def sketch_bits(held: np.ndarray) -> np.ndarray:
    """One bit for each component, 64 to a whole number; unequal components agree in it half the time."""
    docs, m = held.shape
    with np.errstate(over="ignore"):
        bits = (mix(held + np.arange(1, m + 1, dtype=np.uint64) * _GOLD) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(docs, m // 64)


def probability_jaccard(xe: np.ndarray, xw: np.ndarray, ye: np.ndarray, yw: np.ndarray) -> float:
    """Exact J_P of two sparse weighted sets, elements in order."""
    if not len(xe) or not len(ye):
        return 0.0
    _, i, j = np.intersect1d(xe, ye, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = xw[i].astype(np.float64), yw[j].astype(np.float64)
    x_rest, y_rest = xw.sum() - x.sum(), yw.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    x_up = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))
    y_up = np.concatenate(([0.0], np.cumsum(y)))
    lo = np.searchsorted(ratio, ratio, "left")
    return float((1.0 / ((x_up[lo] + x_rest) / x + (y_up[lo] + y_rest) / y)).sum())


def _sketch_rows(size: int, bands: int, rows: int):
    m = bands * rows

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in packs(texts):
                words = Words(texts[lo:hi])
                sets = [shingles(words.h[words.first[k] : words.first[k + 1]], size) for k in range(hi - lo)]
                n = np.array([len(e) for e, _ in sets])
                elem, weight = np.concatenate([e for e, _ in sets]), np.concatenate([c for _, c in sets])
                doc = np.repeat(np.arange(hi - lo), n)
                held = sketch(elem, weight.astype(np.float64), doc, hi - lo, m)
                with np.errstate(over="ignore"):
                    salt = np.arange(1, m + 1, dtype=np.uint64) * _GOLD
                    band = mix(mix(held + salt).reshape(hi - lo, bands, rows).sum(axis=2, dtype=np.uint64))
                    w = weight.astype(np.uint64)
                    keys = [np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)]
                    for key, v in zip(keys, (mix(elem + w * _GOLD), mix(mix(elem) ^ (w * _GOLD))), strict=True):
                        np.add.at(key, doc, v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(band.view(np.int64).ravel()))
                columns = [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "tag")), *(pa.array(k.view(np.int64)) for k in keys), pa.array(n, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "k1", "k2", "n", "bands"])

    return run


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), text_bytes(batch.column("text"))
            for lo, hi in packs(texts):
                words = Words(texts[lo:hi])
                sets = [shingles(words.h[words.first[k] : words.first[k + 1]], size) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([e.tobytes() for e, _ in sets], pa.binary()), pa.array([b"" if (c == 1).all() else c.astype(np.int32).tobytes() for _, c in sets], pa.binary())],
                    ["doc_id", "elems", "counts"],
                )

    return run


def _parts(elems: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    e = np.frombuffer(elems, np.uint64)
    return e, np.frombuffer(counts, np.int32) if counts else np.ones(len(e), np.int32)


def _compared(batches):
    for batch in batches:
        sim = [probability_jaccard(*_parts(a, b), *_parts(c, d)) for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in ("ea", "ca", "eb", "cb")), strict=True)]
        names = ["a", "b", "la", "lb"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sim, pa.float64())], [*names, "sim"])


def _bit_rows(m: int, together: int = 64):
    """Long sketches, a bit for each component, of ``together`` documents at a time."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, together):
                some = batch.slice(lo, together)
                sets = [_parts(e, c) for e, c in zip(some.column("elems").to_pylist(), some.column("counts").to_pylist(), strict=True)]
                doc = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
                elem, weight = np.concatenate([e for e, _ in sets]), np.concatenate([c for _, c in sets])
                bits = sketch_bits(sketch(elem, weight.astype(np.float64), doc, len(sets), m))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (m // 64)), pa.array(bits.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists], ["doc_id", "bits"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bands: int = 30, rows: int = 6, rounds: int = 2, few: int = 8, long_sketch: int = 2048
) -> DataFrame:
    """doc_id and class_id (the smallest id of its near-duplicate class), one row a document; tag (its text's hash, where the id has several texts) and leads (it is the one of its class to keep).

    With 30 bands of 6 components a pair at the threshold of 0.8 shares no
    bucket with probability 1.1e-4. Turns of step 3 go on, ``rounds`` at most, until
    the open pairs are no more than ``few`` for each open member. A pair left for
    step 3's last part is compared only if its long sketches, one bit for each of
    ``long_sketch`` components, agree in as many bits as a pair at the threshold does
    but for 4.5 deviations (a chance of 4e-6 to miss one).
    """
    plain = id_text(docs, id_col, text_col).withColumn("tag", _tag(F.col("text")))
    signs = keep(plain.where("doc_id is not null").mapInArrow(releasing(_sketch_rows(shingle, bands, rows)), "doc_id long, tag long, k1 long, k2 long, n int, bands array<long>"), "sketches")
    texts = signs.groupBy("doc_id").agg(F.min("tag").alias("lead"), F.max("tag").alias("other")).where("lead < other")
    # an id's first text goes under the id, its other texts under numbers of their own
    number = F.when(F.col("tag") == F.col("lead"), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "tag"))
    repeated = keep(signs.select("doc_id", "tag").join(texts, "doc_id").select("doc_id", "tag", number.alias("node")).distinct(), "repeated")
    has_repeated = not repeated.isEmpty()

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(repeated, ["doc_id", "tag"], "left").withColumn("doc_id", F.coalesce("node", "doc_id")).drop("node") if has_repeated else df

    full = numbered(signs.where("n > 0"))
    reps = full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    member = full.select("doc_id", "k1", "k2", "n").join(reps, ["k1", "k2", "n"]).select("doc_id", "rep").distinct()
    member = keep(member, "members")
    lead = full.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    in_band = lead.select("doc_id", F.posexplode("bands").alias("band", "key")).distinct()
    sizes = in_band.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = keep(in_band.join(sizes, ["band", "key"]), "buckets")
    # the first of a bucket is the member that meets most others in all its buckets
    central = keep(buckets.groupBy("doc_id").agg(F.sum("size").alias("met")), "central")
    placed = buckets.join(central, "doc_id").withColumn("order", F.struct(-F.col("met"), F.col("doc_id")))
    pivots = placed.groupBy("band", "key").agg(F.min("order").getField("doc_id").alias("pivot"))
    buckets = keep(placed.join(pivots, ["band", "key"]).select("band", "key", "doc_id", "met", "pivot"), "buckets-pivots")

    sets = numbered(plain).join(central.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = keep(sets.select("doc_id", "text").mapInArrow(releasing(_set_rows(shingle)), "doc_id long, elems binary, counts binary"), "sets")
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("elems").alias(f"e{x}"), F.col("counts").alias(f"c{x}")) for x in "ab")

    def compare(pairs: DataFrame) -> DataFrame:
        """sim of the pairs (a, b); la and lb, their labels, go along."""
        return keep(pairs.join(left, "a").join(right, "b").mapInArrow(_compared, "a long, b long, la long, lb long, sim double"), "compared")

    pairs = buckets.where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    first = compare(pairs.withColumns({"la": F.col("a"), "lb": F.col("b")}))
    labels = min_labels(first.where(F.col("sim") >= threshold).select("a", "b"), "near")
    merges: list[DataFrame] = []  # later links, between labels alone

    def merged(rows: DataFrame, label: str, up: DataFrame) -> DataFrame:
        up = up.select(F.col("node").alias(label), F.col("label").alias("_up"))
        return rows.join(up, label, "left").withColumn(label, F.coalesce("_up", label)).drop("_up")

    def more_links(compared: DataFrame) -> bool:
        links = compared.where(F.col("sim") >= threshold).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        if found := not links.isEmpty():
            merges.append(min_labels(links, "near"))
        return found

    known = buckets.join(first.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), "sim"), ["doc_id", "pivot"], "left").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    known = known.select("band", "key", "doc_id", "met", F.coalesce("label", "doc_id").alias("label"), (F.col("doc_id") == F.col("pivot")).alias("done"), F.coalesce(1 - F.col("sim"), F.lit(0.0)).alias("far"))
    turn = 0
    while True:
        # buckets with members of several components go on, with the members not yet compared with all others
        next_ = F.min(F.when(~F.col("done"), F.struct(-F.col("met"), F.col("doc_id").alias("doc"), "label")))
        known = keep(known, "known")
        mixed = known.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), next_.alias("next"), F.sum((~F.col("done")).cast("long")).alias("size"))
        mixed = keep(mixed.where("lo < hi and size > 1").select("band", "key", "next", "size"), "mixed")
        open_pairs = F.sum(F.col("size").cast("double") * (F.col("size") - 1) / 2)
        left_over = mixed.agg(F.sum("size").alias("members"), open_pairs.alias("pairs")).first()
        known = known.join(mixed.select("band", "key", "next"), ["band", "key"])
        if turn == rounds or not left_over.members or left_over.pairs <= few * left_over.members:
            break
        turn += 1
        known = keep(known, "known-mixed")
        pairs = known.where("label <> next.label and not done")
        pairs = pairs.select(F.col("doc_id").alias("a"), F.col("next.doc").alias("b"), F.col("label").alias("la"), F.col("next.label").alias("lb")).distinct()
        found = more_links(compare(pairs))
        known = known.select("band", "key", "doc_id", "met", "label", (F.col("done") | (F.col("doc_id") == F.col("next.doc"))).alias("done"), "far")
        if found:
            known = merged(known, "label", merges[-1])
    if left_over.members:
        reach = 1 - threshold + 1e-9
        same = (1 + threshold) / 2  # of the bits of a pair at the threshold
        differ = int(long_sketch * (1 - same) + 4.5 * (long_sketch * same * (1 - same)) ** 0.5) + 1
        known = known.where("not done")
        ids = keep(known.select("doc_id").distinct(), "open-ids")
        held = sets.join(ids, "doc_id", "left_semi").mapInArrow(_bit_rows(long_sketch), "doc_id long, bits array<long>")
        held = held.join(lead.join(ids, "doc_id", "left_semi").select("doc_id", "bands").dropDuplicates(["doc_id"]), "doc_id")
        open_ = keep(known.join(held, "doc_id").withColumn("slot", F.floor(F.col("far") / reach)), "open")
        parts = (("doc_id", ""), ("label", "l"), ("far", "f"), ("bits", "s"), ("bands", "k"))
        x = open_.select("band", "key", *(F.col(c).alias(f"{n}a") for c, n in parts), F.explode(F.sequence(F.col("slot") - 1, F.col("slot") + 1)).alias("slot"))
        y = open_.select("band", "key", *(F.col(c).alias(f"{n}b") for c, n in parts), "slot")
        near = (F.col("a") > F.col("b")) & (F.col("la") != F.col("lb")) & (F.abs(F.col("fa") - F.col("fb")) <= reach)
        # a pair is made in the first bucket that both are in; where that bucket is not mixed, or one of them is done in it, the pair is settled
        for i in range(bands - 1):
            near = near & ((F.col("band") <= i) | (F.get("ka", F.lit(i)) != F.get("kb", F.lit(i))))
        near = near & (sum(F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(long_sketch // 64)) <= differ)
        more_links(compare(keep(x.join(y, ["band", "key", "slot"]).where(near).select("a", "b", "la", "lb").distinct(), "rest")))

    classed = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    for up in merges:
        classed = merged(classed, "class_id", up)
    if has_repeated:
        named = classed.withColumnsRenamed({"doc_id": "node", "class_id": "label"}).join(repeated, "node", "left").withColumn("doc_id", F.coalesce("doc_id", "node"))
        heads = named.groupBy("label").agg(F.min(F.struct("doc_id", "tag")).alias("head"))
        leads = (F.col("doc_id") == F.col("head.doc_id")) & F.col("tag").eqNullSafe(F.col("head.tag"))
        classed = named.join(heads, "label").select("doc_id", F.col("head.doc_id").alias("class_id"), "tag", leads.alias("leads"))
    else:
        classed = classed.select("doc_id", "class_id", F.lit(None).cast("long").alias("tag"), (F.col("doc_id") == F.col("class_id")).alias("leads"))
    alone = signs.where("n = 0").select("doc_id", "tag").distinct().union(plain.where("doc_id is null").select("doc_id", "tag"))
    return classed.union(alone.select("doc_id", F.col("doc_id").alias("class_id"), "tag", F.lit(True)))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that do not lead their class."""
    gone = classes.where("not leads").select(F.col("doc_id").alias("_near_id"), F.col("tag").alias("_near_tag"))
    same_text = F.col("_near_tag").isNull() | (F.col("_near_tag") == _tag(docs[text_col]))
    return docs.join(gone, (docs[id_col] == F.col("_near_id")) & same_text, "left_anti")


def _tag(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text.cast("string")), F.lit(0))
