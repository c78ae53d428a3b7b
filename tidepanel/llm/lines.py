"""Line dedup: a line goes if an earlier one (smaller document id, then smaller line number) is near it.

Two lines of which the longer has ``min_words`` words or more are near if their
edit distance in words is at most one for each ``words_per_edit`` words of the
longer, ``most_edits`` at most. Shorter lines are near if their edit distance in
characters (words joined by one space) is at most one for each ``chars_per_edit``
characters of the longer, ``most_char_edits`` at most. Equal lines are near
whatever their length.

1. Equal lines: the first of each is kept.
2. Deletion neighbourhood: at k edits two lines share all but k words of the
   longer, so of the k + 2 words of each that come first in one order of all
   words, rarest first, they share two (the third same word of a line is another
   word than its first). A line's keys are the hashes of all variants that leave
   out k of these k + 2 words. For characters the same holds with runs of three,
   of which an edit changes three. The order comes from a sample of the lines; it
   changes the cost alone.
3. Lines with an equal variant are candidates if their lengths and the parities of
   64 word classes allow the bound; a line has its nearest ``most`` of a key
   compared, and only if none is near, all the others too.
4. The edit distance is computed before a line goes.

Defined results: lines end at "\\n"; words are what stands between white space,
so lines equal but for white space are equal; lines without words stay and are
counted in n_lines alone; a null text has no lines; a row with a null id loses
nothing and takes no part; of rows with the same id each text is a document of
its own, in the order of the texts' hashes, and rows equal in both are one
document; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, keep, packs, releasing, text_bytes
from .textkit import Words, _tables, mix

_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_NUMBER = 0xFFFFFFFF


def _segments(h: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs h[a:b], equal to those of the runs by themselves."""
    powers, inverse = _tables(base, len(h) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers[: len(h)], dtype=np.uint64)))
        return mix((sums[b] - sums[a]) * inverse[a])


def distance(x: list, y: list, most: int) -> int:
    """Edit distance of two sequences (bit-parallel); more than ``most`` may end early."""
    a, n = 0, min(len(x), len(y))
    while a < n and x[a] == y[a]:
        a += 1
    b = 0
    while b < n - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if not x or not y or abs(len(x) - len(y)) > most:
        return max(len(x), len(y))
    at: dict = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full, top, score, left = (1 << len(x)) - 1, 1 << (len(x) - 1), len(x), len(y)
    up, down = full, 0
    for c in y:
        eq = at.get(c, 0)
        rows = eq | down
        cols = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(cols | up) & full), up & cols
        score += bool(plus & top) - bool(minus & top)
        left -= 1
        if score - left > most:
            return score - left
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(rows | plus)) & full, plus & rows & full
    return score


@dataclass(frozen=True)
class Bounds:
    """Edits allowed, and what a line must emit to meet every longer line it can be near."""

    min_words: int = 10
    words_per_edit: int = 10
    most_edits: int = 4
    chars_per_edit: int = 10
    most_char_edits: int = 2

    def allowed(self, chars, longer):
        """Edits between two lines of which the longer has ``longer`` words, or characters where ``chars`` is true."""
        return np.where(chars, np.minimum(self.most_char_edits, longer // self.chars_per_edit), np.minimum(self.most_edits, longer // self.words_per_edit))

    def met(self, chars: bool, n: np.ndarray) -> np.ndarray:
        """The most edits allowed between a line of size n and any longer one."""
        per, most = (self.chars_per_edit, self.most_char_edits) if chars else (self.words_per_edit, self.most_edits)
        return np.minimum(most, n // (per - 1))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of three characters, and how many each text has."""
    size = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    with np.errstate(over="ignore"):
        h = mix((c[:-2] * np.uint64(0x9E3779B97F4A7C55) + c[1:-1]) * np.uint64(0x9E3779B97F4A7C55) + c[2:] + np.uint64(1 << 40))
    return h[text[:-2] == text[2:]], np.maximum(size - 2, 0)


def _in_order(owner: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by owner, rank and h, by one sort of numbers that hold all of the first two and as much of h as there is room for."""
    bits = int(owner[-1]).bit_length() + int(rank.max()).bit_length() if len(h) else 64
    if bits < 64:
        room = np.uint64(64 - bits)
        packed = (owner.astype(np.uint64) << np.uint64(int(rank.max()).bit_length()) | rank.astype(np.uint64)) << room | h >> np.uint64(bits)
        order = np.argsort(packed)
        packed, sorted_h = packed[order], h[order]
        if not ((packed[1:] == packed[:-1]) & (sorted_h[1:] != sorted_h[:-1])).any():
            return order
    return np.lexsort((h, rank, owner))


@dataclass(frozen=True)
class Ranks:
    """Places of frequent words in one order of all words, rarest first, looked up by the first bits of their hashes; a word that is not held comes before them all. Of words in one slot the most frequent is held, which changes the cost alone."""

    held: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, common: tuple[np.ndarray, np.ndarray], bits: int = 20) -> Ranks:
        h, n = common
        order = np.lexsort((h, n))
        held, rank = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        slot = (h[order] >> np.uint64(64 - bits)).astype(np.int64)
        held[slot], rank[slot] = h[order], np.arange(1, len(h) + 1)
        return cls(held, rank)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(64 - (len(self.held).bit_length() - 1))).astype(np.int64)
        return np.where(self.held[slot] == h, self.rank[slot], 0)


def _variants(h: np.ndarray, count: np.ndarray, gone: np.ndarray, ranks: Ranks, chars: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of ``count`` entries of h: the hashes of all pairs of its ``gone`` + 2 rarest (none where gone is 0), how many they are, and the parities of the 64 classes. A hash is odd where it stands for characters."""
    count = np.asarray(count, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    order = _in_order(owner, ranks(h), h)
    h, place = h[order], np.arange(len(h))  # owners are in order already
    start = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
    again = place - np.maximum.accumulate(np.where(start, place, 0))
    with np.errstate(over="ignore"):
        key = mix(h + again.astype(np.uint64) * _PLACE)
    parity, some = np.zeros(len(count), np.uint64), np.flatnonzero(count)
    if len(some):
        parity[some] = np.bitwise_xor.reduceat(np.uint64(1) << (key & np.uint64(63)), (np.cumsum(count) - count)[some])
    held, many = np.where(gone > 0, np.minimum(gone + 2, count), 0), np.zeros(len(count), np.int64)
    many = held * (held - 1) // 2
    out, first, put = np.zeros(many.sum(), np.uint64), np.cumsum(count) - count, np.cumsum(many) - many
    for c in np.unique(held[held > 1]):
        own = np.flatnonzero(held == c)
        rarest = key[first[own][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        with np.errstate(over="ignore"):
            out[put[own][:, None] + np.arange(len(i))] = mix(rarest[:, i] * _PLACE + rarest[:, j]) & ~np.uint64(1) | np.uint64(chars)
    return out, many, parity


def _pack_lines(texts: list[bytes | None]):
    """Words of all lines of the texts, and of each line with words: its text, number, first and last word."""
    lines = [(t or b"").split(b"\n") for t in texts]
    count = np.array([len(t) for t in lines])
    words = Words([x for t in lines for x in t])
    doc = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    a, b = words.first[:-1], words.first[1:]
    full = np.flatnonzero(b > a)
    return words, a[full], b[full], doc[full], number[full]


def _squeezed(words: Words, a, b) -> list[str]:
    return [b" ".join(words.text(i, j)).decode("utf-8", "replace") for i, j in zip(a.tolist(), b.tolist(), strict=True)]


def _sampled(min_words: int):
    """Counts of the words and, in short lines, of the runs of three characters."""

    def run(batches):
        for batch in batches:
            for lo, hi in packs(texts := text_bytes(batch.column("text"))):
                words, a, b, _, _ = _pack_lines(texts[lo:hi])
                if len(a):
                    short = b - a < min_words
                    h, n = np.unique(np.concatenate((words.h, _grams(_squeezed(words, a[short], b[short]))[0])), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return run


def _line_rows(bounds: Bounds, common: tuple[np.ndarray, np.ndarray]):
    """A row for each distinct line of a document: its hash, its line numbers, its size in words and characters, its variants and parities by words and by characters."""

    def run(batches):
        ranks = Ranks.of(common)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in packs(texts):
                words, a, b, doc, number = _pack_lines(texts[lo:hi])
                if not len(a):
                    continue
                doc, n = doc + lo, b - a
                k1 = _segments(words.h, a, b, _BASES[0])
                k2 = _segments(words.h, a, b, _BASES[1]) >> np.uint64(33)
                order = np.lexsort((number, n, k2, k1, doc))
                a, b, doc, number, n, k1, k2 = (x[order] for x in (a, b, doc, number, n, k1, k2))
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (n[1:] != n[:-1])))
                at = np.flatnonzero(new)
                a, b, m = a[at], b[at], n[at]
                long = np.where(m + bounds.met(False, m) >= bounds.min_words, m, 0)
                h = words.h[np.repeat(a - (np.cumsum(long) - long), long) + np.arange(long.sum())]
                keys, many, parity = _variants(h, long, bounds.met(False, long), ranks, False)
                columns = [*(batch.column(c).take(pa.array(doc[at])) for c in ("doc_id", "tag")), pa.array(k1[at].view(np.int64)), pa.array(k2[at].astype(np.int32)), pa.array(m.astype(np.int32))]
                columns += [pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)).astype(np.int32)), pa.array(number.astype(np.int32)))]
                columns += [_lists(keys, many), pa.array(parity.view(np.int64))]
                short = np.flatnonzero(m < bounds.min_words)
                plain = _squeezed(words, a[short], b[short])
                size, many, parity = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), np.zeros(len(m), np.uint64)
                size[short] = [len(t) for t in plain]
                h, count = _grams(plain)
                keys, many[short], parity[short] = _variants(h, count, 3 * bounds.met(True, size[short]), ranks, True)
                columns += [pa.array(size.astype(np.int32)), _lists(keys, many), pa.array(parity.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _LINES.split(", ")])

    return run


_LINES = "doc_id long, tag int, k1 long, k2 int, n int, numbers array<int>, keys array<long>, p long, chars int, grams array<long>, gp long"


def _lists(flat: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(flat.view(np.int64)))


_CANDIDATES = "key long, doc_id long, line long, others array<long>, other_lines array<long>, more boolean"


def _candidates(bounds: Bounds, most: int | None):
    """From rows sorted by key: each line with its nearest ``most`` earlier ones of its key, by document and line; ``more`` says that it has others."""

    def pairs(key, *rest):
        same = key[1:] == key[:-1]
        some = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))  # most lines are alone with a key
        key, doc, line, size, p, asks = (x[some] for x in (key, *rest))
        order = np.lexsort((line, doc, key))
        key, doc, line, size, p, asks = (x[order] for x in (key, doc, line, size, p, asks))
        kind, p, size = (key & 1).astype(bool), p.view(np.uint64), size.astype(np.int64)
        found, more, out, active, d = np.zeros(len(key), np.int64), np.zeros(len(key), bool), [], np.flatnonzero(asks), 0
        while len(active):
            d += 1
            active = active[active >= d]
            active = active[key[active] == key[active - d]]
            i, j = active, active - d
            k = bounds.allowed(kind[i], np.maximum(size[i], size[j]))
            ok = (np.abs(size[i] - size[j]) <= k) & (np.bitwise_count(p[i] ^ p[j]) <= np.where(kind[i], 6, 2) * k) & ((doc[i] != doc[j]) | (line[i] != line[j]))
            ok &= kind[i] | (np.maximum(size[i], size[j]) >= bounds.min_words)
            over = ok & (found[i] == most) if most else np.zeros(len(i), bool)
            more[i[over]] = True
            out.append((i[ok & ~over], j[ok & ~over]))
            found[i[ok]] += 1
            active = active[~over]
        if not out:
            return None
        i, j = map(np.concatenate, zip(*out, strict=True))
        j = j[np.argsort(i, kind="stable")]
        i, count = np.unique(i, return_counts=True)
        offsets = pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32))
        columns = [pa.array(key[i]), pa.array(doc[i]), pa.array(line[i]), *(pa.ListArray.from_arrays(offsets, pa.array(x[j])) for x in (doc, line)), pa.array(more[i])]
        return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "line", "others", "other_lines", "more"])

    def run(batches):
        names, rest = ("key", "doc_id", "line", "size", "p", "asks"), None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) if c in batch.schema.names else np.ones(batch.num_rows, bool) for c in names]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            rest = [c[whole:] for c in columns]
            if whole and (got := pairs(*(c[:whole] for c in columns))) is not None:
                yield got
        if rest is not None and (got := pairs(*rest)) is not None:
            yield got

    return run


def _open_lines(batches):
    """The listed lines, white space squeezed."""
    for batch in batches:
        ids, listed, texts = batch.column("doc_id").to_pylist(), batch.column("listed").to_pylist(), text_bytes(batch.column("text"))
        out = []
        for d, want, t in zip(ids, listed, texts, strict=True):
            lines = t.split(b"\n")
            out += [(d, i, b" ".join(lines[i & _NUMBER].split())) for i in want]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "line", "words"])


def _verified(bounds: Bounds):
    def near(kind: bool, x: bytes, y: bytes) -> bool:
        x, y = (x.decode("utf-8", "replace"), y.decode("utf-8", "replace")) if kind else (x.split(b" "), y.split(b" "))
        k = int(bounds.allowed(kind, max(len(x), len(y))))
        return distance(x, y, k) <= k

    def run(batches):
        for batch in batches:
            found = [near(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "words", "others")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("line")], ["doc_id", "line"]).filter(pa.array(found, pa.bool_()))

    return run


def _kept(batches):
    for batch in batches:
        ids, removed, texts = batch.column("doc_id"), batch.column("removed").to_pylist(), batch.column("text").to_pylist()
        out = []
        for t, gone in zip(texts, removed, strict=True):
            lines, gone = t.split("\n") if t is not None else [], set(gone or ())
            left = [x for i, x in enumerate(lines) if i not in gone] if gone else lines
            out.append((len(lines), len(lines) - len(left), "\n".join(left)))
        n, less, text = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(less, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])


def _common(plain: DataFrame, min_words: int, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of a sixteenth of the documents, by hash, and their counts."""
    sample = plain.where("pmod(xxhash64(doc_id), 16) = 0").mapInArrow(_sampled(min_words), "h long, n long")
    top = sample.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(most).collect()
    h, n = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def line_tag(text_col: str = "text") -> Column:
    """Tells the different texts of one id apart."""
    return F.coalesce(F.xxhash64(text_col).bitwiseAND(0x7FFFFFFF), F.lit(0)).cast("int")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds = Bounds(), most: int = 3) -> DataFrame:
    """doc_id, tag (``line_tag`` of the text) and removed (line numbers from 0), for the documents that lose lines."""
    plain = id_text(docs, id_col, text_col).where("doc_id is not null").withColumn("tag", line_tag())
    lines = keep(plain.mapInArrow(releasing(_line_rows(bounds, _common(plain, bounds.min_words))), _LINES), "lines")
    same = ["k1", "k2", "n"]
    copied = lines.groupBy(*same).agg(F.min(F.struct("doc_id", "tag")).alias("low"), F.count("*").alias("copies")).where("copies > 1").select(*same, F.col("low.doc_id").alias("low"), F.col("low.tag").alias("low_tag"))
    later = lines.select("doc_id", "tag", *same, "numbers").join(copied, same).where("doc_id <> low or tag <> low_tag")
    later = keep(later.select("doc_id", "tag", *same, "numbers"), "later")
    again = later.select("doc_id", "tag", "numbers").union(lines.where("size(numbers) > 1").select("doc_id", "tag", F.slice("numbers", 2, 1 << 30)))
    again = again.select("doc_id", F.explode(F.transform("numbers", _tagged)).alias("line"))

    # only lines whose bucket holds a later copy are joined; the broadcast has at most 2^20 numbers
    bucket = F.pmod("k1", F.lit(1 << 20)).cast("int").alias("_bucket")
    marks, dealt = F.broadcast(later.select(bucket).distinct()), lines.select("*", bucket)
    firsts = dealt.join(marks, "_bucket", "left_semi").join(later.select("doc_id", "tag", *same), ["doc_id", "tag", *same], "left_anti")
    firsts = firsts.unionByName(dealt.join(marks, "_bucket", "left_anti"))
    firsts = firsts.select("doc_id", _tagged(F.element_at("numbers", 1)).alias("line"), "n", "chars", "p", "gp", F.explode(F.concat("keys", "grams")).alias("key"))
    by_chars = F.col("key").bitwiseAND(1) == 1
    keys = firsts.select("key", "doc_id", "line", F.when(by_chars, F.col("chars")).otherwise(F.col("n")).alias("size"), F.when(by_chars, F.col("gp")).otherwise(F.col("p")).alias("p"))

    def candidates(rows: DataFrame, most: int | None, name: str) -> DataFrame:
        dealt = rows.repartition("key").sortWithinPartitions("key")  # by one number, so that Spark sorts by its bits
        return keep(dealt.mapInArrow(releasing(_candidates(bounds, most)), _CANDIDATES), name)

    def near(found: DataFrame, name: str) -> DataFrame:
        other = F.explode(F.arrays_zip("others", "other_lines")).alias("other")
        pairs = found.select((F.col("key").bitwiseAND(1) == 1).alias("kind"), "doc_id", "line", other)
        pairs = keep(pairs.select("kind", "doc_id", "line", F.col("other.others").alias("other_doc"), F.col("other.other_lines").alias("other_line")).distinct(), f"{name}-pairs")
        tag = F.shiftright("line", 32).cast("int").alias("tag")
        listed = pairs.select("doc_id", "line").union(pairs.select("other_doc", "other_line")).groupBy("doc_id", tag).agg(F.collect_set("line").alias("listed"))
        listed = keep(listed, f"{name}-listed")
        words = keep(_only(plain, listed).join(listed, ["doc_id", "tag"]).select("doc_id", "text", "listed").mapInArrow(_open_lines, "doc_id long, line long, words binary").dropDuplicates(["doc_id", "line"]), f"{name}-words")
        there = words.select(F.col("doc_id").alias("other_doc"), F.col("line").alias("other_line"), F.col("words").alias("others"))
        return keep(pairs.join(words, ["doc_id", "line"]).join(there, ["other_doc", "other_line"]).select("kind", "doc_id", "line", "words", "others").mapInArrow(_verified(bounds), "doc_id long, line long").distinct(), name)

    found = candidates(keys, most, "candidates")
    gone = near(found, "near")
    more = keep(found.where("more").join(gone, ["doc_id", "line"], "left_anti").select("key", "doc_id", "line").distinct(), "more")
    if not more.isEmpty():
        some = keys.join(more.select("key").distinct(), "key", "left_semi")
        rest = some.join(more.withColumn("asks", F.lit(True)), ["key", "doc_id", "line"], "left").fillna(False, ["asks"])
        gone = gone.union(near(candidates(rest, None, "candidates-rest"), "near-rest"))
    # the copies of a line that goes have gone with the equal lines
    number = F.col("line").bitwiseAND(_NUMBER).cast("int")
    gone = again.union(gone).groupBy("doc_id", F.shiftright("line", 32).cast("int").alias("tag")).agg(F.collect_set(number).alias("removed"))
    return keep(gone, "removed")


def _tagged(number: Column) -> Column:
    """A line's number within all rows of its id."""
    return F.shiftleft(F.col("tag").cast("long"), 32).bitwiseOR(number.cast("long"))


def _only(docs: DataFrame, some: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """``docs`` without most rows whose id is not in ``some``, so that their texts are not shuffled; the broadcast holds at most ``buckets`` numbers."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    return docs.withColumn("_bucket", bucket).join(F.broadcast(some.select(bucket.alias("_bucket")).distinct()), "_bucket", "left_semi").drop("_bucket")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """doc_id, n_lines, n_removed and text (the kept lines joined by "\\n"), a row for each row of ``docs``."""
    gone = removed_lines(docs, id_col, text_col, bounds)
    plain = id_text(docs, id_col, text_col).withColumn("tag", line_tag())
    return plain.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "removed").mapInArrow(_kept, "doc_id long, n_lines long, n_removed long, text string")
