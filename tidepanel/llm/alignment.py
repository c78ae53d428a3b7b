"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, cut into groups where both end.

Tokenizer A is byte-level BPE and reads a space and the text; tokenizer B is a
SentencePiece model, which adds that space itself. Every stretch between two
neighbouring token ends (of either tokenizer) is one link: the pair of tokens
that cover it. Links are counted by pair of ids over the whole corpus.

A text of up to ``long_bytes`` is aligned where it lies. A longer one is cut into
byte ranges that other tasks take. A range holds the tokens that end in it and
yields a fragment: an open prefix (what ends up to the first common end), closed
groups, and an open suffix. Two neighbouring fragments compose into one: the
suffix of the first and the prefix of the second close into a group, or stay
open if one of the two has no common end. That is associative, so fragments are
reduced as a tree, ``fan`` at a time. Closed groups leave the tree at once, with
their place; a document's digest reads them in order as a stream.

To find its tokens a range reads on to the next cut that neither tokenizer joins
over (a single space between two visible characters), on both sides. Ranges that
have no such cut near are merged.

Pair counts: the ``most_frequent`` pairs (a bound, not a cut) are looked up in
each task; the other pairs, each with few links, are joined by Spark.

Defined results: a null or empty text, or one that a tokenizer does not give back
(a text that holds "▁"), has no tokens: zeros and an empty digest; special
tokens' strings are plain text; rows with the same or no id are texts of their
own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import id_text, keep, packs

MARK = "▁"
_CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")
_loaded: dict[tuple[str, str], Tokenizers] = {}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens and what is written for them in a digest."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = bpe.load(a).plain
        self.other = Tokenizer.from_file(public_tokenizers.path(f"{a}.json"))
        self.other.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        n_a, n_b = self.other.get_vocab_size(), self.pieces.get_piece_size()
        self.bytes_a = [self.plain.decode_single_token_bytes(i) if i < self.plain.n_vocab else b"" for i in range(n_a)]
        names = [self.pieces.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.within = not any(MARK in p.lstrip(MARK) for p in names)  # no piece goes on over a space
        self.n_a, self.n_b = n_a, n_b
        self.shown = [b"%d%b" % (i, end) for n, ends in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for end in ends for i in range(n)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text, which must begin with a space; none where they do not give the text back."""
        found = []
        for text, b in zip(texts, self.pieces.encode([t[1:] for t in texts], num_threads=1), strict=True):
            plain, raw = not bpe.needs_library(text), text.encode()
            a = self.plain.encode_ordinary(text) if plain else self.other.encode(text, add_special_tokens=False).ids
            if b"".join(map(self.bytes_b.__getitem__, b)) != raw or not plain and b"".join(map(self.bytes_a.__getitem__, a)) != raw:
                a, b = [], []
            found.append((np.array(a, np.int64), np.array(b, np.int64)))
        return found


def load(a: str, b: str) -> Tokenizers:
    if (a, b) not in _loaded:
        _loaded[a, b] = Tokenizers(a, b)
    return _loaded[a, b]


class Aligned:
    """Two token sequences over the same bytes, given by ids and ends (offsets after each token)."""

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
        self.a, self.b, self.ends_a, self.ends_b = a, b, ends_a, ends_b
        ends = np.concatenate((ends_a, ends_b))
        order = np.argsort(ends, kind="stable")  # of two equal ends A's comes first
        ends, of_a = ends[order], order < len(ends_a)
        same = ends[1:] == ends[:-1]
        edge = np.zeros(min(1, len(ends)), bool)
        first, second = (np.concatenate(x) for x in ((same, edge), (edge, same)))
        self.common, self.cuts = ends[first], ends[~second]  # one link ends at each cut
        self.link_a, self.link_b = (x[(np.cumsum(of) - of)[~second]] for x, of in ((a, of_a), (b, ~of_a)))
        group = np.cumsum(first) - first - second
        self.in_a, self.in_b, self.last_a, self.last_b = group[of_a], group[~of_a], first[of_a], second[~of_a]

    def shown(self, t: Tokenizers) -> np.ndarray:
        """Places in ``t.shown`` of all tokens in the digest's order: group by group, A before B."""
        up_to_a, up_to_b = (np.cumsum(np.bincount(x, minlength=len(self.common))) for x in (self.in_a, self.in_b))
        before_b = np.concatenate(([0], up_to_b))
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + before_b[self.in_a]] = self.a + t.n_a * self.last_a
        out[np.arange(len(self.b)) + up_to_a[self.in_b]] = 2 * t.n_a + self.b + t.n_b * self.last_b
        return out


def _pairs(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """of, a, b and number of the distinct rows, in order of ``of``."""
    keys, n = np.unique(of << 42 | a << 21 | b, return_counts=True)
    return keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF, n


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


_COUNTS = "n_a long, n_b long, n_groups long, n_links long, a array<int>, b array<int>, k array<int>"
_DOCUMENT = f"row long, doc_id long, {_COUNTS}, groups_sha256 string"


def _numbers() -> Iterator[int]:
    """Row numbers that no other task gives."""
    from pyspark import TaskContext

    n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    while True:
        yield n
        n += 1


def _whole(names: tuple[str, str], most: int = 1 << 20) -> Callable:
    """Aligns each text; those of one, about ``most`` bytes, are one byte sequence, as their ends are common ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = load(*names), _numbers()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo, hi in packs(texts, most):
                some = [i for i in range(lo, hi) if texts[i]]
                found = dict(zip(some, t.encode([" " + texts[i] for i in some]), strict=True))
                none = np.empty(0, np.int64)
                tokens = [found.get(i, (none, none)) for i in range(lo, hi)]
                n_a, n_b = (np.array([len(x[k]) for x in tokens], np.int64) for k in (0, 1))
                a, b = (np.concatenate([x[k] for x in tokens]) for k in (0, 1))
                all_ = Aligned(a, np.cumsum(t.size_a[a]), b, np.cumsum(t.size_b[b]))
                ends = np.concatenate(([0], all_.ends_a))[np.cumsum(n_a)]
                n_groups, n_links = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (all_.common, all_.cuts))
                of, pa_, pb, k = _pairs(np.repeat(np.arange(hi - lo), n_links), all_.link_a, all_.link_b)
                shown, n_pairs = all_.shown(t), np.bincount(of, minlength=hi - lo)
                stops, digests = np.cumsum(n_a + n_b).tolist(), []
                for start, stop in zip([0, *stops], stops):
                    digests.append(hashlib.sha256(b"".join(map(t.shown.__getitem__, shown[start:stop].tolist()))[:-1]).hexdigest() if stop > start else "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(number) for _ in tokens], pa.int64()), ids.slice(lo, hi - lo), *map(pa.array, (n_a, n_b, n_groups, n_links)), _lists(pa_, n_pairs), _lists(pb, n_pairs), _lists(k, n_pairs), pa.array(digests, pa.string())],
                    [c.split()[0] for c in _DOCUMENT.split(", ")],
                )

    return run


# long texts


def ranges(text: str, size: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, first, last) in characters: ranges of about ``size`` and the cuts around each between which its tokens are found."""
    marks = [(0, 0, 0)]  # (border, cut before it, cut after it)
    for border in range(size, len(text), size):
        if border <= marks[-1][2]:
            continue
        before = text.rfind(" ", border - size, border + 1)
        while before >= 0 and not _CUT.match(text, before):
            before = text.rfind(" ", border - size, before)
        after = _CUT.search(text, border, border + size)
        if before > 0 and after:
            marks.append((border, before, after.start()))
    marks.append((len(text), len(text), len(text)))
    return [(lo[0], hi[0], lo[1], hi[2]) for lo, hi in zip(marks, marks[1:])]


_CHUNK = "row long, doc_id long, part int, lo long, hi long, first long, text string"


def _cut(names: tuple[str, str], size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, within = _numbers(), load(*names).within
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                row, text, at, done, out = -1 - next(number), " " + text, 0, 0, []

                def place(to: int) -> int:  # in bytes; asked for in rising order but for the overlaps
                    nonlocal at, done
                    done += len(text[at:to].encode()) if to >= at else -len(text[to:at].encode())
                    at = to
                    return done

                for part, (lo, hi, first, last) in enumerate(ranges(text, size if within else len(text))):
                    out.append((row, doc_id, part, place(lo), place(hi), place(first), text[first:last]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

    return run


_OPEN = ("a", "ends_a", "b", "ends_b")
_PART = f"kind string, row long, doc_id long, part int, at long, same boolean, {_COUNTS}, shown binary, cut boolean, last long" + "".join(f", {side}_{x} array<long>" for side in ("pre", "suf") for x in _OPEN)
_PART_TYPES = pa.schema(
    [("kind", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("same", pa.bool_()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links"))]
    + [*((n, pa.list_(pa.int32())) for n in "abk"), ("shown", pa.binary()), ("cut", pa.bool_()), ("last", pa.int64()), *((f"{side}_{x}", pa.list_(pa.int64())) for side in ("pre", "suf") for x in _OPEN)]
)


def _piece(t: Tokenizers, row: int, at: int, tokens: tuple) -> dict:
    """Closed groups that start at byte ``at``, as a row."""
    all_ = Aligned(*tokens)
    _, a, b, k = _pairs(np.zeros(len(all_.cuts), np.int64), all_.link_a, all_.link_b)
    shown = b"".join(map(t.shown.__getitem__, all_.shown(t).tolist()))
    return {"kind": "piece", "row": row, "at": at, "n_a": len(all_.a), "n_b": len(all_.b), "n_groups": len(all_.common), "n_links": len(all_.cuts), "a": a, "b": b, "k": k, "shown": shown}


def _fragment(row: int, doc_id: int, part: int, same: bool, cut: bool, last: int, pre: tuple, suf: tuple) -> dict:
    own = {"kind": "fragment", "row": row, "doc_id": doc_id, "part": part, "same": same, "cut": cut, "last": last}
    return own | {f"pre_{n}": x for n, x in zip(_OPEN, pre, strict=True)} | {f"suf_{n}": x for n, x in zip(_OPEN, suf, strict=True)}


def _side(fragment: dict, side: str) -> tuple:
    return tuple(np.asarray(fragment[f"{side}_{n}"], np.int64) for n in _OPEN)


def _both(x: tuple, y: tuple) -> tuple:
    return tuple(np.concatenate(p) for p in zip(x, y, strict=True))


_NONE = tuple(np.empty(0, np.int64) for _ in _OPEN)


def compose(t: Tokenizers, x: dict, y: dict) -> tuple[dict, list[dict]]:
    """The fragment of two neighbours and the groups that close between them."""
    pre, suf, closed, last = _side(x, "pre"), _side(y, "suf"), [], y["last"] if y["cut"] else x["last"]
    if not x["cut"]:
        pre = _both(pre, _side(y, "pre"))
    elif y["cut"]:
        closed.append(_piece(t, x["row"], x["last"], _both(_side(x, "suf"), _side(y, "pre"))))
    else:
        suf = _both(_side(x, "suf"), _side(y, "pre"))
    return _fragment(x["row"], x["doc_id"], x["part"], x["same"] and y["same"], x["cut"] or y["cut"], last, pre, suf), closed


def fragment(t: Tokenizers, row: int, doc_id: int, part: int, lo: int, hi: int, first: int, text: str) -> tuple[dict, list[dict]]:
    """The fragment of the tokens that end after byte ``lo`` and up to ``hi``, and its closed groups."""
    a, b = t.encode([text])[0]
    ends_a, ends_b = first + np.cumsum(t.size_a[a]), first + np.cumsum(t.size_b[b])
    in_a, in_b = (ends_a > lo) & (ends_a <= hi), (ends_b > lo) & (ends_b <= hi)
    tokens, common = (a[in_a], ends_a[in_a], b[in_b], ends_b[in_b]), np.intersect1d(ends_a[in_a], ends_b[in_b], assume_unique=True)
    if not len(common):
        return _fragment(row, doc_id, part, len(a) > 0, False, 0, tokens, _NONE), []

    def between(after: int, to: int) -> tuple:
        (p, q), (r, s) = (np.searchsorted(e, (after, to), "right") for e in (tokens[1], tokens[3]))
        return tokens[0][p:q], tokens[1][p:q], tokens[2][r:s], tokens[3][r:s]

    start, last = int(common[0]), int(common[-1])
    closed = [_piece(t, row, start, between(start, last))] if last > start else []
    return _fragment(row, doc_id, part, True, True, last, between(lo, start), between(last, hi)), closed


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in _PART_TYPES.names} for r in rows], _PART_TYPES)


def _fragments(names: tuple[str, str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(*names)
        for batch in batches:
            for i in range(batch.num_rows):
                own, closed = fragment(t, **{k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()})
                yield _rows([own, *closed])

    return run


def _reduced(names: tuple[str, str], fan: int) -> Callable:
    """Folds runs of ``fan`` neighbours; rows come in order of row and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held = load(*names), None
        for batch in batches:
            for x in batch.to_pylist():
                x["part"] //= fan
                if held and (held["row"], held["part"]) == (x["row"], x["part"]):
                    held, closed = compose(t, held, x)
                    yield _rows(closed)
                else:
                    if held:
                        yield _rows([held])
                    held = x
        if held:
            yield _rows([held])

    return run


def _first_groups(names: tuple[str, str]) -> Callable:
    """What is open before the first common end of a whole document is its first group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(*names)
        for batch in batches:
            yield _rows([_piece(t, x["row"], 0, _side(x, "pre")) for x in batch.to_pylist() if x["same"]])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a document's groups in order, fed piece by piece, without the last separator."""
    now, sha, out = None, None, []
    for batch in batches:
        for row, shown in zip(batch.column("row").to_pylist(), batch.column("shown").to_pylist(), strict=True):
            if row != now:
                out += [(now, sha.hexdigest())] if sha else []
                now, sha = row, hashlib.sha256(shown[:-1])
            else:
                sha.update(b";" + shown[:-1])
    out += [(now, sha.hexdigest())] if sha else []
    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["row", "groups_sha256"])


def _long_texts(docs: DataFrame, names: tuple[str, str], size: int, fan: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, counts and digest) and their pieces (row, a, b, k), of long texts."""
    chunks = keep(docs.mapInArrow(_cut(names, size), _CHUNK), "align-chunks")
    parts = max(1, chunks.count() // spread)
    found = keep(chunks.repartition(parts, "row", "part").mapInArrow(_fragments(names), _PART), "align-fragments")
    pieces = [found.where("kind = 'piece'")]
    while (found.where("kind = 'fragment'").agg(F.max("part")).first()[0] or 0) > 0:
        near = found.where("kind = 'fragment'").repartition(parts, "row", F.floor(F.col("part") / fan)).sortWithinPartitions("row", "part")
        found = keep(near.mapInArrow(_reduced(names, fan), _PART), "align-fragments")
        pieces.append(found.where("kind = 'piece'"))
    roots = found.where("kind = 'fragment'").select("row", "doc_id", "same", *(f"pre_{n}" for n in _OPEN))
    pieces.append(keep(roots.mapInArrow(_first_groups(names), _PART), "align-first"))
    every = pieces[0]
    for p in pieces[1:]:
        every = every.unionByName(p)
    every = every.select("row", "at", "n_a", "n_b", "n_groups", "n_links", "a", "b", "k", "shown").join(roots.where("same").select("row"), "row", "left_semi")
    sums = every.groupBy("row").agg(*(F.sum(n).alias(n) for n in ("n_a", "n_b", "n_groups", "n_links")))
    digests = every.select("row", "at", "shown").repartition(parts, "row").sortWithinPartitions("row", "at").mapInArrow(_digests, "row long, groups_sha256 string")
    documents = roots.select("row", "doc_id").join(sums, "row", "left").join(digests, "row", "left")
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": F.coalesce("groups_sha256", F.lit(""))}
    return documents.withColumns(zero), keep(every.select("row", "a", "b", "k"), "align-pieces")


# pair counts


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and numbers of a batch's pairs, and how many each row has."""
    a, b, k = (batch.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in "abk")
    return a << 32 | b, k, batch.column("a").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, k, _ = _flat(batch)
        pairs, at = np.unique(keys, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, at, k)
        yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32()), pa.array(n)], ["a", "b", "n"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, their number of links in all rows and whether that is the highest of b."""
    counts = keep(rows.select("a", "b", "k").mapInArrow(_summed, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("count")), "align-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # B's vocabulary at most
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


_SCORE = "row long, n_best long, count_sum long, a array<int>, b array<int>, k array<int>"


def _scored(keys: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Callable:
    """Sums over a row's frequent pairs; the others are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, k, lengths = _flat(batch)
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            stops = np.concatenate(([0], np.cumsum(lengths)))
            sums = []
            for value in (best, counts):
                run_ = np.concatenate(([0], np.cumsum(np.where(known, k * value[at], 0) if len(keys) else np.zeros(len(pairs), np.int64))))
                sums.append(np.diff(run_[stops]))
            rest = np.diff(np.concatenate(([0], np.cumsum(~known)))[stops])
            lists = [_lists(x[~known], rest) for x in (pairs >> 32, pairs & 0xFFFFFFFF, k)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums), *lists], ["row", "n_best", "count_sum", "a", "b", "k"])

    return run


def scores(rows: DataFrame, counts: DataFrame, most_frequent: int) -> DataFrame:
    """n_best and count_sum of each row number in ``rows`` (row, a, b, k)."""
    top = counts.orderBy(F.desc("count"), "a", "b").limit(most_frequent).toArrow()
    a, b, n, best = (top.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "count", "best"))
    order = np.argsort(a << 32 | b)
    known = keep(rows.select("row", "a", "b", "k").mapInArrow(_scored((a << 32 | b)[order], n[order], best[order]), _SCORE), "align-scored")
    few = counts.where(F.col("count") <= int(n.min())) if len(n) else counts
    rest = known.where(F.size("a") > 0).select("row", F.explode(F.arrays_zip("a", "b", "k")).alias("p")).select("row", "p.*")
    rare = rest.join(few, ["a", "b"]).select("row", (F.col("k") * F.col("best").cast("long")).alias("n_best"), (F.col("k") * F.col("count")).alias("count_sum"))
    return known.select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model", long_bytes: int = 1 << 15, range_chars: int = 1 << 14, fan: int = 8, most_frequent: int = 1 << 16, spread: int = 64
) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the corpus's pairs (a, b, count, best)."""
    docs, names = id_text(docs, id_col, text_col), (a, b)
    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    short = keep(docs.where(~is_long).mapInArrow(_whole(names), _DOCUMENT), "align-documents")
    long, pieces = _long_texts(docs.where(is_long), names, range_chars, fan, spread)
    rows = short.select("row", "a", "b", "k").unionByName(pieces)
    counts = keep(pair_counts(rows), "align-pairs")
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    both = short.select(columns).unionByName(long.select(columns)).join(scores(rows, counts, most_frequent), "row", "left")
    sums = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_best", "count_sum")]
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256"), counts


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k", b: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and each text's groups themselves, an array of (a, b) id arrays, for texts that fit a row."""
    names = (a, b)

    @F.arrow_udf("array<struct<a: array<int>, b: array<int>>>")
    def of(texts: pa.Array) -> pa.Array:
        t, out = load(*names), []
        for text in texts.to_pylist():
            (ids_a, ids_b) = t.encode([" " + text])[0] if text else (np.empty(0, np.int64),) * 2
            all_ = Aligned(ids_a, np.cumsum(t.size_a[ids_a]), ids_b, np.cumsum(t.size_b[ids_b]))
            sides = [np.split(x, np.searchsorted(e, all_.common, "right")[:-1]) for x, e in ((all_.a, all_.ends_a), (all_.b, all_.ends_b))] if len(all_.common) else [[], []]
            out.append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(*sides, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))

    return id_text(docs, id_col, text_col).select("doc_id", of("text").alias("groups"))
