"""Substring dedup by repeated-phrase automata.

1. Each document gives the minimizer grams of its words; a run of ``window``
   words always holds one, chosen by the run's content alone. Grams that two
   documents share mark the only regions that can recur.
2. *Confirm.* In these regions each bucket of documents gives its distinct
   window hashes (96 bits) with the smallest and largest document; grouping
   them finds the first document of every window and the buckets that repeat it.
3. *Compile.* The first document's bucket cuts the recurring passages for each
   bucket that repeats them. There, aligned blocks of half a window become the
   patterns of one Aho-Corasick automaton over word numbers: a shard holds no
   more than its own documents share.
4. *Stream.* Every document runs through its bucket's automaton; each hit is
   extended word by word, so that equality is exact, and an extent of at least
   ``window`` words is an occurrence.

Defined results: a null text has no words; a text of fewer than ``window`` words
loses none; a null id takes no part and loses none; rows with the same id are
one document id each judged by itself, and only smaller ids count; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, id_text, keep, packs, releasing, releasing_groups, text_bytes
from .textkit import Words, _slide, anchors, windows

_SECOND = 0xA0761D6478BD642F
_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int32()), ("bucket", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
_PASSAGES = pa.schema([("bucket", pa.int32()), ("source", pa.int64()), ("words", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _anchor_rows(window: int, gram: int):
    def run(batches):
        for batch in batches:
            ids, buckets, texts = batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), text_bytes(batch.column("text"))
            for lo, hi in packs(texts):
                words, out = Words(texts[lo:hi]), []
                for k in range(hi - lo):
                    h = words.h[words.first[k] : words.first[k + 1]]
                    if len(h) >= window:
                        g = windows(h, gram)
                        g = np.unique(g[anchors(g, window - gram + 1)])
                        out.append((g.view(np.int64), np.full(len(g), ids[lo + k]), np.full(len(g), buckets[lo + k], np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["gram", "doc_id", "bucket"])

    return run


def _by_doc(ids: np.ndarray, *values: np.ndarray):
    """{id: values of its rows}."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], [v[order] for v in values]
    cut = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    return {int(ids[a]): [v[a:b] for v in values] for a, b in zip(cut, [*cut[1:], len(ids)], strict=True)} if len(ids) else {}


def _window_rows(window: int, gram: int):
    """Per bucket: its distinct windows whose minimizer recurs, with the smallest and largest document."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not shared.num_rows or not docs.num_rows:
            return _WINDOWS.empty_table()
        grams = _by_doc(shared.column("doc_id").to_numpy(), shared.column("gram").to_numpy().view(np.uint64))
        ids, texts = docs.column("doc_id").to_pylist(), text_bytes(docs.column("text"))
        use = [i for i, d in enumerate(ids) if d in grams]
        ids, texts, found = [ids[i] for i in use], [texts[i] for i in use], []
        for lo, hi in packs(texts):
            words = Words(texts[lo:hi])
            for k in range(hi - lo):
                h = words.h[words.first[k] : words.first[k + 1]]
                if len(h) < window:
                    continue
                low = _slide(windows(h, gram), window - gram + 1, np.minimum)
                at = np.flatnonzero(np.isin(low, grams[ids[lo + k]][0]))
                w1 = windows(h, window)[at]
                w2 = (windows(h, window, _SECOND)[at] >> np.uint64(32)).astype(np.uint32)
                w1, first = np.unique(w1, return_index=True)
                found.append((w1, w2[first], np.full(len(w1), ids[lo + k])))
        if not found:
            return _WINDOWS.empty_table()
        w1, w2, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, w2, w1))
        w1, w2, doc = w1[order], w2[order], doc[order]
        new = np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))) if len(w1) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(w1)) - 1
        bucket = np.full(len(at), docs.column("bucket")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(x) for x in (w1[at].view(np.int64), w2[at].view(np.int32), bucket, doc[at], doc[last] if len(at) else doc[:0])], schema=_WINDOWS)

    return run


def _passage_rows(window: int):
    """Per bucket of first documents: for each bucket that repeats some of their windows, the passages these windows make."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not hits.num_rows or not docs.num_rows:
            return _PASSAGES.empty_table()
        wanted = _by_doc(hits.column("source").to_numpy(), hits.column("w1").to_numpy().view(np.uint64), hits.column("bucket").to_numpy())
        ids, texts = docs.column("doc_id").to_pylist(), text_bytes(docs.column("text"))
        use = [i for i, d in enumerate(ids) if d in wanted]
        ids, texts, out = [ids[i] for i in use], [texts[i] for i in use], []
        for lo, hi in packs(texts):
            words = Words(texts[lo:hi])
            for k in range(hi - lo):
                base = words.first[k]
                own, first = np.unique(windows(words.h[base : words.first[k + 1]], window), return_index=True)
                w1, to = wanted[ids[lo + k]]
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(own, w1), len(own) - 1)
                ok = own[at] == w1  # of rows with one id, each has its own windows
                pos, to = first[at[ok]], to[ok]
                order = np.lexsort((pos, to))
                pos, to = pos[order], to[order]
                cut = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (pos[1:] > pos[:-1] + 1)))) if len(pos) else []
                for a, b in zip(cut, [*cut[1:], len(pos)], strict=True):
                    out.append((int(to[a]), ids[lo + k], b" ".join(words.text(base + pos[a], base + pos[b - 1] + window))))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PASSAGES.types, strict=True)], schema=_PASSAGES) if out else _PASSAGES.empty_table()

    return run


def compile_automaton(passages: list[np.ndarray], block: int):
    """An automaton of the aligned blocks of the passages (word numbers, from 1); a block's value lists its (passage, offset) places."""
    places: dict[tuple, list] = {}
    for c, ids in enumerate(passages):
        for o in range(0, len(ids) - block + 1, block):
            places.setdefault(tuple(ids[o : o + block].tolist()), []).append((c, o))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, value in places.items():
        automaton.add_word(key, value)
    if places:
        automaton.make_automaton()
    return automaton if places else None


def _runs(true: np.ndarray):
    edge = np.flatnonzero(np.diff(np.concatenate(([False], true, [False])).view(np.int8)))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def cover(doc: np.ndarray, allowed, passages: list[np.ndarray], automaton, block: int, window: int, equal) -> np.ndarray:
    """True for each word inside an occurrence of ``window`` or more words of an allowed passage.

    ``doc`` holds word numbers, 0 for words of no passage; ``equal(a, b, passage, at)``
    says whether the words a to b - 1 are those of the passage from ``at`` on.
    """
    covered, seen = np.zeros(len(doc), bool), set()
    for lo, hi in _runs(doc > 0):
        if hi - lo < window:
            continue
        for end, value in automaton.iter(tuple(doc[lo:hi].tolist())):
            for c, o in value:
                shift = lo + end - block + 1 - o
                if not allowed[c] or (c, shift) in seen:
                    continue
                seen.add((c, shift))
                a, b = max(0, shift), min(len(doc), shift + len(passages[c]))
                if covered[a:b].all():
                    continue
                for x, y in _runs(doc[a:b] == passages[c][a - shift : b - shift]):
                    if y - x >= window and equal(a + x, a + y, c, a + x - shift):
                        covered[a + x : a + y] = True
    return covered


def _kept_rows(window: int):
    block = window // 2

    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        ids, tags, texts, out = docs.column("doc_id").to_pylist(), docs.column("tag").to_pylist(), text_bytes(docs.column("text")), []
        least: dict[bytes, int] = {}
        for p, d in zip(passages.column("words").to_pylist(), passages.column("source").to_pylist(), strict=True):
            least[p] = min(least.get(p, d), d)
        source, given = np.array(list(least.values()), np.int64), [p.split(b" ") for p in least]
        held = Words([b" ".join(p) for p in given])
        numbers, number = np.unique(held.h, return_inverse=True)  # a word's number is the place of its hash; words are compared where numbers agree
        arrays = [number[held.first[c] : held.first[c + 1]] + 1 for c in range(len(given))]
        automaton = compile_automaton(arrays, block)
        for lo, hi in packs(texts):
            words = Words(texts[lo:hi]) if automaton is not None else None
            for k in range(lo, hi):
                split, removed = (texts[k] or b"").split(), 0
                if words is not None and ids[k] is not None and len(split) >= window:
                    h = words.h[words.first[k - lo] : words.first[k - lo + 1]]
                    at = np.minimum(np.searchsorted(numbers, h), len(numbers) - 1)
                    doc = np.where(numbers[at] == h, at + 1, 0)
                    covered = cover(doc, source < ids[k], arrays, automaton, block, window, lambda a, b, c, o, split=split: split[a:b] == given[c][o : o + b - a])
                    if removed := int(covered.sum()):
                        out.append((ids[k], tags[k], len(split), removed, b" ".join([split[i] for i in np.flatnonzero(~covered)]).decode()))
                if not removed:
                    out.append((ids[k], tags[k], len(split), 0, b" ".join(split).decode()))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _KEPT.types, strict=True)], schema=_KEPT) if out else _KEPT.empty_table()

    return run


def _schema(s: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in s)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 8) -> DataFrame:
    """doc_id, tag (xxhash64 of the text), n_words, n_removed and the kept words joined by one space, a row for each row of ``docs``."""
    if not 1 <= gram <= window // 2:
        raise ValueError("gram must be between 1 and half the window")
    plain = id_text(docs, id_col, text_col)
    buckets = bucket_count(plain, bytes_each=4 << 20)  # a task holds a bucket's texts several times over: as given, as words, as what is kept

    def home(column):
        return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")

    tag = F.xxhash64("text")
    plain = plain.select(home(F.coalesce("doc_id", tag)).alias("bucket"), "doc_id", tag.alias("tag"), "text")
    grams = keep(plain.where("doc_id is not null").mapInArrow(releasing(_anchor_rows(window, gram)), "gram long, doc_id long, bucket int"), "grams")
    often = grams.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("gram")
    shared = keep(grams.join(often, "gram").select("bucket", "doc_id", "gram"), "shared")
    by_bucket = plain.groupBy("bucket")
    found = by_bucket.cogroup(shared.groupBy("bucket")).applyInArrow(releasing_groups(_window_rows(window, gram)), _schema(_WINDOWS))
    first = F.min("low").over(Window.partitionBy("w1", "w2"))
    hits = found.withColumn("source", first).where("high > source").select(home("source").alias("home"), "source", "w1", "bucket")
    passages = by_bucket.cogroup(hits.groupBy("home")).applyInArrow(releasing_groups(_passage_rows(window)), _schema(_PASSAGES))
    return by_bucket.cogroup(passages.groupBy("bucket")).applyInArrow(releasing_groups(_kept_rows(window)), _schema(_KEPT))
