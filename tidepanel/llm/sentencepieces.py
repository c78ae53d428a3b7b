"""SentencePiece encoding and decoding with a shared-prefix forward pass.

The distinct marked words ("▁" and the characters up to the next one) of many
texts are sorted, which is a trie walked depth-first: each word keeps the forward
states of the prefix it shares with the word before and computes the rest. For a
unigram model the state of a prefix is its best score and last piece (Viterbi).
For a BPE model, where a sum of scores would not give the library's ids, it is
the last piece of the prefix's own encoding: exactly one piece can follow the
encoding of the rest, the one whose pair with the last piece there is left alone
by the merges. Words that begin with several marks, and models with pieces that
go beyond a word, are encoded by the merges or scores over the whole run.

Defined results: a null or empty text has no ids and decodes to an empty text; rows
with the same or no id are texts of their own; a character that is not in the model is its bytes' pieces (or the unknown piece,
if the model has none); extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, packs

MARK = "▁"
_loaded: dict[str, Model] = {}


class Model:
    """Pieces, scores and rules of a SentencePiece model file with the identity normaliser."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(data)
        rule = proto.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        kinds = pb.ModelProto.SentencePiece
        self.unigram = proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM
        self.dummy = rule.add_dummy_prefix
        self.ids, self.score, self.bytes, self.unknown = {}, {}, {}, 0
        self.text: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.text.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.text.append(p.piece.replace(MARK, " ").encode())
            else:
                self.unknown = i if p.type == kinds.UNKNOWN else self.unknown
                self.text.append(" ⁇ ".encode() if p.type == kinds.UNKNOWN else b"")
        self.longest = max(map(len, self.ids), default=1)
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {end: sorted(sizes, reverse=True) for end, sizes in ends.items()}  # sizes of the pieces by their last two characters
        self.known: dict[str, bytes] = {}  # words met before
        self.older: dict[str, bytes] = {}  # those known before ``known`` was last begun
        self.within = not any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in self.ids)
        self.worst = min(self.score.values(), default=0.0) - 10
        self.alone: dict[str, bool] = {}  # piece -> the merges give it whole
        self.left: dict[int, bool] = {}  # numbers of two pieces -> the merges leave the pair alone

    # what a run is when nothing is shared

    def merged(self, run: str) -> list[str]:
        """BPE: the adjacent pair with the best piece is joined (ties: the leftmost) until none is a piece."""
        if len(run) > 48:
            return self._merged_long(run)
        parts = list(run)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_long(self, run: str) -> list[str]:
        """The same by a heap of the neighbouring pairs and links from part to part: n log n steps."""
        parts: list[str | None] = list(run)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score = self.score.get
        pairs = [(-s, i, run[i : i + 2]) for i in range(len(parts) - 1) if (s := score(run[i : i + 2])) is not None]
        heapq.heapify(pairs)
        while pairs:
            _, i, piece = heapq.heappop(pairs)
            j = after[i]
            # a part since joined to its left is None, one joined to its right is longer
            if parts[i] is None or j == len(parts) or len(parts[i]) + len(parts[j]) != len(piece):
                continue
            parts[i], parts[j], after[i] = piece, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else len(parts)
                if right < len(parts):
                    new = parts[left] + parts[right]
                    if (s := score(new)) is not None:
                        heapq.heappush(pairs, (-s, left, new))
        return [p for p in parts if p is not None]

    def _fits(self, before: str | None, piece: str) -> bool:
        if piece not in self.alone:
            self.alone[piece] = self.merged(piece) == [piece]
        if not self.alone[piece] or before is None:
            return self.alone[piece]
        pair = self.ids[before] << 32 | self.ids[piece]
        if pair not in self.left:
            if len(self.left) > 400_000:
                self.left.clear()
            self.left[pair] = self.merged(before + piece) == [before, piece]
        return self.left[pair]

    def spelled(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    # forward states: one a character

    def _step(self, word: str, j: int, states: list) -> tuple:
        """Unigram: the best-scored way to the first j characters."""
        best, score = None, self.score
        for i in range(max(0, j - self.longest), j):
            piece = word[i:j]
            s = score.get(piece, self.worst if j - i == 1 else None)
            if s is not None and (best is None or states[i][0] + s > best[0]):
                best = (states[i][0] + s, piece, i)
        return best

    def encode_words(self, words) -> dict[str, bytes]:
        """The ids (32-bit machine words) of each distinct marked word, by a depth-first walk of their trie."""
        out, last = {}, ""
        # a state is (score or the piece's number, piece, its state's place)
        states: list[tuple] = [(0.0 if self.unigram else None, "", 0)]
        ids, alone, left, ends, step, unigram = self.ids, self.alone, self.left, self.ends, self._step, self.unigram
        for word in sorted(words):
            if not unigram and word.startswith(MARK * 2):
                out[word] = array("i", self.spelled(self.merged(word))).tobytes()
                continue
            n, same = min(len(word), len(last)), 0
            while same < n and word[same] == last[same]:
                same += 1
            del states[same + 1 :]
            for j in range(same + 1, len(word) + 1):
                if unigram:
                    states.append(step(word, j, states))
                    continue
                for size in ends.get(word[j - 2 : j], ()) if j > 1 else ():
                    if size > j:
                        continue
                    piece = word[j - size : j]
                    number = ids.get(piece)
                    if number is not None:  # pairs met before are decided here, without a call
                        first, before, _ = states[j - size]
                        fits = alone.get(piece) if first is None else left.get(first << 32 | number)
                        if fits is None:
                            fits = self._fits(None if first is None else before, piece)
                        if fits:
                            states.append((number, piece, j - size))
                            break
                else:
                    piece = word[j - 1]
                    states.append((ids.get(piece), piece, j - 1))
            found, j, last = [], len(word), word
            while j:
                number, piece, j = states[j]
                found.append(piece if unigram or number is None else number)
            if unigram:
                found = self.spelled(found[::-1])
            else:
                found.reverse()
                if str in map(type, found):
                    found = [i for x in found for i in (self.spelled([x]) if isinstance(x, str) else (x,))]
            out[word] = array("i", found).tobytes()
        return out

    def marked(self, text: str) -> list[str]:
        run = (MARK if self.dummy else "") + text.replace(" ", MARK)
        return _WORD.findall(run) if self.within else [run]

    def encode(self, texts: list[str | None], most_known: int = 1 << 17) -> list[np.ndarray]:
        """The ids of each text. Beyond ``most_known`` words the known ones become the older ones; of these, words met again stay, so frequent words are walked once."""
        parts = [self.marked(t) if t else [] for t in texts]
        if len(self.known) > most_known:
            self.known, self.older = {}, self.known
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.difference_update(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        self.known.update(self.encode_words(new - again))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), np.int32) for p in parts]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.text.__getitem__, ids))
        return (raw[1:] if self.dummy and raw.startswith(b" ") else raw).decode("utf-8", "replace")


_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def load(name: str) -> Model:
    if name not in _loaded:
        import public_tokenizers

        with open(public_tokenizers.path(name), "rb") as f:
            _loaded[name] = Model(f.read())
    return _loaded[name]


def encode_column(text_col: str = "text", model: str = "piece_bpe_32k.model") -> Column:
    """The ids (array<int>) of each whole text. Spark repeats a column's expression wherever it is used: where ids are used twice, take ``encode_texts``."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        found = list(_ids(texts, model))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return encode(F.col(text_col).cast("string"))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, text and ids (array<int>) of each row of ``docs``, each text encoded once."""

    def run(batches):
        for batch in batches:
            lo = 0
            for ids in _ids(batch.column("text"), model):
                part = batch.slice(lo, len(ids))
                lo += len(ids)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], ["doc_id", "text", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>")


def _ids(texts: pa.Array, model: str, most: int = 1 << 20):
    """Arrays of ids of the texts in order; the texts of one, about ``most`` characters, share one walk."""
    sp, texts = load(model), texts.to_pylist()
    for lo, hi in packs(texts, most):
        out = sp.encode(texts[lo:hi])
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out)))


def decode_column(ids: Column | str, model: str = "piece_bpe_32k.model") -> Column:
    """The text of an array of ids."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        sp = load(model)
        return pa.array([None if x is None else sp.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in column], pa.string())

    return decode(ids)
