import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidepanel.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    return {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(rest)}


BYTE = byte_of()
NAME = {i: p for p, i in A.get_vocab().items()}


def tokens(text):
    a = [(i, bytes(BYTE[c] for c in NAME[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def spans(ts):
    out, at = [], 0
    for i, raw in ts:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(rows):
    """All pairs of tokens that overlap, group by group, from the definition."""
    docs, total = [], Counter()
    for doc_id, text in rows:
        a, b = map(spans, tokens(text) if text else ([], []))
        groups, links, i, j = [], [], 0, 0
        while i < len(a):
            p, q = i + 1, j + 1
            while a[p - 1][2] != b[q - 1][2]:
                p, q = (p + 1, q) if a[p - 1][2] < b[q - 1][2] else (p, q + 1)
            links += [(x[0], y[0]) for x in a[i:p] for y in b[j:q] if x[1] < y[2] and y[1] < x[2]]
            groups.append(",".join(str(x[0]) for x in a[i:p]) + "|" + ",".join(str(y[0]) for y in b[j:q]))
            i, j = p, q
        total.update(links)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    highest = Counter()
    for (_, y), n in total.items():
        highest[y] = max(highest[y], n)
    want = Counter((d, na, nb, g, len(ls), sum(total[p] == highest[p[1]] for p in ls), sum(total[p] for p in ls), h) for d, na, nb, g, ls, h in docs)
    return want, {(x, y): (n, n == highest[y]) for (x, y), n in total.items()}


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeghilnorstuäéßжи中") for _ in range(rng.randint(1, 12)))
    text = lambda n: "".join(word() + rng.choice([" "] * 8 + ["  ", "\n", ", ", "\t", "'s "]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60))) for i in range(40)] + [(7, text(4)), (7, text(4)), (None, text(5)), (None, None)]
    odd = ["", " ", "   ", "\n", "a", "<|endoftext|>", "<s> </s> <unk>", "a▁b", "x\x00y", "²½ x³", "😀😀 zz", "<0x41>", "  x", "don't re-enter 12345", "​", "a b c", "tail  "]
    rows += [(100 + i, t) for i, t in enumerate(odd)]
    rows += [(200, text(900)), (201, "same words again " * 300), (202, "same words again " * 300), (203, "nospaceatall" * 400), (204, "中" * 2_000), (205, text(500) + "▁" + text(500)), (206, " " * 3_000), (207, text(300) + " " * 2_000 + text(300)), (208, "a b" * 1_500)]
    return rows


@pytest.mark.parametrize(("long_bytes", "range_chars", "fan", "most_frequent"), [(1 << 20, 1 << 14, 8, 1 << 16), (60, 30, 2, 40)])
def test_alignment_equals_definition(spark, long_bytes, range_chars, fan, most_frequent):
    rows = corpus()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, row int, a string").repartition(3)
    got, pairs = alignment.align_texts(df, long_bytes=long_bytes, range_chars=range_chars, fan=fan, most_frequent=most_frequent, spread=4)
    want, counts = plain(rows)
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs.collect()} == counts
    found = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect())
    assert found == want


def test_composition_is_associative():
    t, text = alignment.load("byte_bpe_50k", "piece_bpe_32k.model"), " " + corpus()[-9][1][:600]
    size = len(text.encode())  # ranges of three bytes, so that many have no common end
    parts = [alignment.fragment(t, 1, 1, k, lo, min(lo + 3, size), 0, text)[0] for k, lo in enumerate(range(0, size, 3))]
    assert len(parts) > 50 and not all(p["cut"] for p in parts)
    show = lambda f: {k: v.tolist() if hasattr(v, "tolist") else v for k, v in f.items() if k != "part"}
    for x, y, z in zip(parts, parts[1:], parts[2:]):
        (left, c1), (right, c2) = alignment.compose(t, x, y), alignment.compose(t, y, z)
        (one, c3), (two, c4) = alignment.compose(t, left, z), alignment.compose(t, x, right)
        order = lambda ps: sorted((p["at"], p["shown"]) for p in ps)
        assert show(one) == show(two) and order(c1 + c3) == order(c2 + c4)


def test_empty_table_and_groups_themselves(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    got, pairs = alignment.align_texts(none)
    assert got.collect() == [] and pairs.collect() == []
    rows = [(1, "Hello wörld"), (2, None), (3, "a▁b")]
    for r in alignment.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        a, b = tokens(dict(rows)[r.doc_id] or "") if dict(rows)[r.doc_id] else ([], [])
        assert [x for g in r.groups for x in g.a] == [i for i, _ in a] and [x for g in r.groups for x in g.b] == [i for i, _ in b]
