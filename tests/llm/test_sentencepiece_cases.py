import random
import time

import public_tokenizers
import pytest
import sentencepiece

from tidepanel.llm.sentencepieces import Model, decode_column, encode_texts

NAME = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


def test_encoded_once_with_odd_rows(spark, lib):
    """Null ids and texts, repeated rows, a very long text, a clashing column; the plan encodes in one place."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefghiklmnorstué") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    rows = [(1, "one two"), (1, "one two"), (1, "other"), (None, "no id"), (2, None), (3, ""), (4, long), (5, "x" * 5_000)]
    coded = encode_texts(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, ids string"))
    got = coded.select("doc_id", "text", "ids", decode_column("ids").alias("back")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        assert r.ids == lib.encode(r.text or "") and r.back == (r.text or "")
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_known_words_are_cleared_and_ids_stay(lib):
    rng = random.Random(6)
    own = Model(open(public_tokenizers.path(NAME), "rb").read())
    texts = [" ".join("".join(rng.choice("etaoinshrdlé") for _ in range(rng.randint(1, 8))) for _ in range(40)) for _ in range(60)]
    for t in texts:
        assert own.encode([t], most_known=50)[0].tolist() == lib.encode(t)
        assert len(own.known) < 200


def test_unigram_scores_with_marks_newlines_and_other_scripts():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(open(public_tokenizers.path(NAME), "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in proto.pieces:
        p.score = -(len(p.piece) ** 0.5) - 1e-4 * (len(p.piece) * 7919 % 101) if p.type == 1 else p.score
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), Model(proto.SerializeToString())
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdeio \n1éжλ中😀▁") for _ in range(30)) for _ in range(200)]
    worst = min(p.score for p in proto.pieces if p.type == 1) - 10

    def total(ids):
        known = {i: proto.pieces[i].score for i in ids if not lib.is_byte(i)}
        raw = b"".join(bytes([lib.id_to_piece(i) and int(lib.id_to_piece(i)[3:5], 16)]) for i in ids if lib.is_byte(i))
        return sum(known[i] for i in ids if i in known) + worst * len(raw.decode())

    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert own.decode(ids.tolist()) == lib.decode(lib.encode(t))
        assert abs(total(ids.tolist()) - total(lib.encode(t))) < 1e-2


def test_long_runs_take_no_square_time(lib):
    own, rng = Model(open(public_tokenizers.path(NAME), "rb").read()), random.Random(11)
    runs = [" " * n for n in (1, 2, 47, 48, 49, 50, 100, 1_000, 100_000)] + ["\t" * 100_000, "\n" * 50_000, "x" * 100_000, "▁" * 100_000]
    runs += ["".join(rng.choice([" ", "▁", "\t", "a", "  "]) for _ in range(60_000)), " " * 60_000 + "word" + " " * 60_000, " " * 500 + "internationalization" * 300]
    runs += [" " * rng.randint(2, 90) + "".join(rng.choice("abett ▁") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    began = time.process_time()
    got = own.encode(runs)
    assert time.process_time() - began < 30
    for r, ids in zip(runs, got, strict=True):
        assert ids.tolist() == lib.encode(r)
    began = time.process_time()
    Model(open(public_tokenizers.path(NAME), "rb").read()).encode([" " * 100_000])
    assert time.process_time() - began < 3
