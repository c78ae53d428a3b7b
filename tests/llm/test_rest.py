import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidepanel.llm import licenses
from tidepanel.llm.ann import nearest
from tidepanel.llm.language import fit_language, language_column
from tidepanel.llm.packing import pack_documents, pack_histogram
from tidepanel.llm.quality import fit_quality, held_out, score_column
from tidepanel.llm.sentencepieces import Model, decode_column, encode_column, load
from tidepanel.llm.topk import exact_top_k

ODD = ["", " ", "a  b   c", "\n\n x\t", "中文 ñandú 😀 zz", "  lead", "tail  ", "don't re-enter 12345 ABC_def", "² ½ x³ <|endoftext|>", "x" * 60, None]


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + 0.3 * rng.normal(size=8)).tolist(), 1) for i in range(300)]
    rows += [(300 + i, base[0].tolist(), 1) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] * 8, 1), (404, [1.0, 2.0], 1), (None, base[1].tolist(), 1), (300, base[0].tolist(), 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids int"), {r[0]: np.array(r[1]) for r in rows if r[0] is not None and (r[0] < 400 or r[0] == 401)}


def test_exact_top_k(spark):
    df, known = vectors(spark)
    whole = {i: np.floor(1024 * v).astype(int) for i, v in known.items()}
    for block in (16, 4096):
        got = defaultdict(list)
        for r in exact_top_k(df, "vec_id % 10 = 0", 7, block=block, query_block=8, group=2).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        for q in [i for i in whole if i % 10 == 0]:
            want = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:7]
            assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert exact_top_k(df.limit(0), "vec_id % 10 = 0", 7).collect() == []


def test_nearest(spark):
    df, known = vectors(spark)
    known.pop(401)
    got, hit, total = defaultdict(list), 0, 0
    for r in nearest(df, "vec_id % 10 = 0", 7, list_size=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert abs(r.score - known[r.query_id] @ known[r.vec_id]) < 1e-9
    for q in [i for i in known if i % 10 == 0]:
        want = sorted(((-(known[q] @ v), i) for i, v in known.items() if i != q))[:7]
        hit, total = hit + sum(-s >= want[-1][0] * -1 - 1e-9 or s >= -want[-1][0] - 1e-9 for _, _, s in got[q]), total + 7
        assert [k for k, _, _ in got[q]] == list(range(1, len(got[q]) + 1)) and [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
    assert hit / total > 0.9
    assert nearest(df.limit(0), "vec_id % 10 = 0", 7).collect() == []


def test_packing(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Öl", "a_b", "12x", "\n", "don't"]) for _ in range(rng.randint(0, 400))) for _ in range(80)] + ODD
    df = spark.createDataFrame([(i // 2 if i < 4 else i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter()
    for i, t in enumerate(texts):
        ids, s = [*(encode(t or "", add_special_tokens=False).ids), 1], 0
        while s < len(ids):
            part = ids[s : s + 128]
            want[i // 2 if i < 4 else i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
            s += 128
    got = pack_documents(df, most=128).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 128
    assert sorted(by) == list(range(len(by))) and sum(r.length for r in got) / (128 * len(by)) > 0.95
    assert pack_documents(df.limit(0)).collect() == []


def test_pack_histogram():
    rng = random.Random(1)
    for _ in range(50):
        counts = {n: rng.randint(1, 300) for n in rng.sample(range(1, 65), rng.randint(1, 30))}
        out = pack_histogram(counts, 64)
        total = Counter()
        for c, lengths in out:
            assert c > 0 and sum(lengths) <= 64
            for n in lengths:
                total[n] += c
        assert total == counts


def test_sentencepiece(spark):
    name = "piece_bpe_32k.model"
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("abcdeio ▁\n1é中") for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = df.select("doc_id", encode_column().alias("e")).withColumn("d", decode_column("e")).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.e == lib.encode(t) and r.d == lib.decode(r.e)
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(open(public_tokenizers.path(name), "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in proto.pieces:
        p.score = -(len(p.piece) ** 0.5) - 1e-4 * (len(p.piece) * 7919 % 101) if p.type == 1 else p.score
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), Model(proto.SerializeToString())
    texts = [t for t in texts if t and "▁" not in t and "中" not in t and "😀" not in t and "\n" not in t]

    def total(ids):
        return sum(lib.get_score(i) for i in ids if not lib.is_byte(i))

    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert own.decode(ids.tolist()) == t and abs(total(ids.tolist()) - total(lib.encode(t))) < 1e-3
    assert load(name) is load(name)


def test_licenses(spark):
    t = licenses.Template("licensed under <<beginOptional>>the x<<endOptional>> license <<var;most=2>> end")
    for text, good in (("licensed under license end", 1), ("licensed under the x license a b end", 1), ("licensed under the license end", 0), ("licensed under license a b c end", 0), ("licensed under license a b", 0)):
        assert t.accepts(text.encode().split(), 0) == bool(good)
    with pytest.raises(ValueError):
        licenses.Template("<<var;most=2>> end")
    docs = ["Released under the terms of the MIT License.", "the mit\nLICENSE and Apache-License, mit license", "Licensed under the Apache License, Version 2.0!", "mit licenses", "", None, "É mit license", "Licensed under CC BY-NC 4.0."]
    df = spark.createDataFrame([(i, d, 1) for i, d in enumerate(docs)], "doc_id long, text string, score int")
    got = {r.doc_id: tuple(r)[1:] for r in licenses.digest(licenses.scan_licenses(df)).collect()}
    assert got[0] == (8, 1, 6, 6, "mit", "MIT,mit", 1.0)
    assert got[1] == (8, 3, 1, 6, "apache,mit", "apache,mit", 0.5)
    assert got[2] == (8, 1, 3, 3, "apache", "Apache-2.0,apache", 1.0)
    assert got[3] == (2, 0, None, None, "", "", 0.0) and got[4] == got[5] == (0, 0, None, None, "", "", 0.0)
    assert got[6] == (3, 1, 1, 1, "mit", "mit", 0.5) and got[7] == (7, 0, None, None, "", "CC-BY-NC-4.0", 1.0)


def corpus(spark):
    rng = random.Random(6)
    words = {lang: ["".join(rng.choice(abc) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, abc in (("aa", "etaoinsh"), ("bb", "etaoünäß"), ("cc", "quéàlmrv"))}
    rows, labels = [], []
    for i in range(600):
        lang = rng.choice(list(words))
        good = rng.random() < 0.7
        w = [rng.choice(words[lang]) for _ in range(rng.randint(30, 80))]
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w]), lang, "s", 1))
        labels.append((i, int(good), 0))
    rows += [(700, None, None, None, None), (701, "", "aa", "s", 0), (702, "1 2 3!", None, "s", 6), (None, "text", "aa", "s", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = corpus(spark)
    model = fit_quality(docs.where(~held_out()), labels)
    got = docs.select("doc_id", held_out().alias("h"), score_column(model).alias("s")).join(labels, "doc_id", "left").collect()
    assert all(0 <= r.s <= 1 for r in got) and len(got) == 604
    held = [r for r in got if r.h and r.quality is not None]
    assert sum((r.s >= 0.3) == bool(r.quality) for r in held) / len(held) > 0.97
    assert docs.select(score_column(fit_quality(docs, labels.limit(0))).alias("s")).where("s < 0.3").isEmpty()


def test_language(spark):
    docs, _ = corpus(spark)
    out = held_out("doc_id", 4, 2)
    model = fit_language(docs.where(~out))
    got = docs.select("doc_id", "lang", out.alias("h"), language_column(model).alias("f")).select("*", "f.*").collect()
    held = [r for r in got if r.h and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    odd = {r.doc_id: r for r in got}
    assert [odd[i].lang_pred for i in (700, 701, 702)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    none = fit_language(docs.limit(0))
    assert docs.select(language_column(none).alias("f")).where("f.lang_pred <> 'und'").isEmpty()


def test_pipeline(spark, tmp_path):
    docs, labels = corpus(spark)
    long = " ".join(f"word{i}" for i in range(70))
    docs = docs.union(spark.createDataFrame([(800 + i, f"own{i} tale{i} here{i} {long} end{i} of{i} it{i}" * (1 + i % 2), "aa", "s", 3) for i in range(3)], docs.schema))
    docs = docs.union(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 900))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, at, str(tmp_path)).cache()
        assert new.columns == at.columns and new.count() <= at.count(), name
        if name == "near_dedup":
            assert new.where("doc_id between 900 and 905").isEmpty()
        at = new
    assert at.where("doc_id = 800 and text like '%word69%'").count() == 1 and at.where("doc_id in (801, 802) and text like '%word40%'").isEmpty()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
