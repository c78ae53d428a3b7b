"""The registered queries of the training-data operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .alignment import align_texts
from .ann import nearest
from .common import read
from .language import fit_language, language_column
from .lines import dedup_lines
from .mixing import mix_sources
from .packing import pack_documents
from .probminhash import near_duplicates
from .quality import fit_quality, held_out, score_column
from .sentencepieces import decode_column, encode_texts
from .substrings import remove_repeats
from .topk import exact_top_k
from .tries import prefix_trie, rebuilt


def op1_balanced_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs.where(~held_out()), read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op5_norm_bucket_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = fit_language(docs.where(~out))
    return docs.select("doc_id", out.alias("held_out"), language_column(model).alias("found")).select("doc_id", "held_out", "found.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(read(spark, sf_dir, "documents")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_sha256"), (decode_column("ids") == F.coalesce("text", F.lit(""))).alias("same"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(read(spark, sf_dir, "conversations")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_texts(read(spark, sf_dir, "documents"))[0]


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries():
    return {
        "op1_balanced_posting_lists": op1_balanced_posting_lists,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_histogram_packing": op4_histogram_packing,
        "op5_norm_bucket_top_k": op5_norm_bucket_top_k,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_language_id": op7_language_id,
        "op8_line_dedup": op8_line_dedup,
        "op9_license_scan": op9_license_scan,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_token_alignment": op12_token_alignment,
        "op13_mixing": op13_mixing,
    }


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM starts
), early AS (
  SELECT k, min(doc_id) AS f FROM win GROUP BY k
), hit AS (
  SELECT win.doc_id, win.i FROM win JOIN early USING (k) WHERE early.f < win.doc_id
), covered AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(ps) AS p FROM covered)
), kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(covered.ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _op9_sql() -> str:
    """The same phrases and templates as regular expressions over words each followed by a space."""
    counts = [(f"len(regexp_extract_all(s, '{p} '))" if len(p.split()) == 1 else f"len(list_filter(spots, lambda i: (w[i:i + {len(p.split()) - 1}] = {p.split()!r})))", label) for p, label in licenses.PHRASES.items()]
    starts = " OR ".join(f"w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p in licenses.PHRASES)
    base = ", ".join(f"CASE WHEN {c} > 0 THEN '{label}' END" for c, label in counts)
    own = ", ".join(f"CASE WHEN {' OR '.join(f"regexp_matches(s, '(^| ){licenses.template_regex(t)}')" for t in ts)} THEN '{label}' END" for label, ts in licenses.TEMPLATES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), e AS (
  SELECT doc_id, w, range(1, len(w) + 1) AS spots, array_to_string(w, ' ') || ' ' AS s FROM d
), f AS (
  SELECT doc_id, len(w) AS n, list_filter(spots, lambda i: ({starts})) AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM e
)
SELECT doc_id, n::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, own))), ','), '') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM f
"""


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn IS NOT NULL, turn, id) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, ((4294967295 - list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) % 6)::BIGINT AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS own, p, id, chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND p <= h
  UNION ALL SELECT conv_id, 1, p, id, chars FROM t JOIN c USING (conv_id) WHERE p > h
), s AS (
  SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(id, '') OVER w AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)
), pre AS (
  SELECT conv_id, depth, key, left(key, length(key) - 32) AS parent, chars FROM s UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c
), node AS (
  SELECT key, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM pre GROUP BY ALL
), child AS (
  SELECT parent AS key, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY 1
), told AS (
  SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, depth) AS key FROM pre GROUP BY 1) GROUP BY 1
), sums AS (
  SELECT pre.key, sum((child.n IS NULL)::BIGINT) AS n_leaves, sum((node.n_convs - 1) * node.chars) AS saved
  FROM node LEFT JOIN child USING (key) JOIN pre ON pre.conv_id = node.conv_id AND pre.depth <= node.depth GROUP BY 1
)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(child.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN sums USING (key) LEFT JOIN child USING (key) LEFT JOIN told USING (key) LEFT JOIN node up ON up.key = node.parent
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS spot
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM d GROUP BY source
), f AS (
  SELECT *, row_number() OVER by_cap AS i, 2.0::DOUBLE * coalesce(sum(source_size) OVER (by_cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS caps,
    sum(w) OVER (by_cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total
  FROM s WINDOW by_cap AS (ORDER BY source_size / w, source NULLS LAST)
), level AS (
  SELECT total - caps AS rest, ws FROM f WHERE w * (total - caps) / ws <= 2.0::DOUBLE * source_size ORDER BY i LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * rest / ws) AS target FROM s LEFT JOIN level ON true
), r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spot, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(floor(target + 0.5)::BIGINT - whole * source_size - earlier, size)))::BIGINT AS taken FROM r
"""


def oracle_sql():
    return {"op2_substring_dedup": OP2_SQL, "op5_norm_bucket_top_k": OP5_SQL, "op9_license_scan": _op9_sql(), "op11_conversation_trie": OP11_SQL, "op13_mixing": OP13_SQL}
