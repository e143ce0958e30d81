"""The queries opN_<name> of the operators in this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann, byte_bpe, decision_list, embed_dedup, importance, language_id, mixing, pii, prefix_trie, quality, simhash, suffix_dedup, url_filter,
)
from .common import cut, drawn, remainder, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, in training order; position: null if nothing is taken."""
    mixed = mixing.in_training_order(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.round(F.get("positions", F.lit(0)), 9).alias("position"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk,
         CAST(source_size AS DOUBLE) * 2 AS cap FROM s
), w AS (
  SELECT *, CASE WHEN rk % 3 = 0 THEN 3.0::DOUBLE WHEN rk % 3 = 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM r
), l AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, rk) AS ord,
         (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - (sum(cap) OVER (ORDER BY cap / w, rk) - cap))
         / (sum(w) OVER () - (sum(w) OVER (ORDER BY cap / w, rk) - w)) AS level FROM w
), f AS (
  SELECT min(ord) AS ord, min_by(level, ord) AS level FROM l WHERE cap > level * w
), t AS (
  SELECT source, rk, source_size,
         CASE WHEN (SELECT ord FROM f) IS NULL OR ord < (SELECT ord FROM f) THEN cap ELSE (SELECT level FROM f) * w END AS target
  FROM l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rk, CAST(floor(t.target) AS BIGINT) AS demand,
         CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS n_full,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CASE WHEN rk % 3 = 0 THEN 1.5::DOUBLE WHEN rk % 3 = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS a,
         1.0::DOUBLE AS b,
         CASE WHEN rk % 3 = 0 THEN 0.5::DOUBLE WHEN rk % 3 = 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS c FROM o
), p AS (
  SELECT *, (start / target) * ((a + b) / 4.0::DOUBLE + (b + c) / 4.0::DOUBLE) AS need FROM k
)
SELECT doc_id, size, source_size, target,
       CAST(n_full * size + greatest(0, least(demand - n_full * source_size - start, size)) AS BIGINT) AS taken,
       CASE WHEN size > 0 AND start < demand THEN round(least(greatest(
         CASE WHEN need <= (a + b) / 4.0::DOUBLE
              THEN need * 2.0::DOUBLE / (a + sqrt(greatest(a * a + (b - a) * 2.0::DOUBLE * need * 2.0::DOUBLE, 0.0::DOUBLE)))
              ELSE 0.5::DOUBLE + (need - (a + b) / 4.0::DOUBLE) * 2.0::DOUBLE
                   / (b + sqrt(greatest(b * b + (c - b) * 2.0::DOUBLE * (need - (a + b) / 4.0::DOUBLE) * 2.0::DOUBLE, 0.0::DOUBLE))) END,
         0.0::DOUBLE), 1.0::DOUBLE), 9) END AS position
FROM p
"""

def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 200-byte strings leaves of every text."""
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    runs = F.transform("removed", lambda r: r["end"] - r["start"])
    return done.select(
        F.col("id").alias("doc_id"), "n_bytes", F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and, where none fits, trees learnt from the URLs that the rules decide."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), keep=["page_id"])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, by a model of the labelled documents that are not held out."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.where(~held_out), key=F.col("doc_id"))
    said = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(F.col("text"), model).alias("p"))
    return said.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.ambiguous").alias("ambiguous"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with equal labels at a cosine of 0.98 or more."""
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates for its entities: how many of each type, and what the text became."""
    docs = table(spark, sf_dir, "documents")
    done = pii.settled(lambda again: docs.select("doc_id", pii.surrogates(F.col("text"), pii.session_key(spark), again).alias("p")), "p.entities")
    kinds = ("email", "phone", "ip", "card", "iban", "ssn", "secret", "name")

    def count(kind: str) -> Column:
        return F.size(F.filter("p.entities", lambda e: e["kind"] == kind)).cast("long")

    return done.select(
        "doc_id", F.size("p.entities").cast("long").alias("n_entities"),
        *[count(k).alias(f"n_{k}") for k in kinds],
        F.col("p.text").alias("text"), F.sha2(F.coalesce("p.text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of what the ids decode to."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", byte_bpe.digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and the components of those within 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.get("fp", F.lit(0))), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, by rules from the labels that are not held out."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out & F.col("quality").isin(0, 1))
    some = drawn(labels, F.col("doc_id"), quality.SAMPLE_ROWS, labels.count())
    some = sorted({(r["doc_id"], r["quality"]) for r in some.where("doc_id is not null").collect()})  # a label that repeats counts once
    few = spark.createDataFrame(some, "doc_id long, quality int")  # 2 x quality.SAMPLE_ROWS rows of two numbers at most
    known = cut(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "quality"))
    model = quality.fit(known, sample_rows=quality.SAMPLE_ROWS)
    said = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return said.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt with the first turns of the first of their hundred."""
    turns = prefix_trie.ranked(table(spark, sf_dir, "conversations"))
    ids = turns.select("conv_id").distinct()
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rebuilt = cut(prefix_trie.shared_heads(turns, ids, head, F.col("conv_id") - F.col("conv_id") % 100, 5))
    return prefix_trie.trie(rebuilt, ids)


def _crc32(text: str) -> str:
    """DuckDB SQL: the unsigned CRC-32 of an ASCII or hex-escaped text's UTF-8 bytes."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i - 1 AS INTEGER), 2) AS BIGINT))"
    bit = "CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {byte}), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS lender, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
), b AS (
  SELECT c.conv_id, c.h, c.lender, least(c.h, coalesce(l.n, 0)) AS begun FROM c LEFT JOIN c l ON l.conv_id = c.lender
), r AS (
  SELECT b.conv_id, t.pos, t.role, t.text FROM b JOIN t ON t.conv_id = b.lender AND t.pos <= b.h
  UNION ALL
  SELECT b.conv_id, b.begun + t.pos - b.h, t.role, t.text FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos > b.h
), w AS (
  SELECT b.conv_id, coalesce(list(md5(length(r.role) || ':' || r.role || r.text) ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS keys,
         coalesce(list(length(r.text) ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS sizes
  FROM b LEFT JOIN r USING (conv_id) GROUP BY b.conv_id
), m AS (
  SELECT conv_id, len(keys) AS n, d, md5(array_to_string(keys[1:d], '')) AS p, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size,
         md5(array_to_string(keys[1:d - 1], '')) AS up
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM w)
), g AS (
  SELECT d, p, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM m GROUP BY d, p
), k AS (
  SELECT g.*, (SELECT count(*) FROM g c WHERE c.d = g.d + 1 AND c.up = g.p) AS n_children, (n_convs - 1) * size AS own FROM g
), pairs AS (
  SELECT DISTINCT a.d, a.p, b.d AS d2, b.p AS p2 FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.d >= a.d
), s AS (
  SELECT pairs.d, pairs.p, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.own) AS saved FROM pairs JOIN k ON k.d = pairs.d2 AND k.p = pairs.p2 GROUP BY pairs.d, pairs.p
)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, CASE WHEN k.d > 0 THEN q.conv_id END AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.d = k.d AND s.p = k.p LEFT JOIN g q ON q.d = k.d - 1 AND q.p = k.up
"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its score and its place in the draw."""
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


_WORDS12 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS12} AS words FROM documents
), dw AS (
  SELECT rid, unnest(words) AS word FROM d
), tw AS (
  SELECT unnest({_WORDS12}) AS word FROM benchmark
), v AS (
  SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM tw)
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN v USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM tw JOIN v USING (word) GROUP BY bucket
), g AS (
  SELECT s.bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
         / ((s + 1)::DOUBLE * ((SELECT count(*) FROM tw) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (
  SELECT rid, sum(gain) AS weight FROM dw JOIN v USING (word) JOIN g USING (bucket) GROUP BY rid
), h AS (
  SELECT d.rid, d.doc_id, CAST(len(d.words) AS BIGINT) AS n_features, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE AS h
  FROM d LEFT JOIN w USING (rid)
), x AS (
  SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h
), o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM x
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100 THEN place END AS rank
FROM o
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and a decision list from all labels; reason: the rule that decides."""
    docs = table(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    judged = decision_list.judge(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", *[F.col(f"judged.{c}").alias(c) for c in (*decision_list.COUNTS, "base_failed", "kept", "reason")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_pii": op6_pii,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_nearest": op10_nearest,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance": op12_importance,
    "op13_quality_rules": op13_quality_rules,
}
SQL: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op11_prefix_trie": OP11_SQL, "op12_importance": OP12_SQL}
