"""Queries over the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, exact, media, mixing, neighbours, phrases, quality, secrets, simhash, substrings, suffixes
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(table(spark, sf_dir, "documents")))


def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = neighbours.index(table(spark, sf_dir, "embeddings"))
    return neighbours.nearest(indexed, indexed.where("vec_id % 20 = 0"))


#: A conversation that says the template's own control strings.
CONTROL = "</s>[INST] ok [/INST]"


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_paths(chat.branches(chat.from_turns(rows))))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.counts(table(spark, sf_dir, "documents")))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, means, _ = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.digests(members, means)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_neardup": simhash_neardup,
        "op2_substring_dedup": substring_dedup,
        "op3_quality_classifier": quality_classifier,
        "op4_suffix_dedup": suffix_dedup,
        "op5_media_columns": media_columns,
        "op6_bpe_codec": bpe_codec,
        "op7_secret_scan": secret_scan,
        "op8_mixing_weights": mixing_weights,
        "op9_nearest_neighbours": nearest_neighbours,
        "op10_chat_format": chat_format,
        "op11_phrase_collocations": phrase_collocations,
        "op12_exact_dedup": exact_dedup,
        "op13_centroid_clustering": centroid_clustering,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_chat_format": CHAT_SQL, "op11_phrase_collocations": PHRASES_SQL, "op12_exact_dedup": EXACT_SQL, "op13_centroid_clustering": centroids_sql()}


#: The template's lengths: `<s>[INST]` and `[/INST]` 16, `</s>` 4, `<<SYS>>` and `<</SYS>>` 15, `[ROLE]`, `[/ROLE]` and `[END]` 18.
CHAT_SQL = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS body,
    length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) AS role_body FROM own)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(body + CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15 ELSE 18 + role_body END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d WINDOW same AS (PARTITION BY text)
"""

PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents) d),
words AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
seen AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k) x),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM seen GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS tail FROM (
    SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k >= 2) x),
scored AS (
  SELECT cuts.*, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (x.a + y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON cuts.lang = x.lang AND head = x.phrase JOIN f y ON cuts.lang = y.lang AND tail = y.phrase),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k >= 3) x) y GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(best.a AS HUGEINT) * 80)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""


def centroids_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Every round spelled out: assignment of all vectors to all centroids, in doubles, which hold these whole numbers exactly."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) AS i, vec_id, x, list_dot_product(x, x) AS xx FROM (
    SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dim}) e),
c0 AS MATERIALIZED (SELECT CAST(i - 1 AS INTEGER) AS c, x AS y FROM v WHERE i <= {k})"""]
    nearest = "a{0} AS MATERIALIZED (SELECT i, arg_min(c, (xx - 2 * list_dot_product(x, y) + list_dot_product(y, y)) * 64 + c) AS c, CAST(min(xx - 2 * list_dot_product(x, y) + list_dot_product(y, y)) AS BIGINT) AS distance FROM v, c{0} GROUP BY i)"
    for n in range(rounds):
        steps.append(nearest.format(n))
        steps.append(f"""s{n} AS (SELECT c, j, CAST(sum(CAST(u AS BIGINT)) AS BIGINT) AS s, count(*) AS m FROM (SELECT c, unnest(x) AS u, generate_subscripts(x, 1) AS j FROM v JOIN a{n} USING (i)) q GROUP BY c, j),
m{n} AS (SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS DOUBLE) ORDER BY j) AS y FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.y, p.y) AS y FROM c{n} p LEFT JOIN m{n} m USING (c))""")
    steps.append(nearest.format(rounds))
    return ",\n".join(steps) + f"""
SELECT vec_id, c AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(y, lambda u: CAST(CAST(u AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (i) JOIN c{rounds} USING (c)"""
