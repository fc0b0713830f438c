"""Registered queries of the text functions and classifiers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, html, text
from ..plans.registry import query
from ..sources.tables import table
from .console import insight


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


@query("norm_ws", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x{00a0}]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), ' ' || chr(9) || chr(10) || chr(160))) AS digest FROM documents")
def norm_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalise_whitespace(F.col("text"))).alias("digest"))


@query("html_to_text")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text"))


@query("strip_tags", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


@query("est_tokens", "SELECT doc_id, CAST(ceil(length(text) / 3.6::DOUBLE) AS BIGINT) AS tokens FROM documents")
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("content_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("digest"))


def reuse_vectors(chunks: DataFrame, held: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, digest) with the vector of a held chunk (chunk_id, digest, embedding) of the same content, and which; null where it has to be made.

    Of several the least id serves. What is held is reduced to one row a digest before it meets the chunks.
    """
    known = held.where("embedding IS NOT NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("chunk_id", "embedding")).alias("kept"))
    return chunks.join(known, "digest", "left").select("chunk_id", "digest", F.col("kept.chunk_id").alias("reused_from"), F.col("kept.embedding").alias("embedding"))


@query("embed_reuse", """WITH held AS (SELECT sha256(text) AS digest, min(doc_id) AS reused_from FROM documents JOIN embeddings ON vec_id = doc_id WHERE embedding IS NOT NULL AND text IS NOT NULL GROUP BY 1)
SELECT doc_id AS chunk_id, reused_from, reused_from IS NULL AS to_embed FROM documents LEFT JOIN held ON digest = sha256(text)""")
def embed_reuse(spark, sf_dir):
    """Every chunk with the held chunk whose vector it takes over, so that a text is embedded once."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), text.content_hash(F.col("text")).alias("digest"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return reuse_vectors(chunks, chunks.join(vectors, "chunk_id")).select("chunk_id", "reused_from", F.col("reused_from").isNull().alias("to_embed"))


_STOPS_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("lexical_terms", rf"""SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(substr(regexp_replace(regexp_replace(trim(text), '[\s \x{{a0}}]+', ' ', 'g'), '[?!.]+$', ''), 1, 1000)), '[^\p{{L}}\p{{N}}_-]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOPS_SQL}))[1:24] AS terms FROM conversations WHERE role = 'user'""")
def lexical_terms(spark, sf_dir):
    return _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", text.lexical_terms(F.col("text")).alias("terms"))


def _edged(pattern: str) -> str:
    """The pattern as SQL has it, whose word edges are those of ASCII."""
    return pattern.replace("(?<![A-Za-z0-9_])", "\\b").replace("(?![A-Za-z0-9_])", "\\b")


@query("is_complex", f"SELECT conv_id, turn, regexp_matches(text, '{_edged(text.COMPLEX)}') OR regexp_matches(text, '{_edged(text.SEVERAL_FILES)}') AS is_complex FROM conversations WHERE role = 'user'")
def is_complex(spark, sf_dir):
    return _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", text.is_complex(F.col("text"), 2).alias("is_complex"))


def _topic_oracle() -> str:
    """The themes' patterns as SQL; the first theme with most patterns wins."""
    quoted = {slug: [p.replace("'", "''") for p in patterns] for slug, patterns in classify.TOPICS.items()}
    hits = ", ".join(f"{' + '.join(f'CAST(regexp_matches(q, $$(?i){p}$$) AS INTEGER)' for p in patterns)} AS h_{slug}" for slug, patterns in classify.TOPICS.items())
    names = " ".join(f"WHEN h_{slug} = m THEN '{slug}'" for slug in quoted)
    words = ", ".join(f"'{w}'" for w in classify.GENERIC)
    return f"""SELECT conv_id, turn, CASE WHEN m = 0 THEN CASE WHEN len(w) = 0 THEN 'general' ELSE substr(array_to_string(w, '-'), 1, 60) END {names} END AS slug, CAST(round(CASE WHEN m = 0 THEN 0.3 ELSE least(0.55 + 0.2 * m, 0.95) END, 6) AS DOUBLE) AS confidence
FROM (SELECT *, greatest({', '.join(f'h_{slug}' for slug in quoted)}) AS m, list_filter(regexp_split_to_array(lower(q), '[^\\p{{L}}\\p{{N}}-]+'), lambda x: length(x) > 3 AND x NOT IN ({words}))[1:2] AS w FROM (SELECT conv_id, turn, q, {hits} FROM (SELECT conv_id, turn, trim(text) AS q FROM conversations WHERE role = 'user')))"""


@query("topic", _topic_oracle())
def topic(spark, sf_dir):
    return _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", classify.topic(F.col("text")).alias("t")).select("conv_id", "turn", "t.slug", "t.confidence")


@query("topics_list", f"""WITH t AS ({_topic_oracle()}), answers AS (SELECT conv_id, turn, bool_and(regexp_matches(text, '(?i){"|".join(p.replace("'", "''") for p in classify.REFUSALS)}') OR length(text) < 120) AS refused FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY ALL),
sums AS (SELECT slug AS topic, count(*) AS questions, count(*) FILTER (coalesce(refused, true)) AS unanswered FROM t LEFT JOIN answers a ON a.conv_id = t.conv_id AND a.turn = t.turn + 1 GROUP BY slug)
SELECT topic, questions, unanswered, CASE WHEN unanswered < 2 OR unanswered / questions < 0.3 THEN NULL WHEN unanswered / questions >= 0.7 THEN 'not covered' ELSE 'not clear' END AS insight FROM sums ORDER BY questions DESC, topic LIMIT 8""")
def topics_list(spark, sf_dir, top: int = 8):
    """The themes asked about most, with what their unanswered share says: a question without a next turn that answers it is unanswered."""
    asked = _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", classify.topic(F.col("text"))["slug"].alias("topic"))
    shown = _turns(spark, sf_dir).where("role = 'assistant' AND text IS NOT NULL").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.bool_and(classify.is_refusal(F.col("text")) | (F.length("text") < 120)).alias("refused"))
    sums = asked.join(shown, ["conv_id", "turn"], "left").groupBy("topic").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.coalesce("refused", F.lit(True))).alias("unanswered"))
    return sums.withColumn("insight", insight(F.col("questions"), F.col("unanswered"))).orderBy(F.desc("questions"), "topic").limit(top)


#: Parts in which the questions of a theme are ranked before their first ones meet.
PARTS = 64


@query("topic_rollup")
def topic_rollup(spark, sf_dir, examples: int = 5):
    """Questions by theme with the five oldest as examples. Each question is classified once; a frequent theme is ranked in ``PARTS`` parts."""
    asked = _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", "text", classify.topic(F.col("text"))["slug"].alias("slug"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(PARTS)).alias("part"))
    own = Window.partitionBy("slug", "part").orderBy("conv_id", "turn", "text")
    first = F.collect_list(F.when(F.col("r") <= examples, F.struct("conv_id", "turn", "text")))
    parts = asked.withColumn("r", F.row_number().over(own)).groupBy("slug", "part").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return parts.groupBy("slug").agg(F.sum("n").alias("questions"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, examples).alias("examples"))


def _request_oracle() -> str:
    """The shapes of requests as SQL; the heaviest that fits names the intent, earlier ones first."""
    quoted = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    shapes = ", ".join(f"CASE WHEN regexp_matches(q, {quoted(p)}) THEN {{'weight': {w}::DOUBLE, 'place': {-k}, 'intent': '{i}'}} END" for k, (i, w, p) in enumerate(classify.EXTRACTION_RULES))
    return rf"""WITH asked AS (SELECT conv_id, turn, regexp_replace(trim(text), '\s+', ' ', 'g') AS q FROM conversations WHERE role = 'user'),
best AS (SELECT conv_id, turn, q, list_max(list_filter([{shapes}], lambda x: x IS NOT NULL)) AS b FROM asked),
scored AS (SELECT conv_id, turn, b, CASE WHEN b IS NULL THEN 0 ELSE greatest(0, least(1, b.weight - CASE WHEN regexp_matches(q, {quoted(classify.COMPREHENSION)}) AND b.intent <> 'bulk_reproduction' THEN 0.25 ELSE 0 END)) END AS score FROM best)
SELECT conv_id, turn, coalesce(b.intent, 'none') AS intent, round(score, 3)::DOUBLE AS score, b IS NOT NULL AND score >= {classify.MODES["STANDARD"][0]} AS blocked FROM scored"""


@query("classify_request", _request_oracle())
def classify_request(spark, sf_dir):
    return _turns(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", classify.classify_request(F.col("text")).alias("c")).select("conv_id", "turn", "c.intent", "c.score", "c.blocked")


@query("is_refusal", "SELECT conv_id, turn, regexp_matches(text, '(?i)couldn''?t find|could not find|not (?:contained|included|present|mentioned|covered) in|(?:does|do) not (?:contain|include|mention|cover|specify)|no information (?:about|on|regarding)|isn''?t (?:in|covered)|can''?t reproduce') AS refused FROM conversations WHERE role = 'assistant'")
def is_refusal(spark, sf_dir):
    return _turns(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", classify.is_refusal(F.col("text")).alias("refused"))


_LEGIBLE = rf"""flat AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), cut AS (SELECT doc_id, t, length(t) AS chars, list_filter(string_split(t, ' '), lambda w: length(w) > 0) AS w FROM flat),
seen AS (SELECT doc_id, chars, len(w) AS words, CASE WHEN chars > 0 THEN length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) / chars ELSE 0 END AS alnum, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '{classify.WELL_FORMED.replace("'", "''")}'))) / len(w) ELSE 0 END AS formed,
  CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0 END AS mean FROM cut),
scored AS (SELECT *, greatest(0, least(1, 0.5::DOUBLE * formed + 0.3::DOUBLE * alnum + 0.2::DOUBLE * greatest(0, least(1, (mean - 1.5::DOUBLE) / 3.5::DOUBLE)))) AS raw FROM seen)"""


@query("legibility", f"WITH {_LEGIBLE} SELECT doc_id, CASE WHEN chars = 0 THEN 0.0::DOUBLE ELSE round(raw, 3) END AS score, CAST(chars AS INTEGER) AS chars, CAST(words AS INTEGER) AS words, round(alnum, 3) AS alnum, round(formed, 3) AS well_formed, round(mean, 2) AS mean_length, false AS empty_read FROM scored")
def legibility(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.legibility(F.col("text")).alias("l")).select("doc_id", "l.*")


@query("needs_vision", f"WITH {_LEGIBLE} SELECT doc_id, chars < 40 OR round(alnum, 3) < 0.45 OR round(formed, 3) < 0.55 AS needs_vision FROM scored")
def needs_vision(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.needs_vision(F.col("text")).alias("needs_vision"))
