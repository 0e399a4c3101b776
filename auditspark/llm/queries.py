"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import alignment, chat, decontaminate, language, licenses, mixing, negatives, neighbours, quality, simhash, tokens, toxicity, urls
from .common import fold, stored, table
from ..session import small_table


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    return docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score(model, F.col("text"), spark), quality.THRESHOLD)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score(model, F.col("text"), spark), toxicity.THRESHOLD)


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """Per document: confirmed licence families (comma-joined), their paragraphs, and anchored paragraphs without one."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"),
                        (F.size("paragraphs") - F.col("unknown_paragraphs")).cast("bigint").alias("n_confirmed"),
                        F.col("unknown_paragraphs").cast("bigint").alias("n_unknown"))


def op5_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                          tokens.token_counts(docs, str(public_tokenizers.path("word_bpe_49k.json"))).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > tokens.LIMIT)


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts are control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), odd)
    return chat.read_back(chat.format_turns(rows.unionAll(more)))


#: Entries of the url filter: fixed values.
URL_ENTRIES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
               ("net", "/fr/", "block")]


def op11_urls(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    entries = small_table(spark, URL_ENTRIES, "host string, path string, action string")
    return urls.judge(pages, entries).select("page_id", "host", "path", "rule", "verdict")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    a, b = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text"), a, b)
    digest = F.when(F.col("alignment.groups") == "", "").otherwise(F.sha2("alignment.groups", 256)).alias("groups_sha256")
    found = stored(found.select("doc_id", digest, F.col("alignment").dropFields("groups").alias("alignment")))
    return alignment.counted(found, a, b).select("doc_id", "alignment.n_a", "alignment.n_b", "alignment.n_groups", "alignment.n_links", "n_best", "count_sum",
                                                 "groups_sha256")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50, against all rows; every seventh label is moved by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 50 == 0)


QUERIES = {"op1_simhash": op1_simhash, "op2_quality": op2_quality, "op3_toxicity": op3_toxicity, "op4_licenses": op4_licenses,
           "op5_tokens": op5_tokens, "op6_language": op6_language, "op7_mixing": op7_mixing, "op8_neighbours": op8_neighbours,
           "op9_decontamination": op9_decontamination, "op10_chat": op10_chat, "op11_urls": op11_urls,
           "op12_alignment": op12_alignment, "op13_negatives": op13_negatives}
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, least(len(w), {decontaminate.WINDOW}) AS size, array_to_string(w[i:i + {decontaminate.WINDOW} - 1], ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {decontaminate.WINDOW} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
there AS (SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT d.*, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM wins))),
occ AS (SELECT r, p, size, item FROM there JOIN wins USING (size, win)),
hit AS (SELECT r, count(DISTINCT word) AS n FROM (SELECT r, p + unnest(range(0, size)) AS word FROM occ) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chat_sql() -> str:
    """Every conflict costs one character more, the marks of a role cost theirs."""
    import re
    conflict = _quoted("|".join(["\\\\", *(re.escape(c) for c in chat.CONTROLS)]))
    escaped = lambda c: f"length({c}) + len(regexp_extract_all({c}, {conflict}))"
    marks = " ".join(f"WHEN {_quoted(role)} THEN {sum(map(len, pair))}" for role, pair in chat.MARKS.items())
    other = f"{len(chat.ROLE + chat.TEXT + chat.END)} + {escaped('role')}"
    odd = _quoted("</s>[INST] ok [/INST]")
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {odd}), (-7, 1, 'assistant', {odd}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role {marks} ELSE {other} END + {escaped('text')}) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""


def _url_sql() -> str:
    entries = ", ".join(f"({_quoted(h)}, {_quoted(p)}, {_quoted(a)})" for h, p, a in URL_ENTRIES)
    return rf"""WITH e(h, p, action) AS (VALUES {entries}),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
a AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
fit AS (SELECT r, arg_max(h || p, (length(h), length(p))) AS rule, arg_max(action, (length(h), length(p))) AS action
  FROM a JOIN e ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM a LEFT JOIN fit USING (r)"""


_NEGATIVES = """WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


#: The other operators rest on hashes, trained models, tokenizers or graphs, which are not SQL; tests compare them with brute force.
ORACLES: dict[str, str] = {"op9_decontamination": _CONTAMINATION, "op10_chat": _chat_sql(), "op11_urls": _url_sql(), "op13_negatives": _NEGATIVES}
