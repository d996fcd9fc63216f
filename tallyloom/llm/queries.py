"""The queries over the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import ann, cuckoo, license_scan, line_dedup, mixing, pieces, quality, secret_ledger, simhash, warc
from tallyloom.llm.base import saved, table

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _found_of_kind(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one ledger, which together scan every text by every rule.

    The first is the history: the blobs whose address is in the lower half, by all
    rules but the newest. The second covers the whole table by all rules: it scans
    the other blobs by all of them and those in the ledger by the newest only.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    past = docs.filter(F.sha2(F.coalesce("text", F.lit("")), 256) < "8")
    ledger, _ = secret_ledger.update(past, None, secret_ledger.RULES[:-1], path_col="doc_id", content_col="text")
    _, findings = secret_ledger.update(docs, ledger, path_col="doc_id", content_col="text")
    counts = [_found_of_kind(k).alias(f"n_{k}") for k in secret_ledger.BASE_KINDS]
    base = F.filter("found", lambda s: s["kind"].isin(*secret_ledger.BASE_KINDS))
    return findings.select(F.col("path").alias("doc_id"), *counts, F.sha2(secret_ledger.span_text(base), 256).alias("base_sha256"), secret_ledger.span_text(F.col("found")).alias("spans"))


def _op1_sql() -> str:
    parts = []
    for number, rule in enumerate(secret_ledger.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT row_no, {number} AS kind_no, '{rule.kind}' AS kind,
         unnest(list_transform(range(1, len(m) + 1), lambda i: {{
           'start': CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
           'size': length(m[i]), 'part': length(g[i])}})) AS s
  FROM (SELECT row_no, string_split_regex(body, '{pattern}') AS p, regexp_extract_all(body, '{pattern}', 0) AS m, regexp_extract_all(body, '{pattern}', {rule.part}) AS g
        FROM bodies WHERE regexp_matches(body, '{pattern}'))""")
    least = " ".join(f"WHEN {i} THEN {max(r.least, 1)}" for i, r in enumerate(secret_ledger.RULES))
    return f"""
WITH bodies AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS body FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (
  SELECT row_no, kind_no, kind, s.start AS start, kind || ':' || s.start || ':' || (s.start + s.size) AS span
  FROM found WHERE s.part >= CASE kind_no {least} END
)
SELECT doc_id, count(span) FILTER (WHERE kind = 'assign') AS n_assign, count(span) FILTER (WHERE kind = 'access') AS n_access, count(span) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_no) FILTER (WHERE kind_no < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind_no), '') AS spans
FROM bodies LEFT JOIN spans USING (row_no) GROUP BY row_no, doc_id
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


# chr(11), chr(12): the white space that DuckDB's string literals cannot escape
OP2_SQL = """
WITH lines AS (
  SELECT doc_id, row_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT row_no) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no, doc_id
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(warc.planned(table(spark, sf_dir, "pages")))
    return warc.read_archives(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM hashed),
typed AS (SELECT *, payload_bytes >= 1000 AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS again FROM grouped)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to
FROM typed
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each whole text; exact: whether decoding them gave the text back."""
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _op6_sql() -> str:
    """Lines, and runs of words wherever lines end; runs are tried only in texts that have the words at all."""
    size = lambda words: license_scan.run_words(words, license_scan.CONTAINMENT)
    templates = ", ".join(f"({i}, '{label}', list_distinct(string_split('{words}', ' ')), {size(words)})" for i, (label, words) in enumerate(license_scan.TEMPLATES))
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in license_scan.PHRASES)
    word = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    return f"""
WITH bodies AS (SELECT doc_id, row_number() OVER () AS row_no, {_LOWER} AS body FROM documents),
texts AS (SELECT *, regexp_extract_all(body, {word}) AS words FROM bodies),
templates(template, label, own, run) AS (VALUES {templates}),
phrases(label, parts) AS (VALUES {phrases}),
places AS (
  SELECT row_no, label, unnest(list_filter(range(0, greatest(len(words) - len(parts) + 1, 0)), lambda i: words[i + 1:i + len(parts)] = parts)) AS place
  FROM texts CROSS JOIN phrases
), base AS (
  SELECT row_no, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY row_no
), lines AS (
  SELECT row_no, list_distinct(regexp_extract_all(line, {word})) AS own FROM (SELECT row_no, unnest(string_split(body, chr(10))) AS line FROM bodies)
), able AS (
  SELECT row_no, words, label, t.own, run FROM (SELECT *, list_distinct(words) AS had FROM texts) x CROSS JOIN templates t
  WHERE len(list_intersect(had, t.own)) / len(t.own)::DOUBLE >= {license_scan.CONTAINMENT}
), runs AS (
  SELECT row_no, label, own, run, words, unnest(range(0, greatest(len(words) - run + 1, 1))) AS spot FROM able
), contained AS (
  SELECT row_no, label, len(list_intersect(b.own, t.own)) / len(t.own)::DOUBLE AS score FROM lines b CROSS JOIN templates t
  UNION ALL
  SELECT row_no, label, len(list_intersect(list_distinct(words[spot + 1:spot + run]), own)) / len(own)::DOUBLE AS score FROM runs
), labelled AS (
  SELECT row_no, label, score FROM contained WHERE score >= {license_scan.CONTAINMENT} UNION ALL SELECT row_no, label, 1.0::DOUBLE FROM places
), total AS (
  SELECT row_no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM labelled GROUP BY row_no
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM texts LEFT JOIN base USING (row_no) LEFT JOIN total USING (row_no)
"""


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = saved(mixing.sized_documents(table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS lim
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER f, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0::DOUBLE)) AS level
  FROM weighed
  WINDOW f AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(lim, max(level) OVER () * weight) AS target FROM levels
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), drawn AS (
  SELECT doc_id, size, source_size, target, whole,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE
           <= target - whole * source_size AS more
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN CAST(size * (whole + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) ELSE 0 END AS taken
FROM drawn
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cuckoo.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = f"""
WITH hashed AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
kept AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM hashed JOIN kept USING (text_sha256)
"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_license_scan": op6_license_scan,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLES = {
    "op3_warc": OP3_SQL,
    "op1_secret_scan": _op1_sql(),
    "op6_license_scan": _op6_sql(),
    "op2_line_dedup": OP2_SQL,
    "op9_mixing": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
}
