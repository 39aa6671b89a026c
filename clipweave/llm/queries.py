"""The queries of this subpackage and, where SQL can say it, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, lm, mixing, passages, quality, secrets, simhash, topk, warc
from .common import Scratch, remainder_is, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op1"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH b AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, array_to_string(ws[i:i + 12], ' ') AS w, least(len(ws), 13) AS n
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), spot AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)
), hit AS (
  SELECT rid, i, spot.n AS n, item FROM spot JOIN win USING (w, n)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # clipweave.ledger names the folder of a ledger to go on with, so that only new blobs are scanned; else this run begins one
    ledger = secrets.Ledger(spark, spark.conf.get("clipweave.ledger", None) or Scratch(spark, "op2").path)
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger, path="doc_id")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.spans(F.col("findings"))
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _found_sql(k: int, pattern: str, keep: str = "true") -> str:
    """The spans of one kind: a match begins after all gaps up to it and all matches before it."""
    return f"""SELECT rid, {k} AS k, upto - length(hit) AS a, upto AS b FROM (
    SELECT rid, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY i) AS upto
    FROM (SELECT rid, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i
      FROM (SELECT rid, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM d))) WHERE {keep}"""


_NAME = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN = _NAME + r"""["'']?\x20*[:=]\x20*["'']?"""
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS (
  {_found_sql(0, _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(hit, '^{_ASSIGN}([A-Za-z0-9+/_.=-]+)$', 1)) >= {secrets.MIN_VALUE}")}
  UNION ALL {_found_sql(1, f"AKIA[A-Z0-9]{{{secrets.MIN_ACCESS - 4},}}")}
  UNION ALL {_found_sql(2, f"[0-9a-f]{{{secrets.MIN_HEX},}}")}
), g AS (
  SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    string_agg({list(secrets.KINDS)}[k + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, k) AS spans FROM f GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    return warc.read(spark, warc.write(table(spark, sf_dir, "pages"), scratch), scratch)


_B32 = " || ".join(f"substr('{warc.BASE32}', CAST((CAST('0x' || substr(sha1(h), {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * k}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for k in range(4))
OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(h) AS payload_bytes, {_B32} AS payload_digest FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS most FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> most THEN most END AS refers_to FROM q
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), Scratch(spark, "op6"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")



def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return topk.search(rows, rows.where("id % 50 = 0"))


OP4_SQL = """
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS code FROM embeddings WHERE len(embedding) = 64),
d AS (
  SELECT q.vec_id AS query_id, n.vec_id AS neighbour_id, CAST(len(list_filter(list_zip(q.code, n.code), lambda p: p[1] <> p[2])) AS INTEGER) AS distance
  FROM c AS q JOIN c AS n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0
)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10
"""


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder_is(F.col("doc_id"), 7, 2)
    model = lm.fit(docs.where(~held), Scratch(spark, "op5"))
    return lm.score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder_is(F.col("doc_id"), 5, 0)
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder_is(F.col("doc_id"), 4, 2)
    model = quality.fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    spans = F.array_join(F.transform("remove", lambda s: F.concat_ws(":", s["at"].cast("string"), s["to"].cast("string"))), ",")
    return found.select("doc_id", "component_id", "n_links", "n_remove", spans.alias("remove_words"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_secrets": op2_secrets,
    "op3_warc": op3_warc,
    "op4_topk": op4_topk,
    "op5_lm": op5_lm,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_passages": op10_passages,
}
SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_secrets": OP2_SQL, "op3_warc": OP3_SQL, "op4_topk": OP4_SQL}
