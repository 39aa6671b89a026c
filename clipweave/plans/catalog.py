"""The registered queries, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clipweave.functions import frames as fr
from clipweave.functions import text as tx
from clipweave.functions.align import transcribed
from clipweave.functions.interpret import interpreted
from clipweave.functions.prompts import Prompts
from clipweave.operators import evaluate, redundancy, segmentation, selection, state, visual
from clipweave.plans import summary
from clipweave.plans.segmenters import WordSegmenter
from clipweave.sources.shared import keeper

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Segments of conversations: 15 characters a second.
SEG = """seg AS (SELECT conv_id AS video_index, turn AS segment_index, coalesce(text, '') AS content, role AS topic,
  CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) - length(coalesce(text, '')) AS DOUBLE) / 15 AS start,
  CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) / 15 AS "end" FROM conversations)"""
#: Timed words of events: seconds since the user's first event; a purchase ends a sentence.
WORDS = """words AS (SELECT user_id AS video, row_number() OVER w - 1 AS pos, event_type AS text, epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1e6 AS start,
  epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1e6 + least(value, 5.0) AS "end", event_type = 'purchase' AS ends, CASE WHEN event_type = 'view' THEN '' ELSE ' ' END AS separator_after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _segments(spark, d) -> DataFrame:
    c = _table(spark, d, "conversations")
    text = F.coalesce("text", F.lit(""))
    upto = F.sum(F.length(text)).over(W.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("video_index"), F.col("turn").alias("segment_index"), text.alias("content"), F.col("role").alias("topic"), ((upto - F.length(text)).cast("double") / 15).alias("start"), (upto.cast("double") / 15).alias("end"))


def _words(spark, d) -> DataFrame:
    w, ts = W.partitionBy("user_id"), F.col("ts").cast("timestamp")
    t = F.unix_micros(ts) / 1e6 - F.min(F.unix_micros(ts)).over(w) / 1e6
    e = _table(spark, d, "events")
    return e.select(F.col("user_id").alias("video"), (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("pos"), F.col("event_type").alias("text"), t.alias("start"), (t + F.least("value", F.lit(5.0))).alias("end"), (F.col("event_type") == "purchase").alias("ends"), F.when(F.col("event_type") == "view", "").otherwise(" ").alias("separator_after"))


_TFIDF = """tok AS (SELECT video_index, segment_index, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]{2,}')) AS token FROM seg),
tf AS (SELECT video_index, segment_index, token, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
x AS (SELECT video_index, segment_index, token, tf * (ln((SELECT count(*) FROM seg) / df) + 1) AS x FROM tf JOIN df USING (token)),
weights AS (SELECT video_index, segment_index, token, x / sqrt(sum(x * x) OVER (PARTITION BY video_index, segment_index)) AS w FROM x)"""
_PAIRS = f"""WITH {SEG}, {_TFIDF}, pairs AS (SELECT a.video_index AS v1, a.segment_index AS s1, b.video_index AS v2, b.segment_index AS s2, round(sum(a.w * b.w), 9) AS value
  FROM weights a JOIN weights b ON a.token = b.token AND a.video_index < b.video_index GROUP BY ALL HAVING round(sum(a.w * b.w), 9) > 0.3)"""


@_query(_PAIRS + " SELECT v1, s1, v2, s2, value FROM pairs QUALIFY value = max(value) OVER (PARTITION BY v1, v2)")
def content_redundancy_pairs(spark, d):
    return redundancy.strongest(redundancy.similar_pairs(redundancy.tfidf(_segments(spark, d)), 0.3, best=True))


@_query(f"WITH {SEG}, {_TFIDF} SELECT video_index, segment_index, token, round(w, 9) AS w FROM weights")
def tfidf_weights(spark, d):
    return redundancy.tfidf(_segments(spark, d)).withColumn("w", F.round("w", 9))


@_query(f"WITH {SEG} SELECT round(s, 6) AS set_time, round(0.17 + 0.17 * (s - 785) / 785, 6) AS threshold FROM (SELECT sum(e) AS s FROM (SELECT arg_max(\"end\", segment_index) AS e FROM seg GROUP BY video_index))")
def adaptive_threshold(spark, d):
    return redundancy.adaptive_threshold(_segments(spark, d)).select(F.round("set_time", 6).alias("set_time"), F.round("threshold", 6).alias("threshold"))


@_query(_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + """, best AS (SELECT v1 || ':' || s1 AS a, v2 || ':' || s2 AS b, row_number() OVER (ORDER BY v2, s2, v1, s1) AS i FROM (SELECT * FROM pairs QUALIFY value = max(value) OVER (PARTITION BY v1, v2))),
fold AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, MAP {}::MAP(VARCHAR, BIGINT) AS known, []::STRUCT(c BIGINT, k VARCHAR)[] AS added
UNION ALL SELECT b.i, f.n + (f.known[b.a] IS NULL AND f.known[b.b] IS NULL)::INT,
  map_concat(f.known, CASE WHEN f.known[b.a] IS NOT NULL THEN MAP {b.b: f.known[b.a]} WHEN f.known[b.b] IS NOT NULL THEN MAP {b.a: f.known[b.b]} ELSE MAP {b.a: f.n} END),
  CASE WHEN f.known[b.a] IS NOT NULL THEN [{'c': f.known[b.a], 'k': b.b}] WHEN f.known[b.b] IS NOT NULL THEN [{'c': f.known[b.b], 'k': b.a}] ELSE [{'c': f.n, 'k': b.a}, {'c': f.n, 'k': b.b}] END
  FROM fold f JOIN best b ON b.i = f.i + 1),
cl AS (SELECT DISTINCT x.c AS cluster_id, CAST(split_part(x.k, ':', 1) AS BIGINT) AS video_index, CAST(split_part(x.k, ':', 2) AS BIGINT) AS segment_index FROM (SELECT unnest(added) AS x FROM fold))
SELECT cluster_id, video_index, segment_index FROM cl""")
def redundancy_clusters(spark, d):
    return redundancy.clusters(content_redundancy_pairs(spark, d))


@_query(f"WITH {SEG} SELECT topic, count(DISTINCT (video_index, content, start, \"end\")) AS n, arg_min(video_index, (video_index, segment_index)) AS first_video, arg_min(segment_index, (video_index, segment_index)) AS first_segment FROM seg WHERE topic <> '' GROUP BY topic")
def topic_clusters(spark, d):
    return redundancy.topic_clusters(_segments(spark, d), "topic")


@_query(f"WITH {SEG} SELECT count(DISTINCT video_index) AS videos, count(*) AS segments, round(sum(\"end\" - start), 6) AS seconds FROM seg")
def summary_metrics(spark, d):
    return summary.metrics(_segments(spark, d))


@_query(f"WITH {SEG} SELECT video_index, segment_index FROM (SELECT *, bool_and(round_even(\"end\", 0) <= 61) OVER (PARTITION BY video_index ORDER BY segment_index) AS ok FROM seg) WHERE ok")
def intro_prefix(spark, d):
    return segmentation.until(_segments(spark, d), F.lit(60)).select("video_index", "segment_index")


_HIST = """h AS (SELECT label AS video, vec_id AS frame_no, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings),
f AS (SELECT video, frame_no, list_transform(a, lambda x: x / list_sum(a)) AS hist FROM h),
p AS (SELECT video, row_number() OVER w - 2 AS i, lag(hist) OVER w AS before, hist FROM f WINDOW w AS (PARTITION BY video ORDER BY frame_no)),
q AS (SELECT video, i, round(list_sum(list_transform(list_zip(before, hist), lambda z: least(z[1], z[2]))), 9) AS same FROM p WHERE i >= 0),
cut AS (SELECT video, CAST(ceil(coalesce(min(CASE WHEN same < 0.7 THEN i END), max(i))) AS BIGINT) AS second FROM q GROUP BY video)"""


def _frames(spark, d):
    e = _table(spark, d, "embeddings")
    return e.select(F.col("label").alias("video"), F.col("vec_id").alias("frame_no"), fr.normalised(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("hist"))


@_query(f"WITH {_HIST} SELECT video, second FROM cut")
def intro_cut(spark, d):
    return selection.intro_end(_frames(spark, d))


@_query(f"WITH {_HIST} SELECT video, CAST(ceil(coalesce(min(CASE WHEN same < 0.7 THEN i - 3 END), max(i - 3)) / 2.0) AS BIGINT) AS second FROM q WHERE i >= 3 GROUP BY video")
def intro_cut_after_skip(spark, d):
    return selection.intro_end(_frames(spark, d), fps=2, skip=1.5)


@_query(f"WITH {SEG}, {_HIST}, ends AS (SELECT video, second + 40 AS second FROM cut), pre AS (SELECT s.* FROM (SELECT seg.*, bool_and(round_even(\"end\", 0) <= second + 1) OVER (PARTITION BY video_index ORDER BY segment_index) AS ok FROM seg JOIN ends ON video = video_index) s WHERE ok) SELECT video_index, segment_index FROM pre WHERE video_index = (SELECT video FROM ends WHERE video IN (SELECT video_index FROM pre) ORDER BY second, video LIMIT 1)")
def shortest_introduction(spark, d):
    ends = selection.intro_end(_frames(spark, d)).withColumn("second", F.col("second") + 40)
    seg = _segments(spark, d).join(ends, F.col("video_index") == F.col("video"))
    return selection.shortest(ends, segmentation.until(seg, F.col("second"))).select("video_index", "segment_index")


@_query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 1")
def object_and_subjective(spark, d):
    seen = _table(spark, d, "labels").where("quality = 1")
    return _table(spark, d, "documents").select("doc_id").join(seen.where("toxic = 1").select("doc_id"), "doc_id")


_FRAMES = """frames AS (SELECT video_index, unnest(generate_series(0, CAST(floor(m / 5) AS BIGINT))) * 5.0::DOUBLE AS t FROM (SELECT video_index, max("end") AS m FROM seg GROUP BY video_index))"""


def _seconds(spark, d):
    ends = _segments(spark, d).groupBy("video_index").agg(F.max("end").alias("m"))
    ends = ends.select("video_index", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") / 5))).alias("k"))
    return ends.select("video_index", (F.col("k") * F.lit(5.0)).alias("t"))


@_query(f"WITH {SEG}, {_FRAMES} SELECT s.video_index, s.segment_index, count(*) AS frames, bool_or(t % 35 = 0) AS has_object FROM frames f JOIN seg s ON f.video_index = s.video_index AND t BETWEEN s.start AND s.\"end\" GROUP BY ALL")
def frames_in_segments(spark, d):
    held = selection.frames_within(_seconds(spark, d), _segments(spark, d))
    return held.groupBy("video_index", "segment_index").agg(F.count("*").alias("frames"), F.bool_or(F.col("t") % 35 == 0).alias("has_object"))


@_query(f"WITH {SEG} SELECT video_index, f AS frame_no FROM (SELECT video_index, unnest(generate_series(0, CAST(floor(max(\"end\")) AS BIGINT) * 30)) AS f FROM seg GROUP BY video_index) WHERE f % 60 = 0 AND f / 30.0 BETWEEN 3 AND 90")
def frame_sampling(spark, d):
    ends = _segments(spark, d).groupBy("video_index").agg(F.floor(F.max("end")).alias("m"))
    videos = ends.select("video_index", F.lit(30.0).alias("fps"), (F.col("m") * 30 + 1).alias("n_frames"))
    return selection.sample_frames(videos, 0.5, 3, 90).select("video_index", "frame_no")


@_query("SELECT user_id AS segment, sum(CASE WHEN event_type <> 'error' AND value > 50 THEN 1 ELSE 0 END) / 40.0::DOUBLE AS ratio FROM events GROUP BY user_id HAVING sum(CASE WHEN event_type <> 'error' AND value > 50 THEN 1 ELSE 0 END) / 40.0::DOUBLE >= 0.5")
def question_filter(spark, d):
    answers = _table(spark, d, "events").select(F.col("user_id").alias("segment"), F.when(F.col("event_type") != "error", F.col("value") > 50).alias("answer"))
    return selection.positive_ratio(answers, 40)


_BOVW = """tf AS (SELECT user_id % 10 AS cluster, user_id AS segment, CAST(floor(value) AS BIGINT) AS word, count(*) AS tf FROM events GROUP BY ALL),
df AS (SELECT cluster, word, count(*) AS df FROM tf GROUP BY ALL), v AS (SELECT cluster, segment, word, tf * log10(300.0::DOUBLE / df) AS w FROM tf JOIN df USING (cluster, word))"""


def _visual(spark, d):
    e = _table(spark, d, "events").select((F.col("user_id") % 10).alias("cluster"), F.col("user_id").alias("segment"), F.floor("value").alias("word"))
    return selection.visual_words(e)


@_query(f"WITH {_BOVW} SELECT cluster, segment, word, round(w, 9) AS w FROM v")
def visual_word_weights(spark, d):
    return _visual(spark, d).withColumn("w", F.round("w", 9))


@_query(f"WITH {_BOVW} SELECT cluster, segment, quality FROM (SELECT cluster, segment, round(sum(w), 6) AS quality FROM v GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY quality DESC, segment) <= 1")
def quality_pick(spark, d):
    return selection.quality_pick(_visual(spark, d))


_COVER = f"""{SEG}, clusters AS (SELECT video_index, cluster_id, min(start) AS a, max("end") AS b, max("end") - min(start) AS duration, string_agg(content, ' ' ORDER BY segment_index) AS content
  FROM (SELECT *, unnest([segment_index // 2, segment_index // 3 + 100]) AS cluster_id FROM seg) GROUP BY ALL)"""


def _clusters(spark, d):
    s = _segments(spark, d).withColumn("cluster_id", F.explode(F.array(F.floor(F.col("segment_index") / 2), F.floor(F.col("segment_index") / 3) + 100)))
    return s, segmentation.cluster_spans(s)


@_query(f"WITH {_COVER} SELECT video_index, cluster_id, round(duration, 6) AS duration, length(content) AS chars FROM clusters")
def cluster_durations(spark, d):
    return _clusters(spark, d)[1].select("video_index", "cluster_id", "duration", F.length("content").cast("long").alias("chars"))


@_query(f"WITH {_COVER}, m AS (SELECT video_index, segment_index, unnest([segment_index // 2, segment_index // 3 + 100]) AS cluster_id FROM seg) SELECT video_index, segment_index, cluster_id FROM m JOIN clusters USING (video_index, cluster_id) QUALIFY row_number() OVER (PARTITION BY video_index, segment_index ORDER BY round(duration, 6), cluster_id) = 1")
def shortest_covering_cluster(spark, d):
    return segmentation.shortest_cover(*_clusters(spark, d))


@_query("""WITH r AS (SELECT CAST(quality AS VARCHAR) AS a, CASE WHEN n_chars > 1000 THEN '1' ELSE '0' END AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT c, (SELECT count(*) FROM r WHERE a = c) AS support, (SELECT count(*) FROM r WHERE p = c) AS given, (SELECT count(*) FROM r WHERE a = c AND p = c) AS hit FROM (VALUES ('0'), ('1')) t(c)),
m AS (SELECT c AS name, hit / given AS precision, hit / support AS recall, support, hit FROM c), f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM m)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
SELECT name, precision, recall, f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f)""")
def classification_report(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("p"))
    out = evaluate.classification_report(_table(spark, d, "labels").join(docs, "doc_id"), "quality", "p")
    return out.select("name", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@_query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark, d):
    return _table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@_query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <> count(DISTINCT role)")
def duplicate_ids(spark, d):
    return evaluate.duplicate_ids(_table(spark, d, "conversations"), "conv_id", "role")


_LOG = """log AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, user_id AS segment, CASE event_type WHEN 'click' THEN 'include' WHEN 'error' THEN 'discard' WHEN 'purchase' THEN 'output' ELSE 'pick' END AS action FROM events)"""
_STATE = f"""WITH {_LOG}, o AS (SELECT *, min(CASE WHEN action = 'output' THEN seq END) OVER (PARTITION BY segment) AS first_out FROM log WHERE action <> 'pick'),
l AS (SELECT * FROM o WHERE (action <> 'discard' OR first_out IS NULL OR seq < first_out) AND (action <> 'output' OR seq = first_out)),
s AS (SELECT segment, arg_max(action, seq) = 'include' AS included, arg_max(action, seq) = 'discard' AS discarded, max(first_out) IS NOT NULL AS outputted FROM l GROUP BY segment)"""


def _log(spark, d):
    e = _table(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "include").when(F.col("event_type") == "error", "discard").when(F.col("event_type") == "purchase", "output").otherwise("pick")
    return e.select(F.struct("ts", "event_id").alias("seq"), F.col("user_id").alias("segment"), action.alias("action"))


@_query(f"{_STATE} SELECT segment, included, discarded, outputted FROM s")
def decision_state(spark, d):
    return state.fold(_log(spark, d), "segment")


@_query(f"{_STATE} SELECT segment FROM s WHERE outputted OR (included AND NOT (SELECT bool_or(outputted) FROM s))")
def finalized_output(spark, d):
    return state.finalize(decision_state(spark, d)).select("segment")


#: A summary's choice: what is said, questions and answers alike, in order.
_OUT = "picked AS (SELECT * FROM seg WHERE topic <> 'system')"


def _picked(spark, d):
    return _segments(spark, d).where("topic <> 'system'")


@_query(f"WITH {SEG}, {_OUT} SELECT row_number() OVER w AS pos, 'v' || video_index AS video_path, round(start, 6) AS start, round(\"end\", 6) AS \"end\", round(coalesce(sum(\"end\" - start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS out_start FROM picked WINDOW w AS (ORDER BY video_index, segment_index)")
def edit_list(spark, d):
    rows = state.positioned(_picked(spark, d), "video_index", "segment_index").withColumn("video_path", F.concat(F.lit("v"), F.col("video_index").cast("string")))
    return state.edit_list(rows).select("pos", "video_path", *[F.round(c, 6).alias(c) for c in ("start", "end", "out_start")])


@_query(f"WITH {SEG}, {_OUT} SELECT count(*) AS segments, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM picked")
def summary_video(spark, d):
    return summary.result(_picked(spark, d), "topic")


@_query(f"WITH {SEG} SELECT video_index, segment_index, row_number() OVER (PARTITION BY video_index ORDER BY start DESC, segment_index DESC) - 1 AS \"order\" FROM seg")
def renumbered(spark, d):
    return segmentation.renumbered(_segments(spark, d).select("video_index", "segment_index", "start"), "video_index", F.desc("start"), F.desc("segment_index")).drop("start")


@_query("SELECT event_id, CASE WHEN d = 0 THEN '' WHEN d = 1 THEN '1 day, ' ELSE d || ' days, ' END || (r // 3600000000) || ':' || lpad(CAST((r // 60000000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((r // 1000000) % 60 AS VARCHAR), 2, '0') || CASE WHEN r % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(r % 1000000 AS VARCHAR), 6, '0') END AS clock FROM (SELECT event_id, m // 86400000000 AS d, m % 86400000000 AS r FROM (SELECT event_id, CAST(round(value * 1000 * 1000000) AS BIGINT) AS m FROM events))")
def clock_text(spark, d):
    return _table(spark, d, "events").select("event_id", tx.clock(F.col("value") * 1000).alias("clock"))


_JOINED = "sha256(string_agg(text || CASE WHEN pos = last THEN '' ELSE separator_after END, '' ORDER BY pos)) AS content"


@_query(f"WITH {WORDS} SELECT video, {_JOINED} FROM (SELECT *, max(pos) OVER (PARTITION BY video) AS last FROM words) GROUP BY video")
def words_text(spark, d):
    return _words(spark, d).groupBy("video").agg(F.sha2(segmentation.joined_words(), 256).alias("content"))


@_query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN u WHEN 1 THEN '/other/' || u ELSE '/up/' || u END AS portable FROM (SELECT page_id, rtrim(regexp_replace(url, '/+', '/', 'g'), '/') AS u FROM pages)")
def portable_paths(spark, d):
    inside = F.when(F.col("page_id") % 3 == 0, "/root/./x/../").when(F.col("page_id") % 3 == 1, "/other/").otherwise("/root/../up/")
    return _table(spark, d, "pages").select("page_id", tx.relative(F.concat(inside, F.col("url")), "/root").alias("portable"))


@_query(f"WITH {SEG} SELECT video_index, segment_index FROM seg WHERE NOT EXISTS (SELECT 1 FROM seg o WHERE o.topic = 'system' AND o.video_index = seg.video_index AND o.segment_index IS NOT DISTINCT FROM seg.segment_index)")
def without_discarded(spark, d):
    s = _segments(spark, d)
    gone = s.where("topic = 'system'").select(F.col("video_index").alias("video_index"), F.col("segment_index").alias("segment_index"))
    return redundancy.without(s.select("video_index", "segment_index"), gone, "video_index", "segment_index")


@_query(_PAIRS + " SELECT v1, s1, v2, s2 FROM pairs WHERE s1 <> 0 AND s2 <> 0")
def live_pairs(spark, d):
    gone = _segments(spark, d).where("segment_index = 0").select("video_index", "segment_index")
    left = redundancy.without(redundancy.tfidf(_segments(spark, d)), gone, "video_index", "segment_index")  # so no pair with one of these is made
    return redundancy.similar_pairs(left, 0.3).select("v1", "s1", "v2", "s2")


@_query(f"WITH {SEG} SELECT video_index, segment_index, regexp_matches(content, '[.!?。！？][\"''”’»)\\]}}\\p{{Pe}}\\p{{Pf}}\\s]*$') AS ends, regexp_matches(content, '[.!?]\\n?\\z') AS closes FROM seg")
def sentence_ends(spark, d):
    return _segments(spark, d).select("video_index", "segment_index", tx.sentence_end(F.col("content")).alias("ends"), tx.closes(F.col("content")).alias("closes"))


@_query(f"WITH {WORDS}, i AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM words) SELECT video, CAST(o AS BIGINT) AS \"order\", round(arg_min(start, pos), 6) AS start, round(arg_max(\"end\", pos), 6) AS \"end\", count(*) AS n_words, {_JOINED} FROM (SELECT *, max(pos) OVER (PARTITION BY video, o) AS last FROM i) GROUP BY video, o")
def transcript_chunks(spark, d):
    return segmentation.chunks(_words(spark, d)).select("video", F.col("order").cast("long").alias("order"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n_words", F.sha2("content", 256).alias("content"))


_WALK = f"""WITH RECURSIVE {WORDS}, walk AS (SELECT video, pos, start AS seg_start, start, "end", ends, text, separator_after, 0::BIGINT AS o FROM words WHERE pos = 0
UNION ALL SELECT n.video, n.pos, CASE WHEN w.ends AND w."end" - w.seg_start >= 86400 THEN n.start ELSE w.seg_start END, n.start, n."end", n.ends, n.text, n.separator_after, w.o + CASE WHEN w.ends AND w."end" - w.seg_start >= 86400 THEN 1 ELSE 0 END FROM walk w JOIN words n ON n.video = w.video AND n.pos = w.pos + 1)
SELECT video, o AS "order", round(min(start), 6) AS start, round(arg_max("end", pos), 6) AS "end", {_JOINED} FROM (SELECT *, max(pos) OVER (PARTITION BY video, o) AS last FROM walk) GROUP BY video, o"""


def _cut(rows):
    return rows.select("video", F.col("order").cast("long").alias("order"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.sha2("content", 256).alias("content"))


@_query(_WALK)
def word_segments(spark, d):
    return _cut(segmentation.word_segments(_words(spark, d), 86400))


@_query(_WALK)
def word_segments_function(spark, d):
    return _cut(segmentation.word_segments_function(_words(spark, d), 86400))


_ISLES = f"""WITH {WORDS}, c AS (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY video ORDER BY pos) = text THEN 0 ELSE 1 END AS new FROM words), g AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY pos) - 1 AS o FROM c)"""


def _topical(spark, d):
    return _words(spark, d).select("video", "pos", F.col("text").alias("topic"), "start", "end", F.col("text").alias("content"))


_CONTENT = "sha256(string_agg(text, ' ' ORDER BY pos)) AS content"


def _merged(rows):
    return rows.select("video", F.col("order").cast("long").alias("order"), "topic", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.sha2("content", 256).alias("content"))


@_query(f"{_ISLES} SELECT video, CAST(o AS BIGINT) AS \"order\", any_value(text) AS topic, round(arg_min(start, pos), 6) AS start, round(arg_max(\"end\", pos), 6) AS \"end\", {_CONTENT} FROM g GROUP BY video, o")
def merged_topics(spark, d):
    return _merged(segmentation.merge_topics(_topical(spark, d)))


def _joining(rule: str) -> str:
    """Neighbours of one topic joined while a rule on w, the segment so far, and n, the next word, holds."""
    return f"""WITH RECURSIVE {WORDS}, walk AS (SELECT video, pos, text, start AS a, "end" AS b, start, 0::BIGINT AS o FROM words WHERE pos = 0
UNION ALL SELECT n.video, n.pos, n.text, CASE WHEN n.text = w.text AND {rule} THEN w.a ELSE n.start END, n."end", n.start, w.o + CASE WHEN n.text = w.text AND {rule} THEN 0 ELSE 1 END FROM walk w JOIN words n ON n.video = w.video AND n.pos = w.pos + 1)
SELECT video, o AS "order", any_value(text) AS topic, round(arg_min(start, pos), 6) AS start, round(arg_max(b, pos), 6) AS "end", {_CONTENT} FROM walk GROUP BY video, o"""


@_query(_joining('n."end" - w.a <= 90000'))
def merged_topics_limited(spark, d):
    return _merged(segmentation.merge_topics(_topical(spark, d), 90000.0))


@_query(_joining('w.b - w.a + n."end" - n.start < 40000'))
def fused_segments(spark, d):
    return _merged(segmentation.fuse(_topical(spark, d), 40000.0))


_STEP = """CASE WHEN w.closed THEN least(w.pos, coalesce((SELECT max(x.pos) + 1 FROM words x JOIN words y ON y.video = x.video AND y.pos = x.pos + 1
  WHERE x.video = w.video AND x.pos > w.a AND x.pos < w.pos AND abs(w.b - x.start - 43200) > abs(w.b - y.start - 43200)), w.a + 1)) ELSE w.a END"""


@_query(f"""WITH RECURSIVE {WORDS}, k AS (SELECT video, pos, start, "end", ends, coalesce(lead(start) OVER (PARTITION BY video ORDER BY pos) - "end" < 3600, false) AS goes_on, pos = max(pos) OVER (PARTITION BY video) AS is_last FROM words),
walk AS (SELECT video, pos, 0::BIGINT AS a, "end" AS b, 0::BIGINT AS c, NOT is_last AND NOT goes_on AND ends AND "end" - start >= 86400 AS closed, is_last FROM k WHERE pos = 0
UNION ALL SELECT n.video, n.pos, g.a, n."end", w.c + w.closed::INT, NOT n.is_last AND NOT n.goes_on AND n.ends AND n."end" - f.start >= 86400, n.is_last
  FROM walk w JOIN k n ON n.video = w.video AND n.pos = w.pos + 1, LATERAL (SELECT {_STEP} AS a) g JOIN k f ON f.video = n.video AND f.pos = g.a)
SELECT w.video, CAST(w.c AS INTEGER) AS cluster_id, k.pos AS "order" FROM walk w JOIN k ON k.video = w.video AND k.pos BETWEEN w.a AND w.pos WHERE w.closed OR w.is_last""")
def overlapping_clusters(spark, d):
    return segmentation.overlapping(_words(spark, d), 86400.0, pause=3600)


@_query(f"WITH {WORDS} SELECT video, pos, coalesce(lead(start) OVER (PARTITION BY video ORDER BY pos) - \"end\" < 3600, false) AS goes_on FROM words")
def pauses(spark, d):
    return segmentation.goes_on(_words(spark, d), 3600).select("video", "pos", "goes_on")


@_query(f"WITH {SEG} SELECT video_index, CAST(ceil(3 + 0.5 * (pow(ceil(max(\"end\") / 60), 2) - 1)) AS BIGINT) AS topics FROM seg GROUP BY video_index")
def topic_limits(spark, d):
    ends = _segments(spark, d).groupBy("video_index").agg(F.max("end").alias("m"))
    return ends.select("video_index", tx.topic_limit(F.col("m")).alias("topics"))


@_query("SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' END AS label FROM documents")
def topic_labels(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.label_of(F.col("lang"), {"en": "English", "de": "German"}).alias("label"))


@_query("SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\\s\\p{Z}\\x{85}\\x{0B}]+|[\\s\\p{Z}\\x{85}\\x{0B}]+$', '', 'g'), '[\\s\\p{Z}\\x{85}\\x{0B}]+', ' ', 'g'), ' ([,.;:!?…%)\\]}”»])', '\\1', 'g'), '([(\\[{¿¡“«]) ', '\\1', 'g')) AS clean, sha256(regexp_replace(text, '^[\\s\\p{Z}\\x{85}\\x{0B}]+|[\\s\\p{Z}\\x{85}\\x{0B}]+$', '', 'g')) AS stripped FROM documents")
def collapsed_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.sha2(tx.collapsed(F.col("text")), 256).alias("clean"), F.sha2(tx.stripped(F.col("text")), 256).alias("stripped"))


@_query("SELECT doc_id, CASE lang WHEN 'fr' THEN 'fra' WHEN 'en' THEN 'en' ELSE lang END AS sent FROM documents")
def language_codes(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.language(F.col("lang"), {"fr": "fra"}, {"fra", "en"}).alias("sent"))


@_query(f"WITH {WORDS} SELECT video, bool_and(start >= 0 AND \"end\" >= start AND coalesce(start >= before, true)) AS valid FROM (SELECT *, lag(start) OVER (PARTITION BY video ORDER BY pos) AS before FROM words) GROUP BY video")
def valid_intervals(spark, d):
    w = W.partitionBy("video").orderBy("pos")
    ok = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & F.coalesce(F.col("start") >= F.col("before"), F.lit(True))
    return _words(spark, d).withColumn("before", F.lag("start").over(w)).groupBy("video").agg(F.bool_and(ok).alias("valid"))


@_query("SELECT n_nationkey, least(pow(2, n_nationkey), 10) AS llm, least(pow(2, n_nationkey), 30) AS stt FROM nation")
def backoff_seconds(spark, d):
    n = F.col("n_nationkey") + 1
    return _table(spark, d, "nation").select("n_nationkey", tx.backoff(n).alias("llm"), tx.backoff(n, cap=30.0).alias("stt"))


#: What a model may say about an event, and what is read of it: a table of cases, one for each remainder of event_id; ~ stands for a single quote.
_ANSWERS = [
    ("""'{"topics": [{"id": "a", "label": "' || event_type || '"}]}'""", """'{"a": "' || event_type || '"}'"""),
    ("""'```json' || chr(10) || '{"a": "' || event_type || '"}' || chr(10) || '```'""", """'{"a": "' || event_type || '"}'"""),
    ("""'{~b~: ~' || event_type || '~, "a": "x"}'""", """'{"a": "x", "b": "' || event_type || '"}'"""),
    ("""'{"a": "x", "a": "' || event_type || '"}'""", None),
    ("""'{1: ~x~, True: ~' || event_type || '~}'""", None),
    ("""'{"topics": [{"id": 1, "label": "' || event_type || '"}]}'""", None),
    ("""'{"topics": [{"id": "1", "label": "x", "note": "' || event_type || '"}]}'""", None),
    ("""'{"a": "x", "b": "x", "c": "' || event_type || '"}'""", None),  # one more than asked for
    ("""'I think it is ' || event_type""", None),
    ("props", None),  # labels that are numbers
    ("'  '", None),
]


@_query("SELECT event_id, value, value IS NOT NULL AS fits FROM (SELECT event_id, CASE event_id % " + str(len(_ANSWERS)) + " " + " ".join(f"WHEN {k} THEN {want or 'NULL'}" for k, (_, want) in enumerate(_ANSWERS)) + " END AS value FROM events)")
def interpreted_answers(spark, d):
    said = F.expr("replace(CASE event_id % " + str(len(_ANSWERS)) + " " + " ".join(f"WHEN {k} THEN {text}" for k, (text, _) in enumerate(_ANSWERS)) + " END, '~', chr(39))")
    rows = _table(spark, d, "events").select("event_id", interpreted(said, "topics", max_items=2).alias("r"))
    return rows.select("event_id", "r.value", F.col("r.error").isNull().alias("fits"))


_TOKENS = "tokens AS (SELECT user_id AS video, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, event_type AS word, event_type = 'purchase' AS ends, CASE WHEN event_type = 'view' THEN '' ELSE ' ' END AS separator_after, epoch_us(ts) / 1e6 - epoch_us(min(ts) OVER (PARTITION BY user_id)) / 1e6 AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _responses(spark, d) -> DataFrame:
    """What a hosted service might say: typed words, an event after the third, full stops only in the text."""
    w = _words(spark, d).withColumn("n", F.count("*").over(W.partitionBy("video")))
    said = F.concat("text", F.when(F.col("ends"), ".").otherwise(""), F.when(F.col("pos") + 1 < F.col("n"), F.col("separator_after")).otherwise(""))
    token = F.struct(F.lit("word").alias("type"), F.col("text").alias("text"), F.col("start"), F.col("start").alias("end"))
    noise = F.struct(F.lit("audio_event").alias("type"), F.lit("(noise)").alias("text"), F.col("start"), F.col("start").alias("end"))
    at = F.col("pos") == 2
    rows = w.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(at, F.array(token, noise)).otherwise(F.array(token)).alias("tokens"), F.when(at, F.concat(said, F.lit("(noise)"))).otherwise(said).alias("said")))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["said"]), "")
    return rows.select("video", F.to_json(F.struct(text.alias("text"), F.lit("en").alias("language_code"), F.flatten(F.transform("x", lambda r: r["tokens"])).alias("words"))).alias("response"))


def _transcripts(spark, d) -> DataFrame:
    return _responses(spark, d).select("video", transcribed(F.col("response"), "hosted").alias("t")).select("video", "t.*")


@_query(f"WITH {_TOKENS} SELECT video, pos, word || CASE WHEN ends THEN '.' ELSE '' END AS text, round(start, 6) AS start, CASE WHEN pos + 1 = n THEN ' ' ELSE separator_after END AS separator_after, ends FROM tokens")
def aligned_transcripts(spark, d):
    rows = segmentation.flattened(_transcripts(spark, d), "video")
    return rows.select("video", "pos", "text", F.round("start", 6).alias("start"), "separator_after", "ends")


class _Told:
    """A model that names the topics it is told and picks one by the content's length."""

    def __call__(self, prompt: str) -> str:
        kind, _, rest = prompt.partition("|")
        if kind == "merge":
            return json.dumps({"items": sorted(set(json.loads(rest)))})
        cells, _, content = rest.partition("|")
        if kind == "topics":
            return json.dumps({"topics": [{"id": str(k), "label": f"t{(k + len(content)) % 3}"} for k in range(min(3, int(cells)))]})
        ids = sorted(json.loads(cells))
        return json.dumps({ids[len(content) % len(ids)]: "said otherwise"})


_TOLD = Prompts(subtopics="topics|{most}|{transcript}", classify="classify|{topics}|{content}", merge_topics="merge|{topics}")


@_query(f"""WITH RECURSIVE {_TOKENS}, w AS (SELECT video, pos, n, word || CASE WHEN ends THEN '.' ELSE '' END AS text, CASE WHEN pos + 1 = n THEN ' ' ELSE separator_after END AS separator_after, ends, start FROM tokens),
doc AS (SELECT video, length(string_agg(text || CASE WHEN pos + 1 = n THEN '' ELSE separator_after END, '' ORDER BY pos)) + coalesce(max(CASE WHEN pos = 2 THEN 0 END), 0) AS chars FROM w GROUP BY video),
walk AS (SELECT video, pos, start AS a, start, ends, text, separator_after, 0::BIGINT AS o FROM w WHERE pos = 0
UNION ALL SELECT n.video, n.pos, CASE WHEN k.ends AND k.start - k.a >= 86400 THEN n.start ELSE k.a END, n.start, n.ends, n.text, n.separator_after, k.o + (k.ends AND k.start - k.a >= 86400)::INT FROM walk k JOIN w n ON n.video = k.video AND n.pos = k.pos + 1),
seg AS (SELECT video, o, min(start) AS start, max(start) AS "end", string_agg(text || CASE WHEN pos = last THEN '' ELSE separator_after END, '' ORDER BY pos) AS content FROM (SELECT *, max(pos) OVER (PARTITION BY video, o) AS last FROM walk) GROUP BY video, o),
lab AS (SELECT seg.*, 't' || ((length(content) % 3 + chars) % 3) AS topic FROM seg JOIN doc USING (video)),
new AS (SELECT *, CASE WHEN lag(topic) OVER (PARTITION BY video ORDER BY o) = topic THEN 0 ELSE 1 END AS fresh FROM lab),
isle AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY o) - 1 AS g FROM new),
done AS (SELECT video, g, any_value(topic) AS video_topic, min(start) AS start, max("end") AS "end", string_agg(content, ' ' ORDER BY o) AS content FROM isle GROUP BY video, g)
SELECT video, CAST(g AS BIGINT) AS "order", video_topic, 't' || (length(content) % 3) AS global_topic, 'v' || video AS video_path, round(start, 6) AS start, round("end", 6) AS "end", sha256(content) AS content FROM done""")
def segmented_videos(spark, d):
    heard = keeper(spark)(_transcripts(spark, d), "transcripts")
    videos = heard.select("video", F.concat(F.lit("v"), F.col("video").cast("string")).alias("path"), F.array().cast("array<string>").alias("topics"), F.lit(600.0).alias("seconds"))
    rows = WordSegmenter(_Told, keeper(spark), least=86400.0, prompts=_TOLD).with_global_topics(videos, heard)
    return rows.select("video", "order", "video_topic", "global_topic", "video_path", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.sha2("content", 256).alias("content"))


@_query("""WITH e AS (SELECT label AS grp, vec_id % 2 AS frame, vec_id AS kp, embedding FROM embeddings),
p AS (SELECT a.grp * 2 AS fa, b.grp * 2 + 1 AS fb, a.kp AS ka, b.kp AS kb, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS s FROM e a JOIN e b ON a.grp = b.grp AND a.frame = 0 AND b.frame = 1)
SELECT fa, fb, count(*) AS matches FROM (SELECT *, row_number() OVER (PARTITION BY fa, ka, fb ORDER BY s DESC, kb) AS ra, row_number() OVER (PARTITION BY fa, fb, kb ORDER BY s DESC, ka) AS rb FROM p) WHERE ra = 1 AND rb = 1 AND s >= 0.2 GROUP BY fa, fb""")
def mutual_neighbours(spark, d):
    e = _table(spark, d, "embeddings").select(F.col("label").alias("group"), (F.col("vec_id") % 2).alias("side"), F.col("vec_id").alias("kp"), F.col("embedding").alias("vec"))
    side = lambda k: e.where(F.col("side") == k).withColumn("frame", F.col("group") * 2 + k)
    return selection.mutual_matches(side(0), side(1), 0.2)


@_query("SELECT event_id, replace(printf('%.2f', value), '.', ',') AS value FROM events")
def decimal_commas(spark, d):
    return _table(spark, d, "events").select("event_id", tx.decimal_comma(F.col("value")).alias("value"))


@_query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_unlabelled(spark, d):
    return _table(spark, d, "documents").select("doc_id").join(_table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@_query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS topics, CAST(sum(count(*)) OVER (ORDER BY conv_id) - count(*) AS BIGINT) AS before FROM conversations GROUP BY conv_id")
def all_topics(spark, d):
    return segmentation.topics_in_order(_table(spark, d, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("pos"), F.col("role").alias("topic"))).select(F.col("video").alias("conv_id"), F.array_join("topics", ",").alias("topics"), "before")


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text, lang HAVING count(*) > 1")
def equal_segments(spark, d):
    return _table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k"), "lang").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


_FIRST = """, member AS (SELECT cl.*, seg.start FROM cl JOIN seg USING (video_index, segment_index)),
firsts AS (SELECT DISTINCT ON (cluster_id) video_index, segment_index, start FROM member ORDER BY cluster_id, video_index, segment_index),
included AS (SELECT *, row_number() OVER (ORDER BY video_index, segment_index) AS i FROM (SELECT DISTINCT * FROM firsts)),
groups AS (SELECT row_number() OVER (ORDER BY cluster_id) AS i, list({'v': video_index, 'start': start} ORDER BY start, segment_index) AS m FROM member GROUP BY cluster_id),
zipped AS (SELECT i, {'v': video_index, 's': segment_index, 'start': start} AS new, m FROM included JOIN groups USING (i)),
line AS (SELECT 0::BIGINT AS i, []::STRUCT(v BIGINT, s BIGINT, start DOUBLE)[] AS made
UNION ALL SELECT z.i, l.made[:p.at] || [z.new] || l.made[p.at + 1:] FROM line l JOIN zipped z ON z.i = l.i + 1,
  LATERAL (SELECT coalesce(list_position(list_transform(l.made, lambda o: coalesce(list_filter(z.m, lambda x: x.v = o.v)[1].start, z.new.start) > o.start), false) - 1, len(l.made)) AS at) p)
SELECT CAST(pos AS BIGINT) AS pos, x.v AS video_index, x.s AS segment_index FROM (SELECT unnest(made) AS x, unnest(range(len(made))) AS pos FROM line WHERE i = (SELECT max(i) FROM line))"""


@_query(SQL["redundancy_clusters"].rsplit("\nSELECT ", 1)[0] + _FIRST)
def chronological_summary(spark, d):
    made = keeper(spark)(redundancy_clusters(spark, d).join(_segments(spark, d), ["video_index", "segment_index"]), "clusters")
    first = made.groupBy("cluster_id").agg(F.min(F.struct("video_index", "segment_index", "start")).alias("m")).select("m.*").distinct()
    return selection.chronology(first, made)


@_query(f"""WITH {SEG}, ends AS (SELECT video_index AS video, CAST(ceil(min("end")) AS BIGINT) + 20 AS second FROM seg GROUP BY video_index),
pre AS (SELECT video_index, segment_index, second FROM (SELECT seg.*, second, bool_and(round_even("end", 0) <= second + 1) OVER (PARTITION BY video_index ORDER BY segment_index) AS ok FROM seg JOIN ends ON video = video_index) WHERE ok)
SELECT 'Introduction' AS agent, 'discard' AS action, video_index, segment_index FROM pre
UNION ALL SELECT 'Introduction', 'output', video_index, segment_index FROM pre WHERE video_index = (SELECT arg_min(video_index, (second, video_index)) FROM pre)""")
def introduction_log(spark, d):
    seg = _segments(spark, d)
    ends = seg.groupBy(F.col("video_index").alias("video")).agg((F.ceil(F.min("end")).cast("long") + 20).alias("second"))
    return summary.introduction(ends)(seg, spark.createDataFrame([], summary.LOG)).select("agent", "action", "video_index", "segment_index")


def _thinned(seg: DataFrame) -> DataFrame:
    """A log in which the first segments are discarded and the fourth ones put out."""
    gone = lambda k, action: summary.entries(seg.where(F.col("segment_index") == k), k, "any", action)
    return gone(0, "discard").unionByName(gone(3, "output"))


@_query(f"WITH {SEG} SELECT topic, count(DISTINCT (video_index, content, start, \"end\")) AS n, arg_min(video_index, (video_index, segment_index)) AS first_video, arg_min(segment_index, (video_index, segment_index)) AS first_segment FROM seg WHERE topic <> '' AND segment_index NOT IN (0, 3) GROUP BY topic")
def live_topic_clusters(spark, d):
    seg = _segments(spark, d)
    return redundancy.topic_clusters(summary.live(seg, _thinned(seg)), "topic")


@_query(f"WITH {SEG}, rest AS (SELECT * FROM seg WHERE topic <> '' AND segment_index NOT IN (0, 3)), first AS (SELECT topic, min(video_index * 1048576 + segment_index) AS pick_id FROM rest GROUP BY topic) SELECT 'TopicRedundancy' AS agent, 'pick' AS action, CAST(pick_id AS BIGINT) AS pick_id, CAST(video_index AS BIGINT) AS video_index, CAST(segment_index AS BIGINT) AS segment_index FROM rest JOIN first USING (topic)")
def topic_picks(spark, d):
    seg = _segments(spark, d)
    return summary.topic_redundancy()(seg, _thinned(seg)).drop("seq")


@_query(f"WITH {SEG}, a AS (SELECT video_index, segment_index, (length(content) % 2 = 0)::INT + (length(content) % 3 = 0)::INT + (length(content) % 4 = 0)::INT AS yes FROM seg WHERE segment_index NOT IN (0, 3)) SELECT 'QuestionFilter' AS agent, 'include' AS action, CAST(video_index AS BIGINT) AS video_index, CAST(segment_index AS BIGINT) AS segment_index FROM a WHERE yes / 4.0 >= 0.5")
def question_filter_log(spark, d):
    seg = _segments(spark, d)
    asked = seg.select("video_index", "segment_index", F.length("content").alias("n"), F.explode(F.sequence(F.lit(2), F.lit(5))).alias("q"))
    answers = asked.select("video_index", "segment_index", F.when(F.col("q") < 5, F.col("n") % F.col("q") == 0).alias("answer"))
    return summary.question_filter(answers, 4)(seg, _thinned(seg)).drop("seq", "pick_id")


@_query()
def keyframes(spark, d):
    e = _table(spark, d, "embeddings")
    return visual.keyframes(e.select(F.col("label").cast("long").alias("segment"), (F.col("vec_id") % 7).alias("frame"), F.col("vec_id").alias("kp"), F.col("embedding").alias("vec")))


@_query()
def visual_vocabulary(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return visual.visual_vocabulary(e).select("vec_id", "word")


@_query()
def flagship_summary(spark, d):
    seg = _segments(spark, d)
    ends = seg.groupBy(F.col("video_index").alias("video")).agg(F.ceil(F.min("end")).cast("long").alias("second"))
    flags = seg.select("video_index", "segment_index", (F.col("segment_index") == 2).alias("has_object"), F.col("content").contains("a").alias("subjective"))
    words = seg.select("video_index", "segment_index", F.explode(F.split("content", " ")).alias("word"))
    out, _ = summary.summarize(seg, [summary.introduction(ends), summary.subjectivity(flags), summary.content_redundancy(0.3), summary.quality(words), summary.chronology()], keeper(spark))
    return out.select("pos", "video_index", "segment_index")
