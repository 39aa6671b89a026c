"""Folds, decisions and text rules on hand-made rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clipweave.functions import text as tx
from clipweave.functions.interpret import Invalid, interpret
from clipweave.operators import evaluate, redundancy, segmentation, selection, state


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


WORDS = "video long, pos long, text string, start double, end double, ends boolean"


def test_word_segments_close_at_sentence_ends(spark):
    words = spark.createDataFrame([(0, 0, "a", 0.1, 3.0, False), (0, 1, "b.", 3.5, 6.0, True), (0, 2, "c", 8.0, 10.0, False), (0, 3, "d.", 10.5, 14.0, True), (1, 0, "x", 0.0, 1.0, False)], WORDS)
    assert rows(segmentation.word_segments(words, 5), "video", "order", "content", "start", "end") == [(0, 0, "a b.", 0.1, 6.0), (0, 1, "c d.", 8.0, 14.0), (1, 0, "x", 0.0, 1.0)]


def test_merge_and_fuse_differ(spark):
    s = spark.createDataFrame([(0, 0, "t", 0.0, 4.0, "a"), (0, 1, "t", 10.0, 14.0, "b"), (0, 2, "u", 14.0, 15.0, "c")], "video long, pos long, topic string, start double, end double, content string")
    assert len(segmentation.merge_topics(s, 10.0).collect()) == 3  # 14 s in all
    assert len(segmentation.fuse(s, 10.0).collect()) == 2  # 8 s of speech
    assert len(segmentation.fuse(s, None).collect()) == 3
    assert [r.content for r in segmentation.merge_topics(s).orderBy("order").collect()] == ["a b", "c"]


def test_overlapping_clusters_seed_the_next(spark):
    s = spark.createDataFrame([(0, k, "w.", 3.0 * k + k, 3.0 * k + k + 3.0, True) for k in range(6)], WORDS)
    out = rows(segmentation.overlapping(s, 10.0), "cluster_id", "order")
    assert [o for c, o in out if c == 0] == [0, 1, 2]
    assert [o for c, o in out if c == 1][0] in (1, 2)
    assert {o for _, o in out} == set(range(6))


def test_prefix_stops_at_the_first_late_segment(spark):
    s = spark.createDataFrame([(0, 0, 2.5), (0, 1, 4.0), (0, 2, 2.0)], "video_index long, segment_index long, end double")
    assert rows(segmentation.until(s, F.lit(1)), "segment_index") == [(0,)]  # 2.5 rounds to 2


def test_state_folds_the_log(spark):
    log = spark.createDataFrame([(1, "a", "include"), (2, "a", "discard"), (1, "b", "output"), (2, "b", "discard"), (3, "c", "discard"), (4, "c", "output"), (5, "c", "include"), (6, "d", "pick")], "seq long, segment string, action string")
    assert rows(state.fold(log, "segment"), "segment", "included", "discarded", "outputted") == [("a", False, True, False), ("b", False, False, True), ("c", True, False, True)]


def test_finalize_moves_included_only_without_output(spark):
    kind = "segment string, included boolean, discarded boolean, outputted boolean"
    assert rows(state.finalize(spark.createDataFrame([("a", True, False, False), ("b", False, True, False)], kind)), "segment") == [("a",)]
    assert rows(state.finalize(spark.createDataFrame([("a", True, False, False), ("b", False, False, True)], kind)), "segment") == [("b",)]


def test_clusters_fold_overwrites_only_the_known(spark):
    pairs = spark.createDataFrame([(0, 9, 2, 11, 0.35), (1, 0, 2, 11, 0.28), (0, 3, 1, 4, 0.49)], "v1 long, s1 long, v2 long, s2 long, value double")
    got = rows(redundancy.clusters(pairs), "cluster_id", "video_index", "segment_index")
    assert got == [(0, 0, 3), (0, 1, 4), (1, 0, 9), (1, 2, 11), (2, 1, 0), (2, 2, 11)]


def test_pairs_equal_brute_force(spark):
    texts = ["alpha beta gamma", "alpha beta delta", "the the alpha", "beta gamma alpha", "zeta", ""]
    seg = spark.createDataFrame([(k % 3, k // 3, t) for k, t in enumerate(texts)], "video_index long, segment_index long, content string")
    got = rows(redundancy.similar_pairs(redundancy.tfidf(seg), 0.2), "v1", "s1", "v2", "s2", "value")
    tf = [Counter(t.split()) for t in texts]
    df = Counter(w for c in tf for w in c)
    vec = [{w: n * (math.log(len(texts) / df[w]) + 1) for w, n in c.items()} for c in tf]
    unit = [{w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for v in vec]
    want = []
    for i in range(6):
        for j in range(6):
            s = round(sum(x * unit[j].get(w, 0) for w, x in unit[i].items()), 9)
            if i % 3 < j % 3 and s > 0.2:
                want.append((i % 3, i // 3, j % 3, j // 3, s))
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want)]
    assert all(abs(a[4] - b[4]) < 1e-8 for a, b in zip(got, sorted(want)))


def test_report_handles_classes_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    got = {r.name: (r.precision, r.recall, r.support) for r in evaluate.classification_report(df, "y", "p").collect()}
    assert got["b"] == (0.0, 0.0, 1) and got["a"] == (0.5, 1.0, 1) and got["accuracy"][0] == 0.5


def test_chronology_keeps_to_the_shorter_side(spark):
    kind = "video_index long, segment_index long, start double"
    inc = spark.createDataFrame([(0, 0, 5.0), (1, 0, 1.0), (2, 0, 9.0)], kind)
    cl = spark.createDataFrame([(0, 0, 0, 5.0), (1, 0, 1, 7.0)], "cluster_id long, " + kind)
    assert [(r.video_index) for r in selection.chronology(inc, cl).orderBy("pos").collect()] == [0, 1]


@pytest.mark.parametrize(("text", "ends"), [("Yes.", True), ('He said "no."', True), ("so。」", True), ("no", False), ("", False), (None, False), ("v1.2 ok", False), ("end. ", True)])
def test_sentence_end(spark, text, ends):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.sentence_end(F.col("t"))).first()[0] is ends


def test_text_rules(spark):
    df = spark.createDataFrame([(" Hi  there , you ( now ) ! ", 93784.5)], "t string, s double")
    assert df.select(tx.collapsed(F.col("t")), tx.clock(F.col("s")), tx.clock(F.lit(59.0))).first()[:] == ("Hi there, you (now)!", "1 day, 2:03:04.500000", "0:00:59")


@pytest.mark.parametrize("bad", [("", "text", {}), ('{"a": 1, "a": 2}', "topics", {}), ('{"9": "x"}', "topic", {"topic_ids": ["0"]}), ("[]", "string_list", {}), ('{"q": 1}', "answers", {"answer_ids": ["q"]}), ("{'a': 'x', 'a': 'y'}", "topics", {}), ("nope", "pattern", {"pattern": "x+"}),
    ("{1: 'a', True: 'b'}", "topics", {}), ("{u'a': 'x', 'a': 'y'}", "topics", {}), ("{[1]: 'a'}", "topics", {}), ("{**{}}", "topics", {}), ("f()", "topics", {}), ('{"topics": [{"id": 0, "label": "a"}]}', "topics", {}), ('{"topics": [{"id": "0", "label": "a", "more": 1}]}', "topics", {}),
    ('{" ": "a"}', "topics", {}), ('{"a": " "}', "topics", {}), ('{"a": "x", "b": "y"}', "topics", {"max_items": 1}), ('{"answers": [{"id": "q", "answer": true}, {"id": "q", "answer": null}]}', "answers", {"answer_ids": ["q"]}), ('{"q": true, "r": false}', "answers", {"answer_ids": ["q", "r"], "max_items": 1}),
    ('{"items": ["x"], "more": 1}', "string_list", {}), ('("x",)', "string_list", {}), ('{"0": "a", "1": "b"}', "topic", {"topic_ids": ["0", "1"]}), ("[" * 100_000, "topics", {})])
def test_answers_rejected(bad):
    text, kind, spec = bad
    with pytest.raises(Invalid):
        interpret(text, kind, **spec)


def test_answers_read():
    assert interpret('```json\n{"topics": [{"id": "0", "label": " a "}]}\n```', "topics") == {"0": " a "}
    assert interpret('{"topics": [{"id": "0", "label": "a"}], "note": 1}', "topics", max_items=1) == {"0": "a"}
    assert interpret("{'7': 'x'}", "topic", topic_ids=["7", "8"]) == {"7": "x"} == interpret('{"id": "7", "label": "x"}', "topic", topic_ids=["7"])
    assert interpret("{'q': None, 'r': True}", "answers", answer_ids=["q", "r"]) == {"q": None, "r": True}
    assert interpret('{"items": ["x"]}', "string_list") == ["x"]
    assert interpret("ab12cd", "pattern", pattern=r"\d+") == "12"


def test_requests_that_no_answer_can_meet(spark):
    from clipweave.functions.interpret import BadRequest, interpreted

    for kind, spec in (("pattern", {}), ("pattern", {"pattern": "("}), ("poem", {})):
        with pytest.raises(BadRequest):
            interpret("x", kind, **spec)
        with pytest.raises(BadRequest):
            interpreted(F.lit("x"), kind, **spec)


def test_keyframes_need_new_matches(spark):
    from clipweave.operators.visual import keyframes

    vec = {0: [1.0, 0.0], 1: [0.0, 1.0]}
    rows = [(0, f, 0, vec[v]) for f, v in enumerate([0, 0, 0, 1, 1])]
    assert rows_of(keyframes(spark.createDataFrame(rows, "segment long, frame long, kp long, vec array<double>"))) == [1, 3]


def rows_of(df):
    return sorted(r.frame for r in df.collect())


def test_summary_puts_out_the_shortest_introduction_and_winners(spark):
    from clipweave.plans import summary

    texts = ["hello there", "big storm hits the coast today", "filler words only", "welcome to the news", "big storm hits coast today", "other matter"]
    seg = spark.createDataFrame([(k // 3, k % 3, t, 10.0 * (k % 3), 10.0 * (k % 3) + 9) for k, t in enumerate(texts)], "video_index long, segment_index long, content string, start double, end double")
    ends = spark.createDataFrame([(0, 9), (1, 12)], "video long, second long")
    words = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (1, 1, "b")], "video_index long, segment_index long, word string")
    out, log = summary.summarize(seg, [summary.introduction(ends), summary.content_redundancy(0.3), summary.quality(words), summary.chronology()])
    assert [(r.video_index, r.segment_index) for r in out.orderBy("pos").collect()] == [(0, 0), (1, 1)]
    assert {r.agent for r in log.select("agent").distinct().collect()} == {"Introduction", "ContentRedundancy", "Quality", "Chronology"}


def test_summary_by_topic_and_by_questions(spark):
    from clipweave.plans import summary

    rows = [(0, 0, "a", 0.0, 9.0), (0, 1, None, 10.0, 19.0), (0, 2, "b", 20.0, 29.0), (1, 0, "b", 0.0, 9.0), (1, 1, "a", 10.0, 19.0), (1, 2, "", 20.0, 29.0)]
    seg = spark.createDataFrame([(v, s, t, t, a, b) for v, s, t, a, b in rows], "video_index long, segment_index long, content string, topic string, start double, end double")
    words = spark.createDataFrame([(0, 0, "x"), (1, 1, "x"), (1, 1, "y"), (0, 2, "x"), (0, 2, "z"), (1, 0, "x")], "video_index long, segment_index long, word string")
    source = "TopicRedundancy"
    out, log = summary.summarize(seg, [summary.topic_redundancy(), summary.quality(words, source), summary.chronology(source)])
    picks = {(r.pick_id, r.video_index, r.segment_index) for r in log.where("action = 'pick'").collect()}
    assert picks == {(0, 0, 0), (0, 1, 1), (2, 0, 2), (2, 1, 0)}  # a topic's first place; null and empty topics are none
    assert {(r.video_index, r.segment_index) for r in out.collect()} == {(1, 1), (0, 2)}
    kept, log = summary.summarize(seg, [summary.topic_redundancy(), summary.quality(words, source), summary.chronology(source, action="include")])
    assert log.where("action = 'output'").isEmpty() and kept.count() == 2
    answers = spark.createDataFrame([(0, 0, True), (0, 0, None), (0, 1, False), (0, 1, True), (0, 1, True), (1, 0, None)], "video_index long, segment_index long, answer boolean")
    first = lambda segments, log: summary.entries(segments.where("video_index = 0 AND segment_index = 0"), 1, "First", "discard")
    out, _ = summary.summarize(seg, [summary.question_filter(answers, 2)])
    assert {(r.video_index, r.segment_index) for r in out.collect()} == {(0, 0), (0, 1)}
    out, _ = summary.summarize(seg, [first, summary.question_filter(answers, 2)])
    assert {(r.video_index, r.segment_index) for r in out.collect()} == {(0, 1)}


def test_introductions_after_skipped_seconds(spark):
    from clipweave.operators.selection import intro_end

    a, b = [1.0, 0.0], [0.0, 1.0]
    frames = spark.createDataFrame([("v", k, h) for k, h in enumerate([a, b, b, b, a, a])] + [("w", k, a) for k in range(2)], "video string, frame_no long, hist array<double>")
    got = lambda **more: {r.video: r.second for r in intro_end(frames, **more).collect()}
    assert got() == {"v": 0, "w": 0}
    assert got(skip=1) == {"v": 2}  # counted from the skip; one frame left is no comparison
    assert got(fps=2, skip=1) == {"v": 1}
