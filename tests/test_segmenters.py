"""Transcripts of services, the two segmenters, model services, runs and the command line, without any service."""

import itertools
import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from clipweave import __main__ as cli
from clipweave.functions import text as tx
from clipweave.functions.align import Mismatch, Silence, Word, aligned_words, hosted_transcript, local_transcript, reported_model, transcribed
from clipweave.functions.prompts import Prompts
from clipweave.operators import segmentation, selection
from clipweave.plans import runs
from clipweave.plans.segmenters import ClusterSegmenter, WordSegmenter
from clipweave.sources import datasets, media, models, providers
from clipweave.sources.shared import keeper

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find the tests
token = lambda t, a, b: {"type": "word", "text": t, "start": a, "end": b}
FOUR = [("One", 0.1, 3.0), ("two.", 3.5, 6.0), ("Three", 8.0, 10.0), ("four.", 10.5, 14.0)]


@pytest.mark.parametrize("gaps", list(itertools.product([" ", ", ", ' "', "… ", " (", "-", "。", "?» «"], repeat=2)))
def test_marks_may_belong_to_either_neighbour(gaps):
    """However a gap's marks are shared out between the tokens, the text comes back."""
    lexical = ["Ay", "bé", "cd"]
    text = lexical[0] + gaps[0] + lexical[1] + gaps[1] + lexical[2] + "."
    for cuts in itertools.product(*[range(len("".join(g.split())) + 1) for g in gaps]):
        bare = ["".join(g.split()) for g in gaps]
        tokens = [lexical[0] + bare[0][: cuts[0]], bare[0][cuts[0] :] + lexical[1] + bare[1][: cuts[1]], bare[1][cuts[1] :] + lexical[2]]
        got, words = aligned_words([Word(t, k, k + 1) for k, t in enumerate(tokens)], text)
        assert got == text and "".join(w.text + w.separator_after for w in words[:-1]) + words[-1].text == text
        assert [w.start for w in words] == [0, 1, 2]


def test_separators_stand_by_the_opening_mark():
    words = lambda *t: [Word(x, k, k + 1) for k, x in enumerate(t)]
    assert [(w.text, w.separator_after) for w in aligned_words(words("a", "b"), "a . ( b")[1]][:1] == [("a .", " ")]
    assert [(w.text, w.separator_after) for w in aligned_words(words("a", "b"), "a — b")[1]][0] == ("a —", " ")
    assert [w.separator_after for w in aligned_words(words("你", "好"), "你好")[1]] == ["", " "]
    assert aligned_words(words("a.", "b"), "a b")[0] == "a. b"  # only the words have the mark
    for said, text in ((("a!", "b"), "a? b"), (("ab",), "a"), (("a",), "a b"), (("a", ""), "a")):
        with pytest.raises(Mismatch):
            aligned_words(words(*said), text)
    with pytest.raises(Silence):
        aligned_words([], " ... ")


def test_events_go_after_their_words():
    said = [token("laughs", 0, 1), {"type": "audio_event", "text": "laughs"}, token("on", 1, 2)]
    got = hosted_transcript({"text": "laughs laughs on", "words": said, "language_code": "en"})
    assert got["text"] == "laughs  on" or got["text"].split() == ["laughs", "on"]
    assert [w.text for w in got["words"]] == ["laughs", "on"] and got["language"] == "en"
    with pytest.raises(Mismatch):
        hosted_transcript({"text": "x laughs on", "words": [{"type": "audio_event", "text": "laughs"}, token("on", 1, 2)]})
    for bad in ({"text": 1, "words": said}, {"text": "a", "words": None}, {"text": "a", "words": [token("a", 0, float("nan"))]}, {"text": "a", "words": [token("a", 2, 1)]}, {"text": "a", "words": [token("a", 0, 1)], "language_code": " "}):
        with pytest.raises(Mismatch):
            hosted_transcript(bad)
    assert reported_model({"model": "m"}) == "m" and reported_model({}) is None


def test_local_segments_hold_their_words(spark):
    word = lambda t, a, b: {"text": t, "start": a, "end": b, "confidence": 1}
    response = {"text": " One two. Three four.", "language": "en", "segments": [{"text": " One two.", "start": 0.0, "end": 6.1, "words": [word(*w) for w in FOUR[:2]]}, {"text": " Three four.", "start": 7.9, "end": 14.2, "words": [word(*w) for w in FOUR[2:]]}, {"text": "", "start": 15, "end": 16, "words": []}]}
    got = local_transcript(response)
    assert got["segments"] == [("One two.", 0.0, 6.1, 2), ("Three four.", 7.9, 14.2, 2)] and len(got["words"]) == 4
    late = json.loads(json.dumps(response))
    late["segments"][0]["end"] = 5.0
    with pytest.raises(Mismatch):
        local_transcript(late)
    df = spark.createDataFrame([(1, json.dumps(response)), (2, json.dumps(late)), (3, json.dumps({"text": "", "segments": []})), (4, None), (5, "{")], "video long, response string")
    rows = {r.video: r.t for r in df.select("video", transcribed(F.col("response"), "local").alias("t")).collect()}
    assert [rows[k].error_type for k in range(1, 6)] == [None, "Invalid", "NoSpeech", "Invalid", "Invalid"]
    assert rows[1].segments[1].n_words == 2 and rows[1].words[1].text == "two."


class Rule:
    """Asked in the way of the test's prompts; notes that it was closed."""

    def __init__(self, label=lambda topics, content: 0):
        self.label = label

    def __call__(self, prompt):
        kind, _, rest = prompt.partition("|")
        if kind == "topics":
            most, _, text = rest.partition("|")
            return json.dumps({"topics": [{"id": str(k), "label": f"t{k}"} for k in range(min(2, int(most)))]})
        if kind == "classify":
            topics, _, content = rest.partition("|")
            ids = list(json.loads(topics))
            return json.dumps({ids[self.label(ids, content) % len(ids)]: "other words"})
        if kind == "merge":
            return json.dumps({"items": sorted(set(json.loads(rest)))})
        return rest.upper() if kind == "part" else "whole"

    def close(self):
        pass


PROMPTS = Prompts(subtopics="topics|{most}|{transcript}", classify="classify|{topics}|{content}", merge_topics="merge|{topics}", repair_all="all|{content}", repair_part="part|{content}{transcript}".replace("{transcript}", "") + "{transcript}")


def heard(spark, segments):
    kind = "video long, text string, words array<struct<text:string,start:double,end:double,separator_after:string>>, segments array<struct<text:string,start:double,end:double,n_words:int>>, error_type string"
    return spark.createDataFrame([(7, "One two. Three four.", [(*w, " ") for w in FOUR], segments, None)], kind)


def videos(spark, topics):
    return spark.createDataFrame([(7, "/v/a.mp4", topics, 14.0)], "video long, path string, topics array<string>, seconds double")


def test_word_segmenter(spark):
    differ = lambda ids, content: 0 if "One" in content else 1
    seg = WordSegmenter(lambda: Rule(differ), keeper(spark), least=5, prompts=PROMPTS)
    out = seg.with_global_topics(videos(spark, ["x", "y"]), heard(spark, [])).orderBy("order").collect()
    assert [(r.order, r.start, r.end, r.content, r.video_topic, r.global_topic, r.video_path) for r in out] == [(0, 0.1, 6.0, "One two.", "x", "x", "/v/a.mp4"), (1, 8.0, 14.0, "Three four.", "y", "y", "/v/a.mp4")]
    same = WordSegmenter(lambda: Rule(), keeper(spark), least=5, prompts=PROMPTS)
    rows, topics = same.segments(videos(spark, []), heard(spark, []))
    assert [(r.start, r.end, r.video_topic) for r in rows.collect()] == [(0.1, 14.0, "t0")]
    assert topics.first().topics == {"0": "t0", "1": "t1"}
    given = same.with_global_topics(videos(spark, ["x"]), heard(spark, []), ["g"]).collect()
    assert {r.global_topic for r in given} == {"g"}


@pytest.mark.parametrize("own", [True, False])
def test_cluster_segmenter(spark, own):
    segments = [("One two.", 0.0, 6.1, 2), ("Three four.", 7.9, 14.2, 2)] if own else []
    seg = ClusterSegmenter(lambda: Rule(lambda ids, content: content.count("T")), keeper(spark), least=5, longest=300, prompts=PROMPTS)
    rows = seg.segments(videos(spark, ["x", "y"]), heard(spark, segments))[0].orderBy("order").collect()
    assert [r.content for r in rows] == ["ONE TWO.WHOLE", "THREE FOUR.WHOLE"] or [r.content for r in rows] == ["ONE TWO.WHOLE THREE FOUR.WHOLE"]
    assert (rows[0].start, rows[-1].end) == ((0.0, 14.2) if own else (0.1, 14.0))


def test_no_model_is_asked_about_silence(spark):
    def never():
        raise AssertionError("asked")

    rows = heard(spark, []).withColumn("error_type", F.lit("NoSpeech"))
    for kind in (WordSegmenter, ClusterSegmenter):
        with pytest.raises(providers.NoSpeech):
            kind(never, keeper(spark)).segments(videos(spark, []), rows)


def test_a_model_that_fails_ends_the_run(spark):
    with pytest.raises(providers.ProviderError, match="Invalid"):
        WordSegmenter(lambda: lambda prompt: "no", keeper(spark), most_attempts=1).segments(videos(spark, []), heard(spark, []))


def test_words_keep_their_separators(spark):
    words = spark.createDataFrame([(0, 0, "你", 0.0, 1.0, False, ""), (0, 1, "好。", 1.0, 6.0, True, ""), (0, 2, "ok", 6.0, 7.0, False, " ")], "video long, pos long, text string, start double, end double, ends boolean, separator_after string")
    assert [r.content for r in segmentation.word_segments(words, 5).orderBy("order").collect()] == ["你好。", "ok"]
    assert [r.content for r in segmentation.chunks(words).orderBy("order").collect()] == ["你好。", "ok"]


def test_errors_by_rule():
    e = providers.error_of
    assert [type(e(s)).__name__ for s in (401, 429, 408, 503, 404, None, 418)] == ["Authentication", "RateLimited", "TimedOut", "Unavailable", "Configuration", "Unavailable", "Configuration"]
    assert not e(429, "insufficient_quota").retryable and e(429, "slow").retryable
    assert isinstance(providers.error_from(TimeoutError()), providers.TimedOut) and isinstance(providers.error_from(ConnectionError()), providers.Unavailable)
    assert isinstance(e(None, name="APITimeoutError"), providers.TimedOut)
    tries = []

    def used_up(prompt):
        tries.append(prompt)
        raise e(429, "insufficient_quota")

    assert providers.attempt(used_up, "p", "text", 3, sleep=tries.append)[0] is None and len(tries) == 1
    assert providers.generate_pattern(lambda p: "id 42", "p", r"\d+") == "42"
    assert providers.generate_pattern(lambda p: "none", "p", r"\d+", 2, sleep=lambda s: None) is None


def test_clients_are_closed(spark, tmp_path):
    path = str(tmp_path / "closed")

    class Client:
        def __call__(self, prompt):
            return prompt

        def close(self):
            open(path, "w").close()

    providers.generate(spark.createDataFrame([(1, "a")], "request_id long, prompt string"), Client, "text").collect()
    assert (tmp_path / "closed").exists()


def test_services():
    sent = []

    def send(url, body, headers, timeout):
        sent.append((url, json.loads(body) if body[:1] == b"{" else body, headers))
        return json.dumps({"response": "hi"} if "generate" in url else {"status": "completed", "output": [{"type": "message", "content": [{"type": "output_text", "text": "yo"}]}]}).encode()

    config = providers.ProviderConfig("ollama", "m", "http://h:1/")
    assert models.client(models.LANGUAGE, config, structured=True, images=(b"x",), send=send)("p") == "hi"
    assert sent[0][0] == "http://h:1/api/generate" and sent[0][1]["format"] == "json" and sent[0][1]["images"] == ["eA=="]
    hosted = providers.ProviderConfig("openai", "m", "http://h/v1", "k", effort="low")
    assert models.client(models.LANGUAGE, hosted, kind="topic", topic_ids=("0",), temperature=0.2, send=send)("p") == "yo"
    assert sent[1][1]["reasoning"] == {"effort": "low"} and "temperature" not in sent[1][1] and sent[1][1]["text"]["format"]["strict"] and sent[1][2]["Authorization"] == "Bearer k"
    for status in ({"status": "incomplete", "output": []}, {"status": "completed", "output": [{"type": "message", "content": [{"type": "refusal", "refusal": "no"}]}]}):
        assert models.OpenAI(hosted, send=lambda *a, s=status: json.dumps(s).encode())("p") is None
    with pytest.raises(providers.Configuration):
        models.OpenAI(providers.ProviderConfig("openai", "m", None, "k", effort="huge"))
    with pytest.raises(providers.Authentication):
        models.pair(providers.ProviderConfig("openai", "m"), providers.ProviderConfig("offline", "m"))
    with pytest.raises(providers.Configuration):
        models.service(models.SPEECH, "none such")
    loaded = []
    local = models.LocalSpeech(providers.ProviderConfig("whisper_local", "base", language="pt"), load=lambda name: loaded.append(name) or (lambda path, language: {"text": path + language}))
    assert not loaded and [local("a"), local("b")][1] == {"text": "bpt"} and loaded == ["base"]


def test_hosted_speech_sends_a_form(tmp_path):
    file = tmp_path / "a.wav"
    file.write_bytes(b"sound")
    got = []
    speech = models.HostedSpeech(providers.ProviderConfig("elevenlabs", "m", None, "k", "en"), send=lambda url, body, headers, t: got.append((body, headers)) or b'{"text": "x"}')
    assert speech(str(file)) == {"text": "x"}
    assert b"sound" in got[0][0] and b'name="language_code"\r\n\r\nen' in got[0][0] and got[0][1]["xi-api-key"] == "k"
    with pytest.raises(providers.Authentication):
        models.HostedSpeech(providers.ProviderConfig("elevenlabs", "m")).preflight()


def test_languages_of_speech_models():
    c = lambda x: providers.ProviderConfig("whisper_local", "base", language=x)
    assert models.checked_speech(c(None)).language is None and models.checked_speech(c("PT")).language == "pt"
    assert models.checked_speech(c("por"), {"pt"}, {"por": "pt"}).language == "pt"
    for bad in ("p", "port", "p1", "xx"):
        with pytest.raises(providers.Configuration):
            models.checked_speech(c(bad), {"pt"}, {})
    with pytest.raises(providers.Configuration):
        models.checked_speech(providers.ProviderConfig("whisper_local", " "))


def test_settings_of_a_file():
    assert providers.env_file("# c\nexport A=1\nB = 'x # y'\nC=z # w\nbad line\n=1") == {"A": "1", "B": "x # y", "C": "z"}


def test_media(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100), w.writeframes(b"\0\0" * 250)
    df = spark.createDataFrame([((tmp_path / "a.wav").read_bytes(),), (b"none",), (None,)], "content binary")
    assert [r[0] for r in df.select(media.wav_duration(F.col("content"))).collect()] == [2.5, None, None]
    command = media.audio_command("ffmpeg", "in.mp4", "out.wav")
    assert command[0] == "ffmpeg" and command[-1] == "out.wav" and ["-ar", "16000"] == command[command.index("-ar") :][:2] and "-copyts" in command
    video = tmp_path / "v.mp4"
    video.write_bytes(b"x")
    ran = []
    with media.upload_audio(str(video), 5, run=lambda c, **k: ran.append(c), which=lambda n: "/bin/ffmpeg") as path:
        assert path.endswith("audio.wav") and ran[0][0] == "/bin/ffmpeg"
    with media.upload_audio(str(tmp_path / "a.wav"), 5) as path:
        assert path.endswith("a.wav")
    for bad in (str(tmp_path / "no.mp4"), str(video)):
        with pytest.raises(providers.Configuration):
            with media.upload_audio(bad, 5, which=lambda n: None):
                pass
    seg = spark.createDataFrame([(0, 0, 1.0, 12.0), (0, 1, 3.0, 3.0)], "video_index long, segment_index long, start double, end double")
    fps = spark.createDataFrame([(0, 10.0, 130), (1, 10.0, 0)], "video_index long, fps double, n_frames long")
    assert sorted((r.frame_no, r.t) for r in media.pictures(fps, seg, 5).collect()) == [(50, 5.0), (100, 10.0)]
    clips = spark.createDataFrame([(0, 29.97, 100)], "video_index long, fps double, n_frames long")
    assert [r.frame_no for r in selection.sample_frames(clips, 1).collect()] == [0, 29, 58, 87]
    assert [r.frame_no for r in selection.sample_frames(clips, 1, 1, 2).collect()] == [58]


def test_archives(tmp_path):
    def made(*names):
        with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
            for n in names:
                z.writestr(n, "x")
        return str(tmp_path / "a.zip")

    assert len(media.unpack(made("d/", "d/a.mp4", "d/e/b.mp4"), str(tmp_path / "out"), "d")) == 2
    assert media.unpack(made("d/", "d/a.mp4"), str(tmp_path / "out"), "d") == []
    for bad in ("x/a.mp4", "d/../a.mp4", "/d/a", "d/run.EXE", "d\\..\\..\\a"):
        with pytest.raises(ValueError):
            media.unpack(made("d/ok", bad), str(tmp_path / "out"), "d")
    assert not (tmp_path / "out/d/ok").exists()


def test_detectors_classifiers_and_questions(spark):
    frames = spark.createDataFrame([(0, 1.0, b"face"), (0, 8.0, b"none"), (0, 20.0, None)], "video_index long, t double, picture binary")
    seg = spark.createDataFrame([(0, 0, 0.0, 5.0), (0, 1, 6.0, 30.0)], "video_index long, segment_index long, start double, end double")
    got = selection.contains(frames, seg, lambda p: p == F.lit(b"face")).collect()
    assert {r.segment_index: r.has_object for r in got} == {0: True, 1: False}
    wise = selection.classifier(lambda: lambda texts: [(0.0, 1.0 if "I" in t else -1.0) for t in texts])
    assert [r[0] for r in spark.createDataFrame([("I think",), ("it is",), (None,)], "t string").select(wise("t")).collect()] == [True, False, False]
    ask = lambda prompt, kind: [prompt, kind]
    assert selection.questions(ask, "q: {query}", ["a?"], "x") == {"0": "a?"} and selection.questions(ask, "q: {query}", None, "x") == {"0": "q: x", "1": "string_list"}
    with pytest.raises(ValueError):
        selection.questions(ask, "{query}", [], " ")


def test_logs_paths_and_tables(spark, tmp_path):
    s = {"content": "c", "start": 0.0, "end": 1.0, "order": 0, "video_topic": "", "global_topic": "", "video_path": f"{tmp_path}/v/../a.mp4"}
    state = datasets.set_sources({"output": [s], "discard": [], "include": (), "pick": [[s]], "agent_log": {"A": {"include": [], "discard": [s], "output": [], "pick": [[s], [s, s]]}}}, [{"path": f"{tmp_path}/a.mp4"}])
    with pytest.raises(ValueError):
        datasets.set_sources(state, [])
    datasets.export_log(state, str(tmp_path / "log.json"), str(tmp_path))
    raw = json.loads((tmp_path / "log.json").read_text())
    assert raw[datasets.LOG_KEYS["output"]][0]["video_path"] == "a.mp4"
    back = datasets.load_log(str(tmp_path / "log.json"), str(tmp_path))
    assert back["source"] == [{"path": f"{tmp_path}/a.mp4"}] and back["pick"][0][0]["video_path"] == f"{tmp_path}/a.mp4"
    acts = datasets.log_actions(spark, back)
    assert sorted((r.action, r.pick_id) for r in acts.collect() if r.action == "pick") == [("pick", 0), ("pick", 1), ("pick", 1)] and acts.count() == 4
    (tmp_path / "bad.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        datasets.load_log(str(tmp_path / "bad.json"))
    paths = spark.createDataFrame([("/root/../x",), ("/root/a/./b",), ("/root",), ("/../root/c",), ("/rootx/a",), ("a//b/../c",)], "p string")
    assert [r[0] for r in paths.select(tx.relative(F.col("p"), "/root")).collect()] == ["/x", "a/b", "/root", "c", "/rootx/a", "a/c"]
    assert datasets.rewritten({"path": "", "x": {"video_path": "p"}, "y": {"path": 1}, "z": {"path"}}, str.upper) == {"path": "", "x": {"video_path": "P"}, "y": {"path": 1}, "z": ["path"]}
    rows = spark.createDataFrame([(1, 1.5, "é"), (2, 2.0, "b")], "id long, v double, t string")
    datasets.write_decimal_commas(rows, str(tmp_path / "csv"), "v")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part-*"))).decode("latin-1")
    assert "1;1,50;é" in text
    assert sorted(r.t for r in datasets.read_labelled(spark.newSession(), str(tmp_path / "csv"), "id long, v string, t string", header=True).collect())[0] == "b"
    a = [r.id for r in datasets.shuffled(spark.range(50).repartition(7), "id").collect()]
    assert a == [r.id for r in datasets.shuffled(spark.range(50), "id").collect()] and sorted(a) == list(range(50)) != a
    for name in ("x/one.json", "x/y/two.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps([{"name": name, "path": "p", "topics": [], "segments": []}]))
    every = datasets.read_all_videos(spark, str(tmp_path / "x"))
    assert every.count() == 2
    assert datasets.invalid_videos(every.withColumn("segments", F.expr("array(named_struct('content','c','start',0D,'end',1D,'order',0L,'video_topic','','global_topic','','video_path','p'))")), spark.createDataFrame([("q",)], "path string")).count() == 2
    assert [r[0] for r in spark.createDataFrame([("a.",), ("a!\n",), ("a. ",), ("",), (None,)], "t string").select(tx.closes(F.col("t"))).collect()] == [True, True, False, False, False]


def test_runs_and_command_line(spark, tmp_path, capsys, monkeypatch):
    with pytest.raises(KeyError), runs.recorded("in", str(tmp_path / "o/out.json")) as r:
        r.input_video_count = 3
        raise KeyError("secret text")
    got = json.loads((tmp_path / "o/out_run.json").read_text())
    assert (got["schema_version"], got["status"], got["error_type"], got["input_video_count"]) == (1, "failed", "KeyError", 3) and "secret" not in json.dumps(got)
    assert "hidden" not in json.dumps(runs.shown(providers.ProviderConfig("a", "m", api_key="hidden")))
    assert cli.main(["doctor"]) == 0 and '"ffmpeg_on_path"' in capsys.readouterr().out
    assert cli.main(["doctor", "--need", str(tmp_path / "none")]) == 1
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/a.mp4", "x")
    assert cli.main(["prepare", str(tmp_path / "a.zip"), str(tmp_path), "--folder", "d"]) == 0
    log = runs.logger(str(tmp_path / "app.log"), "t")
    log.info("said")
    assert runs.logger(str(tmp_path / "app.log"), "t") is log and "said" in (tmp_path / "app.log").read_text()
    hear = {"text": "One two. Three four.", "words": [token(*w) for w in FOUR]}
    monkeypatch.setitem(models.SPEECH, "offline", models.Service(lambda config, **_: models.Offline(rule=lambda path: hear), "none"))
    monkeypatch.setitem(models.LANGUAGE, "offline", models.Service(lambda config, **_: Rule(), "none"))
    monkeypatch.setattr(cli, "session", lambda threads: spark)
    real = cli.WordSegmenter
    monkeypatch.setattr(cli, "WordSegmenter", lambda *a, **k: real(*a, prompts=PROMPTS, **k))
    out = str(tmp_path / "seg.json")
    monkeypatch.chdir(tmp_path)
    assert cli.main(["segment", str(tmp_path / "d"), out]) == 0
    made = json.loads((tmp_path / "seg.json").read_text())
    assert made[0]["name"] == "a" and made[0]["path"] == "d/a.mp4" and [s["content"] for s in made[0]["segments"]] == ["One two. Three four."]
    assert json.loads((tmp_path / "seg_run.json").read_text())["status"] == "completed"
    (tmp_path / "empty").mkdir()
    assert cli.main(["segment", str(tmp_path / "empty"), out]) == 1
    assert cli.main(["segment", str(tmp_path / "d"), out, "--llm-provider", "nobody"]) == 1
    for name, schema in (("ends", "video long, second long"), ("flags", "video_index long, segment_index long, has_object boolean, subjective boolean"), ("words", "video_index long, segment_index long, word string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "f" / name))
    assert cli.main(["summarize", out, str(tmp_path / "clips"), "--features", str(tmp_path / "f")]) == 1  # nothing repeats, so nothing is chosen
