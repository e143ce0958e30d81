"""From recordings to labelled turns, with models that are plain functions."""

import json

import test_files

from pyspark.sql import functions as F

from turnloom.operators import inference
from turnloom.plans import files, stages
from turnloom.sources import readers


def test_full_chain(spark, tmp_path):
    for name in ("in/one take.wav", "in/two.mov", "in/bad.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    out = str(tmp_path / "out")

    def diarizer():
        return lambda path, speakers: [(0.0, 5.0, "A"), (5.0, 2.0, "B"), (7.0, 1.0, "A"), (8.0, 4.0, "A")][: speakers * 2]

    def failing():
        def model(path, speakers):
            raise RuntimeError

        return model

    def extractor():
        def extract(path):
            if "bad" in path:
                raise OSError
            return path.rsplit(".", 1)[0] + ".wav"

        return extract

    def make():
        return lambda frame: [[f"said {a}", "more."] for a in frame["start_ms"]]

    stages.process_media(spark, str(tmp_path / "in"), out, diarizer=diarizer, recogniser=make, extractor=extractor, both_speakers=True)
    lines = readers.read_rttm(spark, out).collect()
    assert sorted({r.uri for r in lines}) == ["one_take", "two"] and len(lines) == 8
    at = tmp_path / "out"
    assert sorted(str(p.relative_to(at)) for p in at.rglob("*.*")) == ["one_take/one_take.rttm", "one_take/results_one_take.json", "two/results_two.json", "two/two.rttm"]
    results = json.loads((at / "two/results_two.json").read_text())
    assert [(t["text"], t["start"], t["end"], t["speaker_id"]) for t in results] == [
        ("said 0", 0, 5000, "client"), ("more.", 0, 5000, "client"), ("said 5000", 5000, 7000, "therapist"), ("more.", 5000, 7000, "therapist"),
        ("said 8000", 8000, 12000, "client"), ("more.", 8000, 12000, "client"),
    ]
    stages.process_media(spark, str(tmp_path / "in"), out, diarizer=failing, recogniser=make, extractor=extractor, skip_existing=True)
    assert len(list(at.rglob("*.json"))) == 2
    stages.translate(spark, out, f"{out}/translated")
    turns = json.loads((at / "translated/two/translate_two.json").read_text())
    assert [(t["turn_index"], t["speaker_id"], t["original_turn_indices"]) for t in turns] == [(0, "client", [0, 1]), (1, "therapist", [2, 3]), (2, "client", [4, 5])]


def test_from_recordings_to_a_result_table(spark, tmp_path):
    """Media, turns, labels, catalog and frames to the result table; a bad file and a patient with two interviews on the way."""
    (tmp_path / "in").mkdir()
    interviews = []
    for p in range(5):
        (tmp_path / f"in/P{p}_bindung.wav").write_text("x")
    test_files.frames(tmp_path, 5)
    for p in (0, 1, 2, 3, 4, 0):
        pair = {"patient_openface": f"frames/patient{p}.csv", "therapist_openface": f"frames/therapist{p}.csv"}
        interviews.append({"therapist": {"therapist_id": f"t{p % 2}"}, "patient": {"patient_id": f"P{p}"}, "types": {"bindung": {"transcript": "x", **pair}}})
    interviews[5]["types"]["bindung"]["patient_openface"] = "frames/patient1.csv"
    (tmp_path / "model.json").write_text(json.dumps({"interviews": interviews}))
    out = str(tmp_path / "out")

    def diarizer():
        return lambda path, speakers: [(k * 13.0, 13.0, "A" if k % 3 else "B") for k in range(6)]

    def make():
        return lambda frame: [["word " * (1 + a // 13000 % 4)] for a in frame["start_ms"]]

    stages.process_media(spark, str(tmp_path / "in"), out, diarizer=diarizer, recogniser=make, extractor=lambda: str, both_speakers=True)
    (tmp_path / "out/P4_bindung/results_P4_bindung.json").write_text("{}")  # no list: this one has no turns from here on
    stages.translate(spark, out, str(tmp_path / "translated"))
    (tmp_path / "translated/translate_P9_bindung.json").write_text("[")
    status = stages.label(spark, str(tmp_path / "translated"), str(tmp_path / "labelled"), inference.length_scorer)
    assert {r.file.split("_")[1]: r.status for r in status.collect()} == {**{f"P{p}": "done" for p in range(4)}, "P9": "failed"}
    assert stages.label(spark, str(tmp_path / "translated"), str(tmp_path / "labelled"), inference.length_scorer, overwrite=False).where("status = 'skipped'").count() == 4
    (tmp_path / "labelled/translate_P4_bindung_sentiment.json").write_text("nothing")
    stages.summarize(spark, str(tmp_path / "labelled"))
    told = (tmp_path / "labelled/sentiment_label_summary.txt").read_text()
    assert told.count("translate_P") == 5 and "TOTAL" in told
    got = files.load(spark, str(tmp_path / "model.json"), str(tmp_path / "labelled"), str(tmp_path))
    assert {r.job: r.reason for r in got.jobs.collect()} == {**{str(k): None for k in (0, 1, 2, 3, 5)}, "4": "exception:JSONDecodeError:not a JSON document"}
    result = files.smile(spark, str(tmp_path / "model.json"), str(tmp_path / "labelled"), str(tmp_path), str(tmp_path / "results"))
    assert {(r.n_patients, r.n_therapists) for r in result.collect()} == {(4, 2)}


def test_sound_goes_from_store_to_store(spark, tmp_path):
    """A stand-in for the program: it fails for one recording, and copies the others in capitals."""
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nin="$5"\nfor out; do :; done\ngrep -q broken "$in" && exit 1\ntr a-z A-Z < "$in" > "$out"\n')
    tool.chmod(0o755)
    (tmp_path / "in").mkdir()
    for name, text in (("a b.mov", "first"), ("c.mp4", "broken"), ("d.wav", "as it is")):
        (tmp_path / "in" / name).write_text(text)
    media = readers.discover_media(spark, str(tmp_path / "in"))
    for folder in (f"{tmp_path}/one", f"file://{tmp_path}/two"):
        rows = inference.extract_audio(media, inference.with_ffmpeg(folder, program=str(tool))).collect()
        got = {r.path.rsplit("/", 1)[1]: r.audio for r in rows}
        assert got["a b.mov"] == f"{folder}/a b.wav" and got["c.mp4"] is None and got["d.wav"].endswith("in/d.wav")
        place = tmp_path / folder.rsplit("/", 1)[1]
        assert [p.name for p in place.iterdir()] == ["a b.wav"] and (place / "a b.wav").read_text() == "FIRST"


def test_unknown_stage(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError, match="unknown stage"):
        stages.process_media(spark, str(tmp_path), str(tmp_path), "both")


class Server:
    """A chat server that fails every third call and counts the distinct requests that it answers."""

    def __enter__(self):
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        seen = self.seen = {"calls": 0, "answered": []}

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                seen["calls"] += 1
                if seen["calls"] % 3 == 0:
                    self.send_error(503)
                    return
                asked = body["messages"][-1]["content"]
                assert len(body["messages"]) == 18 and body["max_tokens"] == 12
                seen["answered"].append(asked)
                answer = json.dumps({"choices": [{"message": {"content": " Positive." if "good" in asked.rsplit("Speech turn:", 1)[-1] else "Negative"}}]}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(answer)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}/v1"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *args):
        self.http.shutdown()


def test_requests_are_asked_once_tried_again_and_kept(spark, tmp_path):
    rows = [(f, k, who, text) for f in ("a", "b") for k, (who, text) in enumerate([("client", "good day"), ("therapist", "yes"), ("client", "bad day"), ("client", " ")])]
    turns = spark.createDataFrame([*rows, ("c", 0, "client", "good luck")], "file string, idx int, speaker string, text string")
    store = str(tmp_path / "answers")
    with Server() as server:
        make = inference.chat_client(server.url, timeout=10)
        done = inference.label_turns_by_requests(turns, make, store, wait=0.01, tries=6).collect()
        assert {(r.file, r.idx): r.sentiment_label for r in done if r.sentiment_label} == {("a", 0): "positive", ("a", 2): "negative", ("b", 0): "positive", ("b", 2): "negative", ("c", 0): "positive"}
        assert len(server.seen["answered"]) == len(set(server.seen["answered"])) == 3  # both files ask the same
        inference.label_turns_by_requests(turns, make, store).collect()
        assert len(server.seen["answered"]) == 3
    gone = inference.label_turns_by_requests(turns.withColumn("text", F.concat("text", F.lit("!"))).where("file = 'c'"), make, store, tries=2, wait=0.01).collect()
    assert [r.sentiment_label for r in gone] == ["other"]  # no server, no answer; nothing is kept of it
    assert spark.read.parquet(store).count() == 3


def test_programs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/results_P1_bindung.json").write_text(json.dumps([{"text": "good day", "start": 0, "end": 900, "speaker_id": "client"}, {"text": "yes", "start": 900, "end": 1000, "speaker_id": "therapist"}]))
    (tmp_path / "model.json").write_text(json.dumps({"interviews": [{"patient": {"patient_id": "P1"}, "types": {"bindung": {}}}]}))
    files.main(["translate", "--input-dir", str(tmp_path / "in"), "--translator", "turnloom.operators.inference:identity"])
    assert (tmp_path / "in/translate_P1_bindung.json").exists()
    with Server() as server:
        files.main(["label", "--input-dir", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--data-model", str(tmp_path / "model.json"), "--server-url", server.url, "--strict-patient-match"])
    turns = json.loads((tmp_path / "out/translate_P1_bindung_sentiment.json").read_text())
    assert [t.get("sentiment_label") for t in turns] == ["positive", None] and "positive" in (tmp_path / "out/sentiment_label_summary.txt").read_text()
