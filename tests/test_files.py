"""The analyses from small files to their tables."""

import json
import math

import numpy as np

from turnloom.plans import analyses, files


def frames(folder, people):
    """Frame tables of so many patients and their therapists."""
    rng = np.random.default_rng(0)
    (folder / "frames").mkdir()
    for p in range(people):
        for who in ("patient", "therapist"):
            t = np.arange(0, 80, 0.1)
            wave = np.sin(t / 3 + (who == "therapist") * 0.5 + p) + rng.normal(size=len(t)) * 0.2
            lines = [" timestamp, confidence, AU06_r, AU12_r, AU06_c, AU12_c"] + [f"{a:.2f}, {0.9 if i % 50 else 0.1}, {max(w, 0):.4f}, {max(w, 0):.4f}, {int(w > 0)}, {int(w > 0)}" for i, (a, w) in enumerate(zip(t, wave, strict=True))]
            (folder / f"frames/{who}{p}.csv").write_text("\n".join(lines) + "\n")


def build(folder, patients=6):
    interviews = []
    (folder / "labelled").mkdir()
    frames(folder, patients + 2)
    (folder / f"frames/patient{patients}.csv").unlink()  # this one's table is missing
    for p in range(patients + 2):
        names = {f"{who}_openface": f"frames/{who}{p}.csv" for who in ("patient", "therapist")}
        interviews.append({"therapist": {"therapist_id": f"t{p % 3}"}, "patient": {"patient_id": f"p{p}"}, "types": {"bindung": {"transcript": "x" if p != patients + 1 else None, **names}}})
        turns = [{"turn_index": k, "text": "a", "start_ms": k * 13000, "end_ms": k * 13000 + 13000, "speaker_id": "p", "original_turn_indices": [k], "sentiment_label": ("positive", "neutral", "negative")[(k + p) % 3]} for k in range(6)]
        (folder / f"labelled/translate_P{p}_bindung_sentiment.json").write_text(json.dumps([*turns, {"turn_index": 6, "text": "no label"}]))
    (folder / "model.json").write_text(json.dumps({"interviews": interviews}))


def test_from_files_to_result_tables(spark, tmp_path):
    build(tmp_path)
    where = (str(tmp_path / "model.json"), str(tmp_path / "labelled"), str(tmp_path))
    got = files.load(spark, *where)
    turns, frames = got.turns, got.frames
    assert {r.patient_id: r.reason for r in got.jobs.collect()} == {f"p{p}": "missing_paths" if p == 6 else None for p in range(7)}
    assert {r.status: r.n for r in got.catalog.collect()} == {"job": 7, "transcript_null": 1, "orphaned": 0}
    assert turns.count() == 36 and frames.count() == 12 * 800 and frames.where("intensity is null").count() == 12 * 16
    out = str(tmp_path / "out")
    smile = files.smile(spark, *where, out, least=1).collect()
    assert len(smile) == 4 and all(r.n_turns == 36 and r.n_patients == 6 and r.n_therapists == 3 and 0 <= r.lr_pval <= 1 for r in smile)
    assert spark.read.option("header", True).csv(f"{out}/smile_by_sentiment").columns == list(analyses.SMILE_RESULT)
    assert spark.read.option("header", True).csv(f"{out}/turns").count() == 36
    sync = files.synchrony(spark, *where, out)
    assert sync.count() == 36 and all(r.n_frames >= 380 and abs(r.cc_r_peak) > 0.5 and r.simul_smile_freq > 0 for r in sync.collect())
    told = files.synchrony_models(spark, f"{out}/synchrony_turns", out).collect()
    assert [r.measure for r in told] == ["simul_smile", "simul_smile_any", "duchenne_smile"]
    assert told[0].n_obs == 24 and told[0].lrt_stat >= 0 and math.isfinite(told[2].estimate) and told[2].wcb_n_clusters == 3
    assert spark.read.option("header", True).csv(f"{out}/synchrony_by_sentiment").columns == list(analyses.SYNC_RESULT)


def test_bad_files_end_their_own_interview_and_interviews_stay_apart(spark, tmp_path):
    build(tmp_path, 7)
    model = json.loads((tmp_path / "model.json").read_text())
    (tmp_path / "labelled/translate_P0_bindung_sentiment.json").write_text('[{"turn_index": 1, ')
    (tmp_path / "labelled/translate_P1_bindung_sentiment.json").write_text('{"turns": []}')
    (tmp_path / "labelled/translate_P2_bindung_sentiment.json").write_text("[3, null, {}]")
    (tmp_path / "frames/patient3.csv").write_text("frame, AU06_r\n1, 2\n")
    (tmp_path / "frames/therapist4.csv").write_text("timestamp, AU06_r\n1, 2\n2, 3, 4\n")
    (tmp_path / "frames/therapist5.csv").write_text("")
    again = json.loads(json.dumps(model["interviews"][6]))  # another interview of p6, with other recordings
    again["types"]["bindung"] |= {"patient_openface": "frames/therapist0.csv", "therapist_openface": str(tmp_path / "frames/therapist1.csv")}
    alone = {**model, "interviews": list(model["interviews"])}
    model["interviews"].append(again)
    (tmp_path / "model.json").write_text(json.dumps(model))
    (tmp_path / "alone.json").write_text(json.dumps(alone))
    got = files.load(spark, str(tmp_path / "model.json"), str(tmp_path / "labelled"), str(tmp_path))
    assert {r.job: r.reason for r in got.jobs.collect()} == {
        "0": "exception:JSONDecodeError:not a JSON document", "1": "exception:TypeError:not a JSON list", "2": "no_labeled_turns",
        "3": "exception:KeyError:'timestamp'", "4": "exception:ParserError:expected 2 fields, saw 3", "5": "exception:EmptyDataError:no lines",
        "6": None, "7": "missing_paths", "9": None,
    }
    out = str(tmp_path / "out")
    files.smile(spark, str(tmp_path / "model.json"), str(tmp_path / "labelled"), str(tmp_path), out)
    files.smile(spark, str(tmp_path / "alone.json"), str(tmp_path / "labelled"), str(tmp_path), str(tmp_path / "alone"))

    def means(folder):
        return {(r.turn_index, r.client_smile_intensity) for r in spark.read.option("header", True).csv(f"{folder}/turns").where("patient_id = 'p6'").collect()}

    assert len(means(out)) == 12 and len(means(tmp_path / "alone")) == 6 and means(tmp_path / "alone") < means(out)
    reasons = {r.reason: r.n for r in spark.read.option("header", True).csv(f"{out}/failures").collect()}
    assert reasons["no_labeled_turns"] == "1" and len(reasons) == 7
    assert spark.read.option("header", True).csv(f"{out}/catalog_counts").count() == 3
    assert files.synchrony(spark, str(tmp_path / "model.json"), str(tmp_path / "labelled"), str(tmp_path), out).select("participant_id").distinct().collect() == [("p6",)]


def test_program(spark, tmp_path):
    build(tmp_path, 4)
    files.main(["smile", "--data-model", str(tmp_path / "model.json"), "--labelled-dir", str(tmp_path / "labelled"), "--root", str(tmp_path), "--output-dir", str(tmp_path / "out"), "--permutations", "5"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out/smile_by_sentiment")).collect()
    assert [r.q_source for r in rows] == ["perm"] * 4
