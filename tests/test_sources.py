import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from verseloom.operators import gate as G
from verseloom.sources import archive, files, ini, reports
from verseloom.streaming import phrases


def test_archives_are_written_and_read(spark, tmp_path):
    archive.register(spark)
    s = spark.createDataFrame([("a", "Canção teste", 0, ["És tudo", "Não temas"], 12.0, "continua"), ("a", "Canção teste", 1, ["x → y"], 15.0, "")], "name string, title string, slide_idx int, lines array<string>, start_seconds double, aux_text string")
    out = ini.render_sections(s, "name", "title").withColumn("audio", F.encode(F.lit("mp3"), "UTF-8"))
    out.write.format("slide_archive").mode("append").save(str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "out" / "a.slja") as z:
        assert set(z.namelist()) == {"slides.lja", "audio\\audio.mp3"} and b"letra=x ? y" in z.read("slides.lja")
    got = spark.read.format("slide_archive").load(str(tmp_path / "out")).orderBy("slide_idx").collect()
    assert [(r.title, r.lines, r.start_seconds, r.aux_text) for r in got] == [("Canção teste", ["És tudo", "Não temas"], 12.0, "continua"), ("Canção teste", ["x ? y"], 15.0, "")]
    assert got[0].audio_member == "audio\\audio.mp3"


def test_old_archives_hold_ticks():
    text = "x=1\r\n[Geral]\r\naudio=m\r\n[Slide:1]\r\ntipo=CAPA\r\nletra=Titulo\r\n[Slide:2]\r\ntipo=LETRA\r\nletra=a|b\r\ntempo=1\r\ntempo=576000\r\n[Slide:3]\r\ntipo=LETRA\r\nletra=\r\ntempo=960000\r\n[Slide:4]\r\ntipo=OUTRO\r\n"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("slides.lja", text.encode("cp1252"))
    assert archive.slides_of_archive(out.getvalue()) == ("Titulo", "m", [(["a", "b"], 3.0, ""), ([], 5.0, "")])


def test_metadata_and_records(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":"a","title":"x"}\n{"id":"b"}\n{"id":"a","title":"y","duration":3.5}\n')
    got = sorted((r.id, r.title, r.duration) for r in files.read_metadata(spark, str(tmp_path / "m.jsonl")).collect())
    assert got == [("a", "y", 3.5), ("b", "b", 0.0)]
    (tmp_path / "t.json").write_text(json.dumps({"words": [{"text": "a", "start": 0.0, "end": 1.0}], "detected_language": "pt", "duration_seconds": 1.0}))
    assert files.read_records(spark, str(tmp_path / "t.json"), files.TRANSCRIPT).first().words[0].text == "a"
    assert files.dispatch("x.MP3") == "generate" and files.dispatch("a.slja") == "validate"
    with pytest.raises(ValueError):
        files.dispatch("a.txt")


def test_archive_points_to_its_audio():
    lja = "[Geral]\r\nurl_musica=audio\\song.mp3\r\n"
    with zipfile.ZipFile(io.BytesIO(archive.archive_bytes(lja, b"mp3"))) as z:
        assert z.read("audio\\song.mp3") == b"mp3"
    assert archive.slides_of_archive(archive.archive_bytes(lja, b""))[1] == "audio\\song.mp3"
    assert archive.audio_member("[Slide:1]\r\naudio=x\r\n") == "audio\\audio.mp3"


def test_json_is_saved_whole(tmp_path):
    path = str(tmp_path / "a" / "x.json")
    assert files.load_json(path) is None
    files.save_json(path, {"b": "é", "a": 1})
    files.save_json(path, {"b": "ü", "a": 2})
    assert (tmp_path / "a" / "x.json").read_text() == '{"a": 2, "b": "ü"}\n' and files.load_json(path) == {"a": 2, "b": "ü"}
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"]
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.load_json(str(tmp_path / "list.json"))


def test_lyrics_source_and_mode(tmp_path):
    (tmp_path / "l.txt").write_bytes(b"\xef\xbb\xbfalfa")
    assert files.lyrics_and_mode(None, str(tmp_path / "l.txt"), None) == ("alfa", "lyrics-first")
    assert files.lyrics_and_mode(None, None, None) == (None, "asr") and files.lyrics_and_mode("", None, "lyrics-first") == ("", "lyrics-first")
    for bad in (("a", "b", None), (None, None, "lyrics-first"), ("a", None, "asr")):
        with pytest.raises(ValueError):
            files.lyrics_and_mode(*bad)


def test_inputs_are_discovered(spark, tmp_path):
    for name in ("a/y.mp3", "a/x.mp3", "a/x.pt.vtt", "a/x.pt-orig.vtt", "b/z.pt.vtt", "c/w.mp3", "d/v.mp3", "d/v.en.vtt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    (tmp_path / "m.jsonl").write_text('{"id":"a","title":"t"}\n{"id":"b"}\n\n{"id":"d","duration":2}\n')
    got = files.discover(spark, str(tmp_path / "in"), str(tmp_path / "m.jsonl")).orderBy("seen").collect()
    ends = [(r.id, r.title, r.duration, r.audio_path.rsplit("/", 1)[1], r.caption_path and r.caption_path.rsplit("/", 1)[1]) for r in got]
    assert ends == [("a", "t", 0.0, "x.mp3", "x.pt-orig.vtt"), ("d", "d", 2.0, "v.mp3", None)]


def test_old_results_are_kept(tmp_path):
    for name in ("report.md", "x.bin", "a/one.slja", "a/consensus-report.md", "a/other.md", "b/two.slja"):
        (tmp_path / "old" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "old" / name).write_text(name)
    assert files.snapshot(str(tmp_path / "old"), ["a", "missing"], str(tmp_path / "kept")) == ["report.md", "a/consensus-report.md", "a/one.slja"]
    assert (tmp_path / "kept" / "a" / "one.slja").read_text() == "a/one.slja"
    assert files.snapshot(str(tmp_path / "none"), [], str(tmp_path / "kept")) == []


def test_runs_are_immutable(spark, tmp_path):
    df = spark.range(3)
    files.write_run(df, str(tmp_path), 1, "r1")
    assert files.load_json(str(tmp_path / "manifests" / "phase-1-r1.json"))["rows"] == 3
    with pytest.raises(Exception, match="exists"):
        files.write_run(df, str(tmp_path), 1, "r1")
    assert files.tree_size(spark, str(tmp_path)).first().bytes > 0


def test_cached_stage_computes_misses_only(spark):
    inputs = spark.createDataFrame([("a",), ("b",)], "song string")
    seen = []

    def compute(df):
        seen.append(sorted(r.song for r in df.collect()))
        return df.select("song", F.concat(F.lit("p-"), "song").alias("payload"))

    first = files.cached_stage(inputs, None, "song", "v1", compute).select("song", "variant", "payload").persist()
    more = spark.createDataFrame([("a",), ("b",), ("c",)], "song string")
    assert sorted(r.payload for r in files.cached_stage(more, first, "song", "v1", compute).collect()) == ["p-a", "p-b", "p-c"]
    files.cached_stage(more, first, "song", "v2", compute).collect()
    assert seen == [["a", "b"], ["c"], ["a", "b", "c"]]


def test_gate_report(spark):
    row = {"slide_count": 10, "line_count": 20, "over_hard": 0, "over_target": 0, "aux_words": 0, "fast_transitions": 0, "text_words": 120, "hard_wrapped_line_count": 0, "hard_wrapped_slide_count": 0}
    m = spark.createDataFrame([("v|w", *row.values())], ["video", *row])
    c = G.compared(m, m, "video")
    text, data = reports.gate_report(G.batch_gate(c, 2), G.metric_deltas(c, "video"), G.top_failures(c, "video"), "video")
    assert "- full set: 1 of 2" in text and "v\\|w" in text and json.loads(data)["passed"] is False
    assert reports.duration(3725) == "1h02m05s"


def test_consensus_report(spark):
    decisions = spark.createDataFrame([(7, 0, 1.0, 2.5, "a", "alfa|beta", 91.0, 2, 2, ""), (7, 1, 3.0, 4.0, "b", "gama", 40.0, 1, 3, "score 40.0 below threshold")], "song int, idx int, start double, end double, source string, text string, score double, support int, n_sources int, doubt string")
    words = spark.createDataFrame([(7, 1, "gama", "phrase-consensus", ""), (7, 0, "alfa", "phrase-consensus", "")], "song int, word_idx int, text string, mode string, reason string")
    text = reports.consensus_report(decisions, spark.createDataFrame([(7, "c", "no words")], "song int, source string, reason string"), spark.createDataFrame([(7, 3)], "song int, slide_count int"), words, "song")
    for part in ("| a | 1 |", "| 7 | c | no words |", "| 7 | 3 |", "| 7 | phrase-consensus |  | 2 |", "| 7 | alfa gama |", "| 7 | 0 | 1.00-2.50 | a | 91.000 | 2 | 2 | alfa\\|beta |", "| 7 | 1 | score 40.0 below threshold | gama |"):
        assert part in text, part


def test_effort_report(spark):
    runs = spark.createDataFrame([("a", 61.0, 0, 3 << 20, 1 << 20), ("b", 3600.0, 3 << 20, 3 << 20, 100)], "song string, elapsed_seconds double, cache_bytes_before long, cache_bytes_after long, output_bytes long")
    text, data = reports.effort_report(runs, "song")
    assert "- total elapsed: 1h01m01s" in text and "| a | 1m01s | 3.0 MiB | 1.0 MiB |" in text and "| b | 1h00m00s | 0 B | 100 B |" in text
    assert json.loads(data)["cache_growth"] == 3 << 20
    assert "- total elapsed: 0m00s" in reports.effort_report(runs.limit(0), "song")[0]


def test_experiment_report_and_comparisons(spark, tmp_path):
    matrix = spark.createDataFrame([("v", "s1", 2.0, 1), ("v", "s2", 1.0, 2)], "song string, strategy string, score double, rank int")
    wins = spark.createDataFrame([("s1", 1)], "strategy string, wins int")
    text = reports.experiment_report(matrix, matrix.where("rank = 1"), wins, spark.createDataFrame([(0.5,)], "mean double"), "song")
    assert text.index("## Best by key") < text.index("| v | s2 | 1.000 | 2 |") < text.index("| s1 | 1 |") < text.index("| 0.500 |")
    deltas = spark.createDataFrame([("a", "x", 1, 2, 1), ("b", "x", 1, None, None)], "video string, metric string, baseline int, phase int, delta int")
    reports.write_comparisons(deltas, "video", str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == ["video=a", "video=b"]
    assert spark.read.json(str(tmp_path / "c")).count() == 2


def test_report_has_all_rows(spark):
    lines = reports.markdown_table(spark.range(10_050).orderBy("id")).split("\n")
    assert lines[2:] == [f"| {k} |" for k in range(10_050)]


def test_session_stream(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00.0", "a"), ("u", "2024-01-01 00:00:00.3", "b"), ("u", "2024-01-01 00:00:02.0", "c"), ("u", "2024-01-01 00:01:00.0", "z")]
    df = spark.createDataFrame(rows, "user string, t string, w string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = phrases.session_phrases(stream, "user", "ts", "w").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r.text for r in spark.table("sessions").collect())
    assert got == ["a b", "c"]
    batch = sorted(r.text for r in phrases.session_phrases(df, "user", "ts", "w").collect())
    assert batch == ["a b", "c", "z"]
