"""What may be shuffled: texts, not the words or lines made of them."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from cuemill import catalog
from cuemill import fixtures as fx
from cuemill.operators import translate
from cuemill.operators.regions import regions_from_frames
from cuemill.operators.segments import merge_short
from cuemill.plans.captions import caption_cues
from cuemill.plans.transcript import transcripts_from_chunks
from cuemill.sources import files as named
from cuemill.sources.captions import caption_lines, retext


def _documents(spark, tmp_path):
    rows = [(1, "en", "one two, three.\n\n four"), (1, "en", "one two, three.\n\n four"), (2, "de", "a b"), (None, "en", "x"), (3, "en", " \n")]
    rows += [(k, "en", "some words here. " * k) for k in range(4, 40)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_stay_where_their_texts_are(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    for made in (fx.words, fx.segments, fx.chunks, fx.frames):
        lines = _plan(made(spark, sf)).split("\n")
        moved = [k for k, line in enumerate(lines) if "Exchange" in line]
        cut = [k for k, line in enumerate(lines) if "Generate" in line and "posexplode" in line]
        # a plan is read from its last line on
        assert moved and all(k > max(cut) for k in moved), made.__name__


def test_plain_segments_come_from_lines_and_words_are_not_gathered(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    expected = fx.segments(spark, sf).drop("words").collect()
    assert sorted(map(str, fx.plain_segments(spark, sf).collect())) == sorted(map(str, expected))
    # a plan that has run names its steps twice
    assert _plan(fx.plain_segments(spark, sf)).count("Generate") == 1


def test_durations_are_those_of_the_words(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    words = fx.words(spark, sf).groupBy("media_id").agg(F.first("language").alias("language"), (F.max("end_ms") + 500).alias("duration_ms"))
    found = fx.media(spark, sf)
    assert sorted(map(str, found.collect())) == sorted(map(str, words.collect()))
    grid = fx.frames(spark, sf).groupBy("media_id").agg(F.count("*").alias("n"), F.max("t_ms").alias("t_ms")).collect()
    durations = {r.media_id: r.duration_ms for r in found.collect()}
    assert {r.media_id: (r.n, r.t_ms) for r in grid} == {k: (d // 100 + 1, d // 100 * 100) for k, d in durations.items()}


def test_heads_come_with_the_first_cue(spark):
    cues = spark.createDataFrame([(1, 0, 0, 900, "a"), (1, 1, 1000, 1900, "b"), (2, 0, 0, 900, "c")], "media_id long, cue_idx long, start_ms long, end_ms long, text string")
    lines = caption_lines(cues, ["srt", "vtt"])
    assert "Exchange" not in _plan(lines)
    kept = lines.select("format", "media_id", "cue_idx").collect()
    assert sorted(kept) == sorted(
        Row(f, m, k) for f in ("srt", "vtt") for m, k in ((1, -1), (1, 0), (1, 1), (2, -1), (2, 0)) if f == "vtt" or k >= 0
    )


def test_frames_become_regions_by_one_sort(spark):
    times = [0, 100, 100, 500, 900, 3_599_900, 3_600_000, 3_600_500, 7_300_000, None]
    frames = spark.createDataFrame([(m, t, 0.9) for m in (1, None) for t in times], "media_id long, t_ms long, p double")
    found = regions_from_frames(frames)
    expected = [(0, 200), (500, 600), (900, 1000), (3_599_900, 3_600_100), (3_600_500, 3_600_600), (7_300_000, 7_300_100)]
    assert sorted((str(r.media_id), r.start_ms, r.end_ms) for r in found.collect()) == sorted((str(m), *e) for m in (1, None) for e in expected)
    plan = _plan(regions_from_frames(frames.repartition(4, "media_id")))
    assert plan.count("lead(t_ms") and plan.count("Exchange") == 1


def test_new_texts_meet_files_not_cues(spark):
    cue = "1\n00:00:0{k},000 --> 00:00:0{k},500\nold\n"
    srt = [(f, "\n".join(cue.format(k=k) for k in range(3))) for f in ("a", "b", None)]
    ass = [(f, "[Events]\nDialogue: 0,0,0,D,,0,0,0,,old\n; note\nDialogue: 1,0,0,D,,0,0,0,,old, too") for f in ("a", "b", None)] + [("c", None)]
    new = [("a", 1, "x\ny"), ("a", 1, "again"), ("a", 7, "none"), ("a", -1, "none"), ("a", None, "none"), ("a", 0, None), (None, 0, "none"), ("d", 0, "none")]
    new = spark.createDataFrame(new, "file string, cue_idx long, text string")
    lines = {}
    for fmt, rows in (("srt", srt), ("ass", ass)):
        found = retext(spark.createDataFrame(rows, "file string, content string"), new, fmt)
        assert all("cue_idx" not in line for line in _plan(found).split("\n") if "Join" in line)
        lines[fmt] = sorted((str(r.file), r.line_idx, r.cue_idx, str(r.value)) for r in found.collect())
    assert [x[:3] for x in lines["srt"]] == [("a", 1, 0), ("a", 2, 1), ("a", 3, 2)]
    assert sorted(x[3].split("\n", 2)[2] for x in lines["srt"][1:]) == ["again\n", "x\ny\n"]
    others = [(f, k, -1, line) for f in ("None", "a", "b") for k, line in ((0, "[Events]"), (2, "; note"))]
    start = "Dialogue: 1,0,0,D,,0,0,0,,"
    assert lines["ass"] == sorted([*others, ("a", 1, 0, "None"), ("a", 3, 1, start + "again"), ("a", 3, 1, start + "x\\Ny")])


def test_pairs_move_rows_before_they_carry_the_next(spark):
    rows = [(m, k, 1000 * k, 1000 * k + 900, "w") for m in (1, 2) for k in range(20)]
    segments = spark.createDataFrame(rows, "media_id long, seg_idx int, start_ms long, end_ms long, text string")
    found = merge_short(segments.repartition(4, "media_id"), block=4)
    lines = _plan(found).split("\n")
    moved = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(media_id" in line and "_block" in line]
    window = [k for k, line in enumerate(lines) if "Window [" in line]
    # a plan is read from its last line on
    assert min(moved) > min(window)
    assert sorted((r.media_id, r.seg_idx, r.end_ms) for r in found.collect()) == [(m, k, 1000 * k + 1900) for m in (1, 2) for k in range(0, 20, 2)]


def test_files_are_written_by_batches(spark, tmp_path):
    lines = [(f"f{k % 3}", k, None if k % 5 == 0 else f"line {k}") for k in range(30)] + [("empty", 0, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        named.write_named(spark.createDataFrame(lines, "name string, i int, value string"), ["i"], str(tmp_path), mark=False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = {f"f{k}": "".join(f"line {i}\n" for i in range(k, 30, 3) if i % 5) for k in range(3)} | {"empty": ""}
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == expected
    assert issubclass(named._NamedTextWriter, named.DataSourceArrowWriter)


def test_cues_meet_translations_without_a_digest(spark, tmp_path):
    rows = [(1, k, t, m) for k, (t, m) in enumerate([("a", None), (" a ", ""), ("a", "x"), ("", None), (None, "x"), ("3F", None)])]
    cues = spark.createDataFrame(rows, "media_id long, cue_idx long, text string, model string")
    expected = {0: "translated: a", 1: "translated: a", 2: "translated: a", 3: "", 4: "", 5: "translated: 3F"}
    for memory in (None, f"{tmp_path}/memory"):
        done = translate.translate_texts(cues, memory=memory, hot=1)
        assert "sha2(" not in _plan(done)
        # without a model and with an empty one are two models
        assert sorted((r.cue_idx, r.translated_text) for r in done.collect()) == sorted(expected.items())


def test_words_of_chunks_are_made_once(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    for made in (fx.chunk_texts, fx.chunk_segments):
        # the duration comes with the words: the documents aren't read again for it
        assert _plan(made(spark, sf)).count("FileScan") == 1, made.__name__
    assert fx.chunk_texts(spark, sf).filter("media_id is null").isEmpty()


def test_chunk_texts_are_made_once(spark, tmp_path):
    sf = _documents(spark, tmp_path)
    catalog.load()
    assert "posexplode" not in _plan(catalog.QUERIES["merged_chunk_texts"](spark, sf))
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(text):
        made.add(1)
        return text

    rows = [(1, 0, "en", "a b c d e"), (1, 1, "en", "c d e f g"), (2, 0, "de", "x y"), (2, 1, "de", None)]
    texts = spark.createDataFrame(rows, "media_id long, chunk_idx int, language string, text string")
    found = transcripts_from_chunks(texts.withColumn("text", said("text"))).collect()
    assert {r.media_id: r.text for r in found} == {1: "A b c d e f g.", 2: "X y."}
    assert made.value == len(rows)


def test_merged_segments_are_stored_by_columns(spark):
    word = "array<struct<word: string, start_ms: long, end_ms: long, probability: double>>"
    rows = [(1, 0, 0, 900, "one two", [("one", 0, 400, 1.0), ("two", 500, 900, 1.0)]), (2, 0, 0, 5000, "three four five six", None)]
    cues = caption_cues(spark.createDataFrame(rows, f"media_id long, seg_idx int, start_ms long, end_ms long, text string, words {word}"))
    assert cues.inputFiles() and all(f.endswith(".parquet") for f in cues.inputFiles())
    assert {r.media_id: r.text for r in cues.collect()} == {1: "one two", 2: "three four five six"}


def test_tables_are_dealt_out_by_their_size(spark, tmp_path, monkeypatch):
    sf = _documents(spark, tmp_path)
    expected = sorted(map(str, fx.words(spark, sf).collect()))
    monkeypatch.setattr(fx, "SLICE_BYTES", 200, raising=False)
    words = fx.words(spark, sf)
    # a table many times as large as a slice is more tasks than a shuffle has
    assert words.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(str, words.collect())) == expected


def test_retexted_cues_are_numbered_in_their_file(spark):
    cue = "1\n00:00:0{k},000 --> 00:00:0{k},500\nold\n"
    content = "\n".join(cue.format(k=k) for k in range(3))
    files = spark.createDataFrame([("a", content), ("a", content), ("b", content), ("c", None)], "file string, content string")
    new = [("a", 2, "z"), ("a", 0, "x"), ("b", 2, "last"), ("b", 3, "none"), ("b", 1, None), ("c", 0, "none")]
    lines = retext(files, spark.createDataFrame(new, "file string, cue_idx long, text string"), "srt")
    # no sort by cues: they come out of the row of their file
    assert "row_number" not in _plan(lines) and "cue_idx ASC" not in _plan(lines)
    found = sorted((r.file, r.line_idx, r.cue_idx, (r.value or "").split("\n")[1:3]) for r in lines.collect())
    time = "00:00:0{k},000 --> 00:00:0{k},500"
    first, last = time.format(k=0), time.format(k=2)
    both = [("a", 1, 0, [first, "x"]), ("a", 2, 1, [first, "x"]), ("a", 3, 2, [last, "z"]), ("a", 4, 3, [last, "z"])]
    assert [x for x in found if x[0] == "a"] == both
    assert [x[:3] for x in found if x[0] != "a"] == [("b", 1, 0), ("b", 2, 1)]
    assert found[-1][3] == [last, "last"]
