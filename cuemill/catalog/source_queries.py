"""Caption and recogniser files, whole jobs."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill import fixtures as fx
from cuemill.catalog import query
from cuemill.operators.language import language_profiles
from cuemill.operators.timeline import assemble_text
from cuemill.plans.captions import caption_cues, place_segments
from cuemill.plans.translation import translate_captions, write_translations
from cuemill.session import shared_folder
from cuemill.sources import captions, transcripts
from cuemill.sources.files import file_stems


@query("""
  select media_id, cast(seg_idx as integer) as seg_idx, cast(word_idx as integer) as word_idx, word, start_ms, end_ms,
         1.0::double as probability
  from words
""")
def recognised_words(spark, sf):
    return transcripts.explode_words(fx.segments(spark, sf))


def _cues(spark, sf):
    return fx.words(spark, sf).select(
        "media_id", F.col("seq").alias("cue_idx"), "start_ms", "end_ms", F.concat("word", F.lit(r"\N"), "word").alias("text")
    )


_STAMP = "printf('%02d:%02d:%02d{mark}%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"
_SHORT = "printf('%d:%02d:%02d.%02d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} // 10 % 100)"


def _numbered(fmt, mark):
    start, end = (_STAMP.format(mark=mark, t=t) for t in ("start_ms", "end_ms"))
    return f"""
  select '{fmt}' as format, media_id, seq as cue_idx,
         cast(seq + 1 as varchar) || chr(10) || {start} || ' --> ' || {end} || chr(10) || word || chr(10) || word || chr(10) as value
  from words"""


def _styled(fmt, first):
    start, end = (_SHORT.format(t=t) for t in ("start_ms", "end_ms"))
    return f"""
  select '{fmt}' as format, media_id, seq as cue_idx,
         'Dialogue: {first},' || {start} || ',' || {end} || ',Default,,0,0,0,,' || word || '\\N' || word as value
  from words"""


def _head(fmt):
    return f"select '{fmt}', media_id, -1, '{captions._HEADS[fmt]}' from (select distinct media_id from words)"


@query(
    " union all ".join(
        [_numbered("srt", ","), _numbered("vtt", "."), _styled("ass", "0"), _styled("ssa", "Marked=0")]
        + [_head(fmt) for fmt in captions._HEADS]
    )
)
def caption_file_lines(spark, sf):
    return captions.caption_lines(_cues(spark, sf), captions.FORMATS)


def _files(spark, sf, fmt):
    """One file per document, put together as the writer orders its lines."""
    lines = captions.caption_lines(_cues(spark, sf), [fmt]).groupBy("media_id").agg(
        F.sort_array(F.collect_list(F.struct("cue_idx", "value"))).alias("lines")
    )
    return lines.select(F.concat(F.lit("m"), "media_id").alias("file"), F.array_join("lines.value", "\n").alias("content"))


_READ = """
  select 'm' || media_id as file, cast(seq as integer) as cue_idx, start_ms, end_ms, word || chr(10) || word as text,
         'Default' as style
  from words
"""


@query(_READ)
def parsed_srt(spark, sf):
    return captions.parse_captions(_files(spark, sf, "srt"), "srt")


@query(_READ)
def parsed_vtt(spark, sf):
    return captions.parse_captions(_files(spark, sf, "vtt"), "vtt")


@query(_READ)
def parsed_vtt_blocks(spark, sf):
    """Files with a head of several lines, styles, named cues and notes between them."""
    cues = captions.caption_lines(_cues(spark, sf), ["vtt"]).filter("cue_idx >= 0")
    cue = F.concat(F.lit("cue "), "cue_idx", F.lit("\n"), F.regexp_replace("value", r"^\d+\n", ""))
    note = F.when(F.col("cue_idx") % 3 == 0, F.lit("\nNOTE said\nby nobody\n")).otherwise("")
    lines = cues.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("cue_idx", F.concat(cue, note).alias("value")))).alias("lines"))
    head = F.lit("WEBVTT - of words\nKind: captions\n\nSTYLE\n::cue { color: red }\n\nNOTE\nbefore the first\n\n")
    content = F.concat(head, F.array_join("lines.value", "\n"))
    files = lines.select(F.concat(F.lit("m"), "media_id").alias("file"), content.alias("content"))
    return captions.parse_captions(files, "vtt")


@query("""
  select 'm' || media_id as file, cast(seq as integer) as cue_idx, start_ms // 10 * 10 as start_ms, end_ms // 10 * 10 as end_ms,
         word || chr(10) || word as text, 'Default' as style
  from words
""")
def parsed_ass(spark, sf):
    return captions.parse_captions(_files(spark, sf, "ass"), "ass")


_HEAD_LINES = captions._ASS_HEAD.split("\n")


@query(f"""
  select 'm' || media_id as file, cast(seq + {len(_HEAD_LINES)} as integer) as line_idx, cast(seq as integer) as cue_idx,
         'Dialogue: 0,' || {_SHORT.format(t="start_ms")} || ',' || {_SHORT.format(t="end_ms")} || ',Default,,0,0,0,,' || word || '!\\Nx' as value
  from words where word <> 'um'
  union all
  select 'm' || media_id, h.line_idx, -1, h.value
  from (select distinct media_id from words) cross join
       (values {", ".join(f"({k}, '{line}')" for k, line in enumerate(_HEAD_LINES))}) as h(line_idx, value)
""")
def retexted_ass(spark, sf):
    return captions.retext(_files(spark, sf, "ass"), _new_texts(spark, sf), "ass")


def _new_texts(spark, sf):
    return fx.words(spark, sf).filter("word <> 'um'").select(
        F.concat(F.lit("m"), "media_id").alias("file"),
        F.col("seq").cast("int").alias("cue_idx"),
        F.concat("word", F.lit("!\nx")).alias("text"),
    )


def _renumbered(mark):
    start, end = (_STAMP.format(mark=mark, t=t) for t in ("start_ms", "end_ms"))
    return f"""
  select 'm' || media_id as file, cast(n as integer) as line_idx, cast(n - 1 as integer) as cue_idx,
         cast(n as varchar) || chr(10) || {start} || ' --> ' || {end} || chr(10) || word || '!' || chr(10) || 'x' || chr(10) as value
  from (select *, row_number() over (partition by media_id order by seq) as n from words where word <> 'um')"""


@query(_renumbered(","))
def retexted_srt(spark, sf):
    return captions.retext(_files(spark, sf, "srt"), _new_texts(spark, sf), "srt").withColumn("cue_idx", F.col("cue_idx").cast("int"))


@query(
    _renumbered(".")
    + f"""
  union all select 'm' || media_id, 0, -1, '{captions._HEADS["vtt"]}' from (select distinct media_id from words where word <> 'um')"""
)
def retexted_vtt(spark, sf):
    return captions.retext(_files(spark, sf, "vtt"), _new_texts(spark, sf), "vtt").withColumn("cue_idx", F.col("cue_idx").cast("int"))


def _new_folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _name(file):
    return F.substring_index(file, "/", -1)


def _stems(spark, sf):
    paths = F.concat(F.lit("/lib/"), F.col("media_id") % 3, F.lit("/talk "), F.expr("media_id div 2"), F.lit(".part.mp4"))
    return file_stems(fx.media(spark, sf).select("media_id", paths.alias("path")))


# two items share a name, but for one whose partner has no words
_STEM_SQL = """
  stems as (
    select media_id, 'talk ' || (media_id // 2) || '.part' || case when count(*) over (partition by media_id // 2) > 1
           then '_' || media_id else '' end as stem
    from (select distinct media_id from words)
  )
"""


@query(f"""
  with {_STEM_SQL}
  select f.format, stem || '_subtitle.' || f.format as file, cast(seq as integer) as cue_idx, word || chr(10) || word as text,
         case when f.format in ('ass', 'ssa') then start_ms // 10 * 10 else start_ms end as start_ms,
         case when f.format in ('ass', 'ssa') then end_ms // 10 * 10 else end_ms end as end_ms
  from words join stems using (media_id), (values ('srt'), ('vtt'), ('ass'), ('ssa')) as f(format)
""")
def written_captions(spark, sf):
    """Caption files of all formats, written under the names of their media and read back."""
    folder = _new_folder(spark)
    captions.write_captions(_cues(spark, sf), folder, captions.FORMATS, _stems(spark, sf))
    read = [captions.read_captions(spark, folder, f).withColumn("format", F.lit(f)) for f in captions.FORMATS]
    rows = reduce(DataFrame.unionByName, read)
    return rows.select("format", _name("file").alias("file"), "cue_idx", "text", "start_ms", "end_ms")


@query(f"""
  with {_STEM_SQL}
  select stem || '_transcript.txt' as file, string_agg(text, ' ' order by seg_idx) as text
  from segs join stems using (media_id) group by stem
""")
def written_transcripts(spark, sf):
    folder = _new_folder(spark)
    transcripts.write_transcripts(assemble_text(fx.segments(spark, sf)), folder, _stems(spark, sf))
    return transcripts.read_transcripts(spark, folder).select(_name("file").alias("file"), "text")


def _recognised(spark, sf):
    """Recogniser output as JSON lines: some cut off, some without a time, some that end before they start."""
    rows = fx.segments(spark, sf).drop("language").withColumn("kind", (F.col("media_id") + F.col("seg_idx")) % 11)
    end = F.when(F.col("kind") == 1, None).when(F.col("kind") == 2, F.col("start_ms") - 1).otherwise(F.col("end_ms"))
    line = F.to_json(F.struct("media_id", "seg_idx", "start_ms", end.alias("end_ms"), "text", "words"))
    cut_off = F.when(F.col("kind") == 0, F.left(line, F.length(line) - 5)).otherwise(line)
    folder = _new_folder(spark)
    rows.select(cut_off.alias("value")).write.text(folder)
    return folder


@query("""
  select media_id, cast(seg_idx as integer) as seg_idx, start_ms, end_ms, text, cast(n_words as bigint) as n_words
  from segs where (media_id + seg_idx) % 11 > 2
""")
def read_segments(spark, sf):
    rows = transcripts.read_segments(spark, _recognised(spark, sf))
    return rows.select("media_id", "seg_idx", "start_ms", "end_ms", "text", F.size("words").cast("long").alias("n_words"))


@query("""
  select case (media_id + seg_idx) % 11 when 0 then 'unreadable' when 1 then 'incomplete' else 'reversed' end as reason,
         count(*) as lines
  from segs where (media_id + seg_idx) % 11 <= 2 group by 1
""")
def damaged_segments(spark, sf):
    rows = transcripts.damaged_segments(spark, _recognised(spark, sf))
    return rows.groupBy("reason").agg(F.count("*").alias("lines"))


@query(r"""
  select page_id, regexp_replace(path, '\.[^./]*$', '') || '_subtitle.vtt' as captions,
         regexp_replace(path, '\.[^./]*$', '') || '_transcript.txt' as transcript
  from listing
""")
def output_paths(spark, sf):
    return fx.listing(spark, sf).select(
        "page_id",
        captions.output_path(F.col("path"), "captions", "vtt").alias("captions"),
        captions.output_path(F.col("path"), "transcript").alias("transcript"),
    )


@query()
def caption_job(spark, sf):
    placed = place_segments(fx.chunk_segments(spark, sf), fx.chunks(spark, sf))
    order = F.struct("chunk_idx", "seg_idx")
    # owned segments of all chunks, in order
    rows = placed.withColumn("seg_idx", (order["chunk_idx"].cast("long") * 1_000_000 + order["seg_idx"]))
    return caption_cues(rows.drop("chunk_idx"))


@query()
def translation_job(spark, sf):
    spoken = fx.segments(spark, sf).filter("media_id % 5 <> 0").select("language", "text")
    return translate_captions(_files(spark, sf, "ass"), "ass", target="en", profiles=language_profiles(spoken))


@query("""
  select 'm' || media_id || '.en.srt' as file, cast(seq as integer) as cue_idx, start_ms, end_ms,
         'translated: ' || word || chr(10) || word as text
  from words
""")
def written_translations(spark, sf):
    """Caption files translated, written under their new names and read back."""
    folder = _new_folder(spark)
    files = _files(spark, sf, "srt").withColumn("file", F.concat(F.lit("/in/"), "file", F.lit(".de.srt")))
    memory = f"{shared_folder(spark)}/memory-{uuid.uuid4().hex}"
    write_translations(translate_captions(files, "srt", target="en", source="de", memory=memory), folder)
    read = captions.read_captions(spark, folder, "srt")
    return read.select(_name("file").alias("file"), "cue_idx", "start_ms", "end_ms", "text")
