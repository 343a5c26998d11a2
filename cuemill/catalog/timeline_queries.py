"""Chunk plan, media timeline, owned slices."""

from pyspark.sql import functions as F

from cuemill import fixtures as fx
from cuemill.catalog import query
from cuemill.operators import timeline


@query("select * from chunks")
def chunk_plan(spark, sf):
    return fx.chunks(spark, sf)


@query("select media_id, cast(sum(overlap_ms) as bigint) as overlap_ms, count(*) as chunks from chunks group by 1")
def planned_overlap(spark, sf):
    return timeline.planned_overlap(fx.chunks(spark, sf))


def _flat(segments):
    """Nested words as countable columns, so that both sides can be hashed."""
    total = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w["start_ms"] + w["end_ms"])
    return segments.withColumn("n_words", F.size("words").cast("long")).withColumn("word_ms", total).drop("words")


@query("""
  select media_id, chunk_idx, seg_idx, min(start_ms) as start_ms, max(end_ms) as end_ms,
         string_agg(word, ' ' order by word_idx) as text, count(*) as n_words,
         cast(sum(start_ms + end_ms) as bigint) as word_ms
  from chunk_words group by media_id, chunk_idx, seg_idx
""")
def media_timeline(spark, sf):
    return _flat(timeline.to_media_timeline(fx.chunk_segments(spark, sf), fx.chunks(spark, sf)))


@query("""
  with known as (
    select media_id, chunk_idx, start_ms as plan_start, end_ms as plan_end from chunks where start_ms < 90000
  ), heard as (
    select media_id, chunk_idx, arg_max(end_ms, seg_idx) as heard_ms from chunk_segs group by 1, 2
  ), both_sides as (
    select media_id, chunk_idx, plan_start, plan_end, heard_ms
    from heard full join known using (media_id, chunk_idx)
  ), runs as (
    select *, count(plan_end) over (partition by media_id order by chunk_idx
                                    rows between unbounded preceding and 1 preceding) as planned_before
    from both_sides
  ), placed as (
    select *, coalesce(max(plan_end) over (partition by media_id order by chunk_idx
                                    rows between unbounded preceding and 1 preceding), 0) as last_plan,
           coalesce(sum(case when plan_end is null then heard_ms else 0 end)
             over (partition by media_id, planned_before order by chunk_idx
                   rows between unbounded preceding and 1 preceding), 0) as since
    from runs
  )
  select media_id, chunk_idx, cast(coalesce(plan_start, last_plan + since) as bigint) as offset_ms
  from placed where heard_ms is not null
""")
def offset_fallback(spark, sf):
    known = fx.chunks(spark, sf).filter("start_ms < 90000")
    return timeline.fallback_offsets(fx.chunk_segments(spark, sf), known)


@query("""
  select s.media_id, s.chunk_idx, s.seg_idx, s.start_ms, s.end_ms, s.text
  from (select media_id, chunk_idx, seg_idx, min(start_ms) as start_ms, max(end_ms) as end_ms,
               string_agg(word, ' ' order by word_idx) as text
        from chunk_words group by 1, 2, 3) s
  left join chunks c on s.media_id = c.media_id and s.chunk_idx = c.chunk_idx
  where c.media_id is null
     or (s.start_ms + s.end_ms) / 2.0 between c.content_start_ms - 50 and c.content_end_ms + 50
""")
def owned_segments(spark, sf):
    plan = fx.chunks(spark, sf)
    placed = timeline.to_media_timeline(fx.chunk_segments(spark, sf), plan)
    return timeline.primary_window(placed, plan).drop("words")


@query("""
  select media_id, seg_idx, language, start_ms + 250 as start_ms, end_ms + 250 as end_ms, text,
         n_words, cast(word_ms + 500 * n_words as bigint) as word_ms
  from (select s.*, w.word_ms from segs s
        join (select media_id, seg_idx, sum(start_ms + end_ms) as word_ms from words group by 1, 2) w
        using (media_id, seg_idx))
""")
def sync_shift(spark, sf):
    return _flat(timeline.shift_times(fx.segments(spark, sf), 250))


@query("select media_id, seg_idx, text from segs where trim(regexp_replace(text, '^(Is|The|La|Du).*', '')) <> ''")
def nonempty_segments(spark, sf):
    rows = fx.plain_segments(spark, sf).select("media_id", "seg_idx", "text")
    kept = timeline.drop_empty_text(
        rows.withColumn("original", F.col("text")).withColumn("text", F.regexp_replace("text", "^(Is|The|La|Du).*", ""))
    )
    return kept.select("media_id", "seg_idx", F.col("original").alias("text"))


@query("select media_id, string_agg(text, ' ' order by seg_idx) as text from segs group by 1")
def assembled_text(spark, sf):
    return timeline.assemble_text(fx.plain_segments(spark, sf))


@query("""
  select s.media_id, s.seg_idx, s.start_ms + r.start_ms as start_ms, s.end_ms + r.start_ms as end_ms
  from segs s join (select media_id, seg_idx, greatest(0, start_ms - 200) as start_ms from segs) r
  using (media_id, seg_idx)
""")
def region_timeline(spark, sf):
    from cuemill.operators.regions import pad_regions

    segments = fx.plain_segments(spark, sf).withColumn("region_idx", F.col("seg_idx"))
    regions = pad_regions(segments.select("media_id", "region_idx", "start_ms", "end_ms"))
    placed = timeline.regions_to_media_timeline(segments, regions)
    return placed.select("media_id", "seg_idx", "start_ms", "end_ms")
