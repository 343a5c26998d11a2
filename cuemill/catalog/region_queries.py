"""Speech regions."""

from pyspark.sql import functions as F

from cuemill import fixtures as fx
from cuemill.catalog import query
from cuemill.operators import regions as ops
from cuemill.plans.captions import plan_regions

_MERGED = """
  select media_id, min(start_ms) as start_ms, arg_max(end_ms, (start_ms, end_ms)) as end_ms
  from (select *, sum(opens) over (partition by media_id order by start_ms, end_ms
                                   rows between unbounded preceding and current row) as grp
        from (select *, case when start_ms - lag(end_ms) over (partition by media_id order by start_ms, end_ms)
                                  <= {gap} then 0 else 1 end as opens
              from {source}))
  group by media_id, grp
"""


@query(_MERGED.format(gap=3_600_000, source="regions"))
def merged_regions(spark, sf):
    return ops.merge_regions(fx.regions(spark, sf), 3_600_000)


@query(f"""
  with speech as (select media_id, t_ms as start_ms, t_ms + 100 as end_ms from frames where p >= 0.3),
  merged as ({_MERGED.format(gap=299, source="speech")})
  select * from merged where end_ms - start_ms >= 100
""")
def frame_regions(spark, sf):
    return ops.regions_from_frames(fx.frames(spark, sf))


@query("select media_id, greatest(0, start_ms - 200) as start_ms, end_ms + 200 as end_ms from regions")
def padded_regions(spark, sf):
    return ops.pad_regions(fx.regions(spark, sf))


def _segment_regions(spark, sf):
    return fx.segments(spark, sf).select("media_id", "start_ms", "end_ms")


@query("""
  select m.media_id, coalesce(r.ms / m.duration_ms, 0.0::double) as speech_ratio from media m
  left join (select media_id, cast(sum(end_ms - start_ms) as bigint) as ms from segs group by 1) r
  on m.media_id = r.media_id
""")
def speech_ratio(spark, sf):
    return ops.speech_ratio(_segment_regions(spark, sf), fx.media(spark, sf))


@query("""
  select m.media_id, coalesce(r.ms, 0) as first_speech_ms from media m
  left join (select media_id, min(start_ms) as ms from segs group by 1) r
  on m.media_id = r.media_id
""")
def first_speech(spark, sf):
    return ops.first_speech(_segment_regions(spark, sf), fx.media(spark, sf))


@query("""
  select media_id, start_ms as sample_start_ms, least(end_ms, start_ms + 30000) as sample_end_ms
  from (select *, row_number() over (partition by media_id order by end_ms - start_ms desc, start_ms) as rn from regions)
  where rn = 1
""")
def language_sample(spark, sf):
    return ops.language_sample(fx.regions(spark, sf))


@query("""
  select event_id as media_id, case when user_id % 2 = 0 then 'en' else 'es' end as language,
         (event_id % 101) / 100.0::double as probability, event_id % 101 < 50 as low_confidence
  from events
""")
def low_confidence(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("media_id"),
        F.when(F.col("user_id") % 2 == 0, "en").otherwise("es").alias("language"),
        ((F.col("event_id") % 101) / 100.0).alias("probability"),
    )
    return ops.flag_low_confidence(rows)


@query(f"""
  with merged as ({_MERGED.format(gap=3_600_000, source="regions")}),
  longest as (
    select media_id, start_ms as sample_start_ms, least(end_ms, start_ms + 30000) as sample_end_ms
    from (select *, row_number() over (partition by media_id order by end_ms - start_ms desc, start_ms) as rn from merged)
    where rn = 1
  )
  select media_id, row_number() over (partition by media_id order by start_ms, end_ms) - 1 as region_idx,
         greatest(0, start_ms - 200) as start_ms, end_ms + 200 as end_ms, sample_start_ms, sample_end_ms
  from merged join longest using (media_id)
""")
def region_plan(spark, sf):
    return plan_regions(fx.regions(spark, sf), 3_600_000)
