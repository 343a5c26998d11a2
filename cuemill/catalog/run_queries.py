"""Inventory, loudness and run reports."""

from pyspark.sql import functions as F

from cuemill import fixtures as fx
from cuemill.catalog import query
from cuemill.operators import inventory, loudness, runs

_SUFFIX = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
_IS_MEDIA = f"{_SUFFIX} in ('.mp4', '.avi', '.mkv', '.mov', '.webm', '.mp3')"


@query(f"select *, {_SUFFIX} as suffix from listing where {_IS_MEDIA} order by lower(path), path")
def media_inventory(spark, sf):
    return inventory.media_inventory(fx.listing(spark, sf))


@query(f"""
  with direct as (
    select folder, string_split(folder, '/') as parts, bool_or(media) as holds_media
    from (select regexp_replace(path, '/[^/]*$', '') as folder, {_IS_MEDIA} as media from listing) group by folder
  ), folders as (
    select distinct array_to_string(parts[1:k], '/') as folder
    from (select parts, unnest(generate_series(1, len(parts))) as k from direct) where parts[k] <> '' and parts[k] not like '%:'
  )
  select folder from folders where folder not in (select folder from direct where holds_media)
""")
def folders_without_media(spark, sf):
    return inventory.folders_without_media(fx.listing(spark, sf))


_VERDICT = rf"""
  verdicts as (
    select *, case when not {_IS_MEDIA} then 'Unsupported format: ' || regexp_extract(path, '[^/](\.[^./]+)$', 1)
                   when not exists then 'File does not exist' when size_bytes = 0 then 'File is empty'
                   else 'File is valid' end as verdict
    from (select page_id, path, "exists", size_bytes from listing)
  )
""".replace("not exists", 'not "exists"')


@query(f"with {_VERDICT} select * from verdicts")
def validated_media(spark, sf):
    return inventory.validate_media(fx.listing(spark, sf))


@query(f"with {_VERDICT} select verdict, count(*) as files from verdicts group by 1")
def verdict_counts(spark, sf):
    return inventory.verdict_counts(fx.listing(spark, sf))


@query("select *, coalesce(input_i < -24, false) as needs_boost from loudness")
def needs_boost(spark, sf):
    return loudness.needs_boost(fx.loudness(spark, sf))


@query("""
  select count(*) as items, count(input_i) as analysed, count(*) filter (where input_i < -24) as boosted, 0::bigint as silent
  from loudness
""")
def loudness_report(spark, sf):
    return loudness.quality_report(fx.loudness(spark, sf))


@query("""
  select event_id as media_id,
         case when event_id % 13 = 0 then null when event_id % 17 = 0 then '-Infinity'::double
              else -cast(round(value * 100) as bigint) / 100.0::double end as input_i,
         case when event_id % 13 <> 0 then -1.5::double end as input_tp,
         case when event_id % 13 <> 0 then (event_id % 20)::double end as input_lra,
         case when event_id % 13 <> 0 then -34.1::double end as input_thresh,
         case when event_id % 13 <> 0 then 0.2::double end as target_offset
  from events
""")
def loudness_from_logs(spark, sf):
    return loudness.read_loudness(fx.loudness_logs(spark, sf))


_LATEST = """
  latest as (
    select media_id, arg_max(status, (ts_ms, event_id)) as status, arg_max(processing_s, (ts_ms, event_id)) as processing_s,
           max(ts_ms) as ts_ms, arg_max(coalesce(error, ''), (ts_ms, event_id)) as error
    from run_log group by 1
  )
"""


@query(f"""
  with {_LATEST}
  select count(*) filter (where status = 'queued') as queued, count(*) filter (where status = 'processing') as processing,
         count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed,
         least(count(*) filter (where status in ('completed', 'failed')) + 1, count(*)) as position, count(*) as total
  from latest
""")
def queue_status(spark, sf):
    return runs.queue_status(fx.run_log(spark, sf))


@query(f"""
  with {_LATEST}
  select count(*) filter (where status = 'completed') as completed, count(*) filter (where status = 'failed') as failed,
         coalesce(cast(sum(cast(round(processing_s * 100) as bigint)) filter (where status = 'completed') as bigint), 0) / 100::double as total_s,
         coalesce(avg(cast(round(processing_s * 100) as bigint)) filter (where status = 'completed'), 0) / 100::double as mean_s
  from latest
""")
def batch_summary(spark, sf):
    return runs.batch_summary(fx.run_log(spark, sf))


@query(f"""
  with {_LATEST}
  select media_id, error, greatest((select count(*) from latest where status = 'failed') - 5, 0) as more
  from latest where status = 'failed' order by media_id limit 5
""")
def first_failures(spark, sf):
    return runs.first_failures(fx.run_log(spark, sf))


@query(f"""
  with {_LATEST},
  totals as (
    select avg(cast(round(processing_s * 100) as bigint)) filter (where status = 'completed') / 100 as mean_s,
           count(*) filter (where status = 'queued') as queued,
           max(ts_ms) filter (where status = 'processing') as since
    from latest
  ), times as (
    select *, (1706659200000 - since) / 1000::double as elapsed from totals
  )
  select case when coalesce(mean_s, elapsed) * queued + (coalesce(mean_s, elapsed) - elapsed) > 0
              then coalesce(mean_s, elapsed) * queued + (coalesce(mean_s, elapsed) - elapsed) end as remaining_s
  from times
""")
def remaining_time(spark, sf):
    # the end of 30 January 2024, when the given events end
    return runs.eta(fx.run_log(spark, sf), 1_706_659_200_000)


_STAGES = ["conversion", "transcription", "processing", "subtitles", "total"]


def _runs(spark, sf):
    e = F.col("event_id")
    parts = [((e % m) + m).cast("double") for m in (3, 17, 5, 7)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    timings = F.struct(*[p.alias(n) for p, n in zip([*parts, total], _STAGES)])
    return fx.table(spark, sf, "events").select(e.alias("media_id"), timings.alias("timings"))


@query("""
  with t as (
    select unnest(['conversion', 'transcription', 'processing', 'subtitles', 'total']) as stage,
           unnest([a, b, c, d, a + b + c + d])::double as s
    from (select event_id % 3 + 3 as a, event_id % 17 + 17 as b, event_id % 5 + 5 as c, event_id % 7 + 7 as d from events)
  )
  select stage, count(*) as runs, avg(s) as mean_s, max(s) as max_s, quantile_disc(s, 0.5) as median_s from t group by 1
""")
def stage_timings(spark, sf):
    return runs.stage_timings(_runs(spark, sf), _STAGES)


@query("""
  select path, arrival, page_id from (
    select regexp_replace(path, '[0-9]+(\\.[a-z]+)?\\.', 'n.') as path, page_id as arrival, page_id,
           row_number() over (partition by regexp_replace(path, '[0-9]+(\\.[a-z]+)?\\.', 'n.') order by page_id) as rn
    from listing)
  where rn = 1
""")
def deduped_queue(spark, sf):
    path = F.regexp_replace("path", r"[0-9]+(\.[a-z]+)?\.", "n.")
    adds = fx.listing(spark, sf).select(path.alias("path"), F.col("page_id").alias("arrival"), "page_id")
    return runs.dedupe_queue(adds)


@query(f"""
  with {_LATEST} select media_id, ts_ms from latest where status = 'queued' order by ts_ms, media_id limit 1
""")
def next_queued(spark, sf):
    return runs.next_queued(fx.run_log(spark, sf))
