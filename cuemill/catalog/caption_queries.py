"""Cues."""

from pyspark.sql import functions as F

from cuemill import fixtures as fx
from cuemill.catalog import query
from cuemill.functions.layout import balanced_lines, middle_lines, pack_captions
from cuemill.operators import cues as ops

_KEY = "trim(lower(word), '.,!?;:¡¿')"

_KEPT = f"""
  kept as (
    select media_id, seq, word, start_ms, end_ms
    from (select *, row_number() over (partition by media_id, run order by seq) as nth
          from (select *, sum(case when key <> '' and key = before then 0 else 1 end)
                            over (partition by media_id order by seq) as run
                from (select *, {_KEY} as key, lag({_KEY}) over (partition by media_id order by seq) as before from words)))
    where nth <= 3
  )
"""

_BREAKS = "\n".join(
    f"""              when lead(end_ms, {k}) over w is null or lead(end_ms, {k}) over w - start_ms > 7000
                   or lead(upto, {k}) over w - upto + length(word) > 84
                   or lead(start_ms, {k}) over w - lead(end_ms, {k - 1}) over w > 300 then {k}"""
    for k in range(1, 10)
)

# cue starts are followed from the first word after every pause
_CUES = f"""
  {_KEPT},
  sized as (
    select *, sum(length(word) + 1) over (partition by media_id order by seq) as upto,
           row_number() over (partition by media_id order by seq) as pos,
           coalesce(start_ms - lag(end_ms) over (partition by media_id order by seq) > 300, true) as after_pause
    from kept
  ), jumps as (
    select *, sum(after_pause::int) over (partition by media_id order by seq) as island, case
{_BREAKS}
              else 10 end as n
    from sized window w as (partition by media_id order by seq)
  ), starts as (
    select media_id, island, pos, n from jumps where after_pause
    union all
    select j.media_id, j.island, j.pos, j.n from starts s join jumps j
      on j.media_id = s.media_id and j.island = s.island and j.pos = s.pos + s.n
  ), numbered as (
    select j.*, sum(case when s.pos is null then 0 else 1 end) over (partition by j.media_id order by j.pos) - 1 as cue_idx
    from jumps j left join starts s on s.media_id = j.media_id and s.pos = j.pos
  ), raw_cues as (
    select media_id, cast(cue_idx as bigint) as cue_idx, min(start_ms) as start_ms, max(end_ms) as end_ms,
           string_agg(word, ' ' order by pos) as text
    from numbered group by 1, 2
  ), cues as (
    select media_id, cue_idx, start_ms, text,
           case when end_ms - start_ms >= 500 then end_ms
                else greatest(end_ms, least(start_ms + 500,
                     lead(start_ms) over (partition by media_id order by cue_idx) - 50)) end as end_ms
    from raw_cues
  )
"""


@query(f"with {_KEPT} select * from kept")
def capped_word_runs(spark, sf):
    words = fx.words(spark, sf).select("media_id", "seq", "word", "start_ms", "end_ms")
    return ops.cap_word_runs(words)


def cues_of_words(spark, sf):
    return ops.words_to_cues(capped_word_runs(spark, sf))


@query(f"with {_CUES} select * from cues", recursive=True)
def word_cues(spark, sf):
    return cues_of_words(spark, sf)


@query(f"""
  with {_CUES}
  select media_id, count(*) as cues, avg(end_ms - start_ms) as mean_ms from cues group by 1
""", recursive=True)
def cues_per_media(spark, sf):
    return cues_of_words(spark, sf).groupBy("media_id").agg(
        F.count("*").alias("cues"), F.avg(F.col("end_ms") - F.col("start_ms")).alias("mean_ms")
    )


@query("""
  select media_id, cue_idx, start_ms, text,
         case when end_ms - start_ms >= 500 then end_ms
              else greatest(end_ms, least(start_ms + 500,
                   lead(start_ms) over (partition by media_id order by cue_idx) - 50)) end as end_ms
  from (select media_id, seq as cue_idx, start_ms, end_ms, word as text from words)
""")
def minimum_duration(spark, sf):
    words = fx.words(spark, sf)
    cues = words.select("media_id", F.col("seq").alias("cue_idx"), "start_ms", "end_ms", F.col("word").alias("text"))
    return ops.min_duration(cues)


# caption texts of every segment: words are packed one after the other
_PACKED = """
  seg_words as (
    select media_id, seg_idx, word_idx, word, length(word) as len,
           sum(length(word) + 1) over (partition by media_id, seg_idx order by word_idx) as upto
    from words
  ), places as (
    select a.media_id, a.seg_idx, a.word_idx, min(b.word_idx) as following
    from seg_words a left join seg_words b
      on a.media_id = b.media_id and a.seg_idx = b.seg_idx and b.word_idx > a.word_idx
     and b.word_idx <= a.word_idx + 84 and b.upto - a.upto + a.len > 84
    group by 1, 2, 3
  ), first_words as (
    select media_id, seg_idx, word_idx, following from places where word_idx = 0
    union all
    select p.media_id, p.seg_idx, p.word_idx, p.following from first_words f join places p
      on p.media_id = f.media_id and p.seg_idx = f.seg_idx and p.word_idx = f.following
  ), captions as (
    select media_id, seg_idx, part, string_agg(word, ' ' order by word_idx) as text
    from (select w.*, sum(case when f.word_idx is null then 0 else 1 end)
                        over (partition by w.media_id, w.seg_idx order by w.word_idx) - 1 as part
          from seg_words w left join first_words f using (media_id, seg_idx, word_idx))
    group by 1, 2, 3
  )
"""

# place of every space in a caption text, and the lengths of both sides
_PLACES = """
  places2 as (
    select media_id, seg_idx, part, text, i as place, i - 1 as first_len, length(text) - i as second_len
    from (select *, unnest(range(1, length(text) + 1)) as i from captions) where text[i] = ' '
  )
"""


@query(f"""
  with {_PACKED} select media_id, cast(seg_idx as integer) as seg_idx, cast(part as integer) as part, text from captions
""", recursive=True)
def packed_captions(spark, sf):
    return _caption_texts(spark, sf)


def _caption_texts(spark, sf):
    segments = fx.plain_segments(spark, sf)
    return segments.select("media_id", "seg_idx", F.posexplode(pack_captions(F.col("text"))).alias("part", "text"))


# caption texts on two lines, as even as they can be
_BALANCED = f"""
  {_PACKED}, {_PLACES},
  best as (
    select media_id, seg_idx, part, min((abs(first_len - second_len), place)) as pick
    from places2 where first_len <= 42 and second_len <= 42 group by 1, 2, 3
  ), half as (
    select media_id, seg_idx, part, list(place order by place)[cast((count(*) + 1) // 2 as bigint)] as place
    from places2 group by 1, 2, 3
  ), chosen as (
    select c.*, coalesce(b.pick[2], h.place) as cut_at
    from captions c left join best b using (media_id, seg_idx, part) left join half h using (media_id, seg_idx, part)
  ), balanced as (
    select media_id, cast(seg_idx as integer) as seg_idx, cast(part as integer) as part,
           case when length(text) <= 42 or cut_at is null then text
                else left(text, cut_at - 1) || '\\N' || substr(text, cut_at + 1) end as text
    from chosen
  )
"""


@query(f"with {_BALANCED} select * from balanced", recursive=True)
def balanced_captions(spark, sf):
    return _caption_texts(spark, sf).withColumn("text", balanced_lines(F.col("text")))


def _timed(least, most):
    """Segment times shared among the segment's caption texts."""
    return f"""
  with {_BALANCED}, timed as (
    select media_id, cast(seg_idx as integer) as seg_idx, start_ms, greatest(end_ms - start_ms, 1500, 400 * n_words) as len from segs
  ), shared as (
    select b.*, t.start_ms as first_ms, len, n, least(greatest(len // n, {least}), {most}) as share
    from balanced b join timed t using (media_id, seg_idx)
      join (select media_id, seg_idx, count(*) as n from balanced group by 1, 2) using (media_id, seg_idx)
  )
  select media_id, seg_idx, part, first_ms + part * share as start_ms,
         case when n = 1 then first_ms + least(greatest(len, {least}), {most})
              when part = n - 1 then first_ms + len
              else least(first_ms + (part + 1) * share, first_ms + len) end as end_ms, text
  from shared"""


@query(_timed(500, 7000), recursive=True)
def estimated_cues(spark, sf):
    return ops.segment_cues(fx.plain_segments(spark, sf))


@query(_timed(800, 2500), recursive=True)
def short_segment_cues(spark, sf):
    """Cues of all segments, none but the last of a segment longer than 2.5 s."""
    return ops.segment_cues(fx.plain_segments(spark, sf), min_ms=800, max_ms=2500)


@query(f"""
  with {_PACKED}, {_PLACES},
  best as (
    select media_id, seg_idx, part, min((abs(place - length(text) // 2), place)) as pick from places2 group by 1, 2, 3
  ), chosen as (
    select c.*, b.pick[2] as cut_at from captions c left join best b using (media_id, seg_idx, part)
  )
  select media_id, cast(seg_idx as integer) as seg_idx, cast(part as integer) as part,
         case when length(text) <= 42 or cut_at is null or cut_at - 1 > 42 or length(text) - cut_at > 42 then text
              else left(text, cut_at - 1) || '\\N' || substr(text, cut_at + 1) end as text
  from chosen
""", recursive=True)
def middle_captions(spark, sf):
    return _caption_texts(spark, sf).withColumn("text", middle_lines(F.col("text")))


# cues of every rule's kind: segments, with a third of them crowded into a short time
_NOISE = """
  noise as (
    select media_id, seg_idx as cue_idx, start_ms, start_ms + case when seg_idx % 3 = 0 then 900 else 4000 end as end_ms,
           case media_id % 6 when 1 then 'whoa, ' || repeat('Whoa ', cast(n_words as integer)) || '-'
                when 2 then repeat('come on, ', 6) || left(text, 6)
                when 3 then 'O' || repeat('-o', cast(n_words as integer))
                when 4 then repeat('o', 15) || left(text, 12)
                else text end as text
    from segs
  )
"""


def noise_cues(spark, sf):
    n = F.size("words")
    kind = F.col("media_id") % 6
    text = (
        F.when(kind == 1, F.concat(F.lit("whoa, "), F.expr("repeat('Whoa ', n)"), F.lit("-")))
        .when(kind == 2, F.concat(F.expr("repeat('come on, ', 6)"), F.left("text", F.lit(6))))
        .when(kind == 3, F.concat(F.lit("O"), F.expr("repeat('-o', n)")))
        .when(kind == 4, F.concat(F.expr("repeat('o', 15)"), F.left("text", F.lit(12))))
        .otherwise(F.col("text"))
    )
    rows = fx.segments(spark, sf).withColumn("n", n)
    return rows.select(
        "media_id",
        F.col("seg_idx").alias("cue_idx"),
        "start_ms",
        (F.col("start_ms") + F.when(F.col("seg_idx") % 3 == 0, 900).otherwise(4000)).alias("end_ms"),
        text.alias("text"),
    )



def flagged(source, tag=""):
    """CTEs that name the rule each row of source breaks: flagged<tag>."""
    return f"""
  tok{tag} as (
    select media_id, cue_idx, w, trim(lower(w), '.,!?;:¡¿…-') as key, trim(lower(w), '.,!?;:¡¿…') as core
    from (select media_id, cue_idx, unnest(string_split_regex(trim(text), '\\s+')) as w from {source}) where w <> ''
  ), by_key{tag} as (
    select media_id, cue_idx, key, count(*) as c from tok{tag} where key <> '' group by 1, 2, 3
  ), keys{tag} as (
    select media_id, cue_idx, cast(sum(c) as bigint) as n, count(*) as distinct_n,
           list_sum(list(c order by c desc)[1:2]) as top2
    from by_key{tag} group by 1, 2
  ), loops{tag} as (
    select media_id, cue_idx, sum(length(w)) as total,
           sum(case when length(core) >= 12 and (select bool_or((length(core) - t) % u = 0 and (length(core) - t) // u >= 4
                              and left(core, length(core) - t) = repeat(left(core, u), (length(core) - t) // u))
                         from (values (1), (2), (3)) a(u), (values (0), (1), (2), (3)) b(t))
                    then length(w) else 0 end) as looped
    from tok{tag} group by 1, 2
  ), chars{tag} as (
    select media_id, cue_idx, max(c) as top_char, sum(c) as n_char
    from (select media_id, cue_idx, ch, count(*) as c
          from (select media_id, cue_idx, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]')) as ch from {source})
          group by 1, 2, 3)
    group by 1, 2
  ), flagged{tag} as (
    select z.media_id, z.cue_idx, z.start_ms, z.end_ms, z.text, coalesce(k.n, 0) as n_keys,
           case when n >= 8 and distinct_n <= 2 then 'repetition wall'
                when n >= 12 and top2 * 10 >= n * 9 then 'two words'
                when looped * 2 >= total then 'character loop'
                when n_char >= 15 and top_char * 5 >= n_char * 3 then 'one character'
                when length(z.text) * 20 > z.end_ms - z.start_ms and n >= 8 then 'density' end as rule
    from {source} z left join keys{tag} k using (media_id, cue_idx) left join loops{tag} using (media_id, cue_idx)
         left join chars{tag} using (media_id, cue_idx)
  )
"""


_FLAGGED = f"{_NOISE}, {flagged('noise')}"


@query(f"with {_FLAGGED} select media_id, cast(cue_idx as integer) as cue_idx, start_ms, end_ms, text, rule from flagged")
def flagged_cues(spark, sf):
    return ops.flag_degenerate(noise_cues(spark, sf))


@query(f"with {_FLAGGED} select media_id, cast(cue_idx as integer) as cue_idx, start_ms, end_ms, text from flagged where rule is null")
def kept_cues(spark, sf):
    return ops.drop_degenerate(noise_cues(spark, sf))


@query(f"""
  with {_FLAGGED},
  counted as (
    select *, len(list_filter(string_split_regex(trim(text), ' +'), lambda x: x <> '')) as n from flagged
  )
  select media_id, count(*) as cues, cast(sum(n) as bigint) as words_before,
         cast(coalesce(sum(n) filter (where rule is null), 0) as bigint) as words_after,
         count(*) filter (where rule = 'repetition wall') as walls,
         count(*) filter (where rule = 'two words') as two_words,
         count(*) filter (where rule = 'character loop') as loops,
         count(*) filter (where rule = 'one character') as one_character,
         count(*) filter (where rule = 'density') as dense
  from counted group by 1
""")
def cleaning_report(spark, sf):
    return ops.cleaning_report(noise_cues(spark, sf))


@query("""
  select media_id, count(*) as cues, count(*) filter (where over_ms > 0) as overlapping,
         cast(coalesce(sum(over_ms), 0) as bigint) as overlap_ms
  from (select media_id, greatest(end_ms + 200 - lead(start_ms) over (partition by media_id order by seq), 0) as over_ms from words)
  group by 1
""")
def cue_overlaps(spark, sf):
    words = fx.words(spark, sf)
    cues = words.select("media_id", F.col("seq").alias("cue_idx"), "start_ms", (F.col("end_ms") + 200).alias("end_ms"))
    return ops.overlap_report(cues)
