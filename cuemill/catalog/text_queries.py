"""Text stages of the transcript job."""

from pyspark.sql import functions as F

from cuemill import fixtures as fx
from cuemill.catalog import query
from cuemill.functions import cleaning, lexicon
from cuemill.functions.repetition import collapse_repetitions
from cuemill.functions.text import comparison_key, token_count, tokens
from cuemill.operators import cues
from cuemill.operators.language import carry_language, detect_language, language_profiles
from cuemill.operators.overlap import find_overlaps, merge_chunk_texts, overlap_stats
from cuemill.plans.transcript import clean_transcripts, transcript_paragraphs, transcripts_from_chunks
from cuemill.session import stored

_WORD = r"[\p{L}\p{N}_]"
_NOT = r"[^\p{L}\p{N}_]"


def _texts(spark, sf):
    return fx.plain_segments(spark, sf).select("media_id", "seg_idx", "language", "text")


def _staged(spark, sf, stage):
    return _texts(spark, sf).select("media_id", "seg_idx", stage(F.col("text")).alias("text"))


def _sql(expression, source="segs"):
    return f"select media_id, cast(seg_idx as integer) as seg_idx, {expression} as text from {source}"


# repeated lines stress the collapse: every text is said again in part
_ECHO = """
  echo as (select media_id, seg_idx, text || repeat(' ' || array_to_string(string_split(text, ' ')[1:3], ' '), 3) as text from segs)
"""


# runs of repeated words and phrases that are shortened
_TAKEN = """
  k as (
    select media_id, seg_idx, pos, w, trim(lower(w), '.,!?;:¡¿') as key, count(*) over (partition by media_id, seg_idx) as n
    from (select media_id, seg_idx, unnest(string_split(text, ' ')) as w,
                 generate_subscripts(string_split(text, ' '), 1) - 1 as pos from echo)
  ), same as (
    select k.*, p, lead(key, p) over (partition by media_id, seg_idx, p order by pos) = key and key <> '' as eq
    from k, range(1, 6) t(p)
  ), runs as (
    select *, sum(case when eq then 0 else 1 end) over (partition by media_id, seg_idx, p order by pos) as run from same
  ), lengths as (
    select *, count(*) over (partition by media_id, seg_idx, p, run, coalesce(eq, false) order by pos desc) as r,
           max(key) over (partition by media_id, seg_idx, p order by pos rows between current row and 4 following) as hi
    from runs
  ), uniform as (
    select media_id, seg_idx, pos, u from (
      select media_id, seg_idx, pos,
             count(*) over (partition by media_id, seg_idx, island order by pos desc) as u
      from (select *, sum(case when key = before then 0 else 1 end) over (partition by media_id, seg_idx order by pos) as island
            from (select *, lag(key) over (partition by media_id, seg_idx order by pos) as before from k)))
  ), candidates as (
    select l.media_id, l.seg_idx, l.pos, max(l.p) as p, arg_max(l.r // l.p + 1, l.p) as times
    from lengths l join uniform u using (media_id, seg_idx, pos)
    where l.eq and l.n >= 4 and l.r // l.p + 1 > case when l.p = 1 then 3 else 2 end and (l.p = 1 or u.u < l.p)
    group by 1, 2, 3
  ), ranked as (
    select *, row_number() over (partition by media_id, seg_idx order by pos) as rank from candidates
  ), taken as (
    select media_id, seg_idx, rank, pos, p, times, true as used, pos + p * times as free from ranked where rank = 1
    union all
    select r.media_id, r.seg_idx, r.rank, r.pos, r.p, r.times, r.pos >= t.free,
           case when r.pos >= t.free then r.pos + r.p * r.times else t.free end
    from taken t join ranked r on r.media_id = t.media_id and r.seg_idx = t.seg_idx and r.rank = t.rank + 1
  )
"""


@query(f"""
  with {_ECHO}, {_TAKEN}, removed as (
    select media_id, seg_idx, unnest(range(pos + p * (case when p = 1 then 3 else 2 end), pos + p * times)) as pos
    from taken where used
  )
  select k.media_id, cast(k.seg_idx as integer) as seg_idx, string_agg(k.w, ' ' order by k.pos) as text
  from k left join removed r using (media_id, seg_idx, pos) where r.pos is null group by 1, 2
""", recursive=True)
def collapsed_repetitions(spark, sf):
    rows = _echoed(spark, sf)
    return rows.select("media_id", "seg_idx", collapse_repetitions(F.col("text")).alias("text"))


def _echoed(spark, sf):
    head = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    echo = F.concat("text", *[F.lit(" "), head] * 3)
    return _texts(spark, sf).withColumn("text", echo)


_RUNS = f"""
  with {_ECHO}, {_TAKEN}, found as (
    select media_id, seg_idx, pos, p, times, p * (times - case when p = 1 then 3 else 2 end) as dropped from taken where used
  )
"""


@query(f"""
  {_RUNS}
  select media_id, cast(seg_idx as integer) as seg_idx, cast(pos as integer) as from_word, cast(p as integer) as phrase_words,
         cast(times as integer) as copies, cast(dropped as integer) as dropped_words
  from found
""", recursive=True)
def repetition_runs(spark, sf):
    return cues.repetition_runs(_echoed(spark, sf), ["seg_idx"])


@query(f"""
  {_RUNS}
  select media_id, count(*) as runs, count(*) filter (where p = 1) as word_runs, count(*) filter (where p > 1) as phrase_runs,
         cast(max(times) as integer) as most_copies, cast(sum(dropped) as bigint) as dropped_words
  from found group by 1
""", recursive=True)
def collapse_report(spark, sf):
    return cues.collapse_report(_echoed(spark, sf))


@query(_sql(r"regexp_replace(lower(text), '[^\p{L}\p{N}_ ]', '', 'g')"))
def comparison_keys(spark, sf):
    return _staged(spark, sf, comparison_key)


@query(_sql(r"regexp_replace(regexp_replace(text || ' [noise] x (cough) end', '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g')"))
def basic_clean(spark, sf):
    return _staged(spark, sf, lambda t: cleaning.basic_clean(F.concat(t, F.lit(" [noise]  x (cough) end "))))


_EXPAND = "text || ' I''m gonna go, kinda. Cause we wanna'"
for _spoken, _written in lexicon.CONTRACTIONS.items():
    _EXPAND = f"regexp_replace({_EXPAND}, '(?i)(^|{_NOT}){_spoken}($|{_NOT})', '\\1{_written}\\2', 'g')"


@query(_sql(_EXPAND))
def expanded_contractions(spark, sf):
    return _staged(spark, sf, lambda t: cleaning.expand_contractions(F.concat(t, F.lit(" I'm gonna go, kinda. Cause we wanna"))))


_FILLER_LIST = ", ".join(f"'{f}'" for f in lexicon.FILLERS if " " not in f)


@query(f"""
  select media_id, cast(seg_idx as integer) as seg_idx, coalesce(string_agg(word, ' ' order by word_idx)
           filter (where trim(lower(word), '.,!?') not in ({_FILLER_LIST})), '') as text
  from words group by 1, 2
""")
def fillers_removed(spark, sf):
    return _staged(spark, sf, cleaning.remove_fillers)


@query(f"""
  with said as (select media_id, count(*) as n from words group by 1)
  select media_id, trim(lower(word), '.,!?') as filler, count(*) as uses, count(*) * 100.0::double / min(n) as per_100_words
  from words join said using (media_id) where trim(lower(word), '.,!?') in ({_FILLER_LIST}) group by 1, 2
""")
def filler_report(spark, sf):
    return report_fillers(_texts(spark, sf))


def report_fillers(texts):
    """Uses of every filler per media, and per 100 words."""
    said = texts.groupBy("media_id").agg(F.sum(token_count(F.col("text"))).alias("n"))
    found = texts.select("media_id", F.explode_outer(cleaning.fillers_in(F.col("text"))).alias("filler"))
    uses = found.filter("filler is not null").groupBy("media_id", "filler").agg(F.count("*").alias("uses"))
    rate = F.col("uses") * 100.0 / F.col("n")
    return uses.join(said, "media_id").select("media_id", "filler", "uses", rate.alias("per_100_words"))


_COMMAS = r"""
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' x , , and y so z,.', '\s+(and|but|or|yet|so)\s+', ', \1 ', 'g'),
    '^(However|Therefore|Moreover|Furthermore|Meanwhile|Nevertheless|Consequently|Thus)', '\1,'), ',\s*,', ',', 'g'), ',\.', '.', 'g')
"""


@query(_sql(_COMMAS))
def added_commas(spark, sf):
    return _staged(spark, sf, lambda t: cleaning.add_commas(F.concat(t, F.lit(" x , , and y so z,."))))


_NOUNS = ", ".join(f"'{w}'" for w in lexicon.PROPER_NOUNS)
_ABBR = ", ".join(f"'{w}'" for w in lexicon.ABBREVIATIONS)


@query(f"""
  select media_id, seq, case
           when key in ({_NOUNS}) then upper(left(core, 1)) || lower(substr(core, 2)) || mark
           when key in ({_ABBR}) then upper(core) || mark else word end as word
  from (select *, trim(lower(word), '.,!?') as key,
               case when right(word, 1) in ('.', ',', '!', '?') then left(word, length(word) - 1) else word end as core,
               case when right(word, 1) in ('.', ',', '!', '?') then right(word, 1) else '' end as mark
        from (select media_id, seq, case seq % 50 when 7 then 'monday,' when 9 then 'eu.' when 30 then 'YouTube' else word end as word
              from words))
""")
def lexicon_case(spark, sf):
    n = F.col("seq") % 50
    word = F.when(n == 7, "monday,").when(n == 9, "eu.").when(n == 30, "YouTube").otherwise(F.col("word"))
    rows = fx.words(spark, sf).select("media_id", "seq", word.alias("word"))
    return rows.withColumn("word", cleaning.lexicon_case(F.col("word")))


_POLISH = r"""
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    text || ' , "  quoted "  text.Next', '\s+([.,!?])', '\1', 'g'), '([.,!?])([A-Z])', '\1 \2', 'g'),
    '([.,!?])\s+', '\1 ', 'g'), '"\s+', '"', 'g'), '\s+"', '"', 'g'), '\s+', ' ', 'g'))
"""


@query(_sql(_POLISH))
def polished(spark, sf):
    return _staged(spark, sf, lambda t: cleaning.polish(F.concat(t, F.lit(' , "  quoted "  text.Next'))))


_SENTENCES = r"""
  sents as (
    select media_id, seg_idx, language, unnest(parts) as s, generate_subscripts(parts, 1) - 1 as i
    from (select media_id, seg_idx, language,
                 string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) as parts from segs)
  )
"""


@query(rf"""
  with {_SENTENCES},
  bad as (
    select media_id, seg_idx, min(i) filter (where not (regexp_matches(s, '^\p{{Lu}}') and right(s, 1) in ('.', '!', '?')
                                               and strpos(s, ' ') > 0)) as first_bad
    from sents group by 1, 2
  )
  select media_id, cast(seg_idx as integer) as seg_idx,
         coalesce(string_agg(s, ' ' order by i) filter (where first_bad is null or i < first_bad), '') as formatted,
         coalesce(string_agg(s, ' ' order by i) filter (where i >= first_bad), '') as unformatted
  from sents join bad using (media_id, seg_idx) group by 1, 2
""")
def formatting_breaks(spark, sf):
    rows = _texts(spark, sf).withColumn("b", cleaning.formatting_break(F.col("text")))
    return rows.select("media_id", "seg_idx", "b.formatted", "b.unformatted")


_STARTERS = ", ".join(f"'{w}'" for w in lexicon.QUESTION_STARTERS)
_I = rf"regexp_replace(regexp_replace(s, '(^|{_NOT})i($|{_NOT})', '\1I\2', 'g'), '(^|{_NOT})i($|{_NOT})', '\1I\2', 'g')"


@query(rf"""
  with {_SENTENCES}
  select media_id, cast(seg_idx as integer) as seg_idx, cast(i as integer) as sentence_idx,
         case when right(t, 1) in ('.', '!', '?') then t
              when language <> 'en' then t || '.'
              when lower(string_split(t, ' ')[1]) in ({_STARTERS}) then t || '?'
              when regexp_matches(lower(t), 'amazing|awesome|fantastic|terrible') then t || '!'
              else t || '.' end as text
  from (select *, case when language = 'en' then {_I} else s end as t
        from (select media_id, seg_idx, i, language, upper(left(s, 1)) || substr(s, 2) as s from sents))
""")
def formatted_sentences(spark, sf):
    from cuemill.functions.text import sentences

    rows = _texts(spark, sf).select(
        "media_id", "seg_idx", "language", F.posexplode_outer(sentences(F.col("text"))).alias("sentence_idx", "text")
    )
    fixed = cleaning.format_sentence(F.col("text"), cleaning.is_english(F.col("language")))
    return rows.select("media_id", "seg_idx", "sentence_idx", fixed.alias("text"))


@query("""
  select language, count(*) as texts, cast(sum(case when language like 'en%' then 1 else 0 end) as bigint) as english
  from segs group by 1
""")
def language_gate(spark, sf):
    english = cleaning.is_english(F.col("language"))
    return _texts(spark, sf).groupBy("language").agg(F.count("*").alias("texts"), F.sum(english.cast("int")).alias("english"))


def _transcripts(spark, sf):
    from cuemill.operators.timeline import assemble_text

    segments = fx.plain_segments(spark, sf)
    language = segments.groupBy("media_id").agg(F.first("language").alias("language"))
    return assemble_text(segments).join(language, "media_id")


# sentences of whole transcripts; cuts are followed from each transcript's first one
_SPOKEN = r"""
  spoken as (
    select media_id, size, unnest(parts) as s, generate_subscripts(parts, 1) - 1 as i, len(parts) as n
    from (select media_id, length(text) as size,
                 string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) as parts
          from (select media_id, string_agg(text, ' ' order by seg_idx) as text from segs group by 1))
  )
"""


def _followed(jumps, keys, at, following):
    """CTEs that follow jumps from position 0 to the one named by each, and number the stretches between them."""
    same = " and ".join(f"j.{k} = c.{k}" for k in keys.split(", "))
    return f"""
  cuts as (
    select {keys}, {at}, {following} from {jumps} where {at} = 0
    union all
    select {", ".join("j." + k for k in keys.split(", "))}, j.{at}, j.{following} from cuts c join {jumps} j on {same} and j.{at} = c.{following}
  ), stretches as (
    select j.*, sum(case when c.{at} is null then 0 else 1 end) over (partition by {", ".join("j." + k for k in keys.split(", "))} order by j.{at}) - 1 as stretch
    from {jumps} j left join cuts c on {same} and j.{at} = c.{at}
  )
"""


@query(f"""
  with {_SPOKEN}, sized as (
    select *, sum(length(s)) over (partition by media_id order by i) as upto from spoken
  ), limits as (
    select *, upto - length(s) + 2000 as most from sized
  ), jumps as (
    select a.media_id, a.s, a.i, case when a.size > 2000 and b.i is not null then greatest(b.i, a.i + 1) end as following
    from limits a asof left join sized b on a.media_id = b.media_id and a.most < b.upto
  ), {_followed("jumps", "media_id", "i", "following")}
  select media_id, cast(stretch as integer) as piece, string_agg(s, ' ' order by i) as text from stretches group by 1, 2
""", recursive=True)
def sentence_pieces(spark, sf):
    pieces = cleaning.pack_sentences(F.col("text"), 2000)
    return _transcripts(spark, sf).select("media_id", F.posexplode_outer(pieces).alias("piece", "text"))


# words and what stands between them; of equal words with only white space between them every second one goes
@query(rf"""
  with parts as (
    select media_id, seg_idx, unnest(parts) as part, generate_subscripts(parts, 1) as i
    from (select media_id, seg_idx, regexp_extract_all(text, '{_WORD}+|{_NOT}+') as parts from segs)
  ), named as (
    select *, regexp_matches(part, '^{_WORD}') as is_word, lag(part) over w as between_them, lag(part, 2) over w as before
    from parts window w as (partition by media_id, seg_idx order by i)
  ), runs as (
    select *, sum(case when lower(part) = lower(before) and regexp_full_match(between_them, '\s+') then 0 else 1 end)
                over (partition by media_id, seg_idx order by i) as run
    from named where is_word
  ), dropped as (
    select media_id, seg_idx, i from (select *, row_number() over (partition by media_id, seg_idx, run order by i) as nth from runs)
    where nth % 2 = 0
  )
  select p.media_id, cast(p.seg_idx as integer) as seg_idx, coalesce(string_agg(part, '' order by p.i) filter (where d.i is null), '') as text
  from parts p left join dropped d on p.media_id = d.media_id and p.seg_idx = d.seg_idx and p.i in (d.i, d.i - 1)
  group by 1, 2
""")
def doubled_words(spark, sf):
    return _staged(spark, sf, cleaning.drop_doubled_words)


_CONTRAST = ", ".join(f"'{w}'" for w in lexicon.CONTRAST_WORDS)
_PRONOUN = ", ".join(f"'{w}'" for w in lexicon.PRONOUNS)


@query(f"""
  with placed as (
    select media_id, seg_idx, word_idx as i, word, count(*) over (partition by media_id, seg_idx) as n,
           case when lower(word) in ({_CONTRAST}) then word_idx end as contrast,
           case when lower(word) in ({_CONTRAST}, {_PRONOUN}) then word_idx end as either
    from words
  ), jumps as (
    select media_id, seg_idx, i, word, n,
           coalesce(min(contrast) over (partition by media_id, seg_idx order by i rows between 9 following and 15 following),
                    min(either) over (partition by media_id, seg_idx order by i rows between 16 following and 25 following),
                    case when i + 26 <= n then i + 26 end) as following
    from placed
  ), {_followed("jumps", "media_id, seg_idx", "i", "following")},
  said as (
    select media_id, seg_idx, stretch, string_agg(word, ' ' order by i) as s, arg_min(word, i) as first_word,
           arg_min(following, i) is not null as complete
    from stretches group by 1, 2, 3
  )
  select media_id, cast(seg_idx as integer) as seg_idx, string_agg(case
           when right(s, 1) in ('.', '!', '?') then s
           when complete and lower(first_word) in ({_STARTERS}, 'had') then s || '?' else s || '.' end, ' ' order by stretch) as text
  from said group by 1, 2
""", recursive=True)
def broken_sentences(spark, sf):
    return _staged(spark, sf, cleaning.break_sentences)


_TURN = " or ".join(f"starts_with(s, '{w}')" for w in lexicon.TRANSITIONS)


@query(f"""
  with {_SPOKEN}, turns as (
    select *, case when {_TURN} then i end as turn from spoken
  ), jumps as (
    select media_id, i, s, coalesce(min(turn) over (partition by media_id order by i rows between 3 following and 4 following),
                                    case when i + 5 < n then i + 5 end) as following
    from turns
  ), {_followed("jumps", "media_id", "i", "following")}
  select media_id, cast(stretch as integer) as para_idx, string_agg(s, ' ' order by i) as text from stretches group by 1, 2
""", recursive=True)
def paragraphs(spark, sf):
    return transcript_paragraphs(_transcripts(spark, sf))


@query()
def clean_transcript_job(spark, sf):
    return clean_transcripts(_transcripts(spark, sf))


# --- chunk texts -----------------------------------------------------------------

_EXACT = r"""
  tok as (
    select t.media_id, t.chunk_idx, coalesce(c.has_start_overlap, true) as shares,
           list_transform(string_split(t.text, ' '), lambda w: lower(regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g'))) as k,
           string_split(t.text, ' ') as w
    from chunk_texts t left join chunks c using (media_id, chunk_idx)
  ), pairs as (
    select *, lag(k) over (partition by media_id order by chunk_idx) as before from tok
  ), cuts as (
    select media_id, chunk_idx, w, coalesce((
             select min(n) from range(3, least(50, len(k), len(before)) + 1) r(n)
             where list_slice(before, len(before) - n + 1, len(before)) = list_slice(k, 1, n)), 0) as removed, shares
    from pairs
  ), removed_words as (
    select media_id, chunk_idx, w, case when shares then removed else 0 end as removed from cuts
  )
"""


@query(f"""
  with {_EXACT} select media_id, chunk_idx, cast(removed as integer) as removed from removed_words
""")
def chunk_overlaps(spark, sf):
    return find_overlaps(fx.chunk_texts(spark, sf), fx.chunks(spark, sf), scorer="exact")


@query(f"""
  with {_EXACT}
  select media_id, string_agg(array_to_string(w[removed + 1:], ' '), ' ' order by chunk_idx)
                     filter (where len(w) > removed) as text
  from removed_words group by 1
""")
def merged_chunk_texts(spark, sf):
    # read for the overlaps and for the texts
    texts = stored(fx.chunk_texts(spark, sf))
    return merge_chunk_texts(texts, find_overlaps(texts, fx.chunks(spark, sf), scorer="exact"))


@query(f"""
  with {_EXACT}
  select media_id, count(*) as chunks, count(*) filter (where removed > 0) as "overlaps",
         cast(sum(removed) as bigint) as words_removed, (count(*) - 1) * 2500 as expected_overlap_ms,
         (count(*) - 1) * 5000 as shared_ms
  from removed_words group by 1
""")
def overlap_statistics(spark, sf):
    return overlap_stats(find_overlaps(fx.chunk_texts(spark, sf), fx.chunks(spark, sf), scorer="exact"))


@query(f"""
  with {_EXACT}, ends as (
    select media_id, chunk_idx, n, array_to_string(list_slice(before, len(before) - n + 1, len(before)), ' ') as l,
           array_to_string(list_slice(k, 1, n), ' ') as r
    from (select *, unnest(range(3, least(50, len(k), len(before)) + 1)) as n from pairs where before is not null)
  ), best as (
    select media_id, chunk_idx, min((-(greatest(length(l), length(r)) - levenshtein(l, r)) / greatest(length(l), length(r)), n)) as pick
    from ends group by all
  )
  select media_id, chunk_idx,
         cast(case when not shares then 0 when removed > 0 then removed when -pick[1] > 0.8 then pick[2] else 0 end as integer) as removed
  from cuts left join best using (media_id, chunk_idx)
""")
def edited_overlaps(spark, sf):
    return find_overlaps(fx.chunk_texts(spark, sf), fx.chunks(spark, sf), scorer="levenshtein")


@query()
def fuzzy_overlaps(spark, sf):
    return find_overlaps(fx.chunk_texts(spark, sf), fx.chunks(spark, sf))


@query()
def transcript_job(spark, sf):
    spoken = fx.media(spark, sf).select("media_id", "language")
    texts = fx.chunk_texts(spark, sf).join(spoken, "media_id")
    return transcripts_from_chunks(texts, fx.chunks(spark, sf))


def _detected(spark, sf):
    guess = F.when(F.col("chunk_idx") % 3 == 1, "en").when(F.col("chunk_idx") % 3 == 2, "es")
    return fx.chunk_texts(spark, sf).select("media_id", "chunk_idx", guess.alias("language"))


@query("""
  with d as (select media_id, chunk_idx, case chunk_idx % 3 when 1 then 'en' when 2 then 'es' end as language from chunk_texts)
  select media_id, chunk_idx, coalesce(first_value(language ignore nulls) over (partition by media_id order by chunk_idx
           rows between unbounded preceding and current row), 'en') as language
  from d
""")
def carried_language(spark, sf):
    return carry_language(_detected(spark, sf))


@query("""
  with counts as (
    select language, lower(word) as word, count(*) as n from words where media_id % 5 <> 0 group by 1, 2
  ), profile as (
    select language, word, cast(n * 1000000 // sum(n) over (partition by language) as bigint) as share from counts
  ), scores as (
    select media_id, p.language, sum(n * share) as score
    from (select media_id, lower(word) as word, count(*) as n from words where seg_idx < 10 group by 1, 2) w
    join profile p using (word) group by 1, 2
  ), best as (
    select *, row_number() over (partition by media_id order by score desc, language) as rn from scores
  )
  select m.media_id, b.language from media m left join (select * from best where rn = 1) b on m.media_id = b.media_id
""")
def detected_language(spark, sf):
    """Profiles from four fifths of the media, used on all of them."""
    texts = _texts(spark, sf)
    profiles = language_profiles(texts.filter("media_id % 5 <> 0"))
    return detect_language(texts.withColumnRenamed("seg_idx", "cue_idx"), profiles)
