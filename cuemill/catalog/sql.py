"""The derived tables of fixtures.py once more, as SQL for the oracle side."""

from __future__ import annotations

import re

# name -> body; a body may use the driver's tables and the names above it
TABLES: dict[str, str] = {}

TABLES["doc_lines"] = r"""
  select doc_id as media_id, lang as language, i,
         trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')) as line
  from (select doc_id, lang, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents)
"""
TABLES["seg_lines"] = """
  select media_id, language, line,
         cast(row_number() over (partition by media_id order by i) - 1 as integer) as seg_idx
  from doc_lines where line <> ''
"""
TABLES["raw_words"] = """
  select media_id, language, seg_idx, word_idx,
         case when word_idx % 23 = 11 then 'um'
              when (media_id + seg_idx) % 7 = 0 and word_idx between 4 and 9 then 'yes'
              else w end as word
  from (select media_id, language, seg_idx, unnest(string_split(line, ' ')) as w,
               generate_subscripts(string_split(line, ' '), 1) - 1 as word_idx
        from seg_lines)
"""
TABLES["words"] = """
  select media_id, language, seg_idx, word_idx, seq, word, start_ms, start_ms + dur as end_ms
  from (
    select *, cast(coalesce(sum(dur + gap) over (partition by media_id order by seg_idx, word_idx
                                            rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ms,
           row_number() over (partition by media_id order by seg_idx, word_idx) - 1 as seq
    from (select *, 120 + 30 * length(word) as dur,
                 case when right(word, 1) in ('.', '!', '?') then 450
                      when right(word, 1) = ',' then 150 else 40 end as gap
          from raw_words))
"""
TABLES["segs"] = """
  select media_id, seg_idx, min(language) as language, min(start_ms) as start_ms, max(end_ms) as end_ms,
         string_agg(word, ' ' order by word_idx) as text, count(*) as n_words
  from words group by media_id, seg_idx
"""
TABLES["media"] = """
  select media_id, min(language) as language, max(end_ms) + 500 as duration_ms from words group by media_id
"""
TABLES["chunks"] = """
  select media_id, cast(i as integer) as chunk_idx,
         greatest(0, (i * d) // n - 2500) as start_ms,
         least(d, ((i + 1) * d) // n + 2500) as end_ms,
         (i * d) // n as content_start_ms, ((i + 1) * d) // n as content_end_ms,
         i > 0 and (i * d) // n > 2500 as has_start_overlap,
         i < n - 1 and ((i + 1) * d) // n + 2500 < d as has_end_overlap,
         case when (i > 0 and (i * d) // n > 2500) or (i < n - 1 and ((i + 1) * d) // n + 2500 < d)
              then 2500::bigint else 0 end as overlap_ms
  from (select media_id, duration_ms as d, n, unnest(range(n)) as i
        from (select *, (duration_ms + 59999) // 60000 as n from media where duration_ms > 60000))
"""
TABLES["chunk_words"] = """
  select w.media_id, coalesce(c.chunk_idx, 0) as chunk_idx, coalesce(c.start_ms, 0) as chunk_start,
         w.seg_idx, w.word_idx, w.seq, w.word, w.start_ms, w.end_ms
  from words w left join chunks c
    on w.media_id = c.media_id and (w.start_ms + w.end_ms) // 2 between c.start_ms and c.end_ms
"""
TABLES["chunk_texts"] = """
  select media_id, chunk_idx, string_agg(word, ' ' order by seq) as text
  from chunk_words group by media_id, chunk_idx
"""
TABLES["chunk_segs"] = """
  select media_id, chunk_idx, seg_idx, min(start_ms - chunk_start) as start_ms, max(end_ms - chunk_start) as end_ms,
         string_agg(word, ' ' order by word_idx) as text, count(*) as n_words
  from chunk_words group by media_id, chunk_idx, seg_idx
"""
TABLES["regions"] = """
  select user_id as media_id, epoch_us(ts) // 1000 as start_ms,
         epoch_us(ts) // 1000 + cast(floor(value * 1000) as bigint) as end_ms
  from events
"""
TABLES["run_log"] = """
  select event_id % 200 as media_id, event_id, epoch_us(ts) // 1000 as ts_ms,
         case event_type when 'signup' then 'queued' when 'purchase' then 'completed'
                         when 'error' then 'failed' else 'processing' end as status,
         value as processing_s, case when event_type = 'error' then props end as error
  from events
"""
TABLES["loudness"] = """
  select event_id as media_id, case when event_id % 97 <> 0 then -(value % 60) end as input_i from events
"""
TABLES["frames"] = """
  select g.media_id, g.k * 100 as t_ms, case when w.media_id is null then 0.1::double else 0.9::double end as p
  from (select media_id, unnest(range(duration_ms // 100 + 1)) as k from media) g
  left join (select media_id, unnest(range((start_ms + 99) // 100, (end_ms + 99) // 100)) as k from words) w
    on g.media_id = w.media_id and g.k = w.k
"""
TABLES["listing"] = r"""
  select page_id,
         regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') ||
           (['.mp4', '.avi', '.mkv', '.mov', '.webm', '.mp3', '.txt', '.MP4'])[page_id % 8 + 1] as path,
         page_id % 19 <> 0 as exists,
         case when page_id % 11 <> 0 then length(html) else 0 end as size_bytes
  from pages
"""


def uses(body: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", body) is not None


def with_tables(query: str, recursive: bool = False) -> str:
    """Put the derived tables a query names, and those they need, in front of it."""
    wanted: set[str] = set()
    todo = [query]
    while todo:
        body = todo.pop()
        for name, text in TABLES.items():
            if name not in wanted and uses(body, name):
                wanted.add(name)
                todo.append(text)
    parts = [f"{name} as materialized ({body})" for name, body in TABLES.items() if name in wanted]
    query = query.strip()
    head = "with recursive " if recursive else "with "
    if query.lower().startswith("with "):
        parts.append(query[5:])
        return head + ",\n".join(parts)
    return (head + ",\n".join(parts) + "\n" + query) if parts else query
