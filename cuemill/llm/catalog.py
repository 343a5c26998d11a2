"""The numbered queries: the given tables through the operators and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def transcripts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as transcripts, with further columns by their names."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("media_id"), "text", F.col("lang").alias("language"), *more
    )


@query()
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.jaccard_join import jaccard_components

    return jaccard_components(transcripts(spark, sf_dir)).withColumnRenamed("media_id", "doc_id")


@query(
    r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), piece as (
  select item_id, w, least(10, len(w)) as n, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0
), item as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from piece
), place as (
  select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from item) where len(w) >= n
), hit as (
  select p.doc_id, p.i, p.n, t.item_id
  from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from place) p join item t on p.n = t.n and p.g = t.g
), inside as (
  select doc_id, count(distinct k) as n_hit
  from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from hit) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join inside using (doc_id) left join items using (doc_id)
"""
)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.decontaminate import find_contamination

    found = find_contamination(transcripts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("media_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _remainder(key: str, modulus: int):
    return F.crc32(F.col(key).cast("string")) % modulus


def training_marks(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(media_id, label) of the rows that are not held out."""
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("media_id"), F.col(label).cast("int").alias(label))
    return marks.filter(F.col(label).isNotNull() & (_remainder("media_id", 3) != 1))


def labelled(spark: SparkSession, sf_dir: str, label: str, *more: str) -> DataFrame:
    """Transcripts with a label to learn from."""
    return transcripts(spark, sf_dir, *more).drop("language").join(training_marks(spark, sf_dir, label), "media_id")


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.toxicity import learn_toxicity, score_toxicity

    model = learn_toxicity(labelled(spark, sf_dir, "toxic"))
    found = score_toxicity(transcripts(spark, sf_dir), model)
    return found.select(
        F.col("media_id").alias("doc_id"),
        (_remainder("media_id", 3) == 1).alias("held_out"),
        "score",
        "predicted",
        F.size("passages").alias("n_passages"),
    )


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.language_id import identify_languages, learn_languages

    held_out = _remainder("media_id", 5) == 0
    rows = transcripts(spark, sf_dir)
    model = learn_languages(rows.filter(~held_out))
    found = identify_languages(rows.select("media_id", "text"), model)
    return found.select(
        F.col("media_id").alias("doc_id"),
        held_out.alias("held_out"),
        F.col("language_found").alias("lang_pred"),
        "score",
        "bits_per_byte",
    )


def encoded(rows: DataFrame) -> DataFrame:
    """Transcripts as token ids, and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    from cuemill.llm.pieces import encode_transcripts, load_pieces

    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_transcripts(rows, pieces, decoded=True).select(
        F.col("media_id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "token_ids",
    )


@query()
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(transcripts(spark, sf_dir)).drop("token_ids")


@query(
    r"""
with d as (select doc_id, coalesce(text, '') as t from documents), m as (
  select doc_id, 'assign' as kind, 1 as k,
    string_split_regex(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') as parts,
    regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') as hits,
    regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) as tested, 12 as least
  from d
  union all
  select doc_id, 'access', 2, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'),
    regexp_extract_all(t, 'AKIA[A-Z0-9]+'), 18 from d
  union all
  select doc_id, 'hex', 3, string_split_regex(t, '[0-9a-f]{16,}'), regexp_extract_all(t, '[0-9a-f]{16,}'),
    regexp_extract_all(t, '[0-9a-f]{16,}'), 16 from d
), each_hit as (
  select doc_id, kind, k, parts, hits, tested, least, unnest(generate_series(1, len(hits))) as i from m where len(hits) > 0
), span as (
  select doc_id, kind, k, len(hits[i]) as size,
    list_sum(list_transform(parts[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) as low
  from each_hit where len(tested[i]) >= least
), found as (
  select doc_id, sum(case when k = 1 then 1 else 0 end) as a, sum(case when k = 2 then 1 else 0 end) as b,
    sum(case when k = 3 then 1 else 0 end) as c,
    string_agg(kind || ':' || cast(cast(low as bigint) as varchar) || ':' || cast(cast(low + size as bigint) as varchar), ',' order by low, k) as spans
  from span group by doc_id
)
select doc_id, cast(coalesce(a, 0) as bigint) as n_assign, cast(coalesce(b, 0) as bigint) as n_access,
  cast(coalesce(c, 0) as bigint) as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join found using (doc_id)
"""
)
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.secrets import find_secrets

    found = find_secrets(transcripts(spark, sf_dir))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    named = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["from"], s["to"]))
    return found.select(
        F.col("media_id").alias("doc_id"),
        *[number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.array_join(named, ",").alias("spans"),
    ).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


@query()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.quality import learn_quality, score_quality

    rows = transcripts(spark, sf_dir, "n_chars")
    found = score_quality(rows, learn_quality(labelled(spark, sf_dir, "quality", "n_chars")))
    return found.select(
        F.col("media_id").alias("doc_id"), (_remainder("media_id", 3) == 1).alias("held_out"), "score", "predicted"
    )


@query()
def op3_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.hamming_index import nearest_vectors

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(vectors, vectors.filter("vec_id % 20 = 0"))


@query()
def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.page_text import page_texts

    found = page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    n_chars = F.length("text").cast("long").alias("n_chars")
    return found.select("page_id", "url", "text", n_chars, "lines", "shared", "restored", "marked")


@query()
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.url_filter import judge_urls, labelled_urls, learn_url_weights

    weights = learn_url_weights(labelled_urls(spark))
    return judge_urls(table(spark, sf_dir, "pages"), weights).drop("score")


@query()
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cuemill.llm.packing import pack_transcripts
    from cuemill.llm.tokens import Vocabulary

    found = pack_transcripts(transcripts(spark, sf_dir), Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    return found.select(F.col("media_id").alias("doc_id"), "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")


@query(
    r"""
with d as (
  select row_number() over () as t, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), asked as (
  select i, item_id, unnest(w) as term from (
    select row_number() over () as i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
    from benchmark)
), total as (
  select count(*) as n_docs, sum(len(w)) as n_terms from d where len(w) > 0
), held as (
  select t, doc_id, term, count(*) as tf, any_value(n) as n
  from (select t, doc_id, len(w) as n, unnest(w) as term from d) group by t, doc_id, term
), df as (
  select term, count(*) as df from held group by term
), part as (
  select t, doc_id, held.term,
    cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint)
      * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + cast((25 * n * n_docs) // n_terms as bigint)))) as part
  from held join df on df.term = held.term cross join total
), scored as (
  select i, item_id, t, doc_id, cast(sum(part) as bigint) as score
  from (select i, item_id, term from asked) a join part on part.term = a.term group by i, item_id, t, doc_id
), ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
"""
)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.ranking import rank_transcripts

    cues = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("cue_idx"), "text")
    found = rank_transcripts(transcripts(spark, sf_dir), cues)
    return found.withColumnsRenamed({"cue_idx": "item_id", "media_id": "doc_id"})


@query(
    r"""
with d as (
  select row_number() over () as t, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), piece as (
  select lang, regexp_extract_all(p, '[^\x20\x09]+') as w
  from (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as p from d)
), total as (
  select lang, cast(sum(len(w)) as bigint) as n from piece group by lang
), place as (
  select lang, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
  from piece, (values (1), (2), (3), (4)) as size(n) where len(w) >= n
), f as (
  select lang, n as size, array_to_string(w[i:i + n - 1], ' ') as phrase, count(*) as f
  from place group by all having count(*) >= 30
), c as (
  select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1
), cut as (
  select lang, phrase, size, a, w, unnest(generate_series(1, size - 1)) as k from c
), scored as (
  select cut.lang, cut.phrase, a, k, x.f as l, y.f as r, cast((2000000 * a::hugeint) // (x.f + y.f) as bigint) as score
  from cut join f x on x.lang = cut.lang and x.phrase = array_to_string(cut.w[1:k], ' ')
    join f y on y.lang = cut.lang and y.phrase = array_to_string(cut.w[k + 1:], ' ')
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_place as (
  select lang, w, size, a, n, unnest(generate_series(1, size - n + 1)) as i
  from c, (values (2), (3)) as s(n) where n < size
), longer as (
  select lang, array_to_string(w[i:i + n - 1], ' ') as phrase, max(a) as around from inner_place group by all
), ranked as (
  select best.*, row_number() over (partition by best.lang order by score desc, a desc, encode(best.phrase)) as rank
  from best left join longer on longer.lang = best.lang and longer.phrase = best.phrase
  where around is null or 100 * around < 80 * a
)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join total on total.lang = ranked.lang where rank <= 2000
"""
)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cuemill.llm.phrases import mine_phrases

    return mine_phrases(transcripts(spark, sf_dir)).withColumnRenamed("language", "lang")
