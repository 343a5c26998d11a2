"""The numbered queries and the pipeline over the given tables, with their SQL where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from cuemill.llm import catalog

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_quality": {"doc_id", "held_out", "score", "predicted"},
    "op3_hamming_index": {"query_id", "rank", "vec_id", "score"},
    "op4_page_text": {"page_id", "url", "text", "n_chars"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op8_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op9_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op10_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op11_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op12_ranked_search": {"item_id", "rank", "doc_id", "score"},
    "op13_phrases": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


def test_all_are_registered():
    assert set(COLUMNS) == set(catalog.QUERIES) and set(COLUMNS) | {"pipeline"} <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    table = {"op3_hamming_index": "embeddings", "op4_page_text": "pages", "op8_url_filter": "pages"}.get(name, "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ("op11_best_fit_packing", "op12_ranked_search", "op13_phrases"):
        assert got.count() > (rows if name == "op11_best_fit_packing" else 0)
    else:
        assert got.count() == (20 * rows / 20 if table == "embeddings" else rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    theirs = con.sql(catalog.ORACLES[name])
    columns = sorted(theirs.columns)
    ours = catalog.QUERIES[name](spark, SF).select(*columns).collect()
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(map(tuple, ours), key=repr) == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)


def test_pipeline_stages(spark, tmp_path):
    """Every stage against the plain rule on what it was given."""
    import re

    from test_pairs import linked_components, windows_hit

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        given = {r.doc_id: r for r in docs.collect()}
        got = {r.doc_id: r for r in after.collect()}
        assert after.count() == len(got) and set(got) <= set(given)
        if name != "sentencepiece":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in ("toxicity", "jaccard_join", "decontamination"):
            assert all(got[k] == given[k] for k in got)
        if name == "toxicity":
            judged = {r.doc_id: r.predicted for r in catalog.QUERIES["op5_toxicity"](spark, SF).collect()}
            assert set(got) == {k for k in given if judged[k] == 0} and 0 < len(got) < len(given)
        if name == "jaccard_join":
            parts = linked_components([(k, r.text) for k, r in given.items()])
            assert set(got) == {k for (k, _), (_, least) in parts.items() if k == least}
        if name == "decontamination":
            assert set(got) == {k for k, r in given.items() if not windows_hit(r.text, items)[1]}
        if name == "secrets":
            assert set(got) == set(given)
            assert all(r.n_chars == len(r.text) and not re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r.text) for r in got.values())
        if name == "sentencepiece":
            assert set(got) == set(given) and all(r.n_tokens == len(r.token_ids) for r in got.values())
        docs = after
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id at all", "en", "s", 3), (3, "x " * 50_000, "en", "s", 1), (3, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, given, SF).count()
            assert kept == (0 if given is not docs else 4 if name == "jaccard_join" else 5)


def test_stages_with_null_and_repeated_ids(spark):
    """Decisions hold for texts and rows, not for ids."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean, other = "wide river stone walk tall sun rain door blue hill", "some quite different words that stand under the same id"
    rows = [(None, item), (1, item), (1, clean), (2, clean + " again"), (None, clean), (None, clean), (5, other), (5, clean), (6, " "), (6, " ")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(rows[2:], key=repr)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    want = [(1, item), (1, clean), (5, other), (6, " "), (6, " ")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)
