"""Each operator's query on awkward tables: nulls in any column, empty texts, repeated rows, more columns with clashing names."""

import pytest

import corpus_pipeline
from wattspark.llm import jaccard, neardup, packing, pieces, pii, quality, quotes, rollups, warc, wavelet

PROSE = "The quick brown fox walks over the old bridge and then it rests a while near the water, because the day was long. "
CLASHING = "'a' AS text_, 1 AS part, 'b' AS path, 2 AS serial, 3 AS key, 4 AS k, 5 AS n, 6 AS token, 7 AS ids, 8 AS bucket, 9 AS component_id, 10 AS kept, 11 AS spans, 12 AS file, 13 AS start, 14 AS _key, 15 AS n_words, 16 AS sequence_id, 17 AS b, 18 AS id"
TEXTS = [None, "", "   ", PROSE * 5, PROSE * 5, "write to a@b.co or 10.0.0.1", "word " * 3000]
OF_DOCUMENTS = [pii.op2_pii_boosting, packing.op4_vector_packing, wavelet.op5_wavelet_shards, jaccard.op6_jaccard_groups, quality.op8_quality_cascade, pieces.op10_suffix_pieces]


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("query", OF_DOCUMENTS, ids=lambda f: f.__name__)
def test_clashing_columns_change_nothing(spark, tmp_path, query):
    docs = documents(spark, [(i, t, None if i % 2 else "en", None, None) for i, t in enumerate(TEXTS)]).coalesce(1)
    write(docs, tmp_path / "a", "documents")
    write(docs.selectExpr("*", *CLASHING.split(", ")), tmp_path / "b", "documents")
    plain = query(spark, str(tmp_path / "a"))
    own = [c for c in plain.columns if c != "sequence_id"]
    assert rows_of(plain, own) == rows_of(query(spark, str(tmp_path / "b")), own)
    assert {r["doc_id"] for r in plain.collect()} == set(range(len(TEXTS)))


@pytest.mark.parametrize("query", OF_DOCUMENTS, ids=lambda f: f.__name__)
def test_repeated_rows_and_null_ids_each_count(spark, tmp_path, query):
    """A row is a document: each gives as many rows as an equal document with an id of its own."""
    docs = documents(spark, [(1, PROSE * 3, "en", "s", 1), (1, PROSE * 3, "en", "s", 1), (None, PROSE * 3, None, None, None), (None, None, None, None, None)]).coalesce(1)
    write(docs, tmp_path, "documents")
    got = [r["doc_id"] for r in query(spark, str(tmp_path)).collect()]
    assert got.count(1) >= 2 and got.count(None) >= 2 and set(got) == {1, None}


@pytest.mark.parametrize("query", [pii.op2_pii_boosting, quality.op8_quality_cascade, jaccard.op6_jaccard_groups, rollups.op9_token_rollups], ids=lambda f: f.__name__)
def test_empty_tables(spark, tmp_path, query):
    write(documents(spark, []), tmp_path, "documents")
    assert query(spark, str(tmp_path)).count() == 0


def test_rollups_with_clashing_columns(spark, tmp_path):
    docs = documents(spark, [(i, t, "en", "s", None) for i, t in enumerate(TEXTS)])
    write(docs, tmp_path / "a", "documents")
    more = [c for c in CLASHING.split(", ")] + ["'x' AS tokenizer", "1 AS batch", "2 AS sign"]
    write(docs.selectExpr("*", *more), tmp_path / "b", "documents")
    one, two = (rollups.op9_token_rollups(spark, str(tmp_path / x)) for x in "ab")
    assert rows_of(one, one.columns) == rows_of(two, one.columns) and one.count() > 0


def test_pages_repeated_and_with_clashing_columns(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, None, "same"), (None, None, None)], "page_id long, url string, html string")
    write(pages.selectExpr("*", "1 AS file", "'q' AS digest", "3 AS part", "'r' AS record_type", "4 AS refers_to", "5 AS offset").coalesce(1), tmp_path, "pages")
    got = warc.op3_warc_normaliser(spark, str(tmp_path)).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"]) for r in got) == [("1", 4), ("1", 4), ("2", 4), ("None", 0)]
    two = [r for r in got if r["page_id"] == 2][0]
    assert (two["record_type"], two["refers_to"]) == ("revisit", 1)


def test_vectors_with_clashing_columns_and_repeats(spark, tmp_path):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (1, v, 1), (1, v, 1), (2, v, None), (3, None, 1), (4, [0.0] * 3, 1), (5, [1.0, None, 2.0], 1)]
    write(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS b", "2 AS n_links", "3 AS component_id", "4 AS seq", "5 AS space").coalesce(1), tmp_path, "embeddings")
    got = neardup.op7_pruned_graph(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["component_id"], r["kept"]) for r in got) == [(0, 0, True), (1, 0, False), (1, 0, False), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True)]


def test_messages_with_clashing_columns(spark, tmp_path):
    rows = [(1, 0, "u", "hello there"), (1, 1, None, "> hello there\nyes"), (None, 0, "u", None), (1, None, "u", "x")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    write(talk, tmp_path / "a", "conversations")
    write(talk.selectExpr("*", "1 AS block", "2 AS level", "3 AS hash", "4 AS reply_to", "5 AS thread", "6 AS t", "7 AS own"), tmp_path / "b", "conversations")
    one, two = (quotes.op1_quote_threads(spark, str(tmp_path / x)) for x in "ab")
    assert rows_of(one, one.columns) == rows_of(two, one.columns) and one.count() == 4


def test_pipeline_keeps_one_row_of_copies_without_ids_of_their_own(spark):
    other = PROSE.replace("fox", "hen").replace("bridge", "wall").replace("water", "barn").replace("day", "road") * 2
    rows = [(3, PROSE), (7, PROSE), (7, other), (7, other), (None, PROSE), (9, ""), (None, None), (4, "a text of its own with words that are nowhere else")]
    docs = documents(spark, [(i, t, "en", "s", None) for i, t in rows])
    got = corpus_pipeline.keep_distinct(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.select("doc_id", "text").fillna("", ["text"]).collect()) == sorted([("3", PROSE), ("7", other), ("9", ""), ("None", ""), ("4", rows[-1][1])])
    assert corpus_pipeline.keep_distinct(spark, docs.where("false"), "").count() == 0
