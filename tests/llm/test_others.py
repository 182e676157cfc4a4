import gzip
import io
import random
import re

import duckdb
import numpy as np
import pytest

from wattspark.llm import neardup, packing, queries, quotes, textkit, warc


# ---- archives
def test_archives_read_back_and_link_copies(spark, tmp_path):
    rows = [(3, "http://a", "x<p>é"), (1, "http://b", "x<p>é"), (2, None, None), (7, "http://c\nd", ""), (9, "u", "y" * 200_000), (8, "u", "y" * 200_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in warc.op3_warc_normaliser(spark, str(tmp_path)).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"]) for k, r in got.items()} == {1: ("response", None, 6), 3: ("revisit", 1, 6), 2: ("response", None, 0), 7: ("revisit", 2, 0), 8: ("response", None, 200_000), 9: ("revisit", 8, 200_000)}
    assert got[1]["payload_digest"] == warc.digest("x<p>é".encode())


def test_members_and_index_agree():
    records = [warc.record("response", warc.record_id(f"f#{i}"), i, "u", "2020-01-01T00:00:00Z", b"z" * i, warc.digest(b"z" * i)) for i in (0, 5, 70_000)]
    whole = gzip.compress(b"".join(records))
    assert [len(warc.payload_of(b)[1]) for _, b in warc.records(warc._Inflated(io.BytesIO(whole)))] == [0, 5, 70_000]
    many = b"".join(gzip.compress(x) for x in records)
    assert [len(warc.payload_of(b)[1]) for _, b in warc.records(warc._Inflated(io.BytesIO(many)))] == [0, 5, 70_000]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(records[1][:-10])))


def test_records_are_whole_and_name_each_other(spark):
    rows = [(2, "u", "x"), (2, "u", "x"), (1, "v", "x"), (None, None, None), (5, "w", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'f' AS file", "1 AS seq", "'d' AS payload_digest").repartition(2)
    folder = textkit.shared_dir(spark, "warc-test")
    index = warc.normalise(warc.with_decisions(warc.write_monolithic(pages, spark, f"{folder}/crawl")), spark, f"{folder}/archive")
    heads = []
    for (archive,) in index.select("archive").distinct().collect():
        fs, at = textkit.filesystem(archive)
        with fs.open_input_file(at) as f:
            found = [h for h, _ in warc.records(warc._Inflated(f))]
        assert found[0]["warc-type"] == "warcinfo"
        heads += found
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(heads) and all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"]) for h in heads)
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 2 and all(ids[h["warc-refers-to"]]["x-page-id"] == "1" and ids[h["warc-refers-to"]]["warc-type"] == "response" for h in revisits)
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in warc.read_archives(index).collect()) == [(0, "response"), (1, "response"), (2, "revisit"), (2, "revisit"), (5, "response")]


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op3_warc_normaliser(spark, str(tmp_path)).count() == 0


# ---- vectors
@pytest.mark.parametrize("params", [neardup.Params(chunk=16, per_centroid=20), neardup.Params(chunk=16, per_centroid=20, shard=12, pack=8)])
def test_links_against_brute_force(spark, params):
    r = np.random.default_rng(1)
    rows, k = [], 0
    for label in (0, 1, None):
        for base in r.normal(size=(30, 16)):
            for scale in (0, 0.01, 0.02, 0.06, 0.08):
                rows.append((k, [float(x) for x in (base + scale * r.normal(size=16)).astype(np.float32)], label))
                k += 1
    for _ in range(80):  # one large group of copies and near copies
        rows.append((k, [1.0, *(float(x) for x in 0.001 * r.normal(size=15))], 0))
        k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [float("nan")] * 16, 0), (k + 3, [None] * 16, 0), (k + 4, [1.0], 0), (k + 5, [2.0], 0), (k + 6, [], 1)]
    rows += [(k + 7, list(rows[0][1]), 0), (k + 8, list(rows[0][1]), 0)]  # copies of a vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'s' AS space", "1 AS ball", "2.0 AS vec")
    got = {x[0]: (x[1], x[2], x[3]) for x in neardup.near_duplicates(df, params).collect()}
    links, parent = {x[0]: 0 for x in rows}, {x[0]: x[0] for x in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    usable = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    for a, (i, v, c) in enumerate(usable):
        for j, w, d in usable[:a]:
            if c == d and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    total = sum(links.values())
    assert sum(min(links[i], got[i][0]) for i in links) >= 0.97 * total
    assert all(got[i][0] <= links[i] for i in links)
    assert sum(got[i][1] == top(i) for i in links) >= 0.97 * len(links)
    assert all(got[i][2] == (i == got[i][1]) for i in links)
    assert neardup.recall(df, neardup.near_duplicates(df, neardup.Params(per_centroid=20)), every=5) >= 0.9


def test_no_vectors(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- conversations
def test_quote_threads_against_sql(spark):
    r, words, rows = random.Random(7), ["alpha", "Beta", "gamma ", "de lta"], []
    for c in range(25):
        said = []
        for t in range(r.randint(1, 12)):
            lines = []
            for _ in range(r.randint(0, 3)):
                if said and r.random() < 0.6:
                    quoted = r.choice(said).split("\n")
                    if r.random() < 0.3:
                        lines.append("On Monday X wrote:")
                    lines += [">" * r.choice([1, 1, 2]) + " " + x for x in r.choice([quoted, [r.choice(quoted)]])]
                else:
                    lines.append(" ".join(r.choice(words) for _ in range(3)))
                if r.random() < 0.4:
                    lines.append("")
            said.append("\n".join(lines))
            rows.append((c, t, "user", said[-1] or None))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread_turn", "depth"]
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    assert sorted(map(tuple, quotes.linked(df).select(*columns).collect())) == sorted(con.execute(quotes.ORACLE).fetchall())


def test_quote_edge_cases(spark):
    rows = [(None, 0, "u", "hi"), (1, None, "u", "hi"), (1, 0, "u", "hi"), (1, 1, "u", "> hi"), (1, 1, "u", "> hi"), (1, 5000, None, ">> HI \n>ok\nyes"), (2, 0, "u", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS hash", "'y' AS depth")
    got = quotes.linked(df).collect()
    assert {(r["conv_id"], r["turn"], r["text"], r["n_quotes"], r["reply_to"]) for r in got} >= {(1, 1, "", 1, 0), (1, 5000, "yes", 2, None), (None, 0, "hi", 0, None), (2, 0, "", 0, None)}
    assert quotes.linked(df.where("false")).count() == 0


# ---- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    prose = lambda k: " ".join("".join(random.Random(100 * k + j).choices("abcdefghij", k=7)) for j in range(80))
    rows = [prose(1), prose(1) + " tail", prose(2) + " me@x.org", "short", None, prose(3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [[0, 1, 2, 5], [0, 2, 5], [0, 2, 5]]
    for (name, stage), want in zip(P.STAGES, kept):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(P.COLUMNS)
        assert sorted(r[0] for r in docs.select("doc_id").collect()) == want, name
    assert "[EMAIL]" in docs.where("doc_id = 2").first()["text"]
    packed = P.run(spark, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {0, 2, 5}
    assert packed.columns == packing.PIECE_SCHEMA.replace(" long", "").split(", ")


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
