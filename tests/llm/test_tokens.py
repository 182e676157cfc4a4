import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wattspark.llm import packing, pieces, textkit, tokens, wavelet

ODD = ["", None, " ", "  a  b \n c 　 d", "x\x1c y\x1f  z\x85 q", "ΣΑΣ ΟΔΟΣ Σ á ́b  é\n\n\n", "don't I'LL we've  's 's", "A" * 3000, "日本語 テキスト。 한국어", "<|endoftext|> hi", "tail   ", "\n\nlead", "a,b.c;d (e) [f] {g}", "▁x ▁▁ y", "😀" * 40]


def texts(n=400, seed=1):
    r = random.Random(seed)
    return ODD + ["".join(r.choice("  abé\nthe ing.,'S12①▁") for _ in range(r.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_library_ids(name, space):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path(name)
    encoder, library = tokens.ChunkEncoder(path, space, not space), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    for _ in range(2):  # the second time from memory
        rows = texts()
        ids, at = encoder.documents(pa.array(rows, pa.string()))
        for i, t in enumerate(rows):
            assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1], t


def thue_morse(n):
    """A word over a and b, and its complement: equal under any polynomial hash modulo a power of two."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 128, 1024, 2048])
def test_crafted_words_do_not_collide(n):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = thue_morse(n)
    rows = [one, two, f"x {one} {two}", f"{two}.{one}"]
    for name, space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = tokens.tokenizer_path(name)
        library = Tokenizer.from_file(path)
        ids, at = tokens.ChunkEncoder(path, space, not space).encode(pa.array(rows))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in rows]
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    ids, at = pieces.PieceEncoder(path).encode(pa.array(rows))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == sentencepiece.SentencePieceProcessor(model_file=path).encode(rows)


def test_a_full_memory_changes_no_ids():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), tokens.ChunkEncoder(path, False, True)
    encoder.SLOTS, encoder.POOL, encoder.JOINED = 16, 500, 3
    encoder.forget()
    r = random.Random(4)
    for _ in range(4):
        rows = [" ".join("".join(r.choices("abçÉß.İ", k=r.randint(1, 3))) for _ in range(60)) for _ in range(8)]
        ids, at = encoder.encode(pa.array(rows))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in rows]


def test_pieces_are_sentencepiece_pieces():
    import sentencepiece

    path = tokens.tokenizer_path("piece_bpe_32k.model")
    model, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceEncoder(path)
    rows = texts(1500) + [" " * n + "x" + " " * (n + 1) for n in range(20)]
    ids, at = encoder.encode(pa.array(rows, pa.string()))
    for i, t in enumerate(rows):
        want = model.encode(t or "")
        got = ids[at[i] : at[i + 1]].tolist()
        assert got == want, t
        assert encoder.decode(got) == model.decode(want)


def test_suffix_array_is_sorted():
    r = np.random.default_rng(2)
    codes = r.integers(1, 4, 300).astype(np.uint32)
    order = pieces.suffix_array(codes, 16)
    keys = [tuple(codes[i : i + 16]) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(300))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 1), (50, 7), (70_000, 49_408)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids, np.array([5]), np.array([n])))
    assert np.array_equal(w.ids(), ids)
    for i in sorted({0, n // 2, n - 1}) if n else []:
        t = int(ids[i])
        assert w.access(i) == t
        assert w.rank(t, i) == int((ids[:i] == t).sum()) and w.rank(t) == int((ids == t).sum())
        assert w.select(t, w.rank(t, i)) == i
        if w.rank(t) < 30:
            assert w.occurrences(t) == np.flatnonzero(ids == t).tolist()
    assert w.rank(1 << 20) == 0
    with pytest.raises(IndexError):
        w.access(n)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


def test_shards_read_back(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = texts(100) * 2
    documents(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, wavelet.op5_wavelet_shards(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    library = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    start, want = 0, []
    for i, t in enumerate(rows):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_small_shards_null_ids_and_clashing_columns(spark):
    rows = [(None, "x y"), (-(2**63), "z"), (3, None), (3, "a b c"), (2, "q " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'p' AS path", "2 AS serial").repartition(2)
    folder = textkit.shared_dir(spark, "small-shards")
    manifest = wavelet.write_shards(docs, spark, folder, tokens.tokenizer_path("word_bpe_49k.json"), False, True, shard_ids=1)
    got = sorted(wavelet.read_documents(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -(2**63), 2, 3, 3]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert wavelet.read_documents(wavelet.write_shards(docs.where("false"), spark, folder, tokens.tokenizer_path("word_bpe_49k.json"), False, True)).count() == 0


def test_packing_places_each_id_once(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = texts(150) + ["word " * 5000]
    documents(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op4_vector_packing(spark, str(tmp_path)).toPandas()
    library = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for doc, g in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(rows[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for _, p in g.iterrows():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert set(got.doc_id) == set(range(len(rows)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        n = g.length.sum()
        assert n <= 2048 and n & (n - 1) == 0  # no padding at all


@pytest.mark.parametrize("cut", [True, False])
def test_limits_hold_in_all_dimensions(cut):
    r = np.random.default_rng(3)
    length = r.integers(1, 60, 500)
    loss = np.minimum(r.integers(0, 40, 500), length)
    limits = packing.Limits(tokens=64, segments=3, loss=40, window=50, cut=cut)
    at = np.zeros(500, int)
    for pieces_ in packing.fill(length, loss, limits):
        assert len(pieces_) <= 3 and sum(n for _, _, n in pieces_) <= 64
        assert sum(max(0, s + n - max(s, length[i] - loss[i])) for i, s, n in pieces_) <= 40
        for i, s, n in pieces_:
            assert n > 0
            at[i] += n
    assert np.array_equal(at, length)
    if not cut:
        with pytest.raises(ValueError):
            packing.fill(np.array([65]), np.array([0]), limits)


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    for f in (packing.op4_vector_packing, wavelet.op5_wavelet_shards, pieces.op10_suffix_pieces):
        assert f(spark, str(tmp_path)).count() == 0
