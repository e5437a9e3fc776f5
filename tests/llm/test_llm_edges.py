"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import llm_brute as brute
from pagemill.llm import hilbert_ann, line_dedup, lm_score, near_dup, packing, quality, secret_scan, sentence_pieces, substring_dedup, warc_store
from pagemill.llm.components import components

LONG = "word " * 30000
LINE = "This line is shared by many of the documents."
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, h long, doc string, n_lines long, kept boolean, "
          "place long, shard int, `odd name` string")


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", len(t or ""), "k", 1, "d", 2, True, 3, 4, "o") for i, t in rows], SCHEMA)


ROWS = [(None, None), (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "one two three four"), (6, "ONE two three four"), (7, LONG),
        (8, f"{LINE}\nalone here in this document only"), (9, f"  {LINE.upper()}  \nother"), (10, f"{LINE}\n{LINE}"), (10, f"{LINE}\n{LINE}"),
        (None, f"{LINE}\nno id"), (11, "é" * 19 + "\n" + "é" * 20), (12, "x" * 70000), (13, "\n\n\n"),
        (14, "a b c d e f g h i j k l m n"), (15, "a b c d e f g h i j k l m n"), (16, "z a b c d e f g h i j k l m")]
IDS = [(i, t) for i, t in ROWS if i is not None]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, ROWS).limit(0)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_line_dedup(odd, empty):
    out = line_dedup.dedup_lines(odd)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()), key=key)
    assert got == sorted(brute.line_dedup(ROWS), key=key)
    assert out.select("doc.*").columns == odd.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_keys_without_ids(spark):
    rows = [(None, f"{LINE}\n{i}") for i in range(4)]
    got = line_dedup.dedup_lines(make(spark, rows)).collect()
    assert all(r.n_dropped == 0 for r in got)      # no larger id holds the key


def test_quality(odd, empty):
    out = quality.quality(odd)
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(r.doc.text)
        assert r.kept in (True, False) and not (r.kept and r.base_failed)
    assert out.count() == len(ROWS) and out.select("doc.*").columns == odd.columns
    assert quality.quality(empty).count() == 0


def test_sentence_pieces(odd, empty):
    got = sentence_pieces.decode(sentence_pieces.encode(odd)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((i is None, i or 0, t or "") for i, t in ROWS)
    assert all((r.n_ids == 0) == (r.text == "") for r in got)
    assert sentence_pieces.decode(sentence_pieces.encode(empty)).count() == 0


def test_packing(odd, empty):
    out = packing.pack_documents(odd).collect()
    per = {}
    for r in out:
        per.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == 4 * r.length
    assert sum(r.length for r in out if r.doc_id == 2) == 1     # the end alone
    assert sum(r.length for r in per[10]) == 2 * per[10][0].doc_tokens
    assert sum(r.length for r in per[7]) == per[7][0].doc_tokens > packing.SEQUENCE
    assert set(per) == {i for i, _ in ROWS}
    assert packing.pack_documents(empty).count() == 0


def test_secret_scan(spark, odd, empty):
    access = "AKIA" + "Z" * 16
    rows = ROWS + [(20, f"token = 'abcdef'  {access}"), (20, f"token = 'abcdef'  {access}"), (21, "password:12345"), (None, f"SECRET=abcdef {access}")]
    df = make(spark, rows)
    got = secret_scan.secret_spans(df).collect()
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, secret_scan.show(brute.base_secrets(t))) for i, t in rows)
    shown = secret_scan.secret_spans(df).select("doc_id", secret_scan.spans_text().alias("s")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.s) for r in shown) == want
    clean = secret_scan.redacted(df)
    assert clean.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in clean.collect()) == \
        sorted((i is None, i or 0, brute.masked(t or "", brute.base_secrets(t))) for i, t in rows)
    assert secret_scan.secret_spans(empty).count() == 0 and secret_scan.redacted(empty).count() == 0


def test_substring_dedup(spark, odd, empty):
    got = {}
    for r in substring_dedup.substring_dedup(odd).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_text))
    for i, n, gone, text in brute.substring_dedup(IDS):
        assert (n, gone, text) in got[i]
    assert all(gone == 0 for _, gone, _ in got[None])
    assert sum(map(len, got.values())) == len(ROWS)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_near_dup(odd, empty):
    want = brute.near_dup([(i, t) for i, t in IDS])
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert want[6][1] == 5 and want[15][1] == 14
    assert near_dup.near_duplicates(empty).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (5, 6), (20, 11)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 7)} == {1} and {got[i] for i in (10, 11, 20)} == {10} and {got[100 + i] for i in range(61)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_score(spark, odd, empty):
    got = sorted(lm_score.score_corpus(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    want = sorted(brute.lm_scores(ROWS), key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    for r, (i, held, n, known, train, base, score) in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert lm_score.score_corpus(empty).count() == 0
    held = [i for i in range(60) if brute.lm_scores([(i, "")])[0][1]][:1]
    only = lm_score.score_corpus(make(spark, [(held[0], "no training text")])).collect()
    assert only[0].train_tokens == 0 and only[0].score == pytest.approx(0.0)


def test_nearest(spark):
    vec = [1.0, 0.0, 2.0]
    rows = [(i, vec) for i in range(50)] + [(60, [0.0, 0.0, 0.0]), (80, None), (100, [1.0, float("nan"), 0.0]), (120, [1.0, None, 0.0]),
            (140, [1.0]), (None, vec), (160, [float("inf"), 0.0, 1.0]), (180, [-0.0, 1.0, 0.0]), (181, [0.0, 1.0, 0.0]), (180, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit(1)).withColumn("pos", F.lit("x"))
    got = {}
    for r in sorted(hilbert_ann.nearest(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 180}
    assert got[0] == [(i, 5.0) for i in range(1, 21)] and got[20] == [(i, 5.0) for i in range(20)]     # ties: smaller ids
    assert got[180][0] == (181, 1.0) and 180 not in [i for i, _ in got[180]]
    assert hilbert_ann.nearest(df.limit(0)).count() == 0


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string, digest string, payload string")
    warc_store.write_archive(pages, str(tmp_path / "a"))
    assert warc_store.read_archive(spark, str(tmp_path / "a")).count() == 0
    assert warc_store.read_digests(spark, str(tmp_path / "a")).count() == 0


def test_warc_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "a")
    warc_store.write_archive(spark.createDataFrame([(1, "u", "y" * 300)], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("other"), "UTF-8"))
    bad.write.parquet(f"{path}/bad")
    import shutil
    shutil.copytree(f"{path}/records", f"{path}2/records")
    shutil.copytree(f"{path}/bad", f"{path}2/payloads")
    assert not spark.read.parquet(f"{path}2/payloads").isEmpty()
    assert [r.verified for r in warc_store.read_archive(spark, f"{path}2").collect()] == [False]
    with pytest.raises(Exception, match="damaged payload"):
        warc_store.read_digests(spark, f"{path}2").collect()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input, and run() as their sequence."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dup", "secret_scan", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]

    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    before, after = map(texts, seen["quality_rules"])
    judged = {r.doc.doc_id: r.kept for r in quality.quality(seen["quality_rules"][0]).collect()}
    assert after == {i: t for i, t in before.items() if judged[i]}
    assert all(judged[i] is False for i, t in before.items() if brute.base_quality(t)[-1])
    before, after = map(texts, seen["line_dedup"])
    assert after == {i: t for i, _, _, t in brute.line_dedup(list(before.items()))}
    before, after = map(texts, seen["near_dup"])
    groups = brute.near_dup(list(before.items()))
    assert after == {i: t for i, t in before.items() if groups[i][1] == i}
    before, after = map(texts, seen["secret_scan"])
    for i, t in before.items():
        spans = brute.base_secrets(t)
        assert after[i] == brute.masked(t, spans) or len(after[i]) <= len(t)
        if spans:
            assert "[SECRET]" in after[i]
    assert all(r.n_chars == len(r.text) for r in seen["secret_scan"][1].collect())
    before = texts(seen["packing"][0])
    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces = seen["packing"][1].collect()
    for i, t in before.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert sum(r.length for r in pieces if r.doc_id == i) == len(ids)
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, got.select("doc_id", "start", "length", "ids_crc32").collect())) == \
        sorted(map(str, seen["packing"][1].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_masking_of_many_spans(spark):
    """Work in proportion to the text: 16,000 spans, code points above the first plane between them."""
    import time

    text = "".join(f"é😀 token={i:06d}abc, " for i in range(16000))
    df = make(spark, [(1, text), (2, "no secret"), (3, None)])
    began = time.time()
    got = {r.doc_id: r.text for r in secret_scan.redacted(df).collect()}
    assert got == {1: "é😀 [SECRET], " * 16000, 2: "no secret", 3: None} and time.time() - began < 15
    spans = [{"start": a, "end": b} for a, b in [(0, 4), (2, 3), (3, 6), (6, 7), (9, 9)]]
    assert secret_scan.mask("0123456789", spans, "#") == "##78#9"


def test_pipeline_stages_on_odd_rows_and_names(spark, odd, empty):
    names = ["a.b", "back`tick", "_doc", "_k", "found", "text2"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        for df in (odd, empty):
            for extra in names:
                df = df.withColumn(extra, F.lit(extra))
            out = stage(spark, df, None)
            assert out.columns == df.columns, name
            rows = out.collect()
            assert all(list(r)[-len(names):] == names for r in rows)
            if df.limit(1).count() == 0:
                assert rows == []
            elif name in ("line_dedup", "secret_scan"):
                assert len(rows) == len(ROWS)
