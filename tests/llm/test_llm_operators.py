"""The operators over whole tables of the smallest scale, against plain Python or SQL."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import llm_brute as brute
from pagemill.llm import (byte_model, hilbert_ann, line_dedup, lm_score, near_dup, packing, quality, queries, secret_scan, sentence_pieces,
                          substring_dedup, warc_store)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def sql_rows(sql, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con.execute(sql).fetchall()


def test_every_operator_has_a_query():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_line_dedup(spark, docs):
    got = line_dedup.query(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    want = sorted((i, n, d, brute.sha(t)) for i, n, d, t in brute.line_dedup(docs))
    assert sorted(map(tuple, got)) == want
    assert sum(r[2] for r in want) > 0
    assert sorted(sql_rows(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.SQL})", "documents")) == want


def test_quality(spark, docs):
    got = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    for i, text in docs:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(text)
        assert r.kept == (not r.base_failed and r.lower <= r.log_ppl <= r.upper)


def test_quality_keeps_clean_and_rejects_noise(spark):
    clean = [(i, " ".join(f"{a}{b}" for a in ("the", "an", "of", "re") for b in ("ing", "ed", "er", "s", "tion", "") for _ in range(2 + i % 3)), "en")
             for i in range(60)]
    clean = [(i, " ".join(t.split()[k::7] and " ".join(t.split()[k::7]) for k in range(7)) + " " + str(i), x) for i, t, x in clean]
    rng = np.random.default_rng(1)
    noise = [(100 + i, " ".join("".join(chr(c) for c in rng.integers(0x21, 0x7F, 9)) for _ in range(80)), "en") for i in range(3)]
    rows = {r.doc.doc_id: r for r in quality.quality(spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")).collect()}
    assert not any(r.kept for i, r in rows.items() if i >= 100)
    assert all(r.kept == (not r.base_failed) for i, r in rows.items() if i < 100)


def test_quality_bands_against_labels(spark):
    """Of the labelled documents past the base rules, most bad ones leave and nearly all clean ones stay."""
    mid = "/root/testdata/sf0.01"
    rows = (quality.query(spark, mid).join(spark.read.parquet(f"{mid}/labels.parquet"), "doc_id").filter("not base_failed")
            .groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect())
    kept = {r.quality: r.kept for r in rows}
    assert kept[0] < 0.35 and kept[1] > 0.98


def test_quality_sees_the_order_of_words(spark):
    """The same words in another order than all texts have are less likely."""
    words = "red cat sits on new mat by old oak in big wood".split()
    rows = [(i, " ".join(words * 6), "en") for i in range(20)] + [(20, " ".join(words[::-1] * 6), "en")]
    got = {r.doc.doc_id: r.log_ppl for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len({got[i] for i in range(20)}) == 1 and got[20] > got[0] + 0.1


def test_byte_ngrams_run_on_from_word_to_word():
    buf = np.frombuffer(b"abc d ef", np.uint8)
    _, key = byte_model.word_ngrams(buf, np.array([0, 4, 6]), np.array([3, 5, 8]), np.array([True, False, True]))
    a, b, c, d, e, f = range(98, 104)
    want = [(0, 0, a), (0, a, b), (a, b, c), (b, c, 257), (c, 257, d), (257, d, 257), (0, 0, e), (0, e, f), (e, f, 257)]
    assert key.tolist() == [(x * 258 + y) * 258 + z for x, y, z in want]


def test_quality_shuffled_models_give_the_same(spark, monkeypatch):
    want = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    monkeypatch.setattr(quality, "MODEL_BYTES", 0)
    for r in quality.query(spark, SF).collect():
        assert r.kept == want[r.doc_id].kept and r.log_ppl == pytest.approx(want[r.doc_id].log_ppl, nan_ok=True)


def test_quality_scores_all_words_of_a_text(spark):
    """Perplexities of whole texts, words of high cost included, by hand from the n-gram counts."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(list(a), rng.integers(1, 7))) for _ in range(60 + i)), x)
            for i, (a, x) in enumerate([("abcde", "en"), ("cdefg\u00e9", "fr"), ("abxyz", None)] * 5)]
    rows += [(20, rows[0][1] + " Qq#9 7@~Z\u6f22", "en"), (21, "a", "en"), (22, "", "en"), (23, None, "fr")]
    grams = {i: [] for i, _, _ in rows}     # per word
    for i, text, _ in rows:
        before = [0, 0]
        for word in (text or "").split():
            symbols = [*(b + 1 for b in word.encode()), 257]
            run = before + symbols
            grams[i].append([(run[k] * 258 + run[k + 1]) * 258 + run[k + 2] for k in range(len(symbols))])
            before = run[-2:]
    counts = defaultdict(Counter)
    for i, _, lang in rows:
        counts[lang or ""].update(g for word in grams[i] for g in word)
    models = [byte_model.estimate(np.array(sorted(c)), np.array([c[k] for k in sorted(c)])) for c in counts.values()]
    got = {r.doc.doc_id: r.log_ppl for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, words in grams.items():
        cost = -sum(max(byte_model.log_probs(m, np.array(word)).sum() for m in models) for word in words)
        assert got[i] == pytest.approx(cost / sum(map(len, words))) if words else got[i] is None


def test_quality_every_language_has_its_bands(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        letters = list("abcdefghijklmnopqrstuvwxyz"[k % 20:k % 20 + 2 + k // 8])
        rows += [(5 * k + i, " ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(60)), f"l{k}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc.doc_id: r for r in quality.quality(docs).collect()}
    for k in range(40):
        own = [got[5 * k + i] for i in range(5)]
        assert not any(r.base_failed for r in own)
        bins = sorted(np.floor(r.log_ppl / quality.BIN) for r in own)
        spread = max((bins[3] - bins[1]) * quality.BIN, quality.LEAST_RANGE)
        band = ((bins[1] + 0.5) * quality.BIN - quality.FENCE * spread, (bins[3] + 0.5) * quality.BIN + quality.FENCE * spread)
        assert all((r.lower, r.upper) == pytest.approx(band) for r in own)
    monkeypatch.setattr(quality, "MODEL_BYTES", 60_000)      # several models at a time, several times
    monkeypatch.setattr(quality, "BAND_ROWS", 0)
    for r in quality.quality(docs).collect():
        want = got[r.doc.doc_id]
        assert r.log_ppl == want.log_ppl and (r.kept, r.lower, r.upper) == (want.kept, want.lower, want.upper)


def test_sentence_pieces_match_the_library(docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    rng = np.random.default_rng(2)
    alphabet = list("abcdefgh  \n\tétheAB01.<>▁漢🙂") + ["the", "ing", "  "]
    texts = [t or "" for _, t in docs] + ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(1500)]
    texts += [" " * k for k in range(20)] + ["the" * 400, "a" * 5000, "inging" * 900, "x  " * 300]
    ids, bounds = sentence_pieces.Encoder(sentence_pieces.model_path())(pa.array(texts))
    pieces = sentence_pieces.Pieces(sentence_pieces.model_path())
    for text, s, e in zip(texts, bounds, bounds[1:]):
        assert ids[s:e].tolist() == lib.encode(text)
        assert pieces.decode(ids[s:e]) == text.replace("▁", " ")


def test_sentence_pieces_unigram_commits_in_a_window():
    """Scores without ties: the streamed path is the library's best path, also over commits."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(sentence_pieces.model_path(), "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = sentence_pieces.UNIGRAM
    rng = np.random.default_rng(3)
    for p in model.pieces:
        if p.type == sentence_pieces.NORMAL:
            p.score = float(-rng.uniform(5, 6) - 0.5 * len(p.piece))
    proto = model.SerializeToString()
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
    mine = sentence_pieces.Pieces(proto=proto)
    for _ in range(60):
        text = "".join(rng.choice(["the", "ing", "re", "a", "tion", "o", "s"], rng.integers(1, 400)))
        got = mine.encode_segment("▁" + text)
        want = lib.encode(text)
        score = [sum(mine.score[i] for i in x) for x in (got, want)]
        assert got == want or score[0] == pytest.approx(score[1], rel=1e-5)


def test_sentence_pieces_query(spark, docs):
    got = {r.doc_id: r for r in sentence_pieces.query(spark, SF).collect()}
    assert all(got[i].text_sha256 == brute.sha(t or "") for i, t in docs) and len(got) == len(docs)


def check_packing(rows, want):
    """rows: pieces; want: {id: ids with the end}."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at:at + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    total = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.SEQUENCE
        total += at
    return total, len(sequences)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: e.ids + [1] for (i, _), e in zip(docs, tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False))}
    total, n = check_packing(packing.query(spark, SF).collect(), want)
    assert total == sum(map(len, want.values())) and n == -(-total // packing.SEQUENCE)


def test_word_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rng = np.random.default_rng(4)
    alphabet = list("abcXYZ019.,'<|>é İΣς漢é") + ["<|endoftext|>", "<|EndOfText|>", "'s", "'LL", " ", "\n", "\x0b", " ", "...", "a.", "Z,", "9."]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(2000)]
    ids, bounds = packing.WordIds(packing.tokenizer_path())(pa.array(texts))
    for text, s, e in zip(texts, bounds, bounds[1:]):
        assert ids[s:e].tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_assign_balances_cost():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 2049, 700)
    placed = packing.assign(sizes)
    load = defaultdict(list)
    for piece, start, n, to, _ in placed:
        load[to].append(n)
    assert sum(map(sum, load.values())) == sizes.sum() and len(load) == -(-sizes.sum() // 2048)
    assert max(map(sum, load.values())) <= 2048


def test_secret_scan(spark, docs):
    for r in secret_scan.query(spark, SF).collect():
        base = brute.base_secrets(dict(docs)[r.doc_id])
        text = secret_scan.show(base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == brute.sha(text)
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_secret_links(spark):
    access, weak, url = "AKIA" + "ABCDEFGH12345678", "aB3" * 13 + "x", "https://db.example.org/x"
    gap = " " * 300
    far = " " * (secret_scan.SCOPE + 50)
    texts = [f"{access} {weak} {url}", f"{weak} {url}", f"{access} {far}{weak}", f"{access}{gap}{weak}{gap}{url}", f"{url} {access}",
             f"{far}{url} {weak}{gap}{access}{far}{url}"]
    rows = secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) \
        .select("doc_id", secret_scan.spans_text().alias("s")).collect()
    kinds = {r.doc_id: [x.split(":")[0] for x in r.s.split(",") if x] for r in rows}

    def expected(text):
        access_, parts = [s for s in brute.base_secrets(text) if s[1] == 1], secret_scan.weak_spans(text)

        def near(a, b):
            return max(b[0] - a[2], a[0] - b[2], 0) <= secret_scan.SCOPE
        out = list(brute.base_secrets(text))
        for p in parts:
            if any(near(p, a) for a in access_) and (p[1] == 3 or any(q[1] == 3 and near(p, q) for q in parts)):
                out.append(p)
        return [secret_scan.KINDS[k] for _, k, _ in sorted(out)]

    assert kinds == {i: expected(t) for i, t in enumerate(texts)}
    assert kinds[0] == ["access", "secret", "endpoint"] and kinds[1] == [] and kinds[2] == ["access"]


def test_secret_forms(spark):
    """Spans written out by hand: env, ini, quoted and URL forms, assignments as secrets."""
    access, weak = "AKIA" + "ABCDEFGH12345678", "aB3" * 13 + "x"
    url, far = "https://db.example.org/x", " " * (secret_scan.SCOPE + 50)

    def at(text, **parts):
        return {f"{k}:{text.index(p)}:{text.index(p) + len(p)}" for k, p in parts.items()}

    env = f"AWS_ACCESS_KEY_ID={access}\nAWS_SECRET_ACCESS_KEY={weak}\n"
    ini = f"[default]\naws_access_key_id = {access}\naws_secret_access_key = {weak}\n"
    quoted = f'{{"id": "{access}", "key": "{weak}"}}'
    query = f"{access} https://db.example.org/x?sig={weak}"
    named = f"{access} secret: abcdef99 {url}"
    apart = f"{access}{far}secret: abcdef99 {url}"
    alone = f"AWS_SECRET_ACCESS_KEY={weak} {url}"
    long = f"{access} k={weak}Z"
    want = {
        env: at(env, access=access, secret=weak),
        ini: at(ini, access=access, secret=weak),
        quoted: at(quoted, access=access, secret=weak),
        query: at(query, access=access, secret=weak, endpoint=f"https://db.example.org/x?sig={weak}"),
        named: at(named, access=access, assign="secret: abcdef99", endpoint=url),
        apart: at(apart, access=access, assign="secret: abcdef99"),
        alone: set(),
        long: at(long, access=access),
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: {x for x in r.s.split(",") if x}
           for r in secret_scan.secret_spans(df).select("doc_id", secret_scan.spans_text().alias("s")).collect()}
    assert got == dict(enumerate(want.values()))
    masked = {r.doc_id: r.text for r in secret_scan.redacted(df).collect()}
    assert not any(weak in masked[i] for i in range(4)) and url not in masked[4]


def test_substring_dedup(spark, docs):
    got = substring_dedup.query(spark, SF).collect()
    want = sorted((i, n, g, brute.sha(t)) for i, n, g, t in brute.substring_dedup(docs))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r[2] for r in want) > 0
    assert sorted(sql_rows(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({substring_dedup.SQL})", "documents")) == want


def test_near_dup(spark, docs):
    want = brute.near_dup(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.query(spark, SF).collect()}
    assert got == want
    assert any(i != c for i, (_, c) in want.items())
    rows = sql_rows(f"SELECT doc_id, n_shingles, component_id FROM ({near_dup.SQL})", "documents")
    assert {i: (n, c) for i, n, c in rows} == want


def test_near_dup_large_mixed_groups(spark):
    """A family of edits in which most pairs are near the threshold, and one of copies."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10 ** 6, 120)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            w[p] = f"e{i}x{p}"
        rows.append((i + 1, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:60])) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_dup(rows)


def test_lm_score(spark, docs):
    got = {r.doc_id: r for r in lm_score.query(spark, SF).collect()}
    for i, held, n, known, train, base, score in brute.lm_scores(docs):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def exact_nearest(vectors, k=20):
    ids = np.array(sorted(vectors))
    m = np.stack([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        order = sorted((-s, i) for s, i in zip((m * vectors[q]).sum(axis=1), ids) if i != q)
        out[q] = [i for _, i in order[:k]]
    return out


def test_nearest(spark):
    rows = hilbert_ann.query(spark, SF).collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding}
    want = exact_nearest(vectors)
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), abs=1e-12)
    found = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(w) for q, w in want.items())


def test_hilbert_keys_are_a_curve():
    """Neighbours in key order are neighbours in space, and every cell has its own key."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3).astype(np.uint64)
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = cells[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_warc(spark):
    got = warc_store.query(spark, SF)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sql_rows(f"SELECT {', '.join(cols)} FROM ({warc_store.SQL})", "pages")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_warc_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 200 + "</p>é"
    rows = [(3, "http://a/\r\nX: y", page), (1, "http://b", page), (2, None, "short"), (5, "u", "short"), (4, "u", None), (None, "n", page)]
    path = str(tmp_path / "archive")
    warc_store.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    back = {r.page_id: r for r in warc_store.read_archive(spark, path).collect()}
    for i, _, html in rows:
        r = back[i]
        head, _, content = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        body = content[:int(fields[b"Content-Length"])]
        assert content == body + b"\r\n\r\n" and r.verified and bytes(r.payload).decode() == (html or "")
        assert body.decode() == ("" if r.record_type == "revisit" else html or "")
    assert {i: r.record_type for i, r in back.items()} == {1: "response", 3: "revisit", None: "revisit", 2: "response", 5: "response", 4: "response"}
    assert back[3].refers_to == 1 and back[None].refers_to == 1
