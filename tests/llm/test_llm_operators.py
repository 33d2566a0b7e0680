"""The operators against brute force, exact round trips and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attrilake.llm import bpe, common, exact_dedup, html_extract, jpeg, language_id, minhash, packing, queries, secret_scan, shingles, toxicity, unit_dedup
from attrilake.llm.wordbpe import WordBpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "w" * 30_000 + " " + "xyz " * 20_000
#: Nulls, empty and blank texts, ties, repeated rows, very long texts.
ODD = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \t\n\x0b\f\r", None, None, 6), (4, "One two three four five six", "en", "s", 27), (5, "one two  three four FIVE six ", "en", "s", 29),
    (5, "one two  three four FIVE six ", "en", "s", 29), (None, "One two three four five six", "en", "s", 27), (6, "short", "en", "s", 5), (7, "SHORT", "en", "s", 5),
    (8, LONG, "en", "s", len(LONG)), (9, LONG + "!", "en", "s", len(LONG) + 1), (10, "Ünïcödé 🙂 текст 日本語", "xx", "t", 20), (None, None, None, None, None), (11, "\x1c\x85  a", "en", "s", 4),
]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"keys": F.lit(1), "row_id": F.lit("x"), "size": F.lit(0.5), "tokens": F.lit(None), "digest": F.lit("d"), "language": F.lit("l")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows, percent=85):
    """Smallest reachable doc_id by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in rows.items()}
    parent = {d: d for d in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in rows}


def test_op1_equals_brute_force(spark, sf_dir):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.queries()["op1_minhash_near_dedup"](spark, sf_dir).collect()}
    assert got == brute_components(texts(spark, sf_dir))


def test_op1_chains_and_large_buckets(spark, monkeypatch):
    """A drifting chain of near copies links end to end, also when buckets are cut into blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = {}
    for i in range(70):
        rows[i] = " ".join(words)
        for _ in range(2):
            words[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
    rows |= {100 + i: rows[3] for i in range(40)}
    got = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_op1_odd_rows(spark, odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and len({r.row_id for r in got}) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert by[4] == by[5] == {(2, 4)} and by[None] == {(0, None), (2, 4)} and by[6] == by[7] == {(1, 6)}
    assert by[8] == {(len(shingle_set(LONG)), 8)} and by[9] == {(len(shingle_set(LONG + "!")), 9)}
    assert minhash.near_duplicates(empty).count() == 0


def test_bayesian_bounds():
    need = minhash.least_matches(85, 1e-6)
    assert list(need) == sorted(need) and all(0 < m < 0.85 * n for n, m in need.items())
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, (300, 120), np.uint32)
    near, far = a.copy(), a.copy()
    near[rng.random(a.shape) > 0.9] += 1
    far[rng.random(a.shape) > 0.4] += 1
    both = np.concatenate([a, near, far])
    n = np.arange(300)
    assert len(minhash.plausible(both, n, 300 + n, need)[0]) == 300 and len(minhash.plausible(both, n, 600 + n, need)[0]) == 0


def test_shingles_in_numpy():
    import pyarrow as pa

    rows = ["a b c d e f", "A B C D E F", "", None, "x", "x ", "a b c d e f a b c d e f", LONG, " \n"]
    got = shingles.shingle_sets(pa.array(rows), 5)
    assert [len(s) for s in got] == [len(shingle_set(t)) for t in rows]
    assert np.array_equal(got[0], got[1]) and np.array_equal(got[4], got[5]) and not np.array_equal(got[0], got[4])


ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_BPE), special_tokens={})


def test_op2_equals_tiktoken(spark, sf_dir):
    rows = texts(spark, sf_dir)
    got = queries.queries()["op2_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = ENCODING.encode_ordinary(rows[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()


def test_op2_random_and_long_pieces():
    codec = bpe.ByteBpe(bpe.read_ranks(BYTE_BPE), public_tokenizers.PATTERN, remembered=50)
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x400), rng.randrange(0x4E00, 0x4E40)])) for _ in range(rng.randrange(200)))
        assert codec.encode(text) == ENCODING.encode_ordinary(text)
    text = "".join(rng.choice("abcdest") for _ in range(50_000))
    assert codec.encode(text) == ENCODING.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    assert codec.encode("a" * 500) == ENCODING.encode_ordinary("a" * 500)


def test_op2_columns_round_trip(spark, odd, empty):
    ids = bpe.encode_column(odd, BYTE_BPE, public_tokenizers.PATTERN)
    raw = bpe.decode_column(ids, BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.raw)) for r in raw) == sorted((r[0] or 0, (r[1] or "").encode()) for r in ODD)
    assert bpe.round_trip(empty, BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def base_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def check_spans(row, text):
    base = base_spans(text or "")
    assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
    listed = [f"{kind}:{a}:{b}" for a, _, kind, b in base]
    assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
    assert [s for s in row.spans.split(",") if s and not s.startswith("random")] == listed


def test_op3_equals_brute_force(spark, sf_dir):
    rows = texts(spark, sf_dir)
    got = queries.queries()["op3_secret_scan"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        check_spans(r, rows[r.doc_id])


def test_op3_odd_texts_and_the_models(spark, tmp_path):
    hits = "é token=token: abcdefgh AKIA" + "B" * 16 + " PassWord : 'abc123' apikey=12345 " + "ab" * 12 + "x" + "cd" * 11
    rows = [(1, hits), (2, None), (3, ""), (4, hits * 300), (5, "🙂 secret = abcdef"), (6, "key Zk3xQ9vLp2Wm8RtY4bNc7 end"), (7, "getUserAccountSettings http_response_status_code thisisalongordinaryword " * 40), (1, hits)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secret_scan.op3(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        check_spans(r, dict(rows)[r.doc_id])
    spans = {r.doc_id: r.spans for r in got}
    assert spans[6] == "random:4:25" and spans[7] == ""


def test_op3_redaction(spark, odd, empty):
    rows = [(1, "a token=abcdef b " + "f" * 24, "en", "s", 1), (2, "clean", "en", "s", 5)]
    got = {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redacted(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ("a [SECRET] b [SECRET]", 21), 2: ("clean", 5)}
    assert sorted(r.text or "" for r in secret_scan.redacted(odd).collect() if len(r.text or "") < 100) == sorted(r[1] or "" for r in ODD if len(r[1] or "") < 100)
    assert secret_scan.redacted(odd).columns == odd.columns and secret_scan.redacted(odd).count() == len(ODD)
    assert secret_scan.scan(empty).count() == 0


def brute_groups(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0))
    return sorted((len(g), -min(g)[0], None if min(g)[1] else min(g)[2]) for g in groups.values())


def test_op4_odd_rows(spark, odd, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len({r.digest for r in got})
    kept = sorted((r.group_size, r.keep_id) for r in got if r.kept and r.keep_id is not None)
    want = sorted((n, i) for n, _, i in brute_groups(ODD) if i is not None)
    assert kept == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_op4_verifies_bytes(spark, monkeypatch):
    """With a digest that collides, groups follow the bytes."""
    monkeypatch.setattr(exact_dedup, "sha256_hex", lambda c: F.lit("same"))
    rows = [(i, t) for i, t in enumerate(["a", "a ", "b", "c", "b", "a"])]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (1, 3, False), 1: (1, 3, True), 2: (2, 2, True), 3: (3, 1, True), 4: (2, 2, False), 5: (1, 3, False)}


def test_op4_batches(spark):
    index = exact_dedup.LsmIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.insert(frame([(1, "a b"), (2, "c")]))
    assert [tuple(r) for r in index.lookup(frame([(9, "ab"), (8, "d")])).collect()] == [(9, 1)]
    index.insert(frame([(3, "ab "), (4, "a  b"), (5, "d")]))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in index.resolve().collect()}
    assert got == {1: (4, 3), 3: (4, 3), 4: (4, 3), 2: (2, 1), 5: (5, 1)}


def test_op4_levels_and_filters(spark, monkeypatch):
    """A level takes in only runs that it doesn't hold, and a filter stops new rows before the level."""
    index = exact_dedup.LsmIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    read = []
    runs = exact_dedup.LsmIndex.runs
    monkeypatch.setattr(exact_dedup.LsmIndex, "runs", lambda self, since=0: read.append(since) or runs(self, since))
    for b in range(3):
        index.insert(frame([(10 * b + i, f"text {i % 4} of {b if i < 6 else 0}") for i in range(9)]))
        index.compact()
    assert read == [0, 1, 2] and index.compact().agg(F.sum("group_size")).first()[0] == 27 and "level-2" not in index.scratch.names
    asked = [(100, "text 0 of 0"), (101, "text 1 of 2"), (102, "new"), (103, "text  2of 1"), (None, "text 3 of 0"), *((200 + i, "text 0 of 0") for i in range(40)), *((300 + i, f"unknown {i}") for i in range(500))]
    got = {r.doc_id: r.keep_id for r in index.lookup(frame(asked)).collect()}
    assert set(got) == {100, 101, 103, None, *range(200, 240)} and got[101] == 21 and got[103] == 12 and {got[d] for d in range(200, 240)} == {got[100]}
    met = spark.read.parquet(index.scratch.path("met"))
    assert met.count() <= 46 and met.filter("doc_id >= 300").count() <= 2  # probes let nearly nothing else through
    assert exact_dedup.LsmIndex(spark).lookup(frame(asked)).isEmpty()


def test_op4_lookup_verifies_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "sha256_hex", lambda c: F.lit("same"))
    index = exact_dedup.LsmIndex(spark)
    index.insert(spark.createDataFrame([(1, "a"), (2, "bb"), (3, "b b")], "doc_id long, text string"))
    got = {r.doc_id: r.keep_id for r in index.lookup(spark.createDataFrame([(7, "a"), (8, "bb "), (9, "c")], "doc_id long, text string")).collect()}
    assert got == {7: 1, 8: 3}


def test_op4_hot_group(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    rows = [(i, "hot text") for i in range(60)] + [(100 + i, f"t{i % 7}") for i in range(30)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 100} == {(0, 60)} and len(got) == 90


def test_op5_finds_languages(spark, sf_dir):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: r.l for r in pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)', 1).alias("l")).collect()}
    got = queries.queries()["op5_language_id"](spark, sf_dir).collect()
    assert len(got) == len(want) and np.mean([r.language == want[r.page_id] for r in got]) > 0.95 and all(r.accepted for r in got)
    # evidence decides where text can't
    rows = [(i, "on", lang, "h" + lang, "h" + lang) for lang in ("en", "de") for i in range(20)] + [(99, "on", "de", "hde", "hde"), (98, "12", "de", "hde", "hde")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, d string, h string, m string")
    found = {r.id: r for r in language_id.identify(language_id.as_rows(frame, "doc_id", frame["text"], frame["d"], frame["h"], None, frame["m"]), model).collect()}
    assert not found[98].accepted and found[98].language is None and found[99].language in model.languages


def test_op5_equals_brute_force(spark, sf_dir):
    """The registered query against a fusion of the same text likelihoods in plain Python."""
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = language_id.page_rows(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    n, soft = len(model.languages), lambda x: np.exp(x - np.max(x)) / np.exp(x - np.max(x)).sum()
    found = {r.id: model.evidence(r.text or "") for r in rows}
    told = [r for r in rows if found[r.id][2]]
    p = {r.id: soft(np.array(found[r.id][0])) for r in told}
    total, want = sum(p.values()), {}
    sums = {k: defaultdict(lambda: [0, np.zeros(n)]) for k in ("host", "domain", "declared", "suffix")}
    for r in told:
        for k, by in sums.items():
            if r[k] is not None:
                by[r[k]][0] += 1
                by[r[k]][1] = by[r[k]][1] + p[r.id]
    for r in told:
        own = p[r.id]
        prior = (total - own + 1) / (len(told) - 1 + n)
        for k in ("domain", "host"):
            if r[k] is not None:
                size, c = sums[k][r[k]]
                prior = (c - own + 10 * prior) / (size - 1 + 10)
        score = np.array(found[r.id][0]) + np.log(np.maximum(prior, 1e-9))
        for k in ("declared", "suffix"):
            if r[k] is not None:
                size, c = sums[k][r[k]]
                score += np.log(np.maximum(c - own + 5 * size / len(told), 1e-9) / (total - own + 5))
        posterior = soft(score)
        want[r.id] = model.languages[posterior.argmax()], posterior.max(), posterior.max() >= 0.5 and found[r.id][1] <= 8
    got = queries.queries()["op5_language_id"](spark, sf_dir).collect()
    assert len(got) == len(rows) and len(want) > 0
    for r in got:
        language, confidence, accepted = want.get(r.page_id, (None, None, False))
        assert r.language == language and r.accepted == accepted and (confidence is None or abs(r.confidence - confidence) < 1e-5)


def test_op5_text_alone_tells_held_out_documents(spark, sf_dir):
    """Text likelihoods, without any declared evidence, on rows that the model's sample doesn't hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    held = [(r.lang, model.evidence(r.text or "")) for r in docs.filter("doc_id % 2 = 1").collect()]
    assert np.mean([model.languages[int(np.argmax(e[0]))] == lang for lang, e in held if e[2] >= 20]) > 0.97


def test_op5_rare_labels_have_models(spark):
    rows = [(i, f"the house and the garden {i}", "en") for i in range(30)] + [(50 + i, "maison très belle près du château", "fr") for i in range(2)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"] and model.languages[int(np.argmax(model.evidence("le château près de la maison")[0]))] == "fr"
    bounded = language_id.train(spark.createDataFrame([(i, "a few words", f"l{i % 200:03d}") for i in range(300)], "doc_id long, text string, lang string"))
    assert len(bounded.languages) == language_id.MOST_LANGUAGES and bounded.languages[:2] == ["l000", "l001"]


def test_op5_odd_pages(spark, sf_dir):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.createDataFrame([(1, None, None), (2, "no address", "<p>12</p>"), (None, "http://u@h.de:8/x", None), (2, None, "<html lang=>"), (3, "http://", LONG)], "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = language_id.identify(language_id.page_rows(pages), model).collect()
    assert len(got) == 5 and not any(r.accepted for r in got if r.id != 3)


def test_op5_odd_rows(spark, sf_dir, odd, empty):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = language_id.identify(language_id.as_rows(odd, "doc_id", odd["text"], odd["lang"], odd["source"]), model).collect()
    assert len(got) == len(ODD) and not any(r.accepted for r in got if r.id in (1, 2, 3))
    assert language_id.identify(language_id.as_rows(empty, "doc_id", empty["text"]), model).count() == 0
    none = language_id.train(empty)
    assert {r.accepted for r in language_id.identify(language_id.as_rows(odd, "doc_id", odd["text"]), none).collect()} == {False}


def test_op6_round_trips(spark, sf_dir, odd, empty):
    rows = texts(spark, sf_dir)
    for r in queries.queries()["op6_jpeg_media"](spark, sf_dir).collect():
        raw = (rows[r.doc_id] or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert jpeg.media_features(jpeg.to_media(odd)).count() == len(ODD) and jpeg.media_features(jpeg.to_media(empty)).count() == 0


def test_op6_any_bytes():
    rng = random.Random(2)
    zero = jpeg.SHIFT
    odd = [b"", b"\0" * 64, bytes([zero]) * 64, bytes([zero]) * 40 + b"z", rng.randbytes(5000), b"\xff" * 777, bytes(rng.choice([zero] * 9 + [0, 255]) for _ in range(9999))]
    for (payload, n, width, height, _), raw in zip(jpeg.read_images(jpeg.write_images(odd)), odd, strict=True):
        assert payload[:n] == raw and len(payload) % 64 == 0 and set(payload[n:]) <= {0} and width % 8 == height % 8 == 0
    for broken in (b"", b"\xff\xd8\xff\xc2\0\x04\0\0", jpeg.write_images([b"x" * 100])[0][:40]):
        with pytest.raises(ValueError):
            jpeg.read_images([broken])


def test_op6_without_restarts_and_in_colour():
    """The decoder reads intervals of many blocks, and components with sampling factors."""
    rng = np.random.default_rng(1)
    blocks = rng.integers(-60, 60, (12, 64)).astype(np.int64)
    blocks[:, 20:][rng.random((12, 44)) < 0.7] = 0

    def bits_of(block, before):
        out = ""

        def value(v):
            size = int(abs(v)).bit_length()
            return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

        size, raw = value(int(block[0]) - before)
        out += format(int(jpeg.DC_CODE[size]), f"0{int(jpeg.DC_LENGTH[size])}b") + raw
        run = 0
        last = max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, last + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                out += format(int(jpeg.AC_CODE[0xF0]), f"0{int(jpeg.AC_LENGTH[0xF0])}b")
                run -= 16
            size, raw = value(int(block[k]))
            out += format(int(jpeg.AC_CODE[run << 4 | size]), f"0{int(jpeg.AC_LENGTH[run << 4 | size])}b") + raw
            run = 0
        return out if last == 63 else out + format(int(jpeg.AC_CODE[0]), f"0{int(jpeg.AC_LENGTH[0])}b")

    # two MCUs of 2 x 2 luminance blocks and one block each of two colours
    before, bits = [0, 0, 0], ""
    component = [0, 0, 0, 0, 1, 2] * 2
    for b, c in zip(blocks, component, strict=True):
        bits += bits_of(b, before[c])
        before[c] = int(b[0])
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    tables = jpeg.segment(0xC4, b"\x00" + jpeg.DC[0] + jpeg.DC[1]) + jpeg.segment(0xC4, b"\x10" + jpeg.AC[0] + jpeg.AC[1])
    frame = jpeg.segment(0xC0, b"\x08\0\x10\0\x20\x03\x01\x22\0\x02\x11\0\x03\x11\0")
    raw = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + b"\x02" * 64) + frame + tables + jpeg.segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + data + b"\xff\xd9"
    image = jpeg.parse(raw)
    found = jpeg.decode_blocks([image])[0]
    assert np.array_equal(found[0], blocks[[0, 1, 2, 3, 6, 7, 8, 9]]) and np.array_equal(found[1], blocks[[4, 10]]) and np.array_equal(found[2], blocks[[5, 11]])
    assert jpeg.luminance(image, found).shape == (2, 4) and len(jpeg.average_hash(jpeg.luminance(image, found))) == 16


PASSAGE = "Passage one has a number of words in it for sure. It goes on for another whole sentence with more words! And ends."


def test_op7_finds_passages(spark, odd, empty):
    rows = [(3, "Alpha beta gamma.\n" + PASSAGE + "\ntail goes on"), (1, "host text\n\n " + PASSAGE), (2, None), (4, ""), (5, PASSAGE.upper() + "\r\n" + PASSAGE), (6, "Short one. " * 3), (7, "a clean text of its own. With nothing shared.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = unit_dedup.repeated_runs(df).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(3, 1), (5, 1)}
    text = dict(rows)
    for r in got:
        assert " ".join(text[r.doc_id][r.start : r.end].lower().split()).count(PASSAGE.lower()) >= 1
    clean = {r.doc_id: r for r in unit_dedup.without_runs(df).collect()}
    assert clean[3].text == "Alpha beta gamma.\n\ntail goes on" and clean[1].text == text[1] and clean[2].text is None
    for i, r in clean.items():
        assert "".join((text[i] or "")[s.start : s.end] for s in r.segments) == (r.text or "")
    assert unit_dedup.repeated_runs(odd).filter("doc_id IN (1, 2, 3)").isEmpty() and unit_dedup.repeated_runs(empty).count() == 0
    assert unit_dedup.without_runs(odd).count() == len(ODD)


def test_op7_removes_every_later_line_whatever_its_length(spark):
    rows = [(1, "One\ntwo words\nthree words here\nunique to the first"), (2, "x y z\nTWO  words\none"), (3, "three words here\n\nÜber alles\nx y"), (4, "one\nüber alles\nÜber alles")]
    got = sorted((r.doc_id, r.start, r.end, r.n_words, r.n_units, r.first_doc_id) for r in unit_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    # of Ü only A-Z would count as lower case, so the two spellings differ
    assert got == [(2, 6, 20, 3, 2, 1), (3, 0, 16, 3, 1, 1), (4, 0, 3, 1, 1, 1), (4, 15, 25, 2, 1, 3)]


def later_runs(rows, least):
    """(doc_id, start, end, words) by a plain pass over the documents in order: equal lines and windows of 51 words."""
    windows, lines, out = {}, set(), set()
    for d in sorted(rows):
        of = [(re.sub("[A-Z]", lambda m: m.group().lower(), m.group()), *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", rows[d] or "")]
        words, marked, at = [w for w, _, _ in of], [], 0
        for i in range(len(words) - 50):
            by, place = windows.setdefault(tuple(words[i : i + 51]), (d, i))
            if by != d or i >= place + 51:
                marked.append((i, i + 51))
        while at < len(of):
            end = at + 1
            while end < len(of) and not re.search(r"[\n\x0b\x0c\r]", rows[d][of[end - 1][2] : of[end][1]]):
                end += 1
            if tuple(words[at:end]) in lines:
                marked.append((at, end))
            lines.add(tuple(words[at:end]))
            at = end
        joined = []
        for a, b in sorted(marked):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        out |= {(d, of[a][1], of[b - 1][2], b - a) for a, b in joined if b - a >= least}
    return out


def test_op7_equals_brute_force(spark, sf_dir):
    rows = texts(spark, sf_dir)
    got = [(r.doc_id, r.start, r.end, r.n_words) for r in queries.queries()["op7_unit_dedup"](spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == later_runs(rows, 51)
    every = [(r.doc_id, r.start, r.end, r.n_words) for r in unit_dedup.repeated_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()]
    assert len(every) == len(set(every)) and set(every) == later_runs(rows, 1)


def later_words(rows):
    """Places of words in windows of 51 that stand earlier, by document; in one text only where they don't overlap."""
    first, out = {}, {}
    for d in sorted(rows):
        words = (rows[d] or "").lower().split()
        out[d] = set()
        for i in range(len(words) - 50):
            by, at = first.setdefault(tuple(words[i : i + 51]), (d, i))
            if by != d or i >= at + 51:
                out[d].update(range(i, i + 51))
    return out


def check_passages(got, rows):
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.end))
        assert r.n_words == len(rows[r.doc_id][r.start : r.end].split())
    for d, places in later_words(rows).items():
        of = [m.span() for m in re.finditer(r"\S+", rows[d] or "")]
        assert all(any(a <= of[i][0] and of[i][1] <= b for a, b in spans[d]) for i in places), d
        assert all(x[1] < y[0] for x, y in zip(sorted(spans[d]), sorted(spans[d])[1:]))
    return spans


def test_op7_finds_every_window_of_51_words(spark, sf_dir):
    rows = texts(spark, sf_dir)
    check_passages(queries.queries()["op7_unit_dedup"](spark, sf_dir).collect(), rows)


def test_op7_passages_of_any_sentences_and_edges(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    short = " ".join(f"{word().title()} {word()}." for _ in range(40))
    titles = " ".join(word().title() for _ in range(60))
    plain = " ".join(word() for _ in range(51))
    mixed = [" ".join(word() for _ in range(20)) for _ in range(20)]
    rows = {i: f"{mixed[2 * i]} {p} {mixed[2 * i + 1]}" for i, p in enumerate([short, titles, plain, plain.upper(), short, titles.lower().replace(" ", "\n"), plain.rpartition(" ")[0]])}
    rows[8] = f"{titles.swapcase()} x"  # the first half
    rows |= {9: "again " * 200, 10: f"{mixed[17]} {mixed[18]} {mixed[19]} and {mixed[17]} {mixed[18]} {mixed[19]}"}
    spans = check_passages(unit_dedup.repeated_runs(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect(), rows)
    assert {d for d, s in spans.items() if s} == {3, 4, 5, 8, 9, 10}
    assert rows[3][slice(*spans[3][0])] == plain.upper() and spans[9] == [(51 * 6, 200 * 6 - 1)]


def test_op8_learns_expressions(spark, odd, empty):
    rng = random.Random(4)
    words = ["".join(rng.choice(["ba", "de", "ki", "lo", "mu", "sa", "te"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = "grumf" + rng.choice(["", "er", "ish"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, [model]).collect()}
    held = [(got[i] >= 0.3, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == bool(t) for p, t in held]) > 0.95
    scores = toxicity.scored(odd, [model]).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.scored(empty, [model]).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(docs, [none]).collect()} == {0.0}


def brute_kneser_ney(rows, labels):
    """Evidence of a word by dictionaries: continuation counts of all words, class counts of labelled texts."""
    order, shared_cut, class_cut = toxicity.ORDER, toxicity.SHARED_DISCOUNT, toxicity.CLASS_DISCOUNT
    tokens = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())

    def grams(word):
        """(n-grams from the shortest to the longest) at each place; '^' is the word's beginning, '$' its end."""
        marked = "^" + word + "$"
        return [[marked[i + 1 - k : i + 1] for k in range(1, min(order, i + 1) + 1)] for i in range(1, len(marked))]

    longer = defaultdict(set)
    for w in {w for t in rows.values() for w in tokens(t)}:
        for at in grams(w):
            for g, h in zip(at, at[1:], strict=False):
                longer[g].add(h)
    n = {g: len(h) for g, h in longer.items()}
    top = {0: defaultdict(int), 1: defaultdict(int)}
    seen = {}
    for d in sorted(rows):
        if d in labels and zlib.crc32(str(d).encode()) % 4 != 2 and rows[d] not in seen:
            seen[rows[d]] = d
            for w in tokens(rows[d]):
                for at in grams(w):
                    top[labels[d]][at[-1]] += 1

    def totals(counts):
        sums = defaultdict(float)
        for g, c in counts.items():
            sums[len(g), g[:-1]] += c
        return sums

    def cuts(counts, cut):
        return totals({g: min(c, cut) for g, c in counts.items()})

    tables = [(n, totals(n), cuts(n, shared_cut), shared_cut), *((top[k], totals(top[k]), cuts(top[k], class_cut), class_cut) for k in (1, 0))]

    def mixed(table, g, p):
        counts, total, gone, cut = table
        key = len(g), g[:-1]
        if not total.get(key):
            return p
        return (counts.get(g, 0) - min(counts.get(g, 0), cut)) / total[key] + gone[key] / total[key] * p

    def evidence(word):
        out = 0.0
        for at in grams(word):
            p = toxicity.FLOOR
            for g in at[:-1]:
                p = mixed(tables[0], g, p)
            toxic, ordinary = (mixed(t, at[-1], p) for t in tables[1:])
            out += np.log(toxic / ordinary)
        return float(np.clip(out, -toxicity.MOST, toxicity.MOST))

    return n, evidence


def test_op8_equals_kneser_ney_by_hand(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_BITS", 21)  # so that no two n-grams meet in a cell
    rng = random.Random(8)
    words = ["".join(rng.choice(["ba", "de", "ki", "lo", "é"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    rows = {i: " ".join(rng.choice(words) + rng.choice(["", "", "grumf", " 7 "]) for _ in range(30)) for i in range(60)} | {60: None, 61: ""}
    rows[62] = rows[3]
    labels = {i: int(i % 4 == 0) for i in range(0, 63, 1) if i % 5}
    model = toxicity.train(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    counts, evidence = brute_kneser_ney(rows, labels)
    asked = sorted({w for t in rows.values() for w in toxicity.words_of(t)})[:60] + ["unheard", "x", "bagrumfde"]
    assert np.allclose(model.evidence(asked), [evidence(w) for w in asked], atol=0.05)
    # one continuation count by hand: what stands before "ba" anywhere, a word's beginning included
    before = {w[i - 1] if i else "^" for t in rows.values() for w in toxicity.words_of(t) for i in range(len(w) - 1) if w[i : i + 2] == "ba"}
    assert counts["ba"] == len(before)
    listed = spark.createDataFrame([(w, -1, 1) for w in {w for t in rows.values() for w in toxicity.words_of(t)}], "word string, kind int, n long")
    at = toxicity.Places(["ba"])
    gram = int(toxicity.high(at.keys[1][1:2])[0])
    assert toxicity.continuations(listed).filter((F.col("gram") == gram) & (F.shiftright("context", 32) == 2)).first().n == len(before)


def test_op8_whole_query(spark, sf_dir):
    rows, labels = texts(spark, sf_dir), {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.queries()["op8_toxicity"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    toxic, clean = ([r.score for r in got if labels.get(r.doc_id) == k] for k in (1, 0))
    assert np.mean(toxic) > np.mean(clean)


PARA = "The quick article paragraph tells of things in several words, with commas."


@pytest.mark.parametrize(("page", "text"), [
    (f"<html><body><header><ul><li>Home</li></ul></header><main><article><h1>Title here</h1><p>{PARA}<p>{PARA} &amp;\n more&nbsp;x</article></main><aside class='sidebar'><p>Related</p></aside><footer>Copyright</footer></body></html>", f"Title here\n{PARA}\n{PARA} & more x"),
    (f'<body><article><h1>T</h1><p>{PARA}</p><div class="ad">Buy now</div><p>{PARA}</p><form><label>Email</label></form><section class="comments"><p>User one said hello</p><p>{PARA}</p></section></article></body>', f"T\n{PARA}\n{PARA}"),
    (f'<div class="cookie-notice">We use cookies</div><div id="main"><p>{PARA}</p><script>var p="<p>no</p>";</script><style>p {{}}</style><!-- <p>no</p> --><p>{PARA}</p></div>', f"{PARA}\n{PARA}"),
    ("", ""), ("<p>", ""), ("<nav><a href='/'>Home</a></nav><footer>Imprint</footer>", ""),
])
def test_op9_templates(page, text):
    assert html_extract.main_text([page], html_extract.trained())[0] == text


def test_op9_drops_nothing_else():
    page = f"<body><article><noscript><p>{PARA}</p></noscript><p>{PARA} <math><mi>x</mi> = 2</math></p><object><p>{PARA}</p></object><template><p>{PARA}</p></template><p>{PARA}<svg><text> label</text></article><footer>Imprint</footer></body>"
    assert html_extract.main_text([page], html_extract.trained())[0] == f"{PARA}\n{PARA} x = 2\n{PARA}\n{PARA} label"


def test_op9_long_pages_go_in_slices():
    model = html_extract.trained()
    page = "<body><nav><ul><li>Home</li></ul></nav><article>" + f"<p>{PARA}</p>" * 20_000 + "</article><footer>Imprint</footer></body>"
    blocks = html_extract.blocks_of(page)
    assert np.abs(model.streamed(blocks[:700], 64) - model.chances([html_extract.vectors(blocks[:700])])[0]).max() < 1e-4
    assert html_extract.main_text(["", page, "<p>"], model) == ["", "\n".join([PARA] * 20_000), ""]


def test_op9_empty_tables_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "u", f"<article><p>{PARA}</p></article>", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_extract.extract(frame).collect()] == [(1, "u", PARA)] and html_extract.extract(frame.limit(0)).count() == 0


def test_op9_whole_table(spark, sf_dir):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.queries()["op9_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    right = 0
    for r in got:
        article = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article.replace("<br>", " "))]
        right += r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)
    assert right >= 0.99 * len(pages)
    odd = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, None)], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(odd).collect()] == ["", "", ""]


def test_lstm_gradients():
    """Backpropagation agrees with differences."""
    rng = np.random.default_rng(3)
    model = html_extract.Labeller.fresh(rng)
    pages = [rng.normal(size=(n, html_extract.FEATURES)).astype(np.float32) for n in (4, 2)]
    x, mask = html_extract.padded(pages)
    y = np.where(mask, rng.integers(0, 2, mask.shape), 0).astype(np.float32)
    gradients, _ = model.gradients(x, mask, y)
    for w, g in zip(model.weights(), gradients, strict=True):
        at = tuple(int(rng.integers(n)) for n in w.shape)
        keep, step = w[at], 1e-2
        w[at] = keep + step
        up = model.gradients(x, mask, y)[1]
        w[at] = keep - step
        down = model.gradients(x, mask, y)[1]
        w[at] = keep
        assert g[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def check_pieces(pieces, want):
    """want: the ids of each document, end id included, as a list."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length
        by_doc[p.doc_id].append((p.start, p.length, p.doc_tokens, tuple(ids)))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for doc, ids in want.items():
        got = sorted(by_doc.pop(doc))
        at = 0
        for start, length, total, piece in got:
            assert (start, total, list(piece)) == (at, len(ids), ids[at : at + length])
            at += length
        assert at == len(ids)
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # no padding at all


def test_op10_places_every_id_once(spark, sf_dir):
    slow = Tokenizer.from_file(WORD_BPE)
    rows = texts(spark, sf_dir)
    want = {d: [*slow.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows.items()}
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORD_BPE, shard_ids=20_000).collect()
    check_pieces(pieces, want)
    got = queries.queries()["op10_lexical_packing"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.agg(F.sum("length")).first()[0] == sum(map(len, want.values()))


def test_op10_odd_rows(spark, odd, empty):
    slow = Tokenizer.from_file(WORD_BPE)
    pieces = packing.pack(odd, WORD_BPE).collect()
    assert sum(p.length for p in pieces) == sum(len(slow.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_word_bpe_equals_tokenizers():
    fast, slow = WordBpe(WORD_BPE, words=20), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(6)
    odd = ["", "Σας ΟΔΟΣ", "a\x1cb", "x<|endoftext|>y", "日本語 12", "don't I'LL we've", "é İstanbul ǅ", "a\x85b", "​z ﻿x", "ſt K", "½²ªº µ", "$$$ &&&amp;", "a" * 3000, "🙂x", "̀abc", "é x"]
    odd += ["".join(chr(rng.choice([rng.randrange(1, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x370, 0x400)])) for _ in range(80)) for _ in range(200)]
    for text in odd:
        assert np.frombuffer(fast.encode(text), "<u2").tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_bm25_finds_neighbours():
    rng = np.random.default_rng(2)
    topics = [rng.integers(1000 * k, 1000 * k + 200, 400) for k in range(1, 6)]
    ids = [rng.choice(topics[i % 5], 120) for i in range(50)]
    df = np.bincount(packing.terms_of(ids)[1], minlength=packing.VOCABULARY)
    index = packing.Bm25Shard(ids, packing.rarity(df, 50), 120.0)
    brute = [[sum(packing.rarity(df, 50)[t] * (c := int((ids[d] == t).sum())) * 2.2 / (c + 1.2) for t in set(ids[s].tolist())) for d in range(50)] for s in (0, 7)]
    assert np.allclose(index.scores(0), brute[0], rtol=1e-4) and np.allclose(index.scores(7), brute[1], rtol=1e-4)
    unused = np.ones(50, bool)
    for seed in range(50):
        unused[:] = True
        unused[seed] = False
        found = index.neighbours(seed, unused)
        assert len(found) and all(d % 5 == seed % 5 for d in found[:5]) and seed not in found


def test_operators_equal_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf_dir), con.sql(sql)
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(con.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})').fetchall()), name


def test_components_of_long_paths(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(500, 501), (501, 500)]
    rng.shuffle(edges)
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "t"), "t").select("node", "root").collect()))
    assert got == {i: i // 50 * 50 for i in range(200)} | {500: 500, 501: 500}


def test_keyed_joins_with_hot_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}" if i % 3 else None) for i in range(60)], "row_id long, k string")
    groups = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    for how in ("inner", "left"):
        got = sorted((r.row_id, r.first) for r in common.join_keyed(rows, groups, "k", "n", 60, how=how).collect())
        assert got == sorted((r.row_id, r.first) for r in rows.join(groups, "k", how).collect())
    wide = groups.select("k", "first")
    got = sorted((r.row_id, r.first) for r in common.join_salted(rows.filter("k IS NOT NULL"), wide, "k", "row_id", 3).collect())
    assert got == sorted((r.row_id, r.first) for r in rows.join(wide, "k").collect())


def test_the_filter_loses_nothing(spark):
    rows = spark.range(5000).withColumn("k", F.concat(F.lit("k"), F.col("id")))
    keys = rows.filter("id % 7 = 0").select("k")
    got = {r.id for r in common.likely(rows, keys, "k").collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 1500


def test_word_bpe_words_with_one_mark(tmp_path):
    """Short cuts for words of letters with one other character give the file's own ids, whatever is remembered."""
    from attrilake.llm import wordbpe

    words = "Word word, word. WORD! word' word's don't a a. ab ab1 1 1a ab_ ab\x00 \x00 x\x7f ab-- ab-c é Été, été naïve. KK ét é. 日本. ''s 's s' <b> a<| ß ẞ. İ ı.".split(" ")
    slow = Tokenizer.from_file(WORD_BPE)
    for limit in (400_000, 3):
        bpe = wordbpe.WordBpe(WORD_BPE, words=limit)
        for w in (*words, *reversed(words)):
            assert np.frombuffer(bpe.encode(w), "<u2").tolist() == slow.encode(w, add_special_tokens=False).ids, w
        text = " ".join(words * 3)
        assert np.frombuffer(bpe.encode(text), "<u2").tolist() == slow.encode(text, add_special_tokens=False).ids
        assert max(len(bpe.new), len(bpe.old)) <= limit
    # one look for all words of a text that are known, and none of them encoded again
    bpe = wordbpe.WordBpe(WORD_BPE)
    bpe.encode("one two. three")
    asked = []
    bpe.piece = asked.append
    assert len(bpe.encode("three one two. one")) > 0 and asked == [] and isinstance(bpe.new, wordbpe.Remembered)


def test_terms_of_many_documents():
    """Keys of 32 bits up to 65,536 documents, of 64 beyond, say the same."""
    ids = [np.array([i % 7, 65535, i % 7], "<u2") for i in range((1 << 16) + 1)]
    small, large = packing.terms_of(ids[: 1 << 16]), packing.terms_of(ids)
    assert all((a == b[: len(a)]).all() for a, b in zip(small, large, strict=True)) and (small[0][-1], large[0][-1]) == (65535, 65536)
    assert [x[:4].tolist() for x in small] == [[0, 0, 1, 1], [0, 65535, 1, 65535], [2, 1, 2, 1]]


def test_word_bpe_remembers_words_without_case_and_stops():
    """Words that differ by case or by a full stop or comma behind them are encoded once, and runs of marks stay one piece."""
    from attrilake.llm import wordbpe

    slow, bpe = Tokenizer.from_file(WORD_BPE), wordbpe.WordBpe(WORD_BPE)
    text = "Word, word. WORD Été. été, ÉTÉ."
    assert np.frombuffer(bpe.encode(text), "<u2").tolist() == slow.encode(text, add_special_tokens=False).ids
    assert set(bpe.new) == {"word", "été", ".", ","}
    rng = random.Random(11)
    letters = [*"aAbzZéÉßÿÆµªº×÷", *"09²½¹", *".,.,.,", *"_-'\"()$\xad\xa8", *"  \n\t\xa0\x85\x00\x7f", "'s", "'LL", "Ÿ", "İ", "Σ", "̇", "日"]
    for k in range(4000):
        text = "".join(rng.choices(letters[: -5 if k % 2 else None], k=rng.randrange(1, 25)))
        assert np.frombuffer(bpe.encode(text), "<u2").tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)
