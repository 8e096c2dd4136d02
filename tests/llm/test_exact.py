"""Operators against brute force, library results and exact round trips, with odd inputs."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scriptorium.llm import chat, fingerprints, jaccard, media, packing, suffix_dedup, tiff, token_counts, url_filters
from scriptorium.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "a  b ", "\n", "<s>x</s>", "日本語 é é\x00", "x" * 3000, "the law " * 2000, "<|endoftext|> it's", "a", "a"]


def table(spark, texts, extra=True):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, tag string")
    return df if extra else df.select("doc_id", "text")


# ---- token counts -----------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" abcdetheino.▁\n\t日本é́<s>12😀", max_size=60))
def test_counts_equal_the_library(text):
    import sentencepiece

    lib = test_counts_equal_the_library.__dict__.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    assert token_counts.piece_counter(PIECES).count(text) == len(lib.encode(text))


def test_counts_of_odd_texts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, ODD), PIECES).collect()}
    assert got == {i: len(lib.encode(t or "")) for i, t in enumerate(ODD)}
    assert token_counts.count_tokens(table(spark, []), PIECES).count() == 0


# ---- packing ----------------------------------------------------------------------------


def test_packing_loses_and_doubles_nothing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["the", "Law", "of!", "éa", "zq"]) for _ in range(rng.randint(0, 900))) for _ in range(120)]
    lib = Tokenizer.from_file(WORDS)
    rows = packing.pack(table(spark, texts), WORDS, window=256, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, t in enumerate(texts):
        whole = b"".join(b for _, b in sorted(pieces[i]))
        assert np.frombuffer(whole, "<u4").tolist() == [*lib.encode(t or "", add_special_tokens=False).ids, 1]
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(table(spark, []), WORDS).count() == 0


def test_plan_fills_windows():
    lengths = np.random.default_rng(1).integers(1, 2048, 5000)
    sequences, rest = packing.plan(lengths, 2048, 8)
    assert sorted([i for s in sequences for i in s] + rest) == list(range(5000))
    fill = [int(lengths[s].sum()) for s in sequences]
    assert max(fill) <= 2048 and sum(fill) / (2048 * len(fill)) > 0.99 and len(rest) < 500


def test_least_squares_finds_a_mix():
    columns = np.array([[3, 1, 0], [2, 2, 0], [2, 1, 1]])
    x = packing.nonnegative_least_squares(columns, np.array([14.0, 10.0, 4.0]))
    assert np.allclose(x, [4, 0, 10], atol=1e-3) or np.allclose([x[0] + 2 * x[2], 2 * x[1] + x[2], x[0]], [14, 10, 4], atol=0.6)


# ---- Jaccard join -----------------------------------------------------------------------


def brute_classes(texts, rule):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        k = min(rule.words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90, 100), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 40, 100)])
def test_classes_equal_brute_force(spark, rule):
    rng = random.Random(rule.num)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = list(ODD)
    for _ in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += passage
        texts.append(rng.choice([" ", "\t", "\n "]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicate_classes(table(spark, texts), rule).collect()}
    assert got == brute_classes(texts, rule)


def test_classes_of_few_rows(spark):
    rule = jaccard.Rule(5, 80, 100)
    assert jaccard.near_duplicate_classes(table(spark, []), rule).count() == 0
    assert [tuple(r) for r in jaccard.near_duplicate_classes(table(spark, [None]), rule).collect()] == [(0, 0, 0)]
    again = table(spark, ["a b c d e f"] * 3).withColumn("doc_id", F.when(F.col("doc_id") == 2, None).otherwise(F.lit(4)))
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard.near_duplicate_classes(again, rule).collect()) == [(0, 4), (4, 4), (4, 4)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 230)] + [(7, 3), (50, 50), (3, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 100 for i in range(101, 141)} | {i: 3 for i in [7, *range(200, 230)]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_of_a_join_go_as_they_are_used_up(spark, monkeypatch):
    tables, write = [], jaccard.written

    def seen(df, label, **options):
        out = write(df, label, **options)
        tables.append((label, os.path.dirname(urlsplit(out.inputFiles()[0]).path)))
        assert os.path.isdir(tables[-1][1])
        return out

    monkeypatch.setattr(jaccard, "written", seen)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(200)}" for _ in range(60)] for _ in range(12)]
    texts = [" ".join(w[:i] + ["new"] + w[i:]) for w in base for i in range(0, 60, 6)]
    rule = jaccard.Rule(5, 80, 100)
    found = jaccard.near_duplicate_classes(table(spark, texts), rule)
    assert {"sets", "postings", "open", "whole"} == {label for label, _ in tables}
    assert {label for label, path in tables if os.path.isdir(path)} == {"sets"}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_classes(texts, rule)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n, m in ((5, 6), (100, 110), (120, 130), (700, 640)):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: min(n, m) - 3], rng.integers(0, 1 << 63, max(0, m - n) + 3).astype(np.uint64)]))
        assert jaccard.differing_bits(jaccard.bitmap(np.unique(a)), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))


# ---- long repeats -----------------------------------------------------------------------


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for k, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out[k] = (len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        suffix_dedup.Sizes(), suffix_dedup.Sizes(batch_bytes=700, batch_windows=300, judged_together=20),
        suffix_dedup.Sizes(batch_bytes=900, batch_windows=300, judged_together=20, crowded=2), suffix_dedup.Sizes(batch_bytes=3000, batch_windows=300, hot_least=1, hot_share=1 << 40, block=16),
    ],
)
def test_repeats_equal_brute_force(spark, sizes):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(2, 9)))
    passages = ["".join(word() for _ in range(n)) for n in (45, 60, 35, 90)]
    texts = [*ODD, "xy" * 250, "z" * 200, "z" * 199]
    for _ in range(60):
        texts.append("".join(rng.choice([word(), word(), rng.choice(passages)[rng.randint(0, 40) :]]) for _ in range(rng.randint(1, 12))))
    texts += [texts[-1], texts[-2] + "!"]
    rows = suffix_dedup.dedupe_substrings(table(spark, texts).repartition(3, "doc_id"), sizes=sizes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_repeats(texts, 200)
    assert all(r.tag == "clash" for r in rows)
    assert suffix_dedup.dedupe_substrings(table(spark, [])).count() == 0


def test_texts_of_one_key_are_told_apart(spark):
    filler = F.concat(*[F.md5(F.concat_ws("-", "id", F.lit(k))) for k in range(8)])
    made = spark.range(30_000).select(filler.alias("text")).withColumn("bits", F.xxhash64("text").bitwiseAND(F.lit((1 << 25) - 1)))
    alike = made.groupBy("bits").agg(F.sort_array(F.collect_list("text")).alias("t")).filter("size(t) > 1").orderBy("bits").first().t
    rows = [(None, alike[0]), (None, alike[1]), (1, alike[0])]
    got = suffix_dedup.dedupe_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_text) for r in got) == [(0, 0, alike[1]), (0, 256, ""), (1, 256, "")]


def test_spans_of_many_families_are_few_files(spark, monkeypatch):
    files, write = {}, suffix_dedup.written

    def counted(df, label, **options):
        out = write(df, label, **options)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passages = [letters(260) for _ in range(40)]
    texts = [letters(90) + p + letters(90) for p in passages for _ in range(2)]
    rows = suffix_dedup.dedupe_substrings(table(spark, texts), sizes=suffix_dedup.Sizes(judged_together=2)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_repeats(texts, 200)
    assert files["spans"] <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_stages_of_the_pipeline_bound_the_bytes_of_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 1000).alias("text"))
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    before = spark.conf.get(name, None)
    try:
        for _, stage in corpus_pipeline.STAGES:  # each ends where it asks for its tables
            spark.conf.unset(name)
            with pytest.raises((AttributeError, AnalysisException)):
                stage(spark, None, "/nowhere")
            assert spark.conf.get(name, None) is not None
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 5_000_000
        spark.conf.set(name, "1000000")
        with pytest.raises(AttributeError):
            corpus_pipeline.packed(spark, None, "/nowhere")
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)
        if before is not None:
            spark.conf.set(name, before)


def test_blocks_of_crowded_surroundings_are_made_once(spark, monkeypatch):
    made, wanted, blocks, write = spark.sparkContext.accumulator(0), [], suffix_dedup._blocks, suffix_dedup.written

    def counted(length, size):
        def count(batches):
            for b in blocks(length, size)(batches):
                made.add(b.num_rows)
                yield b

        return count

    def seen(df, label, **options):
        out = write(df, label, **options)
        if label == "around":
            wanted.append(sum(b.num_rows for b in blocks(200, 8)(iter(out.filter("crowded").toArrow().to_batches()))))
        return out

    monkeypatch.setattr(suffix_dedup, "_blocks", counted)
    monkeypatch.setattr(suffix_dedup, "written", seen)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = letters(260)
    texts = [letters(90) + passage + letters(90) for _ in range(20)]
    rows = suffix_dedup.dedupe_substrings(table(spark, texts), sizes=suffix_dedup.Sizes(crowded=2)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_repeats(texts, 200)
    assert 0 < made.value == wanted[0]


def test_index_family_merges_geometrically():
    rng = np.random.default_rng(3)
    family = suffix_dedup.IndexFamily(20)
    texts = [bytes(rng.integers(97, 99, 60, dtype=np.uint8)) for _ in range(64)]
    for i in range(0, 64, 4):
        family.add(texts[i : i + 4])
    seen = Counter(t[i : i + 20] for t in texts for i in range(41))
    assert np.concatenate(family.repeats).tolist() == [seen[t[i : i + 20]] > 1 for t in texts for i in range(41)]
    assert len(family.levels) <= 5


# ---- urls -------------------------------------------------------------------------------


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/")]
    urls = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "nourl": ("", "", None, "allow"), "http://A.NET": ("a.net", "", None, "allow"), "http://a.net/": ("a.net", "/", "net/", "block"), "x://b.Example.net/en/q?x#y": ("b.example.net", "/en/q", "example.net/en/", "allow"),
            "h://example.net/enx": ("example.net", "/enx", "net/", "block"), "h://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "h://u@example.com:80/de/": ("u@example.com:80", "/de/", None, "allow"), "h://example.com/de/#?": ("example.com", "/de/", "example.com/de/", "block"), "h://É.net/x": ("É.net", "/x", "net/", "block")}
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = url_filters.judge_urls(df, url_filters.ship_index(spark, rules)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == list(urls.values())
    none = url_filters.judge_urls(df, url_filters.ship_index(spark, [])).select("verdict").distinct().collect()
    assert [r.verdict for r in none] == ["allow"]


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filters.xxhash, "xxh64_intdigest", lambda b: 7)
    url_filters.write_index([("block", "a", "/"), ("allow", "b", "/")], str(tmp_path / "i"))
    assert url_filters.DigestArray(str(tmp_path / "i")).probe(["a/", "b/", "c/"]) == ["block", "allow", None]


# ---- fingerprints -----------------------------------------------------------------------


def test_fingerprints_guarantee_shared_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(fingerprints.K + fingerprints.WINDOW - 1))
    pairs = [(i, " ".join([*[word() for _ in range(rng.randint(0, 30))], passage, *[word() for _ in range(rng.randint(0, 30))]]), passage if i == 0 else passage + " " + word()) for i in range(20)]
    df = spark.createDataFrame(pairs, "i long, a string, b string").withColumns({"x": fingerprints.winnow(F.col("a")), "y": fingerprints.winnow(F.col("b"))})
    for r in df.select("a", "b", fingerprints.shared_positions(F.col("x"), F.col("y")).alias("s")).collect():
        assert r.s and all(r.a.split()[m.a : m.a + fingerprints.K] == r.b.split()[m.b : m.b + fingerprints.K] for m in r.s)


def test_rightmost_of_equal_hashes_is_kept(spark):
    df = spark.createDataFrame([("same " * 40,)], "t string").select(fingerprints.winnow(F.col("t"), 2, 5).alias("m"))
    assert [r[0] for r in df.select(F.explode(F.transform("m", fingerprints.position_of))).collect()] == list(range(4, 39))


def test_next_rows_across_ranges(spark):
    ids = [None, 5, 5, 9, 1, 70, 33, 21]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = {r.text: r.next_text for r in fingerprints.with_next(df, "doc_id", ["text"], "text", rows_in_bucket=2).collect()}
    assert got == {"t0": "t4", "t4": "t1", "t1": "t2", "t2": "t3", "t3": "t7", "t7": "t6", "t6": "t5", "t5": "t0"}
    assert fingerprints.with_next(df.limit(0), "doc_id", ["text"], "text").count() == 0
    assert [r.next_text for r in fingerprints.with_next(df.filter("doc_id = 9"), "doc_id", ["text"], "text").collect()] == ["t3"]


def test_fingerprints_of_odd_texts(spark):
    df = table(spark, ODD).withColumn("m", fingerprints.winnow(F.col("text")))
    rows = df.select("text", fingerprints.fingerprint_string(F.col("m")).alias("f"), fingerprints.likeness(F.col("m"), F.col("m")).alias("l")).collect()
    assert all(r.l == 1.0 and r.f for r in rows) and len({r.f for r in rows if r.text in (None, "", " ", "\n")}) == 1


# ---- chat -------------------------------------------------------------------------------


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 0.0), (1, 5, 99, 2.0), (2, 1, 2, 0.0), (2, 2, 1, 0.0), *[(3, i, i - 1 if i > 1 else None, None) for i in range(1, 41)]]
    m = spark.createDataFrame(rows, "tree long, msg long, parent long, score double").withColumns({"role": F.lit("user"), "text": F.col("msg").cast("string")})
    paths = chat.reply_paths(m)
    got = defaultdict(list)
    for r in paths.orderBy("tree", "leaf", F.desc("dist")).collect():
        got[r.tree, r.leaf].append(r.msg)
    assert dict(got) == {(1, 3): [1, 3], (1, 4): [1, 2, 4], (1, 5): [5], (3, 40): list(range(1, 41))}
    best = chat.rank_paths(paths, m, keep=2)
    assert {(r.tree, r.leaf, r["rank"]) for r in best.collect()} == {(1, 3, 1), (1, 5, 2), (3, 40, 1)}


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nx", "<\\/s> \\ <\\\\s>", "", None, "<|im_start|>", "a < b [c]", "\n\n"]
    turns = spark.createDataFrame([(1, i, "assistant" if i % 2 else ["user", "ro\nle\\n", None][i % 3], t, "x") for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string, formatted string")
    m = chat.linear_threads(turns)
    paths = chat.reply_paths(m)
    made = chat.format_paths(paths, chat.rank_paths(paths, m), m)
    r = chat.read_back(made).first()
    assert [(t.role, t.text) for t in r.turns] == [("assistant" if i % 2 else ["user", "ro\nle\\n", ""][i % 3], t or "") for i, t in enumerate(texts)]
    assert r.loss_text == "".join(t or "" for t in texts[1::2]) and [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] != []
    assert not any(c in r.formatted for c in chat.CONTROL if c not in (chat.START, chat.END)) and r.formatted.count(chat.END) == len(texts)
    assert chat.reply_paths(chat.linear_threads(turns.limit(0))).count() == 0


def test_turns_without_a_conversation(spark):
    turns = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 2, "user", "c"), (None, 3, "assistant", "d"), (None, 4, "user", "e"), (5, 0, "user", "f")]
    m = chat.linear_threads(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    paths = chat.reply_paths(m)
    back = chat.read_back(chat.format_paths(paths, chat.rank_paths(paths, m), m)).collect()
    assert {r.tree: ("".join(t.text for t in r.turns), r.loss_text) for r in back} == {None: ("abcde", "bd"), 5: ("f", "")}


# ---- media ------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_known_stream():
    # 9-bit codes: clear, 7, 258, 8, 8, 258, 6, end (7 7 7 8 8 7 7 6, worked out by hand)
    codes = [256, 7, 258, 8, 8, 258, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw_decode(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6])


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("layout", [(None, "<", 1), ((16, 32), ">", 2), (None, ">", 2), ((16, 16), "<", 1)])
def test_pages_round_trip(spark, compression, layout):
    tile, order, predictor = layout
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 256, (37, 64), dtype=np.uint8), rng.integers(0, 1 << 16, (20, 33, 3)).astype(np.uint16)]
    back = list(tiff.pages(tiff.write(images, compression, predictor, 10, tile, order)))
    assert [b.pixels.squeeze().tolist() for b in back] == [i.tolist() for i in images]


def test_media_of_odd_payloads(spark):
    files = [None, b"", b"junk", tiff.write([np.zeros((3, 64), np.uint8)] * 2), tiff.write([np.zeros((3, 64), np.uint8)])[:40]]
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary").withColumn("page", F.lit("clash"))
    rows = media.tiff_pages(df, "media", with_pixels=True).orderBy("doc_id", "page").collect()
    assert [(r.doc_id, r.page, r.error is None) for r in rows] == [(0, -1, False), (1, -1, False), (2, -1, False), (3, 0, True), (3, 1, True), (4, -1, False)]
    stored = media.tiff_pages(media.to_tiff(spark.createDataFrame([(b"",), (None,), (b"x" * 65,)], "p binary"), "p"), "media", with_pixels=True).collect()
    assert [bytes(r.pixels) for r in stored] == [bytes(64), bytes(64), b"x" * 65 + bytes(63)]


def test_damaged_files_give_a_row_each(spark):
    rng = random.Random(8)
    image = np.random.default_rng(8).integers(0, 9, (40, 64), dtype=np.uint8)
    files = [tiff.write([image, image[:7]], c, 1, 10, tile) for c in (tiff.DEFLATE, tiff.LZW, tiff.PACKBITS, tiff.NONE) for tile in (None, (16, 16))]
    damaged = []
    for i in range(2000):
        data = bytearray(files[i % len(files)])
        for _ in range(rng.randint(1, 3)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        damaged.append((i, bytes(data[: rng.choice([len(data), rng.randint(0, len(data))])])))
    rows = media.tiff_pages(spark.createDataFrame(damaged, "doc_id long, media binary"), "media").collect()
    assert {r.doc_id for r in rows} == set(range(2000))
    assert all((r.page >= 0) == (r.error is None) for r in rows)
