"""Operators on small literal tables."""

import sys

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import artifact, assemble, layout, measure, merge, numeric, pages, render, select, tables
from scriptorium.sources import connectors, files
from scriptorium.streaming import transcripts


def test_best_candidate_prefers_safety_then_score_then_order(spark):
    c = spark.createDataFrame([(1, 0, False, 9), (1, 1, True, 3), (1, 2, True, 3), (2, 0, False, 1), (2, 1, False, 5)], "doc_id long, ord int, safe boolean, score long")
    assert {tuple(r) for r in select.best_candidate(c).collect()} == {(1, 1, 3), (2, 1, 5)}


def test_diff_verdicts(spark):
    schema = "file string, status string, sha256 string, deva_frac double, devanagari long, malformed long, replacement long, cid_garbage long, wall_s double"
    base = ("ok", "a", 0.9, 500, 2, 0, 0, 1.0)
    after = {"same": base, "worse1": ("ok", "b", 0.9, 500, 3, 0, 0, 1.0), "worse2": ("ok", "b", 0.3, 500, 2, 0, 0, 1.0), "worse3": ("ok", "b", 0.9, 400, 2, 0, 0, 1.0), "better": ("ok", "b", 0.9, 510, 2, 0, 0, 1.0),
             "changed": ("ok", "b", 0.9, 500, 2, 0, 0, 1.0), "newly-failing": ("error", None, None, None, None, None, None, 1.0), "new-file": base}
    b = spark.createDataFrame([(k, *base) for k in after if k != "new-file"] + [("missing", *base)], schema)
    a = spark.createDataFrame([(k, *v) for k, v in after.items()], schema)
    got = {r.file: r.verdict for r in measure.diff(b, a).collect()}
    assert {k.rstrip("123"): v for k, v in got.items()} == {k: k for k in ("same", "worse", "better", "changed", "newly-failing", "new-file", "missing")}
    bad = measure.regressions(measure.diff(b, a), spark.createDataFrame([("worse1",)], "file string"))
    assert {r.file for r in bad.collect()} == {"worse2", "worse3", "newly-failing", "missing"}


def test_anchors_for_empty_unknown_and_late_pages(spark):
    parts = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (1, 3, 9, "d"), (2, 0, 1, "x")], "doc_id long, ord int, page int, text string")
    page_list = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, page int")
    got = {r.doc_id: r.markdown.split("\n\n") for r in render.with_page_anchors(parts, page_list).collect()}
    a = lambda n: f"<!-- page: {n} -->"
    assert got == {1: [a(1), "a", a(2), "b", "c", a(3), "d"], 2: ["x"]}


def test_visual_lines_compare_with_the_first_member(spark):
    fs = [(0.0, 0.0, 10.0, 10.0, "a"), (20.0, 4.0, 30.0, 14.0, "b"), (40.0, 8.0, 50.0, 18.0, "c")]
    df = spark.createDataFrame([(fs,)], "fs array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    lines = df.select(assemble.visual_lines(F.col("fs")).alias("l")).first().l
    assert [[f.text for f in line] for line in lines] == [["a", "b"], ["c"]]


def test_overprint_is_dropped_and_repeats_are_kept(spark):
    fs = [(0.0, 0.0, 9.0, 9.0, "x"), (1.0, 0.0, 8.0, 9.0, "x"), (9.0, 0.0, 12.0, 9.0, "x")]
    df = spark.createDataFrame([(fs,)], "fs array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>")
    assert df.select(assemble.join_visual_line(F.col("fs"))).first()[0] == "x x"


def test_reading_order_of_two_columns(spark):
    rows = [(1, 1, i, f"l{i}", 50.0, 100.0 + 12 * i, 150.0, 110.0 + 12 * i, None) for i in range(6)] + [(1, 1, 10 + i, f"r{i}", 320.0, 100.0 + 12 * i, 420.0, 110.0 + 12 * i, None) for i in range(6)] + [(1, 1, 20, "head", 50.0, 70.0, 420.0, 88.0, None)]
    f = spark.createDataFrame(rows, "doc_id long, page_number int, ord long, text string, x0 double, y0 double, x1 double, y1 double, gap_before double")
    got = [r.text for r in layout.reading_order(f).orderBy("reading_ord").collect()]
    assert got == ["head", *[f"l{i}" for i in range(6)], *[f"r{i}" for i in range(6)]]


def test_merge_keeps_last_repaired_and_first_original(spark):
    s = "doc_id long, page_number int, block_number int, line_number int, ord long, text string, x0 double, y0 double, x1 double, y1 double"
    box = (0.0, 0.0, 1.0, 1.0)
    left = spark.createDataFrame([(1, 1, 0, 0, 0, "a�b", *box), (1, 1, 0, 0, 1, "later", *box), (1, 1, 0, 1, 2, "only", *box)], s)
    right = spark.createDataFrame([(1, 1, 0, 0, 0, "old", *box), (1, 1, 0, 0, 1, "new", *box), (1, 1, 0, 2, 2, "��", *box)], s)
    assert sorted(r.text for r in merge.merge_variants(left, right).collect()) == ["later", "new", "only"]


def test_partition_search():
    assert numeric.least_partition(["10", ".50", "20", ".25"], [False] * 3) == [2]
    assert numeric.least_partition(["1", "2"], [False]) == [1]
    assert numeric.least_partition(["1"] * 13, [True] * 12) is None
    assert numeric.least_partition(["1", "2", "3"], [False, True]) == [2]
    assert numeric.least_partition(["1", "2", "3"], [False, False]) is None


def test_cuts_by_rule_and_by_advance(spark):
    s = "doc_id long, page int, block int, line int, span int, idx int, c string, origin_x double, x0 double, y0 double, x1 double, y1 double, font string, size double"
    text, x, rows = "12.5034.25", 0.0, []
    for i, c in enumerate(text):
        rows.append((1, 1, 0, 0, 0, i, c, x, x, 0.0, x + 4.9, 10.0, "f", 10.0))
        x += 8.0 if i == 4 else 5.0
    rows += [(2, 1, 0, 0, 0, i, "0", 5.0 * i, 5.0 * i, 0.0, 5.0 * i + 4.9, 10.0, "f", 10.0) for i in range(6)]
    chars = spark.createDataFrame(rows, s)
    edges = numeric.vertical_edges(spark.createDataFrame([(1, 1, "l", 26.0, -1.0, 26.0, 20.0)], "doc_id long, page int, kind string, x0 double, y0 double, x1 double, y1 double"))
    assert [(r.doc_id, r.idx) for r in numeric.rule_cuts(chars, edges).collect()] == [(1, 5)]
    pairs = numeric.digit_pairs(chars)
    cuts = numeric.advance_cuts(pairs, numeric.expected_advances(pairs))
    assert [(r.doc_id, r.idx) for r in cuts.collect()] == [(1, 5)]
    fixed = numeric.line_repairs(chars, cuts).first()
    assert (fixed.merged_text, list(fixed.parts), fixed.occurrence_index) == ("12.5034.25", ["12.50", "34.25"], 0)


def test_pipe_lines_by_digit_signature():
    assert numeric.repair_pipe_line("| 1250 3425 |", "12.5034.25", ["12.50", "34.25"]) == "| 12.50 | 34.25 |"
    assert numeric.repair_pipe_line("no pipes 12.5034.25", "12.5034.25", ["12.50", "34.25"]) == "no pipes 12.5034.25"


def test_grid_fills_spans_and_first_cell_wins(spark):
    c = spark.createDataFrame([(1, 0, 0, "a", 2, 1), (1, 0, 1, "b", 1, 1), (1, 1, 0, "late", 1, 1), (1, 1, 1, "c", 1, 1)], "t long, row int, col int, text string, rowspan int, colspan int")
    assert [list(r["values"]) for r in tables.expanded_grid(c, ["t"]).orderBy("row").collect()] == [["a", "b"], ["a", "c"]]


def test_shared_header_rows(spark):
    df = spark.createDataFrame([([["h", "k"], ["1", "2"]], [["h ", "k"], ["3", "4"]], 2)], "a array<array<string>>, b array<array<string>>, n int")
    assert df.select(tables.shared_header_rows(F.col("a"), F.col("b"), F.col("n"))).first()[0] == 1


def test_ocr_vote_rounds_up(spark):
    p = spark.createDataFrame([(1, True), (1, False), (1, False), (2, True), (2, True), (2, False)], "doc_id long, likely_needs_ocr boolean")
    assert {r.doc_id: r.needs_ocr for r in pages.ocr_vote(p).collect()} == {1: False, 2: True}


def test_strategies_by_page_and_font(spark):
    f = spark.createDataFrame([(1, 1, 0, "AAA+K", "correct"), (1, 1, 1, "B", "legacy_remap"), (1, 2, 2, "K", "broken_cmap")], "doc_id long, page int, ord int, font string, strategy string")
    assert {r.page: r.strategy for r in pages.strategy_by_page(f).collect()} == {1: "legacy_remap", 2: "broken_cmap"}
    assert {r.base_font: r.strategy for r in pages.strategy_by_font(f).collect()} == {"K": "correct", "B": "legacy_remap"}


def test_unknown_check_is_an_error_and_missing_text_fails(spark):
    r = spark.createDataFrame([("x", None, [("odd", "1")]), (None, None, [("contains", "x")]), ("x", None, [("contains", "x")])], "text string, diagnostics string, checks array<struct<kind:string,value:string>>")
    assert [x.passed for x in artifact.evaluate(r).collect()] == [None, False, True]


def test_output_names_skip_what_is_there(spark):
    f = spark.createDataFrame([("d", "a", 0), ("d", "a", 1), ("d", "b", 2)], "directory string, stem string, ord int")
    there = spark.createDataFrame([("d", "a")], "directory string, name string")
    assert [r.name for r in render.output_names(f, there).orderBy("ord").collect()] == ["a-2", "a-3", "b"]


def test_output_names_count_on_past_natural_collisions(spark):
    stems = ["a", "a", "a-2", "a", "b-2", "b", "b", "", "document"]
    f = spark.createDataFrame([("d", s, i) for i, s in enumerate(stems)] + [("e", "a-2", 0)], "directory string, stem string, ord int")
    got = [r.name for r in render.output_names(f).orderBy("directory", "ord").collect()]
    assert got == ["a", "a-2", "a-2-2", "a-3", "b-2", "b", "b-3", "document", "document-2", "a-2"]


def test_merge_takes_the_better_token_of_noisy_lines(spark):
    from scriptorium.operators import merge

    df = spark.createDataFrame([("एिं बैंक", "एवं बैिंक"), ("same", "same"), ("one two", "one two three"), ("सिंह", "सिह")], "a string, b string")
    got = [r.t for r in df.select(merge.best_text(F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == ["एवं बैंक", "same", "one two three", "सिह"]


def test_records_reject_repeated_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"file": "a", "status": "ok"}\n{"file": "b", "status": "ok"}\n')
    assert files.read_records(spark, str(tmp_path)).count() == 2
    (tmp_path / "s.jsonl").write_text('{"file": "a", "status": "ok"}\n')
    try:
        files.read_records(spark, str(tmp_path)).collect()
        raise AssertionError("a repeated file must fail the read")
    except Exception as e:
        assert "recorded twice" in str(e)


def test_junit_report(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuite><testcase name="a" classname="c"/><testcase name="b" classname="c"><failure>x</failure></testcase><testcase name="d" classname="c"><skipped>y</skipped></testcase></testsuite>')
    assert {r.name: r.outcome for r in files.read_junit(spark, str(tmp_path / "r.xml")).collect()} == {"a": "passed", "b": "failed", "d": "skipped"}


def test_corpus_listing_and_pdf_scan(spark, tmp_path):
    for n in ("a.PDF", "b.doc", "c.txt", "empty.pdf"):
        (tmp_path / n).write_text("" if n == "empty.pdf" else "%PDF-1.4")
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_pdfs(spark, str(tmp_path)).collect()] == ["a.PDF"]
    listed = files.list_corpus(spark.createDataFrame([("b.doc",), ("c.txt",), ("a.PDF",), ("b.doc",)], "path string"), spark.createDataFrame([("c.txt",)], "path string"))
    assert [r.path for r in listed.collect()] == ["a.PDF", "b.doc", "c.txt"]


def test_connectors_say_what_is_missing(spark, tmp_path):
    try:
        connectors.pdf_spans(spark, str(tmp_path))
    except connectors.NotInstalled as e:
        assert "PyMuPDF" in str(e)
    pages_ = spark.createDataFrame([(1, b"x")], "page int, image binary")
    assert connectors.ocr_candidates(pages_, None).first().ocr_text is None


def test_streamed_texts_get_signals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one two")
    texts = transcripts.stream_texts(spark, str(tmp_path / "in"))
    transcripts.per_batch(texts, transcripts.with_signals, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.chars for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [7]


def test_cmaps_parse_build_and_patch(spark):
    from scriptorium.operators import cmaps

    stream = "2 beginbfchar\n<0001> <0915>\n<0002> <0924094D0930>\nendbfchar\n2 beginbfrange\n<0005> <0007> <0061>\n<0008> <000A> [<0041> <00420043>]\nendbfrange\n1 beginbfchar\n<0001> <0916>\nendbfchar"
    df = spark.createDataFrame([("f", stream)], "font string, cmap string")
    parsed = cmaps.parse_cmaps(df, "cmap", ["font"])
    want = {1: "ख", 2: "त्र", 5: "a", 6: "b", 7: "c", 8: "A", 9: "BC"}
    assert {r.gid: r.text for r in parsed.collect()} == want
    assert {r.gid: r.text for r in cmaps.parse_cmaps(cmaps.build_cmaps(parsed, ["font"]), "cmap", ["font"]).collect()} == want
    right = spark.createDataFrame([("f", 1, "ि"), ("f", 2, "तर्"), ("f", 5, "र्"), ("f", 20, "ग")], "font string, gid int, text string")
    fixed = {r.gid: r.text for r in cmaps.patch_maps(parsed, right, ["font"]).collect()}
    assert fixed == want | {1: "", 5: "", 20: "ग"}
    assert cmaps.meaningful_differences(parsed, right, ["font"]).first().differences == 2


def test_cmaps_keep_glyph_ids_above_ffff(spark):
    from scriptorium.operators import cmaps

    entries = spark.createDataFrame([("f", 0x41, "a"), ("f", 0xFFFF, "b"), ("f", 0x10000, "c"), ("f", 0x124F80, "d")], "font string, gid int, text string")
    parsed = cmaps.parse_cmaps(cmaps.build_cmaps(entries, ["font"]), "cmap", ["font"])
    assert {r.gid: r.text for r in parsed.collect()} == {0x41: "a", 0xFFFF: "b", 0x10000: "c", 0x124F80: "d"}
    ranged = spark.createDataFrame([("f", "1 beginbfrange\n<0001> <0003> <FFFF>\nendbfrange")], "font string, cmap string")
    assert {r.gid: r.text for r in cmaps.parse_cmaps(ranged, "cmap", ["font"]).collect()} == {1: "\uffff", 2: "\U00010000", 3: "\U00010001"}


def test_ligatures_close(spark):
    from scriptorium.operators import cmaps

    known = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b")], "font string, glyph int, text string")
    rules = spark.createDataFrame([("f", 0, 10, [1, 2]), ("f", 1, 11, [10, 1]), ("f", 2, 12, [11, 99])], "font string, rule int, glyph int, components array<int>")
    assert {r.glyph: r.text for r in cmaps.ligature_closure(known, rules).collect()} == {1: "a", 2: "b", 10: "ab", 11: "aba"}


def test_decision_rows_and_subjects(spark):
    from scriptorium.operators import transcribed

    text = ["heading", "1. A ministry  gets स्वीकृति", "more of the name", "2) B ministry  may गर्ने", "", "३। C ministry", "will be खारेज"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "1. X  गर्ने")], "doc_id long, ord int, text string")
    rows = transcribed.decision_rows(lines)
    assert [(r.serial, r.ministry, r.decision) for r in rows.orderBy("row").collect()] == [("1.", "A ministry more of the name", "gets स्वीकृति"), ("2)", "B ministry", "may गर्ने"), ("३।", "C ministry", "will be खारेज")]
    assert "| 2. | B ministry | may गर्ने |" in transcribed.decision_table(rows).first().markdown
    f = spark.createDataFrame([("Re: a thing. And more", 4, 5.0), ("plain", 5, None)], "text string, line_number int, gap_before double")
    assert [(r.text, r.line_number, r.gap_before) for r in transcribed.split_inline_subjects(f).collect()] == [("Re: a thing.", 4, 5.0), ("And more", 5, 0.0), ("plain", 5, None)]


def test_ligatures_of_a_long_chain_are_resolved(spark):
    from scriptorium.operators import cmaps

    known = spark.createDataFrame([("f", 0, "a")], "font string, glyph int, text string")
    rules = spark.createDataFrame([("f", i, i, [i - 1, 0]) for i in range(1, 37)], "font string, rule int, glyph int, components array<int>")
    got = {r.glyph: r.text for r in cmaps.ligature_closure(known, rules).collect()}
    assert got == {i: "a" * (i + 1) for i in range(37)}


def test_records_need_numbers_and_go_on(spark):
    rows = [(1, "S.N."), (2, ""), (3, "1."), (4, ""), (5, " 1. "), (6, "note"), (7, "२"), (8, "1."), (9, None)]
    df = spark.createDataFrame([(7, *r) for r in rows], "t int, row int, serial string")
    told = lambda d: [(r.record, r.record_key) for r in d.orderBy("row").collect()]
    opened = [(3, "1.")] * 4 + [(4, "२"), (5, "1."), (5, "1.")]
    assert told(tables.record_groups(df, ["t"])) == [(1, "1"), (2, "2"), *opened]
    assert told(tables.record_groups(df, ["t"], continued="9")) == [(1, "9"), (1, "9"), *[(n - 1, k) for n, k in opened]]
    assert told(tables.record_groups(df, ["t"], continued="1.")) == [(1, "1.")] * 6 + [(2, "२"), (3, "1."), (3, "1.")]


def test_pipe_lines_end_as_the_number_does():
    assert numeric.repair_pipe_line("| १२ ३४। |", "१२३४।", ["१२", "३४।"]) == "| १२ | ३४। |"
    assert numeric.repair_pipe_line("| 12 34 |", "1234.", ["12", "34."]) == "| 12 | 34. |"
    assert numeric.repair_pipe_line("| 12 345 |", "1234", ["12", "34"]) == "| 12 345 |"


def test_cells_lose_overprinted_lines_only(spark):
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
    at = lambda x, y, t: (float(x), float(y), x + 9.0, y + 10.0, t)
    cells = {
        "overprint": ([at(0, 0, "a"), at(0, 20, "a"), at(5, 20, " "), at(0, 40, "b")], "a\nb"),
        "rows": ([at(0, 0, "a"), at(20, 0, "b"), at(0, 20, "a"), at(20, 20, "b")], "a b\na b"),
        "order": ([at(0, 20, "z"), at(0, 0, "y")], "y\nz"),
        "empty": ([], ""),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cells.items()], f"k string, fs {kind}")
    assert {r.k: r.t for r in df.select("k", assemble.cell_text(F.col("fs")).alias("t")).collect()} == {k: v[1] for k, v in cells.items()}


def test_converters_run_in_processes_of_their_own(spark):
    program = "import sys, os, time; t = open(sys.argv[1]).read(); exec(t)"
    scripts = {
        "ok": "print('{\"status\":\"ok\",\"text\":\"x\"}')", "own": "print('{\"status\":\"error\"}'); sys.exit(3)", "bad_output": "print('not json')", "empty": "",
        "killed": "os.kill(os.getpid(), 9)", "worker_error": "sys.exit(2)", "timeout": "time.sleep(60)", "unreadable_source": None,
    }
    wanted = {**{k: k for k in scripts}, "own": "error", "empty": "bad_output"}
    files_ = spark.createDataFrame([(k, None if v is None else bytearray(v.encode())) for k, v in scripts.items()], "path string, content binary")
    attempts = connectors.run_converter(files_, [sys.executable, "-c", program], timeout_s=10)
    status = artifact.attempt_status(F.col("readable"), F.col("timed_out"), F.col("exit_code"), F.col("output"))
    assert {r.path: r.status for r in attempts.select("path", status.alias("status")).collect()} == wanted


def test_urls_and_json_that_are_none(spark):
    df = spark.createDataFrame([(t,) for t in ["HTTPS://a.b/c", " http://x ", "javascript:alert(1)", "http://", "http:///p", "/rel", None]], "u string")
    assert [r[0] for r in df.select(files.http_url(F.col("u"))).collect()] == ["HTTPS://a.b/c", "http://x", None, None, None, None, None]
    df = spark.createDataFrame([('{"a":1,"b":{"c":null}}',), ("no",), (None,)], "t string")
    back = [r[0] for r in df.select(files.decoded(F.col("t"), "a int, b struct<c:string>")).collect()]
    assert back[0].a == 1 and back[0].b.c is None and back[1:] == [None, None]


def test_maps_of_too_many_rules_are_refused(spark):
    from scriptorium.functions import keymaps

    rules = spark.range(keymaps.MOST_RULES + 1).selectExpr("'m' AS map_key", "id AS seq", "'char' AS kind", "'a' AS pattern", "'b' AS replacement")
    with pytest.raises(ValueError, match="more than"):
        keymaps.rules_of(rules, "m")
    assert len(keymaps.rules_of(rules.filter("seq < 10"), "m")) == 10
