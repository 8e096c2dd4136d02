"""Counts by batch: texts do not see each other, pieces join up, and queries on texts run no pattern for each text."""

import contextlib
import io
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import batches as B, keymaps, metrics as M, patterns as P, text as X
from scriptorium.operators import assemble, layout, merge, numeric
from scriptorium.plans import catalog


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r[0] for r in df.select("i", expression(F.col("text")).alias("v")).orderBy("i").select("v").collect()]


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["quality_score", "latin_veto", "tied_maps", "text_penalty", "map_validity", "choose_map", "best_candidate", "regression_diff", "regression_counts", "regression_wall_time"])
def test_queries_on_whole_texts_count_by_batch(spark, sf_dir, name):
    told = plan(catalog.queries()[name](spark, sf_dir))
    assert "ArrowEvalPython" in told
    assert not re.findall(r"regexp_(?:count|extract_all)|lambdafunction|translate\(", told)


def test_classes_are_those_of_the_patterns():
    assert list(B.members(r"a-c\-\x{900}-\x{902}]")) == [(97, 99), (45, 45), (0x900, 0x902), (93, 93)]
    assert [c for c in range(B.EDGE) if B._bits()[c] & B.BIT["space"]] == sorted(map(ord, P.SPACE_CHARACTERS))


def test_texts_next_to_each_other_are_apart(spark):
    texts = ["क", "क", None, "", "(cid:1", "2)", "ितन", "िडा", "ितन", "तान", "।", "a", "1", "|x|y|", "जज"]
    n = len(texts)
    alone = [column(spark, [t], lambda c: M.text_penalty(c, M.unexplained_doublets(c)))[0] for t in texts]
    assert column(spark, texts, lambda c: M.text_penalty(c, M.unexplained_doublets(c))) == alone and alone[2] is None
    measured = B.by_piece(texts, lambda t: [*B._token_counts(t).values(), *B._text_counts(t).values(), *B._signals(t).values()])
    for i in range(n):
        one = B.by_piece(texts[i : i + 1], lambda t: [*B._token_counts(t).values(), *B._text_counts(t).values(), *B._signals(t).values()])
        assert [c[i] for c in measured] == [c[0] for c in one]


def test_pieces_join_up(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab cक्िा|\n\U00010400") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    whole = B.by_piece(texts, lambda t: list(B._token_counts(t).values())), B.substitute(texts, "ab", "खग")
    monkeypatch.setattr(B, "PIECE", 64)
    small = B.by_piece(texts, lambda t: list(B._token_counts(t).values())), B.substitute(texts, "ab", "खग")
    assert [c.tolist() for c in whole[0]] == [c.tolist() for c in small[0]] and whole[1] == small[1] == [t.translate(str.maketrans("ab", "खग")) for t in texts]
    assert whole[0][0].tolist() == [len(t.split()) for t in texts]


def test_alternatives_and_doublets_do_not_overlap():
    t = B.Texts(["नम्िराविय", "कककक", "ककक", "अबब बब", "राककोट"])
    assert B._alternatives(t, M.ARTIFACTS.split("|")).tolist() == [len(re.findall(M.ARTIFACTS, x)) for x in t.texts] == [1, 0, 0, 0, 0]
    assert t.count_at(B._doublets(t)).tolist() == [0, 2, 1, 2, 1]
    second = B._doublets(t)
    assert t.count_at(second[B._explained(t, second, ["बब"], ["को"])]).tolist() == [0, 0, 0, 2, 1]


def test_latin_letters_of_other_alphabets_lower_case(spark):
    assert column(spark, ["the x Kx", "İof xyz", "OF the", "", "a b"], lambda c: X.reads_as_latin_words(c, ["of", "the", "kx"])) == [True, True, True, False, False]


def test_maps_of_single_characters_leave_white_space_and_take_whole_texts(spark):
    rules = [("char", "k", "क"), ("char", " ", "x"), ("char", "K", "ख")]
    assert column(spark, ["k k\nKK", None, ""], lambda t: keymaps.decode(t, rules)) == ["क क\nKख", None, ""]
    assert column(spark, ["k kK"], lambda t: keymaps.decode_tied(t, [rules, rules[:2] + [("char", "K", "ग")]])) == ["क कK"]


def test_runs_of_texts_are_found_without_dealing_out_characters(spark, sf_dir, monkeypatch):
    assert not re.findall("Window|Exchange hash", plan(catalog.queries()["unmappable_runs"](spark, sf_dir)))
    monkeypatch.setattr(assemble, "RUNS", 2)
    texts = spark.createDataFrame([(1, "��a�"), (2, None), (3, ""), (4, "x\U00010400�")], "doc_id long, text string").repartition(1)
    assert {tuple(r) for r in assemble.unmappable_runs_of_texts(texts, "text").collect()} == {(1, 0, 2), (1, 3, 1), (4, 2, 1)}


def test_merged_lines_are_judged_by_batch(spark, sf_dir):
    assert "lambdafunction" not in plan(catalog.queries()["variant_merge"](spark, sf_dir))
    assert merge.best_texts(["क� ख", "a", "�", "x y"], ["क ख�", "�", "�x y", "x  y"]) == ["क ख", "a", "�x y", "x  y"]


def test_what_a_task_sorts_follows_the_splits(spark):
    splits = spark.range(0, 100, 1, 20)
    assert layout.dealt(splits, ["id"]).rdd.getNumPartitions() == 20 * layout.PER_SPLIT
    assert "REPARTITION_BY_NUM" in plan(layout.edge_clusters(splits.withColumn("v", F.lit(1.0)), ["id"], "v"))


def test_pipe_lines_compile_nothing_for_a_number(monkeypatch):
    def refuse(*_):
        raise AssertionError("compiled")

    monkeypatch.setattr(numeric.re, "compile", refuse)
    assert numeric.repair_pipe_line("| 12 34.5 | 12 |34 | 123 4 | 91234 |", "1234.", ["12", "34."]) == "| 12 | 34..5 | 12 | 34. | 12 | 34. | 91234 |"
    assert numeric.repair_pipe_line("| 1 2\t३४।| 12345 |", "1234.", ["12", "34."]) == "| 12 | ३४।| 12345 |"


def test_partitions_are_tried_part_by_part(monkeypatch):
    class Counted:
        n, pattern = 0, numeric._PLAUSIBLE

        def match(self, text):
            Counted.n += 1
            return self.pattern.match(text)

    monkeypatch.setattr(numeric, "_PLAUSIBLE", Counted())
    assert numeric.least_partition(["12345.67"] * 12, [False] * 11) == list(range(1, 12))
    assert Counted.n <= 12 * 13 / 2


def test_partitions_of_a_batch_equal_those_of_rows():
    rng = random.Random(8)
    rows = [["".join(rng.choice("0123456789.,१।") for _ in range(rng.randint(1, 5))) if rng.random() < 0.5 else f"{rng.random() * 10 ** rng.randint(0, 5):.2f}" for _ in range(rng.randint(0, 14))] for _ in range(2000)]
    rows += [None, [], ["1.25\n", "2.50"], ["1", "2"], ["12345.67"] * 12, ["12345.67"] * 13]
    supported = [[rng.random() < 0.3 for _ in r or []] for r in rows]
    got = numeric.least_partitions(pa.array(rows, pa.list_(pa.string())), pa.array(supported, pa.list_(pa.bool_())))
    assert got == [None if r is None else numeric.least_partition(r, s) for r, s in zip(rows, supported, strict=True)]
    assert got[-2:] == [list(range(1, 12)), None] and any(g and g != list(range(1, len(r))) for g, r in zip(got, rows, strict=True))
