import random

import pytest
from models import lcs
from pyspark.sql import functions as F

from doubtscope.functions import naming as nm
from doubtscope.functions import text as tx
from doubtscope.operators.prompts import explode_qa, positional_split


def first(spark, row, ddl, *cols):
    return spark.createDataFrame([row], ddl).select(*cols).first()


def test_bit_parallel_lcs_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert tx.lcs_length(a, b) == lcs(a, b)


def test_rouge_and_threshold(spark):
    rows = [("a b c b d a b", "b d c a b a"), ("A", "a"), ("", ""), ("é", "e"), (None, "x"), ("x", None), ("a b c", "d e f"),
            ("one " + "x " * 50, "one " + "y " * 50)]
    df = spark.createDataFrame(rows, "l string, p string")
    got = tx.with_correct_qa(tx.with_rouge_l(df, "l", "p"), "l", "p").collect()
    assert got[0]["rouge_l"] == pytest.approx(8 / 13)
    assert [r["ok"] for r in got] == [True, True, False, False, False, False, False, False]
    assert got[2]["rouge_l"] == 0.0 and got[4]["rouge_l"] is None


def test_shortcuts_never_change_the_answer(spark):
    rng = random.Random(1)
    words = "the a story tells of red blue fox".split()
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 25))), " ".join(rng.choices(words, k=rng.randint(0, 25)))) for _ in range(400)]
    df = tx.with_rouge_l(spark.createDataFrame(rows, "l string, p string"), "l", "p")
    for t in (0.0, 0.3, 0.5, 1.0):
        assert tx.with_correct_qa(df, "l", "p", threshold=t).filter((F.col("rouge_l") >= t) != F.col("ok")).count() == 0


def test_long_texts_are_compared_whole(spark):
    common = " ".join(f"w{i}" for i in range(3000))
    rows = [("x " * 5000 + common, common + " y" * 100)]
    r = tx.with_rouge_l(spark.createDataFrame(rows, "l string, p string"), "l", "p").first()["rouge_l"]
    assert r == pytest.approx(2 * 3000 / (8000 + 3100))


def test_exact_rule(spark):
    ddl = "a string, b string"
    for row, want in [((None, None), False), (("A", "a"), False), (("a", "a"), True), ((None, "a"), False)]:
        assert first(spark, row, ddl, tx.is_correct_exact(F.col("a"), F.col("b")).alias("r"))["r"] is want
    r = first(spark, (["b", None, "a"], ["a", "b"]), "a array<string>, b array<string>",
              tx.is_correct_exact(F.col("a"), F.col("b"), lists=True).alias("r"))
    assert r["r"] is True


def test_strip_is_python_strip(spark):
    for s in ["  a b \n", "\x1c  a ", "　\t\r\n", "a", "", "\x85x\x1f"]:
        assert first(spark, (s,), "s string", tx.strip(F.col("s")).alias("r"))["r"] == s.strip()


def test_templates(spark):
    with pytest.raises(ValueError, match="answer"):
        tx.render_template("{story} {answer}", {"story": F.lit("s")})
    assert tx.resolve_prompts(None, {"content": "c"}) == ("c", tx.DEFAULT_USER_TEMPLATE)
    assert tx.resolve_prompts(tx.STORY_CONFIG, "mine")[0] == "mine"
    assert tx.resolve_prompts(tx.STORY_CONFIG)[0].startswith("You are")
    r = first(spark, ("{x}",), "s string", tx.render_template("a{{b}} {s}", {"s": F.col("s")}).alias("r"))
    assert r["r"] == "a{b} {x}"


def test_explode_handles_missing_parts(spark):
    ddl = "row_id bigint, story string, questions array<string>, answers struct<input_text:array<string>>"
    rows = [(0, None, ["q1", None, "q3"], (["a1", "a2"],)), (1, "s", None, (["a"],)), (2, "s", ["q"], None)]
    got = explode_qa(spark.createDataFrame(rows, ddl), tx.STORY_CONFIG).orderBy("qa_idx").collect()
    assert [(r["data_source"], r["label"]) for r in got] == [("coqa_row0_qa0", "a1"), ("coqa_row0_qa1", "a2")]
    assert got[1]["prompt"][1]["content"] == "Story:\n\n\nQuestion:\n\n\n\n"
    assert [m["role"] for m in got[0]["prompt"]] == ["system", "user"]


def test_positional_split(spark):
    df = spark.range(25).withColumnRenamed("id", "row_id")
    assert sorted(r[0] for r in positional_split(df, "train").collect()) == list(range(21))
    assert sorted(r[0] for r in positional_split(df, "val").collect()) == [21, 22]
    with pytest.raises(ValueError):
        positional_split(df, "test")


def test_names(spark):
    p = F.lit("/models/a--b--c/")
    r = spark.range(1).select(nm.model_tag(p).alias("m"), nm.embedding_tag(F.lit("org/x--y--z")).alias("e"),
                              nm.size_in_tokens(F.lit("32k")).alias("k"), nm.size_in_tokens(F.lit("4096")).alias("n"),
                              nm.stem_of(F.lit("c_set-test-0000-of-0001.parquet")).alias("s"),
                              nm.stem_of(F.lit("c_set-test.parquet")).alias("t")).first()
    assert tuple(r) == ("c", "y--z", 32768, 4096, "c_set-test", "c_set-test")


def test_flatten_chat(spark):
    ddl = "p array<struct<role:string,content:string>>"
    assert first(spark, ([("user", "a"), ("assistant", None), ("user", "b")],), ddl, tx.flatten_chat(F.col("p")).alias("r"))["r"] == "a  b"
    assert first(spark, (None,), ddl, tx.flatten_chat(F.col("p")).alias("r"))["r"] == ""


def test_list_answers_by_dataset(spark):
    rows = [("mmlu", ["b", "a", None], ["a", "b"]), ("mmlu", ["a"], ["b"]), ("coqa", ["the", "red", "fox"], ["fox", "red"]), ("coqa", ["x"], ["y"]), ("mmlu", None, ["a"]), (None, ["a"], ["a"])]
    df = spark.createDataFrame(rows, "d string, label array<string>, pred array<string>")
    got = [r["ok"] for r in tx.with_correct(df, F.col("d"), "label", "pred").collect()]
    assert got == [True, False, True, False, False, True]
    mixed = spark.createDataFrame([("mmlu", ["a"], "a"), ("mmlu", ["a", "b"], "a"), ("nq", ["tall", "tower"], "tall tower")], "d string, label array<string>, pred string")
    assert [r["ok"] for r in tx.with_correct(mixed, F.col("d"), "label", "pred").collect()] == [True, False, True]
