import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as tx


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("n", "expected"), [(0, 0), (5, 1), (13, 1), (14, 2)])
def test_shingles_by_word_count(spark, n, expected):
    got = value(spark, tx.shingles(F.col("t"), 13), t=" ".join(f"w{i}" for i in range(n)))
    assert len(got) == expected


@pytest.mark.parametrize("text", ["aé", "é", "日本語", "a\U0001f600b", "plain", ""])
@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 7])
def test_truncation_keeps_code_points(spark, text, limit):
    assert value(spark, tx.truncated(F.col("t"), limit), t=text) == text.encode()[:limit].decode("utf-8", "ignore")


def test_byte_truncation_may_cut_a_code_point(spark):
    assert bytes(value(spark, tx.truncated_bytes(F.encode(F.col("t"), "UTF-8"), 2), t="aé")) == b"a\xc3"


def test_answers(spark):
    assert value(spark, tx.normalized_answer(F.col("t")), t="An old  (Stone) BRIDGE!") == "old stone bridge"


LONG = "ru_Cyrl_west1"


# a known pair of letters alone, with a script, with a region; three letters; what is no code
@pytest.mark.parametrize(("code", "expected"), [("de", "deu"), (LONG, "rus"), ("pt-BR", "por"), ("zz", "zz"), ("kor_Hang", "kor"), ("QQQ", "qqq"), ("7x", "7x"), ("_", "_")])
def test_alpha3(spark, code, expected):
    assert value(spark, tx.alpha3(F.col("t")), t=code) == expected


def test_scripts_differ_for_three_parts(spark):
    assert value(spark, tx.script_first(F.col("t")), t=LONG) == "Cyrl_west1"
    assert value(spark, tx.script_last(F.col("t")), t=LONG) == "west1"


def test_token_strings_are_one_to_one(spark):
    table = tx.byte_to_unicode()
    assert len(set(table)) == 256
    assert value(spark, tx.token_string(F.encode(F.col("t"), "UTF-8")), t=" a\né") == "".join(table[b] for b in " a\né".encode())


def test_token_bytes_are_the_inverse(spark):
    every = bytes(range(256))
    shown = value(spark, tx.token_string(F.col("t")), t=bytearray(every))
    assert bytes(value(spark, tx.token_bytes(F.col("t")), t=shown)) == every
    assert value(spark, tx.token_bytes(F.col("t")), t="日") is None


def test_prompts(spark):
    assert value(spark, tx.cause_prompt(F.col("p"), F.col("q")), p="Rain fell. \n", q="cause") == "Rain fell because"
    assert value(spark, tx.cause_choices(F.col("a"), F.col("b")), a="It was wet", b="") == [" it was wet", " "]
    assert value(spark, tx.entailment_prompt(F.col("a"), F.col("b")), a="p", b="h") == "p\nQuestion: h True, False, or Neither?\nAnswer:"


def test_composed_and_decomposed_words_are_equal(spark):
    assert value(spark, tx.composed_words(F.col("t")), t="Éa Éa") == ["éa", "éa"]


def test_name_candidates_go_from_the_most_specific(spark):
    assert value(spark, tx.name_candidates(F.col("t")), t="Upper Lümn-Tal (x)") == ["upper lümn-tal", "upper lumn tal", "lumn tal", "tal", "upper"]
    assert value(spark, tx.name_candidates(F.col("t")), t="Kin") == ["kin"]


def test_spans_join_to_the_text(spark):
    got = value(spark, tx.spans_from_boundaries(F.encode(F.col("t"), "UTF-8"), F.col("b")), t="abcdef", b=[0, 1, 0, 0, 1, 0])
    assert [bytes(x) for x in got] == [b"ab", b"cde", b"f"]


def test_pretokens_keep_every_character(spark):
    text = "  two words\n\nend  "
    assert "".join(value(spark, tx.pretokens(F.col("t")), t=text)) == text
