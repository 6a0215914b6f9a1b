"""Panels, hooks, options, streams that go on, and what SQL can't state."""

from collections import Counter
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import adapter, bpe, groups, metrics, options, ordering, prep, results, stats
from lexiloom.plans import catalogue
from lexiloom.sources import readers, sinks
from lexiloom.streaming import streams


def test_advantage_is_against_the_mean_of_the_languages_means(spark):
    rows = [("g", "a", 1.0), ("g", "a", 3.0), ("g", "b", 8.0), ("h", "a", 5.0)]
    got = ordering.group_advantage(spark.createDataFrame(rows, "g string, lang string, r double"), "g", "lang", "r")
    assert sorted((r["g"], r["r"], r["advantage"]) for r in got.collect()) == [("g", 1.0, -4.0), ("g", 3.0, -2.0), ("g", 8.0, 3.0), ("h", 5.0, 0.0)]


def test_reward_to_go(spark):
    rows = spark.createDataFrame([("e", i, 1.0) for i in range(4)] + [("f", 0, 2.0)], "e string, t long, r double")
    got = {(r["e"], r["t"]): r["to_go"] for r in ordering.reward_to_go(rows, "e", "t", "r", 0.5).collect()}
    assert got == {("e", 0): 1.875, ("e", 1): 1.75, ("e", 2): 1.5, ("e", 3): 1.0, ("f", 0): 2.0}


def test_warm_up_starts_at_nothing(spark):
    steps = spark.range(12).select(metrics.rate_factor(F.col("id"), 4, 8, "linear").alias("f")).collect()
    assert [r["f"] for r in steps] == [0, 0.25, 0.5, 0.75, 1, 0.75, 0.5, 0.25, 0, 0, 0, 0]


def test_first_seen_pairs_win_ties():
    sequences = [b"abab cdcd", b"cdcd abab", b"zz"]
    seqs, naive = [list(s) for s in sequences], []
    for k in range(6):
        count = Counter(p for s in seqs for p in zip(s, s[1:], strict=False))
        naive.append(count.most_common(1)[0][0])
        seqs = [bpe.joined(s, naive[-1], 256 + k) for s in seqs]
    assert bpe.fit_first_seen(sequences, 262).pairs == naive
    assert bpe.fit_first_seen([], 300).pairs == [] and bpe.fit_first_seen([b"a"], 300).pairs == []


def test_id_spaces(spark):
    words = adapter.one_by_one(lambda data: data.split(b" "))
    t = adapter.from_spans([b"a", b"the", b"cat"], words)
    assert (t.eos_id, t.vocab_size, adapter.dtype_of(t.vocab_size).name) == (258, 259, "uint16")
    assert t.encode(b"the a dog") == [256, 97, 100, 111, 103]
    assert t.decode([257, t.eos_id, 33]) == b"cat!"
    merged = adapter.from_merges(bpe.Merges([(97, 98)]), words)
    assert merged.encode(b"ab abc") == [256, 256, 99] and merged.decode([256, 99]) == b"abc"
    docs = spark.createDataFrame([(1, "the cat", "x", "old"), (2, None, "x", "old"), (3, "the", "y", "old")], "i long, text string, lang string, ids string")
    only = adapter.from_spans([b"the"], words, ["x"])
    got = adapter.decoded(adapter.encoded(docs, only, end=True), only).collect()
    assert sorted((r["i"], r["ids"], bytes(r["decoded"])) for r in got) == [(1, [256, 99, 97, 116, 257], b"thecat"), (2, [257], b"")]


def test_first_in_the_stream_stays(spark):
    rows = [(1, "a b", "en", "s"), (2, "same text", "en", "s"), (3, "same text", "fr", "t"), (4, "", "en", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = prep.prepare(docs, "doc_id").documents
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    one = prep.prepare(docs, "doc_id", options=prep.PrepOptions(dedup=False, max_docs=1)).documents
    assert [r["doc_id"] for r in one.collect()] == [1]
    pool = prep.PrepOptions(dedup=False, max_docs=1, pool_granular=True, batch=2, pool_batches=1)
    assert prep.prepare(docs, "doc_id", options=pool).documents.count() == 2
    assert {r["chunk"] for r in prep.pooled(prep.prepare(docs, "doc_id"), "source").collect()} == {0}


def test_a_written_preparation_is_not_written_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} x", "en", "s") for i in range(5)], "doc_id long, text string, lang string, source string")
    t = adapter.from_spans([b"w0"], adapter.one_by_one(lambda data: data.split(b" ")))
    result = prep.prepare(docs, "doc_id", tokenizer=t)
    first = prep.write(result, "source", str(tmp_path / "p"), t).first()
    assert (first["tokens"], first["eos_id"], first["dtype"]) == (19, 257, "uint16")
    part = next((tmp_path / "p" / "shards").rglob("*.parquet"))
    before = part.stat().st_mtime_ns
    prep.write(result, "source", str(tmp_path / "p"), t)
    assert part.stat().st_mtime_ns == before


def test_options():
    @dataclass
    class O:  # noqa: E742
        n: int = 1
        name: str | None = None
        rate: float = 0.5

    assert options.merged(O, {"n": 3, "rate": 1}, {"n": 4, "name": None}) == O(4, None, 1)
    for config, match in (({"m": 1}, "unknown"), ({"n": [1]}, "can't be"), ({"n": "x"}, "can't be"), ({"name": "z"}, "one of")):
        with pytest.raises(ValueError, match=match):
            options.merged(O, config, choices={"name": ["a", "b"]})
    with pytest.raises(ValueError, match="must be given"):
        options.merged(O, {}, required=["name"])


def test_one_failure_does_not_end_the_others(spark):
    def broken():
        raise OSError("no file")

    got, status = options.isolated(spark, {"a": lambda: spark.range(2), "b": broken, "c": broken}, done=["c"])
    assert got.count() == 2 and sorted(map(tuple, status.collect())) == [("a", "written", None), ("b", "failed", "no file"), ("c", "skipped", None)]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "i long, text string"
    read = lambda: streams.unique_texts(streams.read_stream(spark, folder, spark.createDataFrame([], schema).schema)).select("i")
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(folder)
    assert streams.run_available(read(), folder=str(tmp_path / "state")).count() == 2
    spark.createDataFrame([(3, "a"), (4, "c")], schema).write.mode("append").parquet(folder)
    assert sorted(r["i"] for r in streams.run_available(read(), folder=str(tmp_path / "state")).collect())[-1] == 4
    assert streams.run_available(read(), folder=str(tmp_path / "state")).count() == 3


def test_late_rows_are_left_out(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ts timestamp, k string, v double"
    day = lambda n: __import__("datetime").datetime(2024, 1, n)
    for rows in ([(day(1), "a", 1.0), (day(20), "a", 2.0)], [(day(1), "a", 4.0), (day(21), "a", 8.0)], [(day(30), "a", 0.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = streams.windowed(streams.read_stream(spark, folder, spark.createDataFrame([], schema).schema), "ts", "1 day", "5 days", "k", "v")
        got = streams.run_available(stream, folder=str(tmp_path / "state"))
    assert sorted((r["start"].day, r["total"]) for r in got.collect() if r["start"].day < 25) == [(1, 1.0), (20, 2.0), (21, 8.0)]


def test_repeats_within_the_delay(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ts timestamp, text string"
    spark.createDataFrame([(__import__("datetime").datetime(2024, 1, 1, 0, i), "Same" if i % 2 else "same!") for i in range(6)], schema).write.parquet(folder)
    stream = streams.unique_within(streams.read_stream(spark, folder, spark.createDataFrame([], schema).schema), "ts", "1 hour")
    assert streams.run_available(stream.select("key")).count() == 1


def test_a_cut_off_line_of_a_log_is_left_out(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": "a", "n": 1}\n{"k": "b", "n": 2}\n{"k": "c", "n"')
    assert sorted(map(tuple, streams.read_log(spark, str(tmp_path / "log.jsonl"), "k string, n long").collect())) == [("a", 1), ("b", 2)]


def test_correlation_signs(spark):
    up, down = [("up", i, float(i)) for i in range(12)], [("down", i, -float(i)) for i in range(12)]
    none = [("none", i % 4, float((i * 7) % 5)) for i in range(12)] + [("flat", 1, float(i)) for i in range(5)]
    got = stats.correlations_by(spark.createDataFrame(up + down + none, "k string, x long, y double"), "k", "x", "y")
    assert {r["k"] for r in got.collect()} == {"up", "down", "none"}
    assert tuple(stats.sign_counts(got).first()) == (1, 1, 1)


def test_spread_range_without_enough_sizes(spark):
    got = stats.spread_range(spark.createDataFrame([("a", 1.0, 5), ("b", 3.0, None)], "t string, spread double, vocab_size long")).first()
    assert (got["factor"], got["rho"], got["strength"]) == (3.0, None, None)


def test_tables_of_another_shape_are_an_error(spark):
    with pytest.raises(ValueError, match="table 1"):
        results.same_shape([spark.createDataFrame([("a", 1.0)], "tokenizer string, v double"), spark.createDataFrame([("a", 1)], "tokenizer string, v int")])


def test_translation_examples_need_their_languages(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "group_id long, lang string, text string")
    assert readers.translation_examples(rows, [("a", "b")]).first()["reference_text"] == "y"
    with pytest.raises(ValueError, match="no texts in c"):
        readers.translation_examples(rows, [("a", "c")])
    with pytest.raises(ValueError, match="all needs options"):
        readers.pool_sources(spark, {"all": {}})


def test_results_must_have_what_is_required(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": {"s": 1.5, "p": {"x": 2.0}}, "b": {"p": {}}, "_failed": ["c"], "n": 3}')
    path = str(tmp_path / "r.json")
    assert sorted(r["tokenizer"] for r in readers.read_results(spark, path).collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="b has no s"):
        readers.read_results(spark, path, required="s")
    assert [tuple(r) for r in readers.result_values(readers.read_results(spark, path, ["b"], "s"), "p").collect()] == [("a", "x", 2.0)]


def test_pools_of_one_language(spark):
    rows = spark.createDataFrame([("de", 1), ("deu_Latn", 2), ("xx", 3)], "lang string, n long")
    got = {r["lang"]: (r["codes"], r["n"]) for r in groups.raw_codes(groups.pooled_by_language(rows)).collect()}
    assert got == {"deu": ("de,deu_Latn", 2), "xx": ("xx", 1)}


def test_forced_languages_are_written_anew(spark, tmp_path):
    rows = spark.createDataFrame([("en", "a"), ("fr", "b")], "lang string, text string")
    path = str(tmp_path / "out")
    assert {r["status"] for r in sinks.write_by_lang(rows, path).collect()} == {"written"}
    assert {r["status"] for r in sinks.write_by_lang(rows, path).collect()} == {"skipped"}
    assert {r["status"] for r in sinks.write_by_lang(rows, path, force=True).collect()} == {"written"}
    assert spark.read.json(path).count() == 2


def test_losses_and_budgets(spark):
    assert metrics.mean_loss(spark.createDataFrame([(1.0,), (3.0,)], "loss double")).first()["loss"] == 2.0
    assert metrics.mean_loss(spark.createDataFrame([], "loss double")).first()["loss"] != metrics.mean_loss(spark.createDataFrame([(1.0,)], "loss double")).first()["loss"]
    got = spark.createDataFrame([(10, 20)], "p long, r long").select(*[c.alias(k) for k, c in metrics.training_budget(F.col("p"), F.col("r")).items()]).first()
    assert tuple(got) == (200, 12_000)


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    rows = [(1, "One two", "en"), (2, "one, TWO", "en"), (3, "drei", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert catalogue.stream_dedup(spark, str(tmp_path)).first()["kept"] == 2


def test_a_complete_result_of_several_files_and_of_none(spark, tmp_path):
    rows = spark.createDataFrame([(1, "One two", "en"), (2, "drei", "de"), (3, "vier", "de")], "doc_id long, text string, lang string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, catalogue.stream_token_counts(spark, str(tmp_path)).collect())) == [("de", 2, 2, 8), ("en", 1, 2, 7)]
    (tmp_path / "none").mkdir()
    assert streams.run_available(streams.token_counts(streams.read_stream(spark, str(tmp_path / "none"), rows.schema)), "complete").count() == 0
