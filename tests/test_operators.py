import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import bpe, contamination, dedup, groups, metrics, ordering, results, scoring, stability, stats
from lexiloom.sources import readers, sinks


def freq(spark, counts):
    return spark.createDataFrame([("x", str(i), c) for i, c in enumerate(counts)], "lang string, span string, cnt long")


@pytest.mark.parametrize("alpha", [1.0, 1.5, 2.0, 2.5, 3.0])
def test_uniform_renyi_is_one(spark, alpha):
    assert metrics.renyi(freq(spark, [5] * 16), alpha).first()["renyi"] == pytest.approx(1.0)


def test_degenerate_renyi_is_zero(spark):
    assert metrics.renyi(freq(spark, [100, 0, 0, 0])).first()["renyi"] == pytest.approx(0.0)
    assert metrics.renyi(freq(spark, [7])).first()["renyi"] == 0.0


def gini(spark, values):
    return metrics.gini(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()["gini"]


def test_gini(spark):
    assert gini(spark, [4, 4, 4, 4]) == pytest.approx(0)
    assert gini(spark, [1, 1, 1, 100]) > gini(spark, [5, 5, 5, 5.1])
    x = sorted([3.0, 1.0, 4.0, 1.0, 5.0])
    assert gini(spark, x) == pytest.approx((2 * sum(i * v for i, v in enumerate(x, 1)) - 6 * sum(x)) / (5 * sum(x)))


def test_compression_without_tokens(spark):
    got = spark.createDataFrame([(10, 5), (10, 0)], "b long, t long").select(metrics.ratio(F.col("b"), F.col("t")).alias("r")).collect()
    assert [r["r"] for r in got] == [2.0, 0.0]


def test_parity_under_two_anchors(spark):
    rows = [(1, "p", "x" * 6), (1, "one", "x" * 8), (2, "q", "x" * 30), (2, "two", "x" * 12), (2, "one", "x" * 10)]
    df = metrics.counts(spark.createDataFrame(rows, "group_id long, lang string, text string"), F.octet_length("text"))
    manifest = spark.createDataFrame([("p", "one"), ("q", "two"), ("q", "one")], "lang string, anchor string")
    got = {(r["anchor"], r["lang"]): r["parity"] for r in metrics.mixed_anchor(df, manifest).collect()}
    assert got == {("one", "p"): 0.75, ("two", "q"): 2.5, ("one", "q"): 3.0}
    with pytest.raises(ValueError, match="group 1"):
        metrics.require_anchors(df, ["two"])


def test_anchor_does_not_change_relative_parity(spark):
    rows = [(g, k, "x" * (n + g)) for g in range(5) for k, n in (("a", 3), ("b", 9), ("c", 20))]
    df = metrics.counts(spark.createDataFrame(rows, "group_id long, lang string, text string"), F.octet_length("text"))
    one, two = ({r["lang"]: r["relative"] for r in metrics.anchor_invariant(metrics.parity(df, k)).collect()} for k in "ab")
    assert all(math.isclose(one[k], two[k], rel_tol=1e-9) for k in one)


def test_anchor_by_short_code(spark):
    df = spark.createDataFrame([(7, "one_Abcd", 11), (7, "two_Abcd", 3), (8, "one", 5), (8, "one_Abcd", 9)], "group_id long, lang string, n long")
    got = {(r["group_id"], r["lang"]): r["anchor_n"] for r in groups.with_anchor(df, "one", ["n"]).collect()}
    assert got == {(7, "one_Abcd"): 11, (7, "two_Abcd"): 11, (8, "one"): 5, (8, "one_Abcd"): 5}


def test_exclusive_quartile(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 10)], "g string, v double")
    assert stats.exclusive_quartile(df, "v", 3, ["g"]).first()["quartile"] == 7.0


def test_survival_functions():
    assert stats.correlation_p(0.5, 10) == pytest.approx(0.14111328, abs=1e-6)
    assert stats.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)


def test_stride_split(spark):
    val = lambda n, f: [r["i"] for r in ordering.stride_split(spark.range(n).select(F.col("id").alias("i")), ["i"], f).filter("validation").orderBy("i").collect()]
    assert val(10, 0.2) == [0, 5]
    assert val(10, 0.0) == []
    assert val(1, 0.2) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_sums_do_not_depend_on_partitions(spark, parts):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("k"), F.col("id").alias("v")).repartition(parts)
    got = ordering.prefix_sums(df, ["k"], {"s": "v"}).orderBy("k").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total


def test_budget_keeps_the_crossing_row(spark):
    df = spark.range(10).withColumn("c", F.lit(3))
    assert ordering.within_budget(df, 7, F.col("c"), ["id"]).count() == 3
    assert ordering.within_budget(df, 7, F.col("c"), ["id"], pool=4).count() == 4


def test_exact_dedup_ignores_case_and_punctuation(spark):
    df = spark.createDataFrame([(1, "The quick, fox!"), (2, "the  quick fox"), (3, "other"), (4, ""), (5, "...")], "i long, text string")
    assert sorted(r["i"] for r in dedup.drop_exact(df, "i").collect()) == [1, 3, 4]
    null = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "i long, text string")
    assert sorted(r["i"] for r in dedup.drop_exact(null, "i").collect()) == [1, 2]


def test_scattered_edits_are_not_similar_enough(spark):
    words = [f"word{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words).replace("word5", "wordFIVE"))], "i long, text string")
    assert dedup.similar_pairs(df, "i", 0.8).count() == 0
    assert dedup.similar_pairs(df, "i", 0.74).first()["jaccard"] == pytest.approx(0.7407, abs=1e-4)


def test_repeated_lines_count_as_words(spark):
    line = " ".join(f"w{i}" for i in range(20))
    texts = ["\n".join([line] * 8)] * 2 + ["x " * 50] * 2 + ["x " * 49] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pairs in (dedup.similar_pairs(df, "doc_id", min_words=50), dedup.minhash_edges(df, "doc_id")):
        assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(0, 1), (2, 3)]


def test_minhash_recall_against_the_exact_join(spark):
    long = [" ".join(f"p{k}w{i}" for i in range(112)) for k in range(200)]
    texts = [x for t in long for x in (t, " ".join(t.split()[:92]))]  # 80 of 100 shingles
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    exact = {(r["a"], r["b"]) for r in dedup.similar_pairs(df, "doc_id", 0.8, min_words=50).collect()}
    found = {(r["a"], r["b"]) for r in dedup.minhash_edges(df, "doc_id").collect()}
    assert len(exact) == 200 and found <= exact
    assert len(found) / 200 == pytest.approx(1 - (1 - 0.8**13) ** 9, abs=0.12)


def test_greedy_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    assert sorted(r["i"] for r in dedup.keep_greedily(spark.createDataFrame([(k,) for k in range(1, 6)], "i long"), edges, "i").collect()) == [1, 3, 5]


def test_greedy_rule_equals_a_plain_loop(spark):
    rng = __import__("random").Random(1)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)} | {(100 + i, 101 + i) for i in range(30)})
    kept, ids = [], [*range(60), *range(100, 131)]
    for i in ids:
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = dedup.keep_greedily(spark.createDataFrame([(i,) for i in ids], "i long"), edges, "i")
    assert sorted(r["i"] for r in got.collect()) == kept


def test_bloom_sizes():
    bits, hashes = dedup.bloom_parameters(2_000_000_000, 0.01)
    assert hashes == 7 and bits / 8e9 == pytest.approx(2.396, abs=0.01)


def test_short_benchmark_items_match_only_equal_documents(spark):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "One two three, four five"), (2, "one two three four five " + "x " * 20)], "doc_id long, text string")
    found = contamination.hits(docs, contamination.benchmark_shingles(items, "item_id", ["text"]), "doc_id")
    assert [r["doc_id"] for r in found.collect()] == [1]


@pytest.mark.parametrize(("tp", "tn", "fp", "fn", "expected"), [(10, 10, 0, 0, 1), (0, 0, 10, 10, -1), (10, 0, 10, 0, 0), (0, 0, 0, 0, 0)])
def test_matthews(spark, tp, tn, fp, fn, expected):
    df = spark.createDataFrame([(float(tp), float(tn), float(fp), float(fn))], "tp double, tn double, fp double, fn double")
    assert df.select(scoring.matthews(*[F.col(c) for c in df.columns]).alias("m")).first()["m"] == pytest.approx(expected)


def test_threshold(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.7), (1, 0.8), (1, 0.9)], "y int, s double")
    got = scoring.best_threshold(df, "y", "s").first()
    assert 0.3 < got["threshold"] <= 0.7 and got["mcc"] == pytest.approx(1.0)


def test_token_f1(spark):
    df = spark.createDataFrame([(1, "old stone bridge", "bridge"), (2, "", ""), (3, "", "stone"), (4, "x", "y"), (4, "x", "the x")], "q long, p string, r string")
    got = {r["q"]: r["f1"] for r in scoring.token_f1(df, ["q"], "p", "r").collect()}
    assert got == pytest.approx({1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0})


def test_bleu_of_equal_texts(spark):
    df = spark.createDataFrame([("a", "the cat sat on the mat", "the cat sat on the mat")], "k string, h string, r string")
    words = lambda c: F.split(c, " ")
    assert scoring.bleu(df, "k", words("h"), words("r")).first()["bleu"] == pytest.approx(100)
    assert scoring.chrf(df, "k", F.col("h"), F.col("r")).first()["chrf"] == pytest.approx(100)


def slow_encode(data, pairs):
    ids = list(data)
    for k, pair in enumerate(pairs):
        ids = bpe.joined(ids, pair, 256 + k)
    return ids


def test_merges_equal_a_naive_recount(spark):
    texts = ["low lower lowest", "new newer newest", "wide wider widest"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    fitted = bpe.fit_bpe(df, 280)
    from collections import Counter

    types = Counter(w for t in texts for w in __import__("re").findall(r"\s*\S+", t))
    seqs, naive = {w: list(w.encode()) for w in types}, []
    for k in range(24):
        count = Counter()
        for w, ids in seqs.items():
            for p in zip(ids, ids[1:], strict=False):
                count[p] += types[w]
        if not count:
            break
        pair = max(count, key=lambda p: (count[p], -p[0], -p[1]))
        naive.append(pair)
        seqs = {w: bpe.joined(ids, pair, 256 + k) for w, ids in seqs.items()}
    assert fitted.pairs == naive
    for w in types:
        assert fitted.encode(w.encode()) == slow_encode(w.encode(), fitted.pairs)
        assert fitted.decode(fitted.encode(w.encode())) == w.encode()


def test_parity_bpe_serves_the_longer_language_first(spark):
    train = spark.createDataFrame([("rich", "aaaa aaaa")] * 3 + [("poor", "bcbcbcbc bcbcbcbc bcbcbcbc")] * 3, "lang string, text string")
    assert ord("a") not in bpe.fit_parity_bpe(train, train, 260).pairs[0]


def naive_merges(counts, merges, tie=lambda p: (-p[0], -p[1]), done=()):
    """Merges learned by a full recount after each, on counted byte strings."""
    seqs, pairs = [(slow_encode(t, done), w) for t, w in counts.items()], list(done)
    for _ in range(merges):
        count = __import__("collections").Counter()
        for ids, w in seqs:
            for p in zip(ids, ids[1:], strict=False):
                count[p] += w
        if not count:
            break
        pairs.append(max(count, key=lambda p: (count[p], *tie(p))))
        seqs = [(bpe.joined(ids, pairs[-1], 255 + len(pairs)), w) for ids, w in seqs]
    return pairs


def odd_texts():
    rng = __import__("random").Random(3)
    return [" ".join("".join(rng.choice("aaabbcé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n", "  \n aaaa"]) for _ in range(150)] + ["", "aaaaaaa", None]


def counted(texts, pattern=tx.PRETOKEN):
    return __import__("collections").Counter(t.encode() for x in texts for t in __import__("re").findall(pattern, x or "", __import__("re").ASCII))


def test_batched_merges_equal_a_naive_recount(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 200)
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    for tie, key in bpe.TIES.items():
        assert bpe.fit_bpe(df, 300, tie=tie).pairs == naive_merges(counted(odd_texts()), 44, key)


def test_texts_encoded_together_equal_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(bpe, "STRIP", 64)
    texts = [t for t in odd_texts() if t is not None] + ["a" * 501, "\x00\U0001f600", "b" * 200]
    merges = bpe.fit_bpe(spark.createDataFrame([(t,) for t in texts], "text string"), 300)
    data = [t.encode() for t in texts]
    ids = merges.encode_all(data)
    assert [x.tolist() for x in ids] == [merges.encode(t) for t in data] and merges.encode_all([]) == []
    assert merges.decode_all(ids) == data


def test_pair_sums_of_weighted_types():
    end, words, weights = np.iinfo(np.uint16).max, [[1, 2, 1, 2], [], [7], [319, 1, 2], [2, 2, 2]], np.array([1, 4, 1, 3, 1])
    expected = __import__("collections").Counter()
    for ids, w in zip(words, weights.tolist(), strict=True):
        for a, b in zip(ids, ids[1:], strict=False):
            expected[a * 320 + b] += w
    found, sums, tokens = bpe.pair_sums(np.array([i for ids in words for i in (*ids, end)], np.uint16), weights, 320)
    assert dict(zip(found.tolist(), sums.tolist(), strict=True)) == expected and tokens == 17


def test_rare_types_count(spark, tmp_path):
    from lexiloom.plans import catalogue

    words = [f"w{i}" for i in range(20_000)] * 2 + [f"zq{i}" for i in range(50_000)]
    spark.createDataFrame([(i, " ".join(words[i::50]), "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert ord("z") not in {r["token_id"] for r in catalogue.bpe_vocab(spark, str(tmp_path)).filter("cnt > 1000").collect()}


def test_superbpe_learns_from_all_lines(spark, tmp_path, monkeypatch):
    from lexiloom.plans import catalogue

    lines = [f"w{i}" for i in range(3_000)] * 2 + [f"k{i} {i % 7} k" for i in range(4_000)]
    texts, found, real = ["\n".join(lines[i::20]) for i in range(20)], [], bpe.fit_superbpe
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(bpe, "fit_superbpe", lambda *a, **o: found.append(real(*a, **o)) or found[0])
    catalogue.superbpe_roundtrip(spark, str(tmp_path))
    first = naive_merges(counted(texts), 51)
    assert found[0].pairs == naive_merges(counted(texts, "[^\n]+"), 64 - len(first), done=first)


@pytest.mark.parametrize("first", [0, 5])
def test_parity_bpe_equals_a_naive_recount(spark, first):
    texts = {"a": odd_texts(), "b": [t and t[::-1].replace("b", "d") for t in odd_texts()[:60]], "c": ["zzzzz zzz", "zz z zzzz"]}
    df = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "lang string, text string")
    seqs = {k: [(list(t), w) for t, w in counted(ts).items()] for k, ts in texts.items()}
    naive = []
    for step in range(40):
        serve = max(seqs, key=lambda k: (sum(len(s) * w for s, w in seqs[k]), k))
        count = __import__("collections").Counter()
        for k in seqs if step < first else [serve]:
            for ids, w in seqs[k]:
                for p in zip(ids, ids[1:], strict=False):
                    count[p] += w
        if not count or max(count.values()) < 2:
            break
        naive.append(max(count, key=lambda p: (count[p], p)))
        seqs = {k: [(bpe.joined(ids, naive[-1], 255 + len(naive)), w) for ids, w in s] for k, s in seqs.items()}
    assert bpe.fit_parity_bpe(df, df, 296, global_merges=first).pairs == naive


def test_parity_bpe_keeps_a_rare_language(spark):
    train = spark.createDataFrame([("hot", " ".join(f"w{i}" for i in range(50_001)))] * 2 + [("rare", "xyxyxyxy")], "lang string, text string")
    dev = spark.createDataFrame([("hot", "w1"), ("rare", "xyxyxyxy " * 9)], "lang string, text string")
    assert set(bpe.fit_parity_bpe(train, dev, 257).pairs[0]) == {ord("x"), ord("y")}


def test_offsets_that_go_back():
    assert bpe.offsets_to_spans("abcd", [(0, 2), (1, 3), (3, 4)]) == [b"ab", b"c", b"d"]


def test_stability_of_equal_spans():
    assert stability.stability([b"a", b"b"], [b"a", b"b"]) == 1.0
    assert stability.stability([b"a"], [b"b", b"c"]) == 0.0


def test_results_need_all_keys(spark):
    have, want = spark.createDataFrame([("a", 1.0)], "tokenizer string, v double"), spark.createDataFrame([("a",), ("b",)], "tokenizer string")
    with pytest.raises(ValueError, match="b"):
        results.require_keys(have, want)


def test_token_windows_have_their_width(spark):
    shards = spark.createDataFrame([(0, list(range(50))), (1, [1, 2])], "shard_id int, ids array<int>")
    got = ordering.token_windows(shards, 20, 8).collect()
    assert len(got) == 20 and all(len(r["window"]) == 9 and r["shard_id"] == 0 for r in got)


def test_sources(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("en\tfr\thello\tbonjour\nbad line\nen\tfr\t\tx\n")
    got = readers.read_groups(spark, "tsv_pairs", path=str(tmp_path / "p.tsv")).collect()
    assert sorted((r["lang"], r["text"]) for r in got) == [("en", "hello"), ("fr", "bonjour")]
    (tmp_path / "t.txt").write_text("; note\nM: one\nM: two\nC: eins\nC: zwei\n\nM: a\nM: b\nC: c\n")
    got = readers.read_groups(spark, "transcript", path=str(tmp_path / "t.txt")).collect()
    assert sorted((r["lang"], r["text"]) for r in got) == [("C", "eins zwei"), ("M", "one two")]
    (tmp_path / "a").write_text("x\n\nz\n")
    (tmp_path / "b").write_text("1\n2\n3\n")
    got = readers.read_groups(spark, "line_pairs", path_a=str(tmp_path / "a"), path_b=str(tmp_path / "b"), lang_a="l", lang_b="m").collect()
    assert sorted((r["group_id"], r["text"]) for r in got) == [(0, "1"), (0, "x"), (2, "3"), (2, "z")]
    (tmp_path / "g.jsonl").write_text('{"crk":"kiya","en":"you"}\n\n{"crk":"x","en":"y"}\n')
    assert readers.read_groups(spark, "jsonl_groups", path=str(tmp_path / "g.jsonl"), first_n=1).count() == 2
    with pytest.raises(ValueError, match="unknown source"):
        readers.read_groups(spark, "nothing")
    assert readers.read_groups(spark, "synthetic", langs=["a", "b"], n=3).count() == 6


def test_shards_hold_every_token(spark, tmp_path):
    docs = spark.createDataFrame([(i, list(range(i))) for i in range(12)], "i long, ids array<int>")
    rows = ordering.shards(docs, ["i"], F.size("ids"), 10)
    sinks.write_shards(rows, str(tmp_path / "s"), 10)
    got = spark.read.parquet(str(tmp_path / "s")).groupBy("shard_id").agg(F.sum(F.size("ids")).alias("n")).orderBy("shard_id").collect()
    assert [r["n"] for r in got] == [10, 10, 10, 10, 10, 10, 6]


def test_rate_band(spark):
    rows = [(g, k, "x" * n) for g in range(4) for k, n in (("en", 10), ("de", 10))]
    df = metrics.counts(spark.createDataFrame(rows, "group_id long, lang string, text string"), tx.word_count(F.col("text")))
    assert all(r["alpha"] == r["beta"] == 0.25 for r in metrics.rate_band(df, "en").collect())


def test_common_ngrams_make_no_rows_in_a_shuffle(spark):
    rows = [("x", "a b a b c", "a b c a"), ("x", None, "a"), ("y", "日本 😀 ab" * 40, "日本 😀" * 30), ("y", "", "")]
    df = spark.createDataFrame(rows, "k string, h string, r string")

    def plain(split, order, key):
        out = []
        for n in range(1, order + 1):
            m = x = y = 0
            for k, h, r in rows:
                grams = [__import__("collections").Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (split(h or ""), split(r or ""))]
                if key in (k, "all"):
                    m, x, y = m + sum((grams[0] & grams[1]).values()), x + sum(grams[0].values()), y + sum(grams[1].values())
            out.append((n, m, x, y))
        return out

    for a, b, split, order in ((F.split("h", " "), F.split("r", " "), lambda t: t.split(" "), 4), (F.col("h"), F.col("r"), list, 12)):
        found = scoring.ngram_matches(df.filter("h is not null"), "k", a, b, order, "all")
        rows = [r for r in rows if r[1] is not None]
        for key in ("x", "y", "all"):
            assert sorted(tuple(r)[1:] for r in found.filter(F.col("k") == key).collect()) == plain(split, order, key)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate explode(transform" not in plan
    assert scoring.chrf(df, "k", F.col("h"), F.col("r")).count() == 2


@pytest.mark.parametrize("often", [1, 20])
def test_similar_pairs_lose_no_link_among_frequent_passages(spark, often):
    import random

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for k in range(12):
        own = [f"w{k}x{i}" for i in range(60)]
        for m in range(4):
            text = passage + own
            if m:
                text[rng.randrange(len(text))] = f"edit{m}"
            rows.append((4 * k + m, " ".join(text)))
    rows += [(100, rows[0][1]), (101, "short one"), (102, "short one"), (103, None), (104, "")]
    sets = {i: frozenset(tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))) for i, t in rows if (w := (t or "").split())}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    reps = sorted(least.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want |= {(least[s], i, len(s)) for i, s in sets.items() if least[s] != i}
    got = dedup.similar_pairs(spark.createDataFrame(rows, "i long, text string"), "i", often=often).collect()
    assert sorted((r["a"], r["b"], r["common"]) for r in got) == sorted(want)
