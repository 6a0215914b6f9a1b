"""Edge cases and brute-force comparisons of the pipeline operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import bpe, chat, graph, hnsw, minhash, mixing, pii, quality, queries, shingles, sketches, substrings, warc

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \n\t ", "one", "one two three four five", "éèà 日本 \U0001f600 \U0001f600", "a" * 3000, "x y " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, size long, target string, spans string, kept string"


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", 1, 0, 9, "t", "s", "k") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 260))) for _ in range(60)]
    out += [out[0], out[1], out[2].upper(), out[3] + " tail", "head " + out[4]]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    out += [" ".join(out[k].split()[:9] + passage.split() + out[k].split()[9:]) for k in range(5, 12)]
    out += ["word " * 90, "word " * 120, "ab cd " * 80]
    return out + ODD


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_equals_the_public_library(spark, prose):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*prose, "don't 'll\x1c\x1f  \n x", "ǅ²Ⅷ ٣", "'re''s"]
    got = rows(bpe.decode(bpe.encode(documents(spark, texts), path, public_tokenizers.PATTERN), path))
    for i, text in enumerate(texts):
        assert got[i]["ids"] == other.encode_ordinary(text or "")
        assert bytes(got[i]["decoded"]) == (text or "").encode()
    assert queries.token_digests(documents(spark, [])).count() == 0


def test_bpe_tables_follow_edits():
    import public_tokenizers

    v = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    table = bpe.PrefixTable(v, b"the quick brown fox jumped over" * 20)
    before = table.steps
    table.edit(50, 58, b"zebra")
    assert table.steps - before < 400
    table.append(b" and more")
    assert table.ids() == bpe.PrefixTable(v, bytes(table.data)).ids()


def test_mix_targets_and_bounds(spark, prose):
    df = documents(spark, prose)
    got = mixing.mix(df, bucket_rows=7).collect()
    size = {i: len(re.findall(WORD, t or "")) for i, t in enumerate(prose)}
    total = sum(size.values())
    sources = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"]
        s = sources.setdefault(r["source"], [0, r["source_size"], r["target"]])
        s[0] += r["taken"]
    assert sum(s[2] for s in sources.values()) == pytest.approx(total)
    names = sorted((s for s in sources if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    level = {s: sources[s][2] / weights[s] for s in names if sources[s][2] < 3 * sources[s][1] - 1e-6}
    assert max(level.values()) == pytest.approx(min(level.values()))
    assert all(taken == int(target + 1e-6) for taken, _, target in sources.values())
    # the cut, by a plain loop
    for name in names:
        own = [i for i in range(len(prose)) if (None if i % 4 == 0 else f"s{i % 3}") == name]
        own.sort(key=lambda i: hashlib.md5(f"17:{i}:{prose[i] or ''}".encode()).hexdigest())
        left, expected = int(sources[name][2] + 1e-6), dict.fromkeys(own, 0)
        while left and sources[name][1]:
            for i in own:
                expected[i] += (now := min(left, size[i]))
                left -= now
        assert {r["doc_id"]: r["taken"] for r in got if r["source"] == name} == expected
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(5), bucket_rows=7).collect()))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_repeat_keeps_columns(spark, prose):
    df = documents(spark, prose)
    plan = {r["doc_id"]: r for r in mixing.plan(df).collect()}
    got = mixing.repeat(df)
    assert got.columns == df.columns
    texts = {}
    for r in got.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert set(texts) == {i for i, r in plan.items() if r["copies"] or r["part"]}
    for i, found in texts.items():
        words = re.findall(WORD, prose[i] or "")
        cut = [" ".join(words[: plan[i]["part"]])] if plan[i]["part"] else []
        assert sorted(map(str, found)) == sorted(map(str, [prose[i]] * plan[i]["copies"] + cut))
    assert sum(bool(r["part"]) for r in plan.values()) >= 1


def test_repeated_rows_are_taken_exactly(spark):
    df = documents(spark, ["a b c"] * 7 + ["d e"] * 5, [1] * 7 + [2] * 5)
    taken = mixing.mix(df).agg(F.sum("taken")).first()[0]
    assert sum(len(r["text"].split()) for r in mixing.repeat(df).collect()) == taken


def jaccard_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def components_of(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates_equal_brute_force(spark, prose, small):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(w if rng.random() > rng.choice([0.01, 0.03, 0.06]) else f"e{rng.randint(0, 5)}" for w in base) for _ in range(40)]
    texts = [*prose, *near]
    sets = jaccard_sets(texts, 4)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components_of(len(sets), links)
    got = rows(minhash.group(documents(spark, texts), small=small, block=8))
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), expected[i], expected[i] == i)


def test_near_duplicates_odd_rows(spark):
    got = minhash.group(documents(spark, ["a b c d e", "a b c d e", "a b c d e", None], [None, 5, 5, 7])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(5, 5, True), (5, 5, True), (7, 7, True)]
    assert [r["kept"] for r in got if r["doc_id"] is None] == [False]
    assert minhash.group(documents(spark, [])).count() == 0
    assert minhash.drop_near(documents(spark, ["a b c d", "a b c d"]), n=5).columns == documents(spark, []).columns


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(edges.unionByName(spark.createDataFrame([(100, 101), (None, 3), (7, 7)], "a long, b long")))
    assert {r["vertex"]: r["component"] for r in got.collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string, payload string, digest string, same string"
    data = [(1, "http://a/ b", "x", "", "", ""), (2, None, "é" * 600, "", "", ""), (3, "u\r\nX: y", None, "", "", ""), (9, "u", "é" * 600, "", "", ""), (4, "u", "x", "", "", ""), (None, "u", "é" * 600, "", "", "")]
    got = warc.read(warc.write(spark.createDataFrame(data, schema), package_bytes=300)).collect()
    assert len(got) == len(data) and all(r["intact"] for r in got)
    for r in got:
        html = next(d[2] for d in data if d[0] == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        revisit = len(html.encode()) >= 1000 and r["page_id"] != 9
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == html.encode()
    assert warc.read(warc.write(spark.createDataFrame([], schema))).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    import zipfile

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"1" * 50)
        z.writestr("two", b"2" * 60, zipfile.ZIP_DEFLATED)
    with open(path, "rb") as file:
        package = warc.Package(file, path.stat().st_size)
        assert package.small("one") == b"1" * 50 and package.small("two") == b"2" * 60
    with pytest.raises(ValueError, match="not a ZIP"), open(__file__, "rb") as file:
        warc.Package(file, 100)


def test_fingerprints_equal_brute_force(spark, prose):
    texts = [t.replace(" a", "\n a") if t else t for t in prose]
    got = rows(sketches.compare(sketches.edited(documents(spark, texts))))
    units = lambda t: set(re.findall(rf"[^\n]{{1,{sketches.UNIT}}}", t))
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    prints = {}
    for i, text in enumerate(texts):
        t, following = text or "", texts[i - 1] or ""  # the document with the next lower id; after 0 the last
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(units(t), units(edited)))
        assert r["near_next"] == pytest.approx(near(units(t), units(following)))
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert sketches.compare(sketches.edited(documents(spark, []))).count() == 0
    # ids that repeat share what follows them, the least text of the next lower id; the one without an id comes last
    odd = sketches.edited(documents(spark, ["aaaaaa", "bbbbbb", "cccccc", "dddddd", "eeeeee"], [1, 1, None, 4, None])).collect()
    assert sorted((r["text"], r["edited"]) for r in odd) == [("aaaaaa", "aaaacc"), ("bbbbbb", "bbbbcc"), ("cccccc", "ccccdd"), ("dddddd", "ddddaa"), ("eeeeee", "eeeedd")]
    one =sketches.compare(sketches.edited(documents(spark, ["x" * 500], [3]))).first()
    assert one["near_next"] == 1.0 and one["near_edited"] == 1.0


def test_stuck_tables_go_again(spark):
    sets = spark.createDataFrame([(1, 0, 250.0, list(range(200)), list(range(150, 300)))], "rid long, pair int, likely double, a array<long>, b array<long>")
    for sizes in ((0.2, 9.0), (0.2,)):
        found = sketches.reconcile(sets, sizes).first()["found"]
        assert {(r["k"], r["n"]) for r in found} == {(k, 1) for k in range(150)} | {(k, -1) for k in range(200, 300)} and len(found) == 250
    assert sketches.reconcile(sets, digests=False).first()["differ"] == 250


@pytest.mark.parametrize(("a", "b"), [([], []), ([1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4], [2, 3, 4, 9]), ([7], []), (list(range(60)), list(range(60, 120)))])
def test_fingerprints_give_back_few_differences(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(sketches.build(F.col("a")).alias("x"), sketches.build(F.col("b")).alias("y"), F.size("a").alias("n"), F.size("b").alias("m"))
    cells = sketches.subtracted(F.col("x"), F.col("y"))
    got = df.select(sketches.peeled_root(cells).alias("found"), sketches.estimated(cells, F.col("n"), F.col("m")).alias("likely")).first()
    expected = {(k, 1) for k in set(a) - set(b)} | {(k, -1) for k in set(b) - set(a)}
    if got["found"] is not None:
        assert {(r["k"], r["n"]) for r in got["found"]} == expected
    else:
        assert len(expected) > 3
    assert abs(len(a) - len(b)) <= got["likely"] <= max(1, len(a) + len(b))


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 16))
    x[100:160] = x[100] + rng.normal(size=(60, 16)) * 0.12
    x[200:210] = x[200]
    x[210] = 5 * x[200]
    data = [(i, [float(v) for v in np.float32(r)], "c") for i, r in enumerate(x)]
    bad = [(900, None, "c"), (901, [0.0] * 16, "c"), (902, [float("nan")] * 16, "c"), (903, [None] * 16, "c"), (904, [], "c"), (905, [1.0, 2.0], "c")]
    got = rows(hnsw.group(spark.createDataFrame(data + bad, "vec_id long, embedding array<float>, digest string"), shards=3, block=64, beam=4), "vec_id")
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    expected = components_of(len(u), [(a, b) for a in range(len(u)) for b in range(a) if linked[a, b]])
    for i in range(len(u)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (linked[i].sum() - 1, expected[i])
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 906))
    assert hnsw.group(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_ask_near_cells(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2600, 16))
    x[:1400] = x[0] + rng.normal(size=(1400, 16)) * 0.45  # one crowded cell
    x[1600:2400] = np.repeat(x[1600:1700], 8, 0) + rng.normal(size=(800, 16)) * 0.15
    staged, laid, stage, lay = [], [], hnsw.stage, hnsw.laid_out
    monkeypatch.setattr(hnsw, "stage", lambda df, tag: staged.append(stage(df, tag)) or staged[-1])
    monkeypatch.setattr(hnsw, "laid_out", lambda *a: laid.append(lay(*a)) or laid[-1])
    df = spark.createDataFrame([(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = rows(hnsw.group(df, shards=8, shard_rows=256, block=128, audit_every=5, all_probes=0), "vec_id")
    space = laid[0][0][64]
    assert 2 <= space.probes < len(space.centres) and space.shards.max() > 1
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    expected = (u @ u.T >= 0.95).sum(1) - 1
    links = np.array([got[i]["n_links"] for i in range(len(u))])
    assert (links <= expected).all() and links.sum() >= 0.97 * expected.sum() > 5000


def test_no_row_holds_a_shard_of_embeddings(spark, monkeypatch):
    staged, stage = [], hnsw.stage
    monkeypatch.setattr(hnsw, "stage", lambda df, tag: staged.append(stage(df, tag)) or staged[-1])
    x = np.random.default_rng(5).normal(size=(600, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    assert hnsw.group(df).count() == 600
    for table in staged:
        binary = [c for c, kind in table.dtypes if kind == "binary"]
        assert max(table.select([F.max(F.octet_length(c)) for c in binary]).first()) <= 64


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\n", "<\\|im_end|> <\\\\|im_end|>", None, "", "é\U0001f600\n\n", "[\\INST] \\"]
    data = [(c, t, role, odd[(c + t) % len(odd)], "x") for c in range(9) for t, role in enumerate(("system", "user", "assistant", "user", "assistant"))]
    data += [(50, 2, "assistant", "b", "x"), (50, 1, None, "a", "x"), (50, None, "user", "z", "x"), (None, 0, "user", "q", "x")]
    rows_ = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, formatted string")
    back = chat.read(chat.write(rows_))
    got, sums = rows(back, "conv_id"), rows(chat.digests(back), "conv_id")
    for c in {d[0] for d in data}:
        turns = sorted((d for d in data if d[0] == c), key=lambda d: -1 if d[1] is None else d[1])
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(d[2] or "", d[3] or "") for d in turns]
        loss = "".join(d[3] or "" for d in turns if d[2] == "assistant")
        assert got[c]["loss_text"] == loss and sums[c]["loss_chars"] == len(loss)
        assert sums[c]["turns_sha256"] == hashlib.sha256("".join(f"{d[2] or ''}\n{d[3] or ''}\n" for d in turns).encode()).hexdigest()
        assert got[c]["formatted"].count("<|im_end|>") == len(turns)
    assert chat.read(chat.write(spark.createDataFrame([], rows_.schema))).count() == 0
    lines = spark.createDataFrame([(1, 0, "us\ner%0A", "t")], "conv_id long, turn long, role string, text string")
    assert chat.read(chat.write(lines)).first()["turns"][0]["role"] == "us\ner%0A"


def test_repeats_equal_brute_force(spark, prose):
    from collections import Counter

    split = [re.findall(WORD, t or "") for t in prose]
    count = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    got = rows(substrings.remove_repeats(documents(spark, prose)))
    for k, w in enumerate(split):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    twice = substrings.remove_repeats(documents(spark, ["u " + " ".join(f"v{i}" for i in range(40))] * 2, [None, None])).collect()
    assert [r["n_removed"] for r in twice] == [41, 41]
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_repeats_hold_at_any_levels(spark, prose):
    rows_ = sorted(map(tuple, substrings.remove_repeats(documents(spark, prose)).select("doc_id", "n_removed", "kept_sha256").collect()))
    for levels in ((0,), (2, 3, 1)):
        assert sorted(map(tuple, substrings.remove_repeats(documents(spark, prose), levels=levels).select("doc_id", "n_removed", "kept_sha256").collect())) == rows_


def test_windows_share_symbols_whatever_stands_around():
    rng = random.Random(2)
    passage = [f"p{rng.randint(0, 9)}" for _ in range(35)]
    shared, most = None, 0
    with np.errstate(over="ignore"):
        for _ in range(40):
            before, after = ([f"{c}{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30))] for c in "qr")
            data, offsets = shingles.text_bytes(pa.array([" ".join(before + passage + after)]))
            hashes, start, _ = shingles.words(data, offsets, lower=False)
            found = substrings.Names(hashes, shingles.document_bounds(start, offsets), 35, 3)
            inside = (found.left >= len(before)) & (found.right <= len(before) + 35)
            mine = found.sym[inside].tolist()
            assert mine and (shared is None or mine == shared)
            shared, most = mine, max(most, len(mine))
    assert most >= 5


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum((2 * int(c) - 9 if c > "4" else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_personal_data_equals_plain_patterns(spark, prose):
    rng = random.Random(6)
    noise = ["".join(rng.choice("ab12.@+-_% ()\né5") for _ in range(rng.randint(1, 400))) for _ in range(80)]
    texts = [*prose, *noise, "a@b.c_d@e.f x@y.zé", "1.2.3.4.5.6.7.8 001.002.3.0004 999.1.1.1 1.2.3.300", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (807) 555-6237 \U0001f600 +1 (984) 555-9848", "1" * 9000, "1 " * 9000, "a." * 5000 + "@", "+1(" * 500]
    got = rows(pii.digests(pii.find(documents(spark, texts))))
    for i, text in enumerate(texts):
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in re.finditer(p, text or "") if good(k, m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k, _ in PLAIN] == [sum(b.startswith(k) for b in base) for k, _ in PLAIN]
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}
    assert pii.find(documents(spark, [])).count() == 0


def planted_identifiers():
    """Texts with seeds, the same contexts with unseen identifiers, and clean texts with numbers of other contexts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    cards = [c for c in (f"4{i:03d}000000000000" for i in range(400)) if good("card", c)][:12]
    seeds = [f"{word()} pay with card {c} now {word()}" for c in cards]
    seeds += [f"{word()} call +1 ({200 + i}) 555-{1000 + i} today {word()}" for i in range(12)]
    seeds += [f'{word()} token = "{rng.getrandbits(160):040x}" {word()}' for _ in range(12)]
    unseen = [("card", f"{word()} pay with card 4000000000000001 now {word()}", "4000000000000001"), ("phone", f"{word()} call 1 (299) 555-1099 today {word()}", "1 (299) 555-1099")]
    unseen += [("secret", f'{word()} token = "ab12cd34ef56ab78" {word()}', "ab12cd34ef56ab78")]
    clean = [f"{word()} version {i}.0 of {word()}" for i in range(20)] + [f"{word()} in 19{i:02d} there {word()}" for i in range(20)] + ["order 4000000000000001 of none"] * 3
    return seeds, unseen, clean


@pytest.mark.parametrize("times", [1, 5])
def test_patterns_discover_identifiers(spark, times):
    """At production defaults, alike at any size of the table."""
    seeds, unseen, clean = planted_identifiers()
    texts = [*seeds, *[t for _, t, _ in unseen], *clean] * times
    found = rows(pii.digests(pii.find(documents(spark, texts))))
    n = len(seeds)
    for k, (kind, text, value) in enumerate(unseen):
        at = text.index(value)
        assert f"{kind}:{at}:{at + len(value)}" in found[n + k]["spans"].split(",")
    assert all(not found[i]["spans"] for i in range(n + len(unseen), n + len(unseen) + 40))
    for i in range(24):
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN for m in re.finditer(p, texts[i]) if good(k, m[0])]
        assert found[i]["spans"] == ",".join(base) and found[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    for i in range(24, 36):
        assert found[i]["spans"].startswith("secret:") and found[i]["n_card"] == 0


def test_discovery_equals_a_plain_scorer(spark):
    seeds, unseen, clean = planted_identifiers()
    base = pii.base_table(documents(spark, [*seeds, *[t for _, t, _ in unseen], *clean]))
    found = pii.instances(base).withColumn("shape", pii.shape(F.col("value"))).withColumns({"before": pii._cue(F.col("left"), True), "after": pii._cue(F.col("right"), False)}).collect()
    graph = {}
    for r in found:
        for cue in ("<" + r["before"], ">" + r["after"]):
            row = graph.setdefault((cue, r["shape"], r["value"]), [0, False])
            row[0] += 1
            row[1] |= r["kind"] is not None
    score = {v: 0.0 for _, _, v in graph}
    score |= {v: 1.0 for (_, _, v), (_, seed) in graph.items() if seed}
    fixed = {v for v, s in score.items() if s}
    share = lambda rows_, v: (sum(score[x] * n for x, n in rows_ if x != v), sum(n for x, n in rows_ if x != v))
    for _ in range(3):
        new = {}
        for value in score:
            said = total = 0.0
            for (cue, shape, v), (n, _) in graph.items():
                if v != value:
                    continue
                ps, pn = share([(x, m) for (c, s, x), (m, _) in graph.items() if (c, s) == (cue, shape)], v)
                # the shape's own mean leaves out this row only
                qs = sum(score[x] * m for (c, s, x), (m, _) in graph.items() if s == shape) - score[v] * n
                qn = sum(m for (c, s, x), (m, _) in graph.items() if s == shape) - n
                said += n * (ps + qs / max(qn, 1)) / (pn + 1)
                total += n
            new[value] = 1.0 if value in fixed else said / total
        score = new
    expected = {v for v, s in score.items() if s >= 0.9 and v not in fixed and any(v == x and len({y for (c2, s2, y), (_, seed) in graph.items() if seed and (c2, s2) == (c, s_)}) >= 2 for c, s_, x in graph)}
    values = {(r["doc_id"], r["start"]): r["value"] for r in found}
    mine = {values[r["doc_id"], r["start"]] for r in pii.discover(base).collect() if (r["doc_id"], r["start"]) in values} - fixed
    assert mine == expected and expected


def test_cues_are_whole_words(spark):
    long = "a" * 300
    got = spark.createDataFrame([(f"{long} 12 34 b 5",)], "t string").select(F.explode(pii.located(F.col("t"), pii.TOKEN)).alias("x")).select("x.*").collect()
    assert [(r["value"], r["left"], r["right"]) for r in got] == [("12", long, "34"), ("34", "12", "b"), ("5", "b", "^")]


def test_masking(spark):
    texts = ["mail a.b@c.de now +1 (807) 555-6237 at 1.2.3.4", None, "é\U0001f600 x@y.zz", "clean text"]
    got = rows(pii.redact(documents(spark, texts)))
    assert [got[i]["text"] for i in range(4)] == ["mail [EMAIL] now [PHONE] at [IP]", None, "é\U0001f600 [EMAIL]", "clean text"]
    assert pii.redact(documents(spark, texts)).columns == documents(spark, []).columns


def test_quality_separates_junk(spark, prose):
    rng = random.Random(1)
    clean = [t for t in prose if t and len(t) > 40][:60]
    junk = [" ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in t.split()) for t in clean]
    texts = clean + junk + ODD
    labels = spark.createDataFrame([(i, 1 if i < len(clean) else 0, 0) for i in range(len(clean) + len(junk))] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows(quality.classify(documents(spark, texts), labels))
    for i in range(len(texts)):
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in range(len(clean) + len(junk)) if got[i]["held_out"]]
    assert sum((got[i]["score"] >= 0.5) == (i < len(clean)) for i in held) >= 0.9 * len(held)
    kept = quality.keep_good(documents(spark, texts), labels)
    assert kept.columns == documents(spark, []).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(len(texts)) if got[i]["predicted"]}
    empty = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality.classify(documents(spark, ["a", ""]), empty).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0


def test_two_way_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.9


def filled(sizes, epochs=3):
    """Targets by giving out the total by weight and taking back what is over a cap, again and again."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate([*sorted(x for x in sizes if x is not None), *[None] * (None in sizes)])}
    out, open_, rest = {}, set(sizes), sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= epochs * sizes[s]}
        for s in full or open_:
            out[s] = epochs * sizes[s] if full else weight[s] * level
        rest -= sum(out[s] for s in full)
        open_ = open_ - full if full else set()
    return out


def test_pipeline_equals_brute_force(spark, prose, tmp_path):
    import base64

    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    junk = [" ".join(w.upper() + "!!" for w in (t or "").split()) for t in prose[:40]]
    texts = [*prose, *junk]
    source = lambda i: None if i % 5 == 0 else f"s{i % 3}"
    docs = spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i < len(prose)), 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good_ = [r["doc_id"] for r in quality.classify(docs, labels).collect() if r["predicted"]]
    sets = dict(zip(good_, jaccard_sets([texts[i] for i in good_], 5), strict=True))
    links = [(x, y) for x, a in enumerate(good_) for y, b in enumerate(good_[:x]) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components_of(len(good_), links)
    least = {}
    for x, i in enumerate(good_):
        least[root[x]] = min(i, least.get(root[x], i))
    kept = sorted(least.values())
    size = {i: len(re.findall(WORD, texts[i] or "")) for i in kept}
    totals = {}
    for i in kept:
        totals[source(i)] = totals.get(source(i), 0) + size[i]
    raw = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=raw, special_tokens={})
    expected = []
    for name, target in filled(totals).items():
        own = sorted((i for i in kept if source(i) == name), key=lambda i: hashlib.md5(f"17:{i}:{texts[i] or ''}".encode()).hexdigest())
        left, epoch = int(target + 1e-6), 0
        while left > 0 and totals[name] and epoch < 3:
            for i in own:
                if left > 0:
                    now = min(left, size[i])
                    words = re.findall(WORD, texts[i] or "")
                    expected.append((i, (texts[i] or "") if now == size[i] else " ".join(words[:now])))
                    left -= now
            epoch += 1
    shown = lambda text: hashlib.sha256(" ".join(map(str, other.encode_ordinary(text))).encode()).hexdigest()
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((i, shown(t)) for i, t in expected)


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    odd = documents(spark, [None, "", "a b c d e f", "a b c d e f", "x y z u v w t", "x y z u v w t", "1 2 3 4 5"], [1, 2, None, None, 7, 7, None])
    for k, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert step(spark, odd, str(tmp_path)).columns == odd.columns
        assert step(spark, odd.limit(0), str(tmp_path)).count() == 0
        if k == 1:
            got = step(spark, odd, str(tmp_path)).collect()
            assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got])) == sorted(map(str, [(1, None), (2, ""), (None, "a b c d e f"), (7, "x y z u v w t"), (None, "1 2 3 4 5")]))
        if k == 2:
            assert step(spark, odd, str(tmp_path)).count() == 7
    assert corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path)).count() == 7


def test_pipeline_keeps_columns_between_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    good_ = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(10, 99)) for _ in range(80)) for _ in range(30)]
    texts = [*good_, good_[0], good_[1] + " me@x.org", *[" ".join(w.upper() + "!!" for w in t.split()) for t in good_]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 32), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
        if k == 0:
            assert {r["doc_id"] for r in now.collect()} == set(range(32))
        if k == 1:
            assert {r["doc_id"] for r in now.collect()} == set(range(30))
        if k == 2:
            assert not any("@" in r["text"] for r in now.collect())
    assert 0 < now.count() and set(now.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_near_duplicates_broadcast_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    joined = graph._with_least(edges, least)
    joined.collect()  # the plan that ran is known after it
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {r["component"] for r in graph.components(edges).collect()} == {0}


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(261, 299)]
    root = components_of(301, [(max(x), min(x)) for x in links if x[0] != x[1]])
    expected = {v: root[v] for x in links if x[0] != x[1] for v in x}
    edges = spark.createDataFrame(links, "a long, b long").repartition(5)
    for alone in (graph.ALONE, 50, 0):
        assert [(r["vertex"], r["component"]) for r in graph.components(edges, alone=alone).orderBy("vertex").collect()] == sorted(expected.items())


def test_components_of_few_edges_take_few_jobs(spark):
    context = spark.sparkContext
    context.setJobGroup("few edges", "few edges")
    try:
        graph.components(spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("few edges")) <= 8


def test_pipeline_drops_near_duplicates_in_few_jobs(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    docs = documents(spark, [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(30)] + ["a b c d e f"])
    context = spark.sparkContext
    context.setJobGroup("near duplicates", "near duplicates")
    try:
        got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("near duplicates"))
    assert sorted(r["doc_id"] for r in got) == [0, 30] and 0 < jobs <= 80, jobs
