"""Document fingerprints as invertible Bloom lookup tables.

A document's units are its lines, cut into paragraphs of at most ``UNIT`` code points from the
line's start; its set holds their 64-bit digests. Each digest is added to one cell in each of
three parts of a table; a cell keeps a count, the xor of its digests and the xor of their checks.
The fingerprint is such a table of ``ROOT`` cells with the number of units. Two versions are
compared by subtracting their fingerprints cell by cell: common digests vanish, and peeling cells
that hold a single digest recovers those that differ. Where more differ than such a small table
can give back, the second moment of the subtracted counts estimates how many, and the two texts
get larger tables in proportion to that estimate, larger still each time peeling gets stuck; only
these pairs send their digests on.

Everything is DataFrame expressions. Texts meet their neighbours by one shuffle: ids are cut into
ranges at a table of bounds (one per partition), and each range also gets the first document of
the next one.

Defined cases: a null text is empty, an empty one has no units; two texts without units are alike
(1.0); a line's repeated paragraphs count once; rows that share an id share the next document, the
one with the next lower id (of rows with that id, the least text); null ids stand after all others
(as the least id); a single document is its own next; tables may be empty; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import cut, stage, text_or_empty

UNIT = 96
ROOT = 12
#: Cells of a pair's tables per digest that is estimated to differ, attempt by attempt.
SIZES = (6.0, 18.0, 72.0)
LEAST = -(1 << 63)
CELLS = "array<struct<n:int,k:bigint,c:bigint>>"
SIGNED = "array<struct<k:bigint,n:int>>"


def units(text: Column, size: int = UNIT) -> Column:
    """The distinct digests of a text's paragraphs."""
    parts = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{size}}}"), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1))


def slot(key: Column, part: Column, third: Column, seed: Column) -> Column:
    """The cell of a digest in part 0, 1 or 2 of a table with ``third`` cells in each."""
    return F.pmod(F.xxhash64(key, part, seed), third)


def root_slots(key: Column) -> list[Column]:
    """A digest's places in a fingerprint."""
    third = ROOT // 3
    return [(j * third + slot(key, F.lit(j), F.lit(third), F.lit(-1))).cast("int") for j in range(3)]


def build(keys: Column) -> Column:
    """The ROOT cells of a set of digests, part by part."""
    placed = F.transform(keys, lambda k: F.struct(k.alias("k"), check(k).alias("c"), *[s.alias(f"s{j}") for j, s in enumerate(root_slots(k))]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def cell(rows: Column, i: int) -> Column:
        mine = F.filter(rows, lambda p: p[f"s{3 * i // ROOT}"] == i)
        return F.aggregate(mine, zero, lambda a, p: F.struct((a["n"] + 1).alias("n"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["c"].bitwiseXOR(p["c"]).alias("c")))

    return F.element_at(F.transform(F.array(placed), lambda rows: F.array(*[cell(rows, i) for i in range(ROOT)])), 1)


def subtracted(a: Column, b: Column) -> Column:
    """The cells of one table without those of another."""
    one = lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c"))
    return F.zip_with(a, b, one)


def _pure(x: Column) -> Column:
    return (F.abs(x["n"]) == 1) & (x["c"] == check(x["k"]))


def peeled_root(cells: Column) -> Column:
    """The digests (k, n: 1 of the first set, -1 of the second) of a subtracted fingerprint; null where peeling gets stuck.

    A table can't give back more digests than it has cells, so that many steps do, and none where a part holds more.
    """
    start = F.struct(cells.alias("cells"), F.array().cast(SIGNED).alias("found"))

    def step(acc: Column, _: Column) -> Column:
        one = F.get(F.filter(acc["cells"], _pure), F.lit(0))
        slots = F.array(*root_slots(one["k"]))
        less = lambda x, i: F.when(F.array_contains(slots, i), F.struct((x["n"] - one["n"]).alias("n"), x["k"].bitwiseXOR(one["k"]).alias("k"), x["c"].bitwiseXOR(one["c"]).alias("c"))).otherwise(x)
        taken = F.struct(F.transform(acc["cells"], less).alias("cells"), F.concat(acc["found"], F.array(F.struct(one["k"].alias("k"), one["n"].alias("n")))).alias("found"))
        return F.when(one.isNull(), acc).otherwise(taken)

    clear = lambda x: F.forall(x, lambda c: (c["n"] == 0) & (c["k"] == 0))
    held = F.aggregate(F.slice(cells, 1, ROOT // 3), F.lit(0), lambda n, c: n + F.abs(c["n"]))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROOT)), start, step, lambda acc: F.when(clear(acc["cells"]), acc["found"]))
    return F.when(clear(cells), F.array().cast(SIGNED)).when(held <= ROOT, done)


def estimated(cells: Column, n_a: Column, n_b: Column) -> Column:
    """How many digests differ, from the second moment of a subtracted fingerprint's counts; never outside what the sizes allow."""
    third = ROOT // 3
    squares = F.aggregate(cells, F.lit(0.0), lambda s, c: s + (c["n"] * c["n"]).cast("double")) / 3
    extra = (n_a - n_b).cast("double")
    moment = (squares - extra * extra / third) / (1 - 1 / third)
    return F.greatest(F.least(moment, (n_a + n_b).cast("double")), F.abs(extra), F.lit(1.0))


def _parts(df: DataFrame) -> int:
    """A row of a set becomes several cells, so there are more partitions than a shuffle's and no table of cells spills."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def peel(cells: DataFrame, steps: int, digests: bool = True) -> DataFrame:
    """Rows (rid, pair, differ, stuck), with ``digests`` also found, from the cells of differences: (rid, pair, third, seed, part, slot, n, k, c).

    Each step looks at one part, in which a digest has one cell only: a cell with a single digest
    takes it out of all its cells and becomes a row of what was found (part -1, in the place of the
    digest itself) or, where only their number is asked for, adds to one such row. All steps group
    by keys that begin with rid, so they run where the cells are. Each aggregate takes a page of
    memory when its task starts, so after two steps, when few cells are left, the rest run as tasks
    of their own.
    """
    same = ["rid", "pair", "third", "seed"]
    c = F.col
    for step in range(steps):
        if step == 2:
            cells = cells.repartition("rid")
        pure = (c("part") == step % 3) & (F.abs(c("n")) == 1) & (c("c") == check(c("k")))
        row = lambda p, slot_, n, k, x: F.struct(p.alias("part"), slot_.alias("slot"), n.alias("n"), k.alias("k"), x.alias("c"))
        out = [row(F.lit(j), slot(c("k"), F.lit(j), c("third"), c("seed")), -c("n"), c("k"), c("c")) for j in range(3)]
        nil = F.lit(0).cast("long")
        keep = row(c("part"), c("slot"), c("n"), c("k"), c("c"))
        taken = row(F.lit(-1), c("k"), c("n"), nil, nil) if digests else row(F.lit(-1), nil, F.lit(1).cast("long"), nil, nil)
        freed = F.array(keep, *out, taken)
        moved = cells.select(*same, F.explode(F.when(pure, freed).otherwise(F.array(keep))).alias("r")).select(*same, "r.*")
        cells = moved.groupBy(*same, "part", "slot").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).filter("n != 0 or k != 0")
    of = c("part") < 0
    wanted = [F.sum(F.when(of, F.abs(c("n"))).otherwise(0)).alias("differ"), F.sum((~of).cast("int")).alias("stuck")]
    if digests:
        wanted.append(F.collect_list(F.when(of, F.struct(c("slot").alias("k"), c("n").cast("int").alias("n")))).alias("found"))
    return cells.groupBy("rid", "pair").agg(*wanted)


def differences(sets: DataFrame, cells_per_digest: float, seed: int, digests: bool = True, steps: int = 6) -> DataFrame:
    """Rows (rid, pair, differ, stuck), with ``digests`` also found, for pairs of sets (rid, pair, likely, a, b) that differ; ``likely`` is the estimate.

    Both tables have the same size. Their cells are added with opposite signs, which is the subtraction of the two tables.
    """
    third = (F.ceil(F.col("likely") * (cells_per_digest / 3)) + 3).cast("long")
    signed = lambda side, n: F.transform(side, lambda k: F.struct(k.alias("k"), F.lit(n).cast("long").alias("n")))
    rows = sets.select("rid", "pair", third.alias("third"), F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("d")).select("rid", "pair", "third", "d.k", "d.n")
    rows = rows.withColumn("seed", F.lit(seed)).withColumn("c", check(F.col("k"))).withColumn("part", F.explode(F.array(*[F.lit(j) for j in range(3)])))
    rows = rows.withColumn("slot", slot(F.col("k"), F.col("part"), F.col("third"), F.col("seed")))
    cells = rows.groupBy("rid", "pair", "third", "seed", "part", "slot").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).filter("n != 0 or k != 0")
    return peel(cells, steps, digests)


def reconcile(sets: DataFrame, sizes: tuple[float, ...] = SIZES, digests: bool = True) -> DataFrame:
    """Rows (rid, pair, differ): in how many digests pairs of sets (rid, pair, likely, a, b) differ.

    With ``digests`` also ``found``: the digests themselves (k, n: 1 of a, -1 of b). Pairs whose
    tables can't be peeled go again with larger ones; should the largest fail too, the sets
    themselves are compared.
    """
    done, columns = None, ["rid", "pair", "differ", *["found"] * digests]
    for k, size_ in enumerate(sizes):
        got = cut(differences(sets, size_, k, digests))
        right = got.filter("stuck = 0").select(*columns)
        done = right if done is None else done.union(right)
        failed = got.filter("stuck > 0").select("rid", "pair")
        if failed.isEmpty():
            return done
        sets = cut(sets.join(failed, ["rid", "pair"]))
    only = lambda x, y, n: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))
    rest = sets.select("rid", "pair", F.concat(only("a", "b", 1), only("b", "a", -1)).cast(SIGNED).alias("found"))
    return done.union(rest.withColumn("differ", F.size("found").cast("long")).select(*columns))


def likeness(both: Column, differ: Column) -> Column:
    """Jaccard similarity of two sets from the sum of their sizes and the number of differing members."""
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))


def written(table: Column, n: Column) -> Column:
    """A fingerprint: the number of units, then count, digests and checks of every cell in hex."""
    cells = F.transform(table, lambda x: F.concat_ws(".", x["n"].cast("string"), F.hex(x["k"]), F.hex(x["c"])))
    return F.concat(n.cast("string"), F.lit(";"), F.array_join(cells, ","))


def fingerprint(documents: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``documents`` with the fingerprint of each text."""
    keys = units(text_or_empty(F.col(text_col)))
    return documents.withColumn("__u", keys).withColumn(out_col, written(build(F.col("__u")), F.size("__u"))).drop("__u")


def _tops(keys: DataFrame) -> list[int]:
    """The greatest key of each of as many ranges of keys as a shuffle has partitions, greatest first."""
    ranged = keys.select("key").repartitionByRange(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("key").desc())
    return sorted((r["top"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.max("key").alias("top")).collect()), reverse=True) or [LEAST]


def _range_of(key: Column, tops: list[int]) -> Column:
    """The number of the range that a key is in: halving steps through the table of tops."""
    steps = [1 << i for i in range(len(tops).bit_length() - 1, -1, -1)]
    table = F.lit(tops).cast("array<long>")
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when((at + s < len(tops)) & (F.get(table, at + s) >= key), at + s).otherwise(at))


def edited(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, edited, u, next): the last third of each text replaced by the start of the next document's.

    ``u`` are the text's units, ``next`` those of the next document.
    """
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("key"), text_or_empty(F.col(text_col)).alias("text"))
    tops, n = _tops(docs), F.col("range")
    docs = docs.withColumn("u", units(F.col("text"))).withColumn("range", _range_of(F.col("key"), tops))
    ahead = docs.filter(F.col("key").isin(tops)).withColumn("range", F.pmod(n - 1, F.lit(len(tops))).cast("int"))
    rows = docs.withColumn("guest", F.lit(False)).unionByName(ahead.withColumn("guest", F.lit(True)))
    order = Window.partitionBy("range").orderBy("guest", F.col("key").desc(), "text")
    after = lambda c: F.lead(c).over(order)
    # the last row of an id sees the next document; its peers, the rows with that id, take it from it
    edge = after("guest") | (after("key") != F.col("key"))
    rows = rows.withColumn("seen", F.when(edge, F.struct(after("text").alias("text"), after("u").alias("u")))).filter("not guest")
    peers = Window.partitionBy("range").orderBy("guest", F.col("key").desc()).rangeBetween(Window.currentRow, Window.currentRow)
    rows = rows.withColumn("seen", F.max("seen").over(peers))
    third = F.floor(F.length("text") / 3).cast("int")
    new = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("seen.text"), F.lit(1), third))
    return rows.select(F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"), "text", new.alias("edited"), "u", F.col("seen.u").alias("next"))


def compare(rows: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of rows (doc_id, text, edited, u, next)."""
    c = F.col
    sized = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "u", units(c("edited")).alias("e"), c("next").alias("x"))
    sized = sized.select("*", *[build(c(k)).alias(f"t{k}") for k in "uex"])
    # the fingerprints themselves are subtracted; a pair that they can't settle gets an estimate instead
    other = lambda k: F.struct(F.size(k).alias("n"), peeled_root(subtracted(c("tu"), c(f"t{k}"))).alias("found"), estimated(subtracted(c("tu"), c(f"t{k}")), F.size("u"), F.size(k)).alias("likely"))
    held = sized.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "n_chars", "edited_sha256", F.size("u").alias("n"), other("e").alias("pe"), other("x").alias("px"), "u", "e", "x",
    )
    held = stage(held, "fingerprints")  # the tables are made again from their digests at the end, which take less room
    # texts go out once for both pairs; only pairs without a result become rows
    sent = held.filter("pe.found is null or px.found is null").select("rid", "u", "e", "x", *[F.when(c(f"p{k}.found").isNull(), c(f"p{k}.likely")).alias(f"likely_{k}") for k in "ex"]).repartition(_parts(held), "rid")
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("pair"), c(f"likely_{name}").alias("likely"), c(name).alias("b")) for k, name in enumerate("ex")]), lambda p: p["likely"].isNotNull())
    sets = sent.select("rid", c("u").alias("a"), F.explode(pairs).alias("p")).select("rid", "p.pair", "p.likely", "a", "p.b")
    found = reconcile(sets, digests=False).groupBy("rid").agg(*[F.sum(F.when(c("pair") == k, c("differ"))).alias(f"differ_{name}") for k, name in enumerate("ex")])
    near = lambda name: likeness(c("n") + c(f"p{name}.n"), F.coalesce(F.size(c(f"p{name}.found")), c(f"differ_{name}")))
    prints = [written(build(c(k)), n).alias(name) for k, n, name in (("u", c("n"), "fingerprint"), ("e", c("pe.n"), "edited_fingerprint"))]
    slim = held.select("rid", "doc_id", "n_chars", "edited_sha256", *prints, "n", "pe", "px")
    return slim.join(found, "rid", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("e").alias("near_edited"), near("x").alias("near_next")
    )
