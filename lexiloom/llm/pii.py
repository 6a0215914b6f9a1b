"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The spans of the four base patterns are seeds, whole: a phone number of three words is one instance.
Keys of 32 and more hexadecimal digits are seeds of a fifth kind, secret. Any other token with a
digit or at-sign is a candidate, without the marks around it; candidates with one blank between
them are one instance. An instance occurs in two patterns, the word before it and the word after
it, each with the instance's shape (the lengths of long digit runs, mixed letters and digits as one sign). A sign
without letters or digits isn't a word of its own: the word before it goes with it (``token =``).

A pattern scores as the mean score of the instances that fill it, without the one that asks and
with one share of the shape's own mean added (the coarser pattern, which a rare context falls back
on); an instance as the mean of its patterns, weighted by how often it fills them; seeds stay at 1
and all else starts at 0. The two are computed in turn, ``rounds`` times. Scores are shares, so
the same contexts give the same spans at any size of table. A candidate that reaches
``confident``, after a word that seeds of its shape have had before them too, becomes a span of
the kind that the seeds in its patterns mostly have. ``informed`` patterns are those that at least
two different seeds fill; a candidate in none of them adds nothing.

All of it is DataFrame operations: matches come from splitting a text at a pattern, positions
from running sums of the pieces' lengths in code points. Patterns are written so that no text
makes a match quadratic or recursive, and mean the same as the plain ones given beside them.

Defined cases: a null text is empty and has no spans; rows are keyed by id and text, so repeated
rows get the same spans and null ids are fine; empty tables give empty results; other columns are
ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import cut, stage, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Each with the plain form; possessive loops give the same matches without backtracking or recursion.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Seeds beyond the base kinds.
SECRET = r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
ALL_KINDS = (*KINDS, "secret")
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
GUARDS = {"email": "@", "ip": ".", "phone": "+"}
SPAN = "array<struct<start:int,stop:int,value:string,left:string,right:string>>"
EDGE = "^"


def _blanks(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places (code points, stop exclusive) and the words before and after each.

    The words before are the last three between this match and the one before it, or that match if there are none.
    """

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["ahead"]
        stop = start + F.length(x["value"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def listed(pair: Column) -> Column:
        """Inside a lambda matches and gaps are values; outside, every use of them would split the text again."""
        hits, gaps = pair["hits"], pair["gaps"]
        bare = F.transform(gaps, lambda g: F.trim(_blanks(g)))
        n = F.size(hits)
        left = F.zip_with(F.slice(bare, 1, n), F.concat(F.array(F.lit(EDGE)), F.slice(hits, 1, F.greatest(n - 1, F.lit(0)))), lambda g, v: F.when(g == "", v).otherwise(F.substring_index(g, " ", -3)))
        right = F.zip_with(F.slice(bare, 2, n), F.concat(F.slice(hits, 2, n), F.array(F.lit(EDGE))), lambda g, v: F.when(g == "", v).otherwise(F.substring_index(g, " ", 1)))
        cues = F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
        values = F.zip_with(hits, F.slice(gaps, 1, n), lambda v, g: F.struct(v.alias("value"), F.length(g).alias("ahead")))
        pieces = F.zip_with(values, cues, lambda v, c: F.struct(v["value"].alias("value"), v["ahead"].alias("ahead"), c["left"].alias("left"), c["right"].alias("right")))
        found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
        return F.when(n > 0, found).otherwise(F.array().cast(SPAN))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.element_at(F.transform(F.array(pair), listed), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (F.substring(bare, 1, 3).cast("int") <= 255))

        return F.forall(F.split(value, r"\."), small)
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def seed_spans(text: Column, kind: str) -> Column:
    if kind == "secret":
        return F.when(text.rlike("[0-9A-Fa-f]{32}"), located(text, SECRET)).otherwise(F.array().cast(SPAN))
    found = F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["value"]))
    present = text.contains(GUARDS[kind]) if kind in GUARDS else F.lit(True)
    return F.when(present & (text.rlike("[0-9]") if kind != "email" else F.lit(True)), found).otherwise(F.array().cast(SPAN))


def base_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, check, one array of spans per kind, tokens), one per document."""
    rows = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    tokens = F.when(F.col("text").rlike("[0-9@]"), located(F.col("text"), TOKEN)).otherwise(F.array().cast(SPAN))
    return rows.select("doc_id", F.xxhash64("text").alias("check"), *[seed_spans(F.col("text"), k).alias(k) for k in ALL_KINDS], tokens.alias("tokens"))


def shape(value: Column) -> Column:
    """Letters and digits mixed as x, letter runs as a, digit runs as 9 or, with their length, from four digits on as 8; marks inside stay."""
    mixed = F.regexp_replace(F.regexp_replace(value, r"^[^\p{L}0-9]++|(?<=[\p{L}0-9])[^\p{L}0-9]++$", ""),r"(?<![\p{L}0-9])(?=\p{L}*+[0-9])(?=[0-9]*+\p{L})[\p{L}0-9]{8,}+", "\u0001")
    plain = F.regexp_replace(F.regexp_replace(mixed, r"\p{L}+", "a"), "[0-9]{1,3}+(?![0-9])", "9")
    long = F.transform(F.regexp_extract_all(plain, F.lit("[0-9]{4,}+"), F.lit(0)), lambda run: F.length(run).cast("string"))
    return F.concat_ws("#", F.regexp_replace(F.regexp_replace(plain, "[0-9]{4,}+", "8"), "\u0001", "x"), F.array_join(long, "."))


def _cue(words: Column, last: bool) -> Column:
    """The nearest word, lower-cased; the two nearest if the nearer has neither letter nor digit. Opening marks are no words."""
    if not last:
        return F.lower(words)
    words = F.rtrim(F.regexp_replace(words, r"(?<![\x20\"'`(\[{<])[\x20\"'`(\[{<]++$", ""))
    near = F.substring_index(words, " ", -1)
    return F.lower(F.when(words == "", F.lit(EDGE)).when(near.rlike(r"[\p{L}0-9]"), near).otherwise(F.substring_index(words, " ", -2)))


def instances(base: DataFrame) -> DataFrame:
    """Rows (doc_id, check, start, stop, value, left, right, kind): seeds, and candidates with a null kind."""
    c = F.col
    overlaps = lambda t: F.exists(c("spans"), lambda s: (s["start"] < t["stop"]) & (s["stop"] > t["start"]))
    spans = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))) for k in ALL_KINDS])
    rows = base.withColumn("spans", spans).filter("size(spans) + size(tokens) > 0")
    tagged = lambda k: F.transform(k, lambda s: F.struct(*[s[f].alias(f) for f in ("start", "stop", "value", "left", "right")], F.lit(k).alias("kind")))
    seeds = rows.select("doc_id", "check", F.explode(F.concat(*[tagged(k) for k in ALL_KINDS])).alias("s")).select("doc_id", "check", "s.*")
    free = rows.select("doc_id", "check", F.explode(F.filter("tokens", lambda t: ~overlaps(t))).alias("t")).select("doc_id", "check", "t.*")
    # candidates that one blank parts are one instance
    order = Window.partitionBy("doc_id", "check").orderBy("start", "stop")
    runs = free.distinct().withColumn("new", F.when(F.lag("stop").over(order) + 1 == c("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    whole = runs.groupBy("doc_id", "check", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), " ").alias("value"),
        F.min_by("left", "start").alias("left"), F.max_by("right", "start").alias("right"),
    )
    # marks around a candidate aren't part of it
    ahead = F.length(F.regexp_extract("value", r"^[^\p{L}0-9+]*+", 0))
    bare = F.regexp_replace("value", r"^[^\p{L}0-9+]++|(?<=[\p{L}0-9])[^\p{L}0-9]++$", "")
    trimmed = whole.drop("run").withColumn("start", c("start") + ahead).withColumn("value", bare).withColumn("stop", c("start") + F.length("value"))
    return seeds.unionByName(trimmed.filter("value != ''").withColumn("kind", F.lit(None).cast("string")))


def discover(base: DataFrame, rounds: int = 3, confident: float = 0.9, informed: int = 2) -> DataFrame:
    """Rows (doc_id, check, kind, start, stop) that the bootstrapped patterns add to ``base``."""
    c = F.col
    rows = instances(base).withColumn("shape", shape(c("value")))
    rows = cut(rows.withColumns({"before": F.concat(F.lit("<"), _cue(c("left"), True)), "after": F.concat(F.lit(">"), _cue(c("right"), False))}).drop("left", "right"))
    # the graph: a row per pattern (cue and shape) and instance, with how often they meet
    met = rows.select("value", "shape", "kind", F.explode(F.array("before", "after")).alias("cue"))
    graph = met.groupBy("cue", "shape", "value").agg(F.count(F.lit(1)).alias("n"), F.max(c("kind").isNotNull().cast("int")).alias("seed"))
    graph = cut(graph.withColumn("score", c("seed").cast("double")))

    def asked(graph: DataFrame) -> DataFrame:
        """Adds what an instance's pattern says of it, the instance itself left out."""
        totals = lambda keys, s, n: graph.groupBy(*keys).agg(F.sum(c("score") * c("n")).alias(s), F.sum("n").alias(n), F.sum("seed").alias(f"{n}_seeds"))
        joined = graph.join(totals(["cue", "shape"], "ps", "pn"), ["cue", "shape"]).join(totals(["shape"], "qs", "qn").drop("qn_seeds"), "shape")
        own = c("score") * c("n")
        coarse = (c("qs") - own) / F.greatest(c("qn") - c("n"), F.lit(1))
        return joined.withColumn("says", (c("ps") - own + coarse) / (c("pn") - c("n") + 1))

    for _ in range(rounds):
        scores = asked(graph).groupBy("value").agg(F.greatest(F.max("seed").cast("double"), F.sum(c("says") * c("n")) / F.sum("n")).alias("score"))
        graph = cut(graph.drop("score").join(scores, "value").select("cue", "shape", "value", "n", "seed", "score"))
    counts = rows.filter("kind is not null").select("shape", "kind", F.explode(F.array("before", "after")).alias("cue"))
    kinds = counts.groupBy("cue", "shape", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("cue", "shape").agg(F.max(F.struct("n", "kind")).alias("k"))
    good = asked(graph).filter((c("seed") == 0) & (c("score") >= confident) & (c("pn_seeds") >= informed)).select("cue", "shape", "value")
    good = good.join(kinds.select("cue", "shape", c("k.kind").alias("as_kind"), c("k.n").alias("weight")), ["cue", "shape"])
    good = good.groupBy("value", "shape").agg(F.max(F.struct("weight", "as_kind")).alias("k")).select("value", "shape", c("k.as_kind").alias("as_kind"))
    new = rows.filter("kind is null").join(good, ["value", "shape"]).select("doc_id", "check", c("as_kind").alias("kind"), "start", "stop")
    secrets = rows.filter("kind = 'secret'").select("doc_id", "check", "kind", "start", "stop")
    return new.union(secrets).distinct()


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (doc_id, check, one array of base spans per kind, added), one per document.

    ``added`` are the spans (kind, start, stop) of secrets and of what the patterns discovered.
    """
    base = stage(base_table(documents, id_col, text_col), "pii")
    extra = discover(base, **options).groupBy(F.col("doc_id").alias("e_id"), F.col("check").alias("e_check")).agg(F.sort_array(F.collect_list(F.struct("kind", "start", "stop"))).alias("added"))
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias(k) for k in KINDS]
    slim = base.select("doc_id", "check", *bare)
    joined = slim.join(extra, slim["doc_id"].eqNullSafe(extra["e_id"]) & (slim["check"] == extra["e_check"]), "left").drop("e_id", "e_check")
    return joined.withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,stop:int>>")))


def _listed(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def _of(kind: str) -> Column:
    """All spans of a kind, by start."""
    added = F.transform(F.filter("added", lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return F.sort_array(F.concat(F.col(kind), added)) if kind in KINDS else F.sort_array(added)


def digests(found: DataFrame) -> DataFrame:
    base = F.array_join(F.concat(*[_listed(F.col(k), k) for k in KINDS]), ",")
    full = F.array_join(F.concat(*[_listed(_of(k), k) for k in ALL_KINDS]), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), full.alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with spans (start, stop, kind) replaced by [KIND]; overlapping spans become one, named after the first."""
    kind = "struct<start:int,stop:int,kind:string>"

    def join_up(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] > s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    flat = F.aggregate(F.sort_array(spans), F.array().cast(f"array<{kind}>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(join_up(acc, s)))
    starts = F.concat(F.array(F.lit(0)), F.transform(flat, lambda s: s["stop"]))
    parts = F.zip_with(starts, flat, lambda a, s: F.when(s.isNull(), F.substring(text, a + 1, F.length(text))).otherwise(F.concat(F.substring(text, a + 1, s["start"] - a), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(parts, ""))


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with every span masked, with all their columns; null texts stay null."""
    found = find(documents, id_col, text_col, **options)
    with_kind = lambda k: F.transform(_of(k), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(k).alias("kind")))
    spans = found.select(F.col("doc_id").alias("__id"), F.col("check").alias("__check"), F.concat(*[with_kind(k) for k in ALL_KINDS]).alias("__spans"))
    spans = spans.filter(F.size("__spans") > 0).dropDuplicates(["__id", "__check"])
    keyed = documents.withColumn("__hash", F.xxhash64(text_or_empty(F.col(text_col))))
    joined = keyed.join(spans, keyed[id_col].eqNullSafe(spans["__id"]) & (keyed["__hash"] == spans["__check"]), "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col("__spans")))
    return joined.select(*[text.alias(c) if c == text_col else keyed[c] for c in documents.columns])
