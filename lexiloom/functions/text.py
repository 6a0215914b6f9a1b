"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word class of Unicode letters, numbers and the underscore; Java's own \w differs.
WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[ \t\n\x0B\f\r]"
SOLID = r"[^ \t\n\x0B\f\r]"
PRETOKEN = rf"{SPACE}*{SOLID}+|{SPACE}+"
#: Unicode white space, with the four separators that a plain Unicode class leaves out.
ANY_SPACE = r"[\s\u0085   -     　\u001C-\u001F]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often a lambda inside ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingles_of(tokens: Column, n: int = 13) -> Column:
    """Distinct n-word shingles; none without words, the whole sequence with fewer than n."""

    def runs(ws: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))
        few = F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(ws, " ")))
        return F.when(F.size(ws) >= n, F.array_distinct(full)).otherwise(few)

    return once(tokens, runs)


def shingles(text: Column, n: int = 13) -> Column:
    return shingles_of(words(text), n)


def shingle_key(shingle: Column) -> Column:
    return F.md5(shingle.cast("binary"))


def exact_key(text: Column) -> Column:
    """Key of texts that are equal up to case, punctuation and spacing."""
    return F.md5(F.array_join(words(text), " ").cast("binary"))


def pretokens(text: Column) -> Column:
    """Words with their leading white space; trailing white space is a token of its own."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, ANY_SPACE), lambda w: w != ""))


def truncated(text: Column, limit: int | None) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends at a code point; None or 0 keeps all."""
    if not limit:
        return text
    data = F.encode(text, "UTF-8")
    lead = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("int")
    # a cut before byte limit+1 is clean unless that byte continues a code point
    end = F.lit(limit)
    for back in (3, 2, 1):
        first = F.lit(limit + 1 - back)
        width = F.when(lead(first) >= 0xF0, 4).when(lead(first) >= 0xE0, 3).when(lead(first) >= 0xC0, 2).otherwise(1)
        end = F.when(width > back, first - 1).otherwise(end)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(data, F.lit(1), end), "UTF-8"))


def truncated_bytes(data: Column, limit: int | None) -> Column:
    """The byte form: a plain prefix that may end inside a code point."""
    return F.substring(data, F.lit(1), F.lit(limit)) if limit else data


def normalized_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " "), ANY_SPACE, " "))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def cause_prompt(premise: Column, question: Column) -> Column:
    """A premise without its full stop, continued by its cause or effect."""
    bare = F.regexp_replace(F.regexp_replace(premise, f"{ANY_SPACE}$", ""), r"\.\z", "")
    return F.concat(bare, F.when(question == "cause", F.lit(" because")).otherwise(F.lit(" so")))


#: What an entailment question asks and the answers it allows, in the order of the labels.
ENTAILMENT_QUESTION, ENTAILMENT_CHOICES = " True, False, or Neither?\nAnswer:", (" True", " False", " Neither")


def entailment_prompt(premise: Column, hypothesis: Column) -> Column:
    """A premise and the question whether a hypothesis follows; the choices are ENTAILMENT_CHOICES."""
    return F.concat(premise, F.lit("\nQuestion: "), hypothesis, F.lit(ENTAILMENT_QUESTION))


def cause_choices(*choices: Column) -> Column:
    """Continuations of a cause prompt: a blank and the choice with a small first letter."""
    return F.array(*[F.concat(F.lit(" "), lower_first(c)) for c in choices])


def answer_prompt(context: Column, question: Column) -> Column:
    return F.concat(context, F.lit("\nQuestion: "), question, F.lit("\nAnswer:"))


def translation_prompt(source_lang: Column, target_lang: Column, source: Column) -> Column:
    return F.concat(source_lang, F.lit(": "), source, F.lit("\n"), target_lang, F.lit(":"))


def short_code(code: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(code, "_", 1)


def script_first(code: Column) -> Column:
    """What stands after the first underscore, with all further parts; null without one."""
    return F.when(F.instr(code, "_") > 0, F.regexp_extract(code, r"^[^_]*_(.*)$", 1))


def script_last(code: Column) -> Column:
    """What stands after the last underscore; null without one."""
    return F.when(F.instr(code, "_") > 0, F.substring_index(code, "_", -1))


#: Two-letter codes and their three-letter forms.
ALPHA3 = {"ar": "ara", "de": "deu", "en": "eng", "es": "spa", "fr": "fra", "hi": "hin", "it": "ita", "ja": "jpn", "ko": "kor", "ks": "kas", "nl": "nld", "pa": "pan", "pt": "por", "ru": "rus", "sw": "swa", "tr": "tur", "vi": "vie", "zh": "zho"}


def alpha3(code: Column) -> Column:
    """The three-letter language code of a code in any of the usual forms; unknown codes stay as they are."""
    base = F.lower(F.regexp_extract(code, r"^([A-Za-z]+)(?:[_-].*)?$", 1))
    table = F.create_map(*[F.lit(x) for pair in ALPHA3.items() for x in pair])
    return F.when(F.length(base) == 2, F.coalesce(F.try_element_at(table, base), code)).when(F.length(base) == 3, base).otherwise(code)


def display_name(code: Column, names: dict[str, str]) -> Column:
    """A language's name by its normalised code, without a clarifier in brackets; the raw code where there is none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.regexp_replace(F.try_element_at(table, alpha3(code)), r" \(individual language\)", ""), code)


def script_hint(code: Column, available: list[str]) -> Column:
    """The script of a code (or a bare script) if it is available, else Latn if that is, else the first."""
    default = "Latn" if "Latn" in available else min(available)
    script = F.coalesce(script_last(code), code)
    return F.when(script.isin(available), script).otherwise(default)


def verse_id(verses: Column) -> Column:
    """The id of a list of verses."""
    return F.array_join(verses, ";;")


#: Words that only qualify the name of a language.
QUALIFIERS = ("standard", "western", "eastern", "northern", "southern", "central", "coastal", "north", "south", "east", "west", "upper", "lower", "greater")


def _normal_form(text: Column, form: str) -> Column:
    """A Unicode normal form; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run(text)


def composed_words(text: Column) -> Column:
    """Lower-cased words of the composed form (NFC), so that both ways to write an accent are one word."""
    return words(_normal_form(text, "NFC"))


def plain_name(name: Column) -> Column:
    """A name without quotes, hyphens, accents and double blanks."""
    bare = F.replace(F.replace(F.translate(name, "ʼ’", "''"), F.lit("'"), F.lit("")), F.lit("-"), F.lit(" "))
    marks = F.regexp_replace(_normal_form(bare, "NFKD"), r"\p{M}+", "")
    return F.trim(F.regexp_replace(marks, ANY_SPACE, " "))


def name_candidates(name: Column) -> Column:
    """Names to look a language up by, the most specific first, each once.

    The name without brackets, its plain form, that without a qualifier in front, its last and its first word.
    """
    low = F.trim(F.regexp_replace(F.lower(name), r"\(.*?\)", ""))

    def listed(pair: Column) -> Column:
        parts = F.split(pair["plain"], " ")
        rest = F.array_join(F.slice(parts, 2, F.size(parts)), " ")
        none = F.array().cast("array<string>")
        qualified = F.when(parts[0].isin(list(QUALIFIERS)), F.array(rest)).otherwise(none)
        more = F.when(F.size(parts) > 1, F.concat(qualified, F.array(F.element_at(parts, -1), parts[0]))).otherwise(none)
        return F.array_distinct(F.concat(F.array(pair["low"], pair["plain"]), more))

    return once(F.struct(low.alias("low"), plain_name(low).alias("plain")), listed)


def file_stem(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("")))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def byte_to_unicode() -> list[str]:
    """For each byte the printable character that stands for it: itself where it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


def token_string(data: Column) -> Column:
    """The visible form of a token's bytes."""
    table = F.array(*[F.lit(c) for c in byte_to_unicode()])
    digits = F.hex(data)
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    shown = F.transform(places, lambda i: F.element_at(table, F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return F.when(F.octet_length(data) > 0, F.array_join(shown, "")).otherwise(F.lit(""))


def token_bytes(shown: Column) -> Column:
    """The bytes of a token's visible form, the inverse of ``token_string``; null if a character stands for no byte."""
    places = {c: f"{b:02X}" for b, c in enumerate(byte_to_unicode())}
    table = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
    digits = F.transform(characters(shown), lambda c: F.try_element_at(table, c))
    return F.when(F.exists(digits, lambda d: d.isNull()), F.lit(None)).otherwise(F.unhex(F.array_join(digits, "")))


def spans_from_boundaries(data: Column, ends: Column) -> Column:
    """Cuts bytes after every position whose mark is 1 and at the end."""
    n = F.size(ends)
    stops = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at(ends, i) == 1) | (i == n))
    starts = F.concat(F.array(F.lit(0)), F.slice(stops, 1, F.size(stops) - 1))
    return F.when(n == 0, F.array().cast("array<binary>")).otherwise(F.zip_with(starts, stops, lambda a, b: F.substring(data, a + 1, b - a)))
