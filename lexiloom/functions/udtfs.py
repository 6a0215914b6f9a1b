"""Table functions for SQL users: shingles, pretokens and spans of a text as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Python's word class is the one of ``text.WORD``.
WORD = re.compile(r"\w+")
PRETOKEN = re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+")


@udtf(returnType="shingle string")
class Shingles:
    """The distinct n-word shingles of a text; the whole sequence if it is shorter, none without words."""

    def eval(self, text: str, n: int) -> Iterator[tuple[str]]:
        words = WORD.findall((text or "").lower())
        if words and len(words) < n:
            yield (" ".join(words),)
        seen = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
        for shingle in seen:
            yield (shingle,)


@udtf(returnType="pos int, pretoken string")
class Pretokens:
    """Words with their leading white space, by place."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(PRETOKEN.findall(text or ""))


@udtf(returnType="pos int, span binary")
class Spans:
    """Bytes cut after every position whose mark is 1 and at the end."""

    def eval(self, data: bytes, ends: list) -> Iterator[tuple[int, bytes]]:
        start = at = 0
        for i, mark in enumerate(ends or []):
            if mark == 1 or i == len(ends) - 1:
                yield at, bytes(data[start : i + 1])
                start, at = i + 1, at + 1


def register(spark: SparkSession) -> None:
    """Makes shingles(text, n), pretokens(text) and spans(data, ends) known to SQL."""
    for name, function in (("shingles", Shingles), ("pretokens", Pretokens), ("spans", Spans)):
        spark.udtf.register(name, function)
