"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one BPE encoding, so it has one last token. That token
is the only vocabulary entry ending there which is compatible with the last token of the prefix
before it; storing it for each prefix gives the encoding by walking back, lets bytes be appended
exactly and lets an edit be re-encoded near its place only (``PrefixTable``). For whole tables
the same recurrence runs over all distinct pieces of a block at once in numpy.

Defined cases: a null text is the empty text (no ids, empty bytes); very long texts are encoded
whole, in blocks of bounded size; repeated rows are encoded alike; input columns other than the
id and the text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.common import blocks, mapped

#: Pieces longer than this many bytes are encoded one by one.
LONG_PIECE = 256
#: Distinct pieces whose ids a task keeps.
CACHE_PIECES = 200_000
NONE = np.int64(1) << 40


def read_ranks(path: str) -> bytes:
    """Bytes of a rank file: a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return file.read()


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Parts of ``piece`` after all merges of a rank under ``below``, lowest rank first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Lookup:
    """Open-addressing table from int64 keys (0 or more) to values, read for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1), np.full(1 << bits, missing)
        keys, values, step = np.asarray(keys, np.int64), np.asarray(values, np.int64), 0
        while len(keys):
            slot = (self._slot(keys) + step) & self.mask
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, step = keys[left], values[left], step + 1
        self.steps = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], self.missing)
        more = np.flatnonzero((held != keys) & (held >= 0))
        step = 1
        while len(more):
            at = (slot[more] + step) & self.mask
            held = self.keys[at]
            hit = held == keys[more]
            out[more[hit]] = self.values[at[hit]]
            more, step = more[~hit & (held >= 0)], step + 1
        return out


class Vocabulary:
    """Ranks with, for each token, the two tokens that its last merge joins."""

    def __init__(self, raw: bytes, split: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.size = size
        if split is None:
            left, right = np.arange(size), np.arange(size)
            for token, rank in self.ranks.items():
                if len(token) > 1:
                    parts = merged(token, self.ranks, rank)
                    if len(parts) == 2:
                        left[rank], right[rank] = self.ranks[parts[0]], self.ranks[parts[1]]
                    else:  # no merges lead to it: only a piece that equals it gets it
                        left[rank] = right[rank] = -1
            split = left, right
        self.left, self.right = split
        made = np.flatnonzero((self.left != np.arange(size)) & (self.left >= 0))
        keys = self.left[made] * size + self.right[made]
        self.pair = Lookup(keys, made, NONE)
        edges: dict[int, int] = {}
        ends = [-1]
        for token, rank in self.ranks.items():
            if self.left[rank] < 0:
                continue
            node = 0
            for byte in token:
                key = node << 8 | byte
                if (nxt := edges.get(key)) is None:
                    edges[key] = nxt = len(ends)
                    ends.append(-1)
                node = nxt
            ends[node] = rank
        self.ends = np.array(ends)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.edge = Lookup(keys, np.fromiter(edges.values(), np.int64, len(edges)), -1)
        self.first = np.array([edges.get(byte, 0) for byte in range(256)])
        self.compatible = lru_cache(200_000)(self._compatible)
        self.longest = max(map(len, self.ranks))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives just these two tokens.

        The merges of both are undone, last first; none may have come after a merge across
        the border that would have had a lower rank.
        """
        return bool(self.compatible_all(np.array([a]), np.array([b]))[0])

    def compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_compatible`` for many pairs."""
        good = np.zeros(len(a), bool)
        live, a, b, limit = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), np.full(len(a), NONE)
        while len(live):
            go = self.pair.get(a * self.size + b) >= limit
            live, a, b = live[go], a[go], b[go]
            # undo the later merge: that of a if its rank is higher, else that of b; if that side is a single byte, the other's
            sa, sb = self.right[a], self.left[b]
            whole_a, whole_b = sa == a, sb == b
            on_a = np.where(a > b, ~whole_a, whole_b & ~whole_a)
            done = whole_a & whole_b
            good[live[done]] = True
            limit = np.where(on_a, a, b + 1)
            a, b = np.where(on_a, sa, a), np.where(on_a, b, sb)
            live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
        return good

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (as the bytes of int32) of pieces of at most LONG_PIECE bytes, all at once."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        starts = np.cumsum(lens) - lens
        begin = np.repeat(starts, lens)
        stop = begin + np.repeat(lens, lens)
        at = np.arange(len(data))
        node, length, found = self.first[data], 1, []
        origin = at
        while len(origin):
            rank = self.ends[node]
            hit = rank >= 0
            found.append((origin[hit], np.full(int(hit.sum()), length), rank[hit]))
            room = origin + length < stop[origin]
            origin, node = origin[room], node[room]
            node = self.edge.get(node << 8 | data[origin + length])
            ok = node >= 0
            origin, node, length = origin[ok], node[ok], length + 1
        start, size, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        end = start + size - 1
        depth = end - begin[end]
        order = np.argsort(depth, kind="stable")
        start, end, rank = start[order], end[order], rank[order]
        bounds = np.append(0, np.cumsum(np.bincount(depth)))
        last = np.full(len(data), -1)
        for i in range(len(bounds) - 1):
            s, e, r = (x[bounds[i] : bounds[i + 1]] for x in (start, end, rank))
            at_start = s == begin[s]
            last[e[at_start]] = r[at_start]
            s, e, r = s[~at_start], e[~at_start], r[~at_start]
            before = last[s - 1]
            usable = before >= 0
            s, e, r, before = s[usable], e[usable], r[usable], before[usable]
            good = self.compatible_all(before, r)
            # a token that starts the piece is only right if no later one fits: each prefix has one last token
            last[e[good]] = r[good]
        sizes = np.array([len(t) for t in self.tokens])
        which, place, steps = np.arange(len(pieces)), starts + lens - 1, []
        while len(which):
            token = last[place]
            steps.append((which, token))
            place = place - sizes[token]
            keep = place >= starts[which]
            which, place = which[keep], place[keep]
        which, token = (np.concatenate([x[i] for x in steps[::-1]]) for i in (0, 1))
        ids = token[np.argsort(which, kind="stable")].astype(np.int32).tobytes()
        ends = 4 * np.cumsum(np.bincount(which, minlength=len(pieces)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class PrefixTable:
    """The last token of every byte prefix of one piece.

    ``append`` continues the table; ``edit`` keeps it up to the edit and recomputes after it only
    until as many entries as the longest token has bytes are what they were.
    """

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.v, self.data, self.last, self.steps = vocabulary, bytearray(), [], 0
        self.append(piece)

    def _at(self, end: int) -> int:
        v, data, node = self.v, self.data, 0
        self.steps += 1
        for start in range(end - 1, max(-1, end - 1 - v.longest), -1):
            rank = v.ranks.get(bytes(data[start:end]))
            if rank is None or v.left[rank] < 0:
                continue
            if start == 0 or v.compatible(self.last[start - 1], rank):
                node = rank
                return node
        raise ValueError("a byte is not in the vocabulary")

    def append(self, more: bytes) -> None:
        for byte in more:
            self.data.append(byte)
            self.last.append(self._at(len(self.data)))

    def edit(self, start: int, stop: int, new: bytes) -> None:
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        del self.data[start:], self.last[start:]
        self.append(new)
        same = 0
        for i, byte in enumerate(tail):
            if same >= self.v.longest:
                self.data += tail[i:]
                self.last += old[i:]
                return
            self.data.append(byte)
            self.last.append(self._at(len(self.data)))
            same = same + 1 if self.last[-1] == old[i] else 0

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(int(self.last[end - 1]))
            end -= len(self.v.tokens[out[-1]])
        return out[::-1]


#: Code points under U+0250 by their Unicode category (letters, numbers, white space).
LOW_LETTERS, LOW_NUMBERS, LOW_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"


class Encoder:
    """Splits texts by a pattern and encodes each piece; keeps a bounded number of pieces' ids."""

    def __init__(self, raw: bytes, pattern: str, split: tuple[np.ndarray, np.ndarray] | None = None):
        import public_tokenizers
        import regex

        self.vocabulary, self.any = Vocabulary(raw, split), regex.compile(pattern)
        self.low = None
        if pattern == public_tokenizers.PATTERN:  # the same pattern with its classes spelt out, for texts of low code points only
            self.low = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LOW_LETTERS}]+| ?[{LOW_NUMBERS}]+| ?[^{LOW_SPACES}{LOW_LETTERS}{LOW_NUMBERS}]+|[{LOW_SPACES}]+(?![^{LOW_SPACES}])|[{LOW_SPACES}]+")
        self.high = re.compile("[^\x00-ɏ]")
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if self.low and (text.isascii() or not self.high.search(text)):
            return self.low.findall(text)
        return self.any.findall(text)

    def learn(self, pieces: set[str]) -> None:
        v, short, long = self.vocabulary, [], []
        for piece in pieces:
            data = piece.encode("utf-8", "surrogatepass")
            rank = v.ranks.get(data)
            if rank is not None:
                self.known[piece] = np.int32(rank).tobytes()
            else:
                (short if len(data) <= LONG_PIECE else long).append((piece, data))
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for (piece, _), ids in zip(part, v.encode_pieces([d for _, d in part]), strict=True):
                self.known[piece] = ids
        for piece, data in long:
            self.known[piece] = np.array(PrefixTable(v, data).ids(), np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and, for each text, where its ids end."""
        split = [self.pieces(text) for text in texts]
        here = set().union(*split)
        if len(self.known) > CACHE_PIECES:  # those of this block stay
            self.known = {piece: self.known[piece] for piece in here if piece in self.known}
        if new := here.difference(self.known):
            self.learn(new)
        get = self.known.__getitem__
        rows = [b"".join(map(get, pieces)) for pieces in split]
        return np.frombuffer(b"".join(rows), np.int32), np.cumsum([len(r) // 4 for r in rows])


_WORKER: dict[tuple, Encoder] = {}


def _encoder(raw: bytes, pattern: str, split: tuple[np.ndarray, np.ndarray]) -> Encoder:
    key = (hashlib.blake2b(raw).digest(), pattern)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(raw, pattern, split)
    return _WORKER[key]


@lru_cache(4)
def _prepared(path: str) -> tuple[bytes, tuple[np.ndarray, np.ndarray]]:
    """The rank file and its table of last merges; of a fixed size, so it can go with each task."""
    raw = read_ranks(path)
    v = Vocabulary(raw)
    return raw, (v.left.astype(np.int32), v.right.astype(np.int32))


def _table(split: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return split[0].astype(np.int64), split[1].astype(np.int64)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The id columns and ``ids`` array<int>, one row per input row; with ``decoded`` also the bytes that the ids decode to.

    Decoding in the same pass takes one Python worker per task where ``encode`` and ``decode`` one after the other take two.
    """
    raw, split = _prepared(path)
    names = [f"k{i}" for i in range(len(id_cols))]
    slim = df.select(*[F.col(c).alias(n) for c, n in zip(id_cols, names, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    more = [T.StructField("decoded", T.BinaryType(), False)] * decoded
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw, pattern, _table(split))
        try:
            for part in blocks(batches, "text", 1 << 20):
                ids, ends = encoder.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))
                back = [pa.array(joined(encoder.vocabulary.tokens, ids, np.append(0, ends)), pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, *back], names=[*names, "ids", *["decoded"] * decoded])
        finally:  # the worker lives on, for other operators too; it keeps the tables only
            encoder.known = {}
            encoder.vocabulary.compatible.cache_clear()

    return mapped(slim, run, schema).select(*[F.col(n).alias(c) for c, n in zip(id_cols, names, strict=True)], "ids", *["decoded"] * decoded)


def joined(tokens: list[bytes], ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each run of ids between two ends."""
    get, flat = tokens.__getitem__, ids.tolist()
    return [b"".join(map(get, flat[a:b])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of ``ids_col`` as ``out_col`` (a column of that name is replaced); null ids give null, an id out of range is an error."""
    raw, df = read_ranks(path), df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])
    names = [f.name for f in schema.fields]
    place = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Vocabulary.tokens_of(raw)
        for batch in batches:
            column = batch.column(place)
            null = column.is_null().to_numpy(zero_copy_only=False)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            out = [None if gone else data for gone, data in zip(null.tolist(), joined(tokens, values, ends), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=names)

    return mapped(df, run, schema)


_TOKENS: dict[bytes, list[bytes]] = {}


def _tokens_of(raw: bytes) -> list[bytes]:
    key = hashlib.blake2b(raw).digest()
    if key not in _TOKENS:
        ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        _TOKENS.clear()
        _TOKENS[key] = [ranks.get(i, b"") for i in range(max(ranks) + 1)]
    return _TOKENS[key]


Vocabulary.tokens_of = staticmethod(_tokens_of)
