"""Token ids of a byte-level BPE vocabulary for every text.

Encoding by per-prefix dynamic programming: for every prefix of a pre-token
exactly one vocabulary token can be the last one of its encoding. An automaton
over the vocabulary gives, at every byte, the tokens that end there; a token is
the last one if the token stored for the prefix before it is compatible with it,
that is, if no merge across their border would have come before the merges that
made them. Following the stored tokens back gives the ids. This is linear in the
text, however long a pre-token is, and equals the ids of merging by rank.

Compatibility needs no encoding: while two neighbouring tokens are built from
bytes, only the right edge of the left one and the left edge of the right one
can meet. A merge of two such pieces of rank r happens before they are consumed
if r is below the rank of the piece's next merge on the left (which, further
left, also wins a tie), and not above it on the right.

Pre-tokens repeat, so each distinct one is encoded once in a worker, in a cache
of bounded size that is dropped when full.

Null and empty texts have no token: their ids are an empty list.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession

from .arrowkit import batch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of this vocabulary, which splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED = 1_000_000
CACHED_LENGTH = 64


class Encoder:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.byte_names = [bytes([b]).decode("latin-1") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: dict[int, bytes] = {}
        for token, i in self.ids.items():
            self.bytes_of[i] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for token, i in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._made_of(token, i)):
                self.parts[i] = pair
                self.merge[pair] = i
        self.compatible = lru_cache(1 << 20)(self._compatible)
        self.cache: dict[str, list[int]] = {}

    def _made_of(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: its encoding by all lower ranks."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ids.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces on one edge of a token while it is built, each with the rank that consumes it."""
        out, until = [], 1 << 60
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token = token, self.parts[token][side]

    def _compatible(self, left: int, right: int) -> bool:
        merge = self.merge
        rights = self._edge(right, 0)
        for a, a_until in self._edge(left, 1):
            for b, b_until in rights:
                rank = merge.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def encode_bytes(self, text: str) -> list[int]:
        """Ids of one pre-token, whose bytes come as latin-1 characters."""
        last: list[int] = [-1] * (len(text) + 1)
        ends: dict[int, list[tuple[int, int]]] = {}
        compatible, parts = self.compatible, self.parts
        for end, match in self.automaton.iter(text):
            ends.setdefault(end + 1, []).append(match)
        for end in range(1, len(text) + 1):
            for size, token in sorted(ends.get(end, ()), reverse=True):
                before = end - size
                if size > 1 and token not in parts:
                    continue
                if before == 0 or last[before] >= 0 and compatible(last[before], token):
                    last[end] = token
                    break
        out, end = [], len(text)
        while end > 0:
            token = last[end]
            out.append(token)
            end -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        cache = self.cache
        out = []
        for word in self.split(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.encode_bytes(word.encode("utf-8", "replace").decode("latin-1"))
                if len(word) <= CACHED_LENGTH:
                    if len(cache) >= CACHED:
                        cache.clear()
                    cache[word] = ids
            out.append(ids)
        return list(chain.from_iterable(out))


@lru_cache(2)
def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def _shipped(spark: SparkSession, path: str) -> str:
    """Give the executors the vocabulary file, which only the driver needs to have; its name there."""
    name = os.path.basename(path)
    if name not in map(os.path.basename, spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def _encode(path: str, pattern: str, schema: pa.Schema, only_count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(path), pattern)
        for rows in batches:
            for lo in range(0, rows.num_rows, 500):
                part = rows.slice(lo, 500)
                ids = map(own.encode, part.column(part.num_columns - 1).to_pylist())
                last = pa.array([len(x) for x in ids], pa.int64()) if only_count else pa.array(list(ids), pa.list_(pa.int32()))
                yield batch(schema, *part.columns[:-1], last)

    return run


def token_ids(df: DataFrame, key: Column, text: Column, *, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids``: one row for each row; special tokens' strings are ordinary text."""
    rows = df.select(key.cast("long").alias("doc_id"), text.alias("body"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return rows.mapInArrow(_encode(_shipped(df.sparkSession, path), pattern, schema, False), "doc_id long, ids array<int>")


def token_counts(df: DataFrame, key: Column, group: Column, text: Column, *, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, grp, tokens``: one row for each row; zero for null and empty texts."""
    rows = df.select(key.cast("long").alias("doc_id"), group.cast("string").alias("grp"), text.alias("body"))
    schema = pa.schema([("doc_id", pa.int64()), ("grp", pa.string()), ("tokens", pa.int64())])
    return rows.mapInArrow(_encode(_shipped(df.sparkSession, path), pattern, schema, True), "doc_id long, grp string, tokens long")
