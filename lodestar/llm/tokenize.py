"""Encoding with a public byte-level BPE vocabulary by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end its encoding: the one that is compatible with the encoding of the prefix before it.
The table of these last tokens is filled from left to right, the ids are read off from right to left. Because an entry depends only
on earlier bytes, appended bytes extend the table exactly, and after an edit only the entries up to the point where both tables agree again are computed.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts text into pieces before the merges of this vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_PIECES, MEMO_PAIRS = 400_000, 500_000
ROWS_A_BATCH = 500


class PrefixEncoder:
    """Byte-level BPE over ``ranks`` (bytes -> id, ids in the order of the merges)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._split = regex.compile(pattern).findall
        self._follows: dict[int, bool] = {}
        self._starts: dict[int, bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_rank_file(cls, content: bytes, pattern: str = PIECES) -> PrefixEncoder:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}, pattern)

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; only ever used on two tokens' bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _can_start(self, token: int) -> bool:
        known = self._starts.get(token)
        if known is None:
            known = self._starts[token] = len(self._merged(self.bytes_of[token])) == 1
        return known

    def _can_follow(self, left: int, token: int) -> bool:
        key = left << 32 | token
        known = self._follows.get(key)
        if known is None:
            a, b = self.bytes_of[left], self.bytes_of[token]
            if len(self._follows) >= MEMO_PAIRS:
                self._follows.clear()
            known = self._follows[key] = self._can_start(token) and self._merged(a + b) == [a, b]
        return known

    def _entry(self, data: bytes, table: list[int], end: int) -> int:
        for start in range(max(0, end - self.longest), end):
            token = self.ranks.get(data[start:end])
            if token is not None and (self._can_start(token) if start == 0 else self._can_follow(table[start - 1], token)):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def extend(self, data: bytes, table: list[int]) -> list[int]:
        """The table of ``data``, given that of a prefix of it (possibly empty); the given table is extended in place."""
        for end in range(len(table) + 1, len(data) + 1):
            table.append(self._entry(data, table, end))
        return table

    def edit(self, data: bytes, table: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Data and table after ``data[start:stop]`` became ``new``; stops computing where old and new tables have agreed for a longest token."""
        after = data[:start] + new + data[stop:]
        shift, fresh, agreed = len(new) - (stop - start), table[:start], 0
        for end in range(start + 1, len(after) + 1):
            fresh.append(self._entry(after, fresh, end))
            past = end > start + len(new)
            agreed = agreed + 1 if past and fresh[-1] == table[end - shift - 1] else 0
            if agreed >= self.longest:
                fresh.extend(table[end - shift :])
                break
        return after, fresh

    def read(self, table: list[int]) -> list[int]:
        """Ids from a table: the last token, then the last token of what is before it, and so on."""
        ids, at = [], len(table)
        while at:
            ids.append(table[at - 1])
            at -= len(self.bytes_of[table[at - 1]])
        return ids[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None and self._can_start(whole):
            return (whole,)
        return tuple(self.read(self.extend(data, [])))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and empty give []. Strings of special tokens are ordinary text."""
        if not text:
            return []
        memo, ids = self._memo, []
        for piece in self._split(text):
            got = memo.get(piece)
            if got is None:
                got = self.encode_piece(piece)
                if len(piece) <= 64:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = got
            ids += got
        return ids


_ENCODERS: dict[int, PrefixEncoder] = {}


def _encoder(content: bytes) -> PrefixEncoder:
    """One encoder per worker process, kept over tasks."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder.from_rank_file(content)
    return _ENCODERS[key]


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """(id, ids) of every document, or (id, n_tokens) with ``counts_only``; no shuffle, whole texts, one row out per row in.

    Null and empty texts give an empty list. The vocabulary is read on the driver and broadcast (its size is fixed by the file, under 1 MB). Other columns are not read.
    """
    with open(vocabulary, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = documents.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(content.value).encode
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_BATCH):
                batch = whole.slice(at, ROWS_A_BATCH)
                texts = batch.column(1).to_pylist()
                if counts_only:
                    out = pa.array([len(encode(t)) for t in texts], pa.int64())
                else:
                    out = pa.array([encode(t) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[id_column, "n_tokens" if counts_only else "ids"])

    schema = f"`{id_column}` {kind}, " + ("n_tokens bigint" if counts_only else "ids array<int>")
    return documents.select(id_column, "text").mapInArrow(run, schema)
