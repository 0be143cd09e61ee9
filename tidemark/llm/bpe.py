"""Byte-level BPE encoding and decoding from a table of ranks.

The merges of a piece of text are reproduced without running them.  A sequence of tokens is the
BPE encoding of its bytes exactly when each pair of neighbours is *compatible*: the encoding of
the two tokens' bytes is those two tokens.  So a piece is read from the left, taking the longest
token at each place (an Aho-Corasick automaton gives it), a shorter one where that isn't
compatible with the token before, and stepping back where none is.  A place from which the rest
was found impossible is never tried again, so the work is linear in the piece's length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .shared import MEMORIES, map_rows

#: A single space between two non-blank characters: no match of the default pattern holds both
#: sides of it other than by beginning with that space, so texts can be cut in front of it.  With
#: another pattern texts are not cut.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Any blank but a space or a line feed; texts without one can be cut faster.
OTHER_BLANK = re.compile(r"[^\S \n]")
#: Stretches up to this length are remembered, at most so many of them; the memory starts afresh
#: when it is full.
KEEP_CHARS, KEEP = 48, 600_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class ByteBpe:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = KEEP):
        import ahocorasick
        import regex

        self.ranks, self.keep = ranks, keep
        self.known_pattern = pattern == default_vocabulary()[1]
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.by_text = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        for token, rank in self.by_text.items():
            self.automaton.add_word(token, rank)
        self.widest = max(map(len, ranks))
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.tokens}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.whole: dict[int, bool] = {}
        self.inner, self.first = _Memory(self, " "), _Memory(self, "")

    def merges(self, data: bytes, least: int = 1) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none merge
        or only ``least`` parts are left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            best, at = min([(ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))])
            if best == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the encoding of the token's bytes is that token."""
        if token not in self.whole:
            self.whole[token] = self.merges(self.tokens[token]) == [token]
        return self.whole[token]

    def half(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one."""
        if token not in self.halves:
            left, right = self.merges(self.tokens[token], least=2)
            self.halves[token] = (left, right)
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just the two.

        Backwards through the merges that made them: at each time the boundary has one part on
        either side, and these must not merge before the part that is merged away next (of
        equal merges the one further left is first).
        """
        if not (self.stands(left) and self.stands(right)):
            return False
        never = 1 << 62
        until_left = until_right = never
        tokens, ranks = self.tokens, self.ranks
        while True:
            x, y = tokens[left], tokens[right]
            rank = ranks.get(x + y, never)
            if rank < until_left and (rank < until_right or rank == until_right != never):
                return False
            if len(x) == 1 and len(y) == 1:
                return True
            if len(y) == 1 or len(x) > 1 and left > right:
                until_left, left = left, self.half(left)[1]
            else:
                until_right, right = right, self.half(right)[0]

    def next_shorter(self, token: int) -> int:
        """The longest token that begins this one; -1 if there is none."""
        if token not in self.shorter:
            data = self.tokens[token]
            self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return self.shorter[token]

    def longest(self, data: str) -> int:
        """The longest token that begins data (bytes as Latin-1)."""
        size = self.automaton.longest_prefix(data)
        while size and data[:size] not in self.by_text:
            size -= 1
        if not size:
            raise ValueError("the table of ranks lacks a single byte")
        return self.by_text[data[:size]]

    def encode_piece(self, data: bytes) -> list[int]:
        token = self.ranks.get(data, -1)
        if token >= 0 and self.stands(token):
            return [token]
        text, size, widest, tokens, pairs = data.decode("latin-1"), len(data), self.widest, self.tokens, self.pairs
        closed = set()
        out: list[int] = []
        at, token = 0, self.longest(text[:widest])
        while at < size:
            while token >= 0:
                end = at + len(tokens[token])
                if end not in closed:
                    if not out:
                        good = self.stands(token)
                    else:
                        key = out[-1] << 32 | token
                        good = pairs.get(key)
                        if good is None:
                            if len(pairs) >= 1_000_000:
                                pairs.clear()
                            good = pairs[key] = self.compatible(out[-1], token)
                    if good:
                        break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = self.longest(text[at : at + widest]) if at < size else -1
            elif out:
                closed.add(at)
                token = out.pop()
                at -= len(tokens[token])
            else:
                raise ValueError("no sequence of tokens spells these bytes")
        return out

    def pack(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not self.known_pattern:
            return b"".join([self.packed[i] for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())])
        parts = text.replace("\n", " \n").split(" ")
        if "" in parts or "\n" in parts or OTHER_BLANK.search(text):
            parts = BETWEEN.split(text)
        inner = self.inner
        return self.first[parts[0]] + b"".join([inner[x] for x in parts[1:]])

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.pack(text)).cast("I"))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I").tolist()))


class _Memory(dict):
    """Packed ids of a stretch of text that begins with ``lead``, or with its own line feed."""

    def __init__(self, bpe: ByteBpe, lead: str):
        super().__init__()
        self.bpe, self.lead = bpe, lead

    def __missing__(self, stretch: str) -> bytes:
        bpe, packed = self.bpe, self.bpe.packed
        whole = stretch if stretch[:1] == "\n" else self.lead + stretch
        ids = b"".join([packed[i] for piece in bpe.pattern.findall(whole) for i in bpe.encode_piece(piece.encode())])
        if len(stretch) <= KEEP_CHARS:
            if len(self) >= bpe.keep:
                self.clear()
            self[stretch] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, keep: int = KEEP) -> ByteBpe:
    """One encoder per worker process; path is a rank file that every executor has."""
    return ByteBpe(read_ranks(path), pattern, keep)


MEMORIES.append(encoder.cache_clear)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Encode every text: ``doc_id, ids`` (packed little-endian unsigned 32-bit integers).

    A null or empty text has no ids.  Each row is encoded by itself, so repeated rows give
    repeated results; a null doc_id stays null; other columns are not read.
    """
    path, pattern = vocabulary or default_vocabulary()

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        bpe = encoder(path, pattern)
        for doc_id, text in each:
            yield doc_id, bpe.pack(text) if text else b""

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The inverse: ``doc_id, bytes`` from ``doc_id, ids``; null ids count as none."""
    path, pattern = vocabulary or default_vocabulary()

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        bpe = encoder(path, pattern)
        for doc_id, ids in each:
            yield doc_id, bpe.decode(ids or b"")

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: tuple[str, str] | None = None, keep_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """Encode and decode each text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``
    and, with ``keep_ids``, ``ids``.  ``keep`` bounds the stretches that a worker remembers; results
    don't depend on it.  Edge cases as in :func:`encode`."""
    path, pattern = vocabulary or default_vocabulary()

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        bpe = encoder(path, pattern, keep)
        for doc_id, text in each:
            ids = bpe.pack(text) if text else b""
            row = doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()
            yield (*row, ids) if keep_ids else row

    return map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
