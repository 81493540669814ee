"""Byte-level BPE by longest matches and backtracking over pairs of tokens that may stand side by side."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task holds, and distinct pieces whose ids a worker remembers.
CHUNK_BYTES, KNOWN_PIECES = 12 << 20, 1 << 18
_NEVER = 1 << 60


class Ranks:
    """The ranks of a byte-level vocabulary, with what backtracking needs of each token.

    ``split`` holds the two tokens whose merge makes a token, ``shorter`` the longest token that it begins with. Tokens
    that merging never makes from their own bytes are told only where they are a whole piece, and match nothing else. As in
    any vocabulary that merges were learnt for, a token's parts have lower ranks than itself; others are refused.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ids, self.bytes = ranks, {i: t for t, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing}")
        self.split: dict[int, tuple[int, int]] = {}
        for token, made in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k], _NEVER), ranks.get(token[k:], _NEVER)
                if max(left, right) < made and self._plain(left) and self._plain(right) and self._apart(left, right, made):
                    self.split[made] = (left, right)
                    break
        if odd := [t for t, i in ranks.items() if not self._plain(i) and self._merged(t) == [i]]:
            raise ValueError(f"tokens that are merged from parts of higher rank: {odd[:5]}")
        plain = {t: i for t, i in ranks.items() if self._plain(i)}
        self.sizes = {i: len(t) for t, i in plain.items()}
        self.shorter = {i: next((plain[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in plain), None) for t, i in plain.items()}
        self.trie = ahocorasick.Automaton()
        self.longest: dict[str, int] = {}  # of each path of the trie, the longest token that begins it
        for token, i in sorted(plain.items()):
            path = token.decode("latin-1")
            self.trie.add_word(path, i)
            for k in range(1, len(path) + 1):
                if path[:k] not in self.longest:
                    self.longest[path[:k]] = plain.get(token[:k]) if token[:k] in plain else self.longest[path[: k - 1]]
        self.trie.make_automaton()
        self.reach = max(map(len, plain))
        self._together: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}

    def _merged(self, data: bytes) -> list[int]:
        """Ids of a few bytes by merging step by step, the lowest rank first and of one rank the leftmost."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, k = min((self.ids.get(a + b, _NEVER), k) for k, (a, b) in enumerate(pairwise(parts)))
            if rank == _NEVER:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def _plain(self, token: int) -> bool:
        return token in self.split or len(self.bytes[token]) == 1

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that stand at an edge of ``token`` while it is built, the last first: each with the ranks that make and end it."""
        out, ends = [], _NEVER
        while token in self.split:
            out.append((token, token, ends))
            token, ends = self.split[token][side], token
        return [*out, (token, -1, ends)]

    def _apart(self, left: int, right: int, before: int = _NEVER) -> bool:
        """Whether merging the bytes of two tokens leads to these two, by merges of ranks under ``before``.

        It doesn't where two tokens at the border merge before either is merged into its own side. Of merges of one rank
        the leftmost comes first: that of the left side precedes one over the border, which precedes that of the right side.
        """
        for a, a_made, a_ends in self._edge(left, 1):
            for b, b_made, b_ends in self._edge(right, 0):
                over = self.ids.get(self.bytes[a] + self.bytes[b], _NEVER)
                if over < before and (at := max(over, a_made, b_made)) < a_ends and at <= b_ends:
                    return False
        return True

    def together(self, left: int, right: int) -> bool:
        """The memoised answer of ``_apart`` for two tokens of a text."""
        found = self._together[left, right] = self._apart(left, right)
        return found

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece, whose bytes are given as Latin-1.

        The longest token that suits the one before is taken; where none does, the one before gets shorter. A place that
        was left in this way is never tried again, so that the work is linear in the piece.
        """
        sizes, shorter, longest, known, trie, reach = self.sizes, self.shorter, self.longest, self._together, self.trie.longest_prefix, self.reach
        found: list[int] = []
        dead: set[int] = set()
        at, stop, last = 0, len(piece), -1
        ahead = piece[:reach]
        token = longest[ahead[: trie(ahead)]]
        while True:
            while token is not None:
                then = at + sizes[token]
                if then not in dead:
                    if last < 0:
                        break
                    beside = known.get((last, token))
                    if beside is None:
                        beside = self.together(last, token)
                    if beside:
                        break
                token = shorter[token]
            if token is None:
                dead.add(at)
                token = found.pop()
                at -= sizes[token]
                token = shorter[token]
                last = found[-1] if found else -1
                continue
            found.append(token)
            if then == stop:
                return found
            at, last = then, token
            ahead = piece[at : at + reach]
            token = longest[ahead[: trie(ahead)]]

    def encode_texts(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null counts as empty. Each distinct piece is encoded once."""
        every, plain = _patterns()
        if len(self._known) > KNOWN_PIECES:
            self._known = {}
        known, long, out = self._known, [], []
        for t in texts:
            pieces = (plain if plain and t and t.isascii() else every).findall(t or "")
            for p in pieces:
                if p not in known:
                    data = p.encode()
                    whole = self.ids.get(data)
                    ids = self.encode_piece(data.decode("latin-1")) if whole is None else [whole]
                    known[p] = pack(f"<{len(ids)}i", *ids)
                    if len(p) > 64:
                        long.append(p)
            out.append(b"".join(map(known.__getitem__, pieces)))
        for p in long:
            del known[p]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def _patterns() -> tuple[regex.Pattern, re.Pattern | None]:
    """The vocabularies' pattern, and the same for texts of ASCII alone, which the plain engine matches faster."""
    import public_tokenizers

    every = public_tokenizers.PATTERN
    letters, digits, blanks = "A-Za-z", "0-9", r"\t-\r "
    plain = every.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{digits}]")
    for name, some in ((r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{digits}]"), (r"\s", f"[{blanks}]"), (r"\S", f"[^{blanks}]")):
        plain = plain.replace(name, some)
    return regex.compile(every), re.compile(plain) if "\\p" not in plain else None


@lru_cache(maxsize=2)
def load_ranks(name: str) -> Ranks:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})


def encode_documents(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs``: ids as an array of integers, decoded as the bytes that they stand for.

    Null and empty texts have no ids and decode to nothing. Rows that repeat a doc_id or a text are encoded each; a null
    doc_id stays null; an empty table gives no rows. Other columns, whatever their names, are not read. Strings of special
    tokens are ordinary text. A task holds CHUNK_BYTES of text, or one longer text, which is read whole, at a time.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(name)

        def flush(docs: list, texts: list) -> Iterator[pa.RecordBatch]:
            ids = ranks.encode_texts(texts)
            for k in range(0, len(docs), 500):
                part = ids[k : k + 500]
                ends = np.cumsum([0, *[len(x) // 4 for x in part]], dtype=np.int32)
                values = np.frombuffer(b"".join(part), "<i4")
                decoded = [ranks.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.record_batch([pa.array(docs[k : k + 500], pa.int64()), lists, pa.array(decoded, pa.binary())], schema=schema)

        docs, texts, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                docs.append(doc)
                texts.append(text.as_py())
                held += text.as_buffer().size if text.is_valid else 0
                if held >= CHUNK_BYTES:
                    yield from flush(docs, texts)
                    docs, texts, held = [], [], 0
        yield from flush(docs, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode_ids(encoded: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``encoded`` (ids: array of integers) with ``decoded``, the bytes; null ids decode to null. An id that the vocabulary lacks raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(name)
        for b in batches:
            at = b.schema.get_field_index("ids")
            made = [None if x is None else ranks.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "decoded"])

    kept = [c for c in encoded.columns if c != "decoded"]
    return encoded.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, encoded.select(*[F.col(f"`{c}`") for c in kept]).withColumn("decoded", F.lit(None).cast("binary")).schema)
