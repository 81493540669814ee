"""BPE encoding and decoding with a pair occurrence index over a partition's words."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a task holds, and bytes of its distinct words that one index is built over.
CHUNK_BYTES, INDEX_BYTES = 14 << 20, 2 << 20
#: Unicode white space, which separates words; str.split() also splits at U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The vocabulary's pre-tokenizer: contractions, letters, single digits, other signs. A fixed value of the format. Line feeds end words.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+|\n")
_BLANKS = regex.compile(rf"[{_SPACE}]+")
_ODD = regex.compile("[\x1c-\x1f]")


def _printable() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def _values(offsets: np.ndarray, data) -> pa.LargeBinaryArray:
    """Byte strings that end and begin at ``offsets`` in ``data``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _offsets(values: pa.Array) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]


def _bytes(values: pa.Array) -> np.ndarray:
    """The bytes of all values, one after the other."""
    ends = _offsets(values)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once; at least one is there."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


class Vocabulary:
    """A BPE vocabulary file of words with an end mark, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        ids, mark = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        letters = _printable()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + mark] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = self.left << 20 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.marked = pa.array(list(self.special), pa.large_string())
        self.marked_ids = _values(np.arange(len(self.special) + 1) * 4, np.array(list(self.special.values()), "<u4"))
        shown = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        self.shown = pa.array([*shown, *(" " + t for t in shown)], pa.large_string())
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode_words(self, raw: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words (not empty) whose bytes are ``raw`` and that end at ``stop``, one after the other, and how many each has.

        The index maps a rank to the positions of its pair. The lowest active rank is applied at all its positions
        (leftmost first where they overlap), and the pairs that this makes are entered at theirs.
        """
        first = np.r_[0, stop[:-1]]
        symbol = self.inner[raw]
        symbol[stop - 1] = self.last[raw[stop - 1]]
        n = len(raw)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[stop - 1] = -1
        before[first] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self.ranks(symbol[at] << 20 | symbol[after[at]])
            known = rank >= 0
            at = at[known]
            if not len(at):
                return
            both = _distinct(rank[known] << 40 | at)
            at, rank = both & (1 << 40) - 1, both >> 40
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else _distinct(np.concatenate(found))
            a, b, c = self.left[r], self.right[r], self.made[r]
            at = at[symbol[at] == a]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            symbol[at] = c
            symbol[gone] = -1
            then = after[gone]
            after[at] = then
            more = then >= 0
            before[then[more]] = at[more]
            left = before[at]
            enter(np.concatenate([left[left >= 0], at[more]]))
        left = symbol >= 0
        return symbol[left], np.add.reduceat(left.astype(np.int64), first)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def _parts(text: str, v: Vocabulary) -> list[str]:
    """Words between white space, special tokens apart (a special token is its own word, exactly as written)."""
    if v.splitter and any(t in text for t in v.special):
        out: list[str] = []
        for k, piece in enumerate(v.splitter.split(text)):
            out += [piece] if k % 2 else _parts(piece, v)
        return out
    return [w for w in _BLANKS.split(text) if w] if _ODD.search(text) else text.split()


def normalise(text: str) -> str:
    """NFC, then each character in lower case by itself (a sigma at the end stays a plain one)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _encode_pieces(pieces: pa.Array, v: Vocabulary) -> pa.Array:
    """Ids, as little-endian 32-bit integers, of each of the distinct ``pieces``."""
    raw, ends = _bytes(pieces), _offsets(pieces) - _offsets(pieces)[0]
    ids, counts, k = [], [], 0
    while k < len(pieces):
        upto = max(k + 1, int(np.searchsorted(ends, ends[k] + INDEX_BYTES, "right")) - 1)
        found, n = v.encode_words(raw[ends[k] : ends[upto]], ends[k + 1 : upto + 1] - ends[k])
        ids.append(found.astype("<u4"))
        counts.append(n)
        k = upto
    return _values(np.r_[0, np.cumsum(np.concatenate(counts))] * 4, np.concatenate(ids))


def _encode_words(words: pa.Array, v: Vocabulary) -> pa.Array:
    """Ids, as little-endian 32-bit integers, of each of the distinct ``words``, which hold no white space."""
    lines = pc.binary_join_element_wise(words, *pa.array(["", "\n"], pa.large_string()))
    found = pa.array(_PIECES.findall(normalise(str(_bytes(lines), "utf-8"))), pa.large_string()).dictionary_encode()
    place = found.indices.to_numpy()
    ends = np.flatnonzero(place == found.dictionary.index("\n").as_py())
    ids = _encode_pieces(found.dictionary, v).take(pa.array(np.delete(place, ends)))
    own = _values(_offsets(ids)[np.r_[0, ends - np.arange(len(ends))]], _bytes(ids))
    return pc.coalesce(v.marked_ids.take(pc.index_in(words, v.marked)), own)


def encode_array(texts: list[str | None], v: Vocabulary) -> pa.Array:
    """Ids, as little-endian 32-bit integers, of each text; null counts as empty. Each distinct word is encoded once."""
    words, counts = [pa.array([], pa.large_string())], [0]
    for k in range(0, len(texts), 100):
        split = [_parts(t or "", v) for t in texts[k : k + 100]]
        counts += map(len, split)
        words.append(pa.array([w for part in split for w in part], pa.large_string()))
    said, ends = pa.concat_arrays(words).dictionary_encode(), np.cumsum(counts)
    if not len(said):
        return _values(ends, b"")
    ids = _encode_words(said.dictionary, v).take(said.indices)
    return _values(_offsets(ids)[ends], _bytes(ids))


def decode_array(ids: pa.Array, v: Vocabulary) -> pa.Array:
    """The tokens of each row of ``ids``, with blanks between."""
    ends = (_offsets(ids) - _offsets(ids)[0]) // 4
    token = _bytes(ids).view("<u4").astype(np.int64) + len(v.shown) // 2
    token[ends[:-1][ends[1:] > ends[:-1]]] -= len(v.shown) // 2
    shown = v.shown.take(pa.array(token))
    return _values(_offsets(shown)[ends], _bytes(shown)).cast(pa.large_string())


def encode_texts(texts: Iterable[str | None], v: Vocabulary) -> list[tuple[bytes, str]]:
    """(ids as little-endian 32-bit integers, decoded text) of each text; null counts as empty."""
    ids = encode_array(list(texts), v)
    return list(zip(ids.to_pylist(), decode_array(ids, v).to_pylist(), strict=True))


def encode_documents(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of ``docs``: ids as little-endian 32-bit integers.

    Null and empty texts have no ids and decode to nothing. Rows that repeat a doc_id or a text are encoded each. Other
    columns are not read. A task holds CHUNK_BYTES of text, or one longer text, at a time, and builds its index over
    INDEX_BYTES of distinct words, or one longer word; a very long text is read whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)

        def flush(docs: list, texts: list) -> Iterator[pa.RecordBatch]:
            encoded = encode_array(texts, v)
            for k in range(0, len(docs), 500):
                ids = encoded.slice(k, 500)
                decoded, n = decode_array(ids, v), np.diff(_offsets(ids)) // 4
                yield pa.record_batch([pa.array(docs[k : k + 500], pa.int64()), pa.array(n, pa.int64()), ids.cast(pa.binary()), decoded.cast(pa.string())], schema=schema)

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

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
