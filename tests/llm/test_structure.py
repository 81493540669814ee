"""Structure repair, the prefix trie and byte-level BPE against brute-force versions."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridwright.llm import byte_bpe, prefix_trie, queries, repair

SMALL = "/root/testdata/sf0.001"
CONVERSATION = "conv_id long, turn int, role string, text string"


# structure repair


def least_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Dynamic programming over all states, row by row, with up to two insertions between rows."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def insert(best: dict) -> dict:
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                for initial, then in follow[state].items():
                    if initial != "s":
                        best[then] = min(best.get(then, (10**9, "")), (cost + 3, audit + "I"))
        return best

    best = insert({0: (0, "")})
    for initial, fault in rows:
        now: dict = {}

        def way(state: int, cost: int, audit: str, now: dict = now) -> None:
            now[state] = min(now.get(state, (10**9, "")), (cost, audit))

        for state, (cost, audit) in best.items():
            way(state, cost + 4, audit + "D")
            if fault in (0, 3):
                for letter, then in follow[state].items():
                    if letter == initial:
                        way(then, cost + fault, audit + "K")
                    if letter != "s":
                        way(then, cost + 3 + fault, audit + "R")
        best = insert(now)
    return min(best[s] for s in (0, 3) if s in best)


def report_of(turns: list[tuple[int | None, str, str]]) -> tuple:
    """The report of one conversation, by the rules as they are told."""
    space = " \t\n\v\f\r"
    turns = sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, rows = set(), []
    for _, role, text in turns:
        bare = text.strip(space)
        rows.append((role[:1], 1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3))
        seen.add((role, text))
    cost, audit = least_edits(rows)
    left, state, lines = iter(turns), "", []
    for edit in audit:
        if edit != "I":
            _, role, text = next(left)
        else:
            text = ""
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == "u" else "user"
        state = role[0]
        lines.append(f"{role}:{text}")
    known = {t for t, _, _ in turns if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    counts = [sum(f == k for _, f in rows) for k in (1, 2, 3)]
    return (max(known) - min(known) + 1 - len(known) if known else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (kind == 3) + [(turn, "user" if kind == 4 else role, text)] * (kind != 0)
    return out


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_search_is_least():
    rnd = random.Random(5)
    for _ in range(1500):
        rows = [(rnd.choice("sssuuuuaaaat"), rnd.choice((0, 0, 0, 1, 2, 3))) for _ in range(rnd.randint(0, 11))]
        found = repair.search(rows, repair.START, frozenset((repair.START, repair.ASSISTANT)), True)
        assert next(iter(found.values())) == least_edits(rows), rows


def test_blocks_change_nothing(monkeypatch):
    rnd = random.Random(6)
    monkeypatch.setattr(repair, "BLOCK", 3)
    for _ in range(400):
        turns = [(k, rnd.choice(("system", "user", "user", "assistant", "assistant", "tool", "")), rnd.choice(("Yes.", "No!", "and", "", f"{k}.", f"{k}"))) for k in range(rnd.randint(0, 25))]
        lines: list[str] = []
        r = repair.Repair(lambda edit, role, text, lines=lines: lines.append(f"{role}:{text}"))
        for turn in turns:
            r.add(*turn)
        got = r.finish()
        assert (*got.values(), hashlib.sha256("\n".join(lines).encode()).hexdigest()) == report_of(turns), turns


def test_undecided_rows_stay_few():
    held = []
    r = repair.Repair(lambda *_: None)
    for k in range(20000):
        r.add(k, "user" if k % 2 == 0 else "assistant", f"Turn {k}" + ("." if k % 7 else ""))
        held.append(len(r.waiting))
    r.finish()
    assert max(held) <= 3 * repair.BLOCK


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {conv: report_of(turns) for conv, turns in damaged(rows).items()}
    got = {r.conv_id: tuple(r[c] for c in REPORT) for r in queries.op11_repair(spark, SMALL).collect()}
    assert got == want


def test_repair_of_hostile_rows(spark):
    long = "word " * 200_000
    rows = [
        (1, 0, "user", None), (1, None, None, "x"), (1, 5, "assistant", long), (1, 5, "assistant", long), (2, None, "user", "a."), (2, None, "user", "a."),
        (3, 1, "", ""), (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes?"), (4, 9, "system", "s."), (5, 3, "User", "big."), (5, 3, "User", "big."),
    ]
    table = spark.createDataFrame(rows, CONVERSATION).withColumns({"cost": F.lit("mine"), "audit": F.lit(1), "copy": F.lit(2), "kind": F.lit(0)})
    got = {r.conv_id: tuple(r[c] for c in REPORT) for r in repair.repair_report(repair.damage(table)).collect()}
    assert got == {conv: report_of(turns) for conv, turns in damaged(rows).items()}
    assert repair.repair_report(table.limit(0)).count() == 0
    plain = {r.conv_id: tuple(r[c] for c in REPORT) for r in repair.repair_report(table).collect()}
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, *(" " if x is None else x for x in (role, text))))
    assert plain == {conv: report_of(turns) for conv, turns in by.items()}
    gone = table.where("conv_id = 4").withColumn("there", F.lit(False))
    assert [tuple(r) for r in repair.repair_report(gone).collect()] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_are_the_reports(spark):
    rows = repair.damage(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    lines = {}
    for r in repair.repaired_turns(rows).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append((r.place, r.edit, f"{r.role}:{r.text}"))
    for r in repair.repair_report(rows).collect():
        mine = lines.get(r.conv_id, [])
        assert [x[0] for x in mine] == list(range(len(mine)))
        assert "".join(x[1] for x in mine) == r.audit.replace("D", "")
        assert hashlib.sha256("\n".join(x[2] for x in mine).encode()).hexdigest() == r.repaired_sha256


# prefix trie


def trie_of(rows: list[tuple]) -> set[tuple]:
    turns: dict = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    rebuilt = {}
    for conv, own in turns.items():
        h, base = zlib.crc32(str(conv).encode()) % 6, conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        rebuilt[conv] = tuple(turns.get(base, [])[:h] + own[h:])
    members: dict = {}
    for conv, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    children: dict = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        under = children.get(path, [])
        leaves[path] = sum(leaves[c] for c in under) if under else 1
        saved[path] = sum(saved[c] for c in under) + (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
    out = set()
    for path, some in members.items():
        ends = ",".join(map(str, sorted(c for c in some if len(rebuilt[c]) == len(path))))
        out.add((min(some), len(path), min(members[path[:-1]]) if path else None, len(some), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_op13(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[c] for c in NODE) for r in queries.op13_prefix_trie(spark, folder).collect()]
    want = trie_of(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_many_families(spark):
    rnd = random.Random(8)
    rows = []
    for conv in [*range(-230, 460), 5000, 700, 701]:
        for turn in range(rnd.randint(1, 7)):
            rows.append((conv, rnd.choice((turn, turn, None)), rnd.choice(("user", "assistant", None)), rnd.choice(("a", "ab", "é", None, "", "a\nb"))))
    rows += [(33, 1, "user", "x" * 300_000), (None, 1, "user", "nobody"), *[r for r in rows[:20]]]
    table = spark.createDataFrame(rows, CONVERSATION).withColumns({"node": F.lit(1), "base": F.lit("b"), "depth": F.lit(0.5), "take": F.lit(1)})
    got = [tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(table).collect()]
    want = trie_of(rows)
    assert len(got) == len(want) and set(got) == want
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0


def test_parents_by_key(spark):
    nodes = prefix_trie.prefix_trie(spark.read.parquet(f"{SMALL}/conversations.parquet")).collect()
    by_key = {(n.node_a, n.node_b): n for n in nodes}
    assert len(by_key) == len(nodes)
    for n in nodes:
        if n.depth:
            parent = by_key[n.over_a, n.over_b]
            assert (parent.depth, parent.conv_id) == (n.depth - 1, n.parent_conv_id)


# byte-level BPE


def library(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


MULTI = "byte_bpe_multi_50k.tiktoken"


def test_ids_are_the_librarys():
    own, other, rnd = byte_bpe.load_ranks(MULTI), library(MULTI), random.Random(11)
    signs = ["ab", "aab", "abc def", " \n\t\r\x1c\x85", "xyzäöüé", "的是我", "0123456789½", "!?.,-'", "aeiou nrst", "<|endoftext|>", "𝒳😀́", "'s'll"]
    tokens = list(own.ids)
    texts = ["".join(rnd.choice("".join(rnd.sample(signs, 2))) for _ in range(rnd.randint(0, 50))) for _ in range(4000)]
    texts += [b"".join(rnd.choices(tokens, k=rnd.randint(2, 7))).decode("utf-8", "ignore") for _ in range(4000)]
    texts += ["a" * 20_000, "ab" * 9_000, "=" * 5_000, "的" * 3_000, " " * 4_000 + "x", "", " 　"]
    for text, ids in zip(texts, own.encode_texts(texts), strict=True):
        got = [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)]
        assert got == other.encode_ordinary(text), text
        assert own.decode(got) == text.encode()


def test_small_vocabularies_merge_exactly():
    """Vocabularies of few letters, whose tokens overlap in all ways, against merging step by step."""
    rnd, held = random.Random(12), 0
    for _ in range(150):
        ranks = {bytes([b]): b for b in range(256)}
        parts = [b"a", b"b", b"c"]
        while len(ranks) < 256 + 9:
            token = rnd.choice(parts) + rnd.choice(parts)
            if token not in ranks:
                ranks[token] = len(ranks)
                parts.append(token)
        try:
            own = byte_bpe.Ranks(ranks)
        except ValueError:
            continue
        held += 1

        def merged(data: bytes, ranks: dict = ranks) -> list[int]:
            if data in ranks:
                return [ranks[data]]
            pieces = [data[k : k + 1] for k in range(len(data))]
            while True:
                best = min(((ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(itertools.pairwise(pieces))), default=(1 << 60, 0))
                if best[0] == 1 << 60:
                    return [ranks[p] for p in pieces]
                pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]

        for _ in range(150):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 24)))
            got = own.encode_texts([word])[0]
            assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == merged(word.encode()), (word, ranks)
    assert held > 30


def test_op12(spark):
    other = library(MULTI)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = other.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_byte_bpe_of_hostile_rows(spark):
    rows = [(1, None), (1, ""), (None, "null id"), (2, "<|endoftext|>"), (2, "<|endoftext|>"), (3, "y" * 700_000 + " " * 5_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("mine"), "decoded": F.lit(1)})
    got = [(r.doc_id, bytes(r.decoded).decode(), len(r.ids)) for r in byte_bpe.encode_documents(table).collect()]
    other = library(MULTI)
    assert sorted(map(str, got)) == sorted(str((d, t or "", len(other.encode_ordinary(t or "")))) for d, t in rows)
    again = byte_bpe.decode_ids(byte_bpe.encode_documents(table))
    assert again.columns == ["doc_id", "ids", "decoded"] and sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.encode_documents(table.limit(0)).count() == 0
