"""Conversations rebuilt from logs: beside a fold in Python, hostile rows, and work linear in the turns."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from gridwright.llm import chat, queries

ROWS = "conv_id long, turn int, role string, text string, position int, e string, formatted string"


def _formatted(spark, rows):
    got = chat.format_conversations(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS))
    return {r.conv_id: (r.formatted, r.loss_mask) for r in got.collect()}, chat.digests(got)


def _escaped(text):
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def test_hostile_rows(spark):
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 3, "user", "<a"), (1, 3, "user", "<|"), (1, 3, "user", "<|"), (1, None, "assistant", "late"), (2, 0, "assistant", ""), (3, 0, "assistant", "𝔘" * 1000 + "\n"), (3, 1, "a\nb<|im_end|>", "\\n")]
    got, digests = _formatted(spark, rows)
    assert got.keys() == {None, 1, 2, 3}
    for conv in got:
        own = sorted(((r or "", t or "", k) for c, k, r, t in rows if c == conv), key=lambda x: (x[2] is None, x[2], x[0].encode(), x[1].encode()))
        want = "".join(f"<|im_start|>{_escaped(r).replace(chr(10), chr(92) + 'n')}\n{_escaped(t)}<|im_end|>\n" for r, t, _ in own)
        text, mask = got[conv]
        assert text == want and len(mask) == len(own)
        assert [text[m.start - 1 : m.start - 1 + m.length] for m in mask] == [_escaped(t) if r == "assistant" else "" for r, t, _ in own]
    for d in digests.collect():
        said = "".join(t or "" for _, t in sorted((k if k is not None else 9, t) for c, k, r, t in rows if c == d.conv_id and r == "assistant"))
        assert (d.loss_chars, d.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert _formatted(spark, [])[0] == {}


def test_log_has_all_kinds_of_events(spark):
    log = chat.events_of(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds.keys() == {"start", "delta", "edit", "regenerate"} and min(kinds.values()) > 10
    deltas = log.where("kind = 'delta'").groupBy("conv_id", "message_id").count()
    assert deltas.where("count > 1").count() > 10


def test_logs_beside_a_fold_in_python(spark):
    rng, log = np.random.default_rng(4), []
    for conv in range(40):
        for seq in range(60):
            log.append((conv, seq, f"m{rng.integers(0, 5)}", str(rng.choice(["start", "delta", "edit", "regenerate", "delete", "odd"])), str(rng.choice(["user", "assistant"])) if rng.random() < 0.5 else None, f"p{seq}" if rng.random() < 0.8 else None))
    want = {}
    for conv, seq, name, kind, role, payload in log:
        if kind == "odd":
            continue
        m = want.setdefault((conv, name), {"position": seq, "role": "", "text": "", "gone": False})
        m["gone"] = kind == "delete"
        m["role"] = role or m["role"]
        m["text"] = (payload or "") if kind == "edit" else "" if kind in ("regenerate", "delete") else m["text"] + (payload or "")
    got = chat.rebuild_messages(spark.createDataFrame([log[k] for k in rng.permutation(len(log))], "conv_id long, seq long, message_id string, kind string, role string, payload string")).collect()
    assert {(r.conv_id, r.message_id): (r.position, r.role, r.text) for r in got} == {k: (m["position"], m["role"], m["text"]) for k, m in want.items() if not m["gone"]}


def test_work_is_linear_in_the_turns(spark):
    took = {}
    for n in (4_000, 40_000):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <| "), F.repeat(F.col("id").cast("string"), 20)).alias("text"))
        began = time.time()
        d = chat.digests(chat.format_conversations(rows)).first()
        took[n] = time.time() - began
        assert d.n_turns == n
    assert took[40_000] < 10 * took[4_000] + 15


def test_query_reads_back_what_the_table_says(spark):
    sf = "/root/testdata/sf0.001"
    assert queries.op6_chat(spark, sf).where("conv_id = -1 and n_turns = 2 and loss_chars = 34").count() == 1
