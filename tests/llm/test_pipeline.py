"""The registered queries beside their SQL, and the pipeline beside its stages done by hand."""

import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import connect, rows  # noqa: E402

from gridwright.llm import pii, queries, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(connect(SF).sql(queries.ORACLE_SQL[name]).df())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    by_text: dict = {}
    for i in sorted(left, key=lambda i: (-len(left[i]), i)):
        by_text.setdefault(left[i].translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))), i)
    left = {i: left[i] for i in by_text.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in left.items()}
    root = {i: i for i in left}
    for _ in left:
        moved = False
        for i in left:
            for j in left:
                if i < j and root[i] != root[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    moved = True
        if not moved:
            break
    kept = {i for i in left if root[i] == i}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept
    kept_rows = docs.where(F.col("doc_id").isin(*kept))
    texts = {r.doc_id: r.text or "" for r in pii.replace_private(kept_rows, "corpus pipeline").collect()}
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc: dict = {}
    by_sequence: dict = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in by_doc.items():
        ids = np.array([*tokens.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        ends = [0]
        for _, start, length, crc, own in sorted(pieces):
            assert own == ids[start : start + length].tobytes()
            assert start == ends[-1] and zlib.crc32(ids[start : start + length].tobytes()) == crc
            ends.append(start + length)
        assert ends[-1] == len(ids)
    for parts in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [at for at, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_on_hostile_rows(spark):
    """Nulls in every column, empty and repeated rows, ties and more columns: stages keep their columns and lose no text of their own."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, exact_0 string, n_private long, length long"
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [(None,) * 8, (1, "mail a.b@mail.org now", "en", "s", 21, "x", 5, 7), (1, "other text of the same id", "en", "s", 25, "x", 5, 7), (1, "other text of the same id", "en", "s", 25, "x", 5, 7), (2, "", "en", "s", 0, "x", 5, 7), (3, long, None, None, None, "x", 5, 7), (4, long + " end", "en", "s", None, "x", 5, 7)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = sorted(str(r.text)[:30] for r in out.collect())
        want = {"toxicity": 7, "exact_dedup": 5, "near_dedup": 6, "pii": 7}[name]
        assert len(got) == want, (name, got)
        assert stage(spark, docs.where("false"), SF).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= len(rows) and packed.where("length is null").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
