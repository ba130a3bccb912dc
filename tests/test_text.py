"""Rules of redaction, chunking, parsing, stemming and ranking against plain versions."""

from __future__ import annotations

import math
import random
import re
import sqlite3
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions import text as tx
from palimpsest.functions.stem import stem
from palimpsest.operators import chunk, keyword, parse, redact


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_patterns_redact_their_fixture(spark):
    for (name, _, marker), fixture in zip(config.REDACTION_PATTERNS, config.REDACTION_FIXTURES, strict=True):
        assert one(spark, f"x {fixture} y", redact.redact) == f"x {marker} y", name
    for text in ("asking a question is fine", "github is a platform", "-----BEGIN PUBLIC KEY-----", "bearer of bad news", "the year 1234567890", ""):
        assert one(spark, text, redact.redact) == text
    assert one(spark, None, redact.redact) is None


def plain_entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def plain_redact(text):
    for run in re.findall(config.ENTROPY_RUN, text):
        at = text.find(run)
        if plain_entropy(run) >= 4.5 and at >= 0:
            near = text[max(0, at - 30) : at + len(run) + 30].lower()
            if any(w in near for w in config.ENTROPY_INDICATORS):
                text = text.replace(run, config.ENTROPY_MARKER)
    return text


def test_entropy_runs_like_plain_python(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = [" ".join(rng.choice(["key= ", "x", "secret=", "auth "]) + "".join(rng.choices(letters, k=rng.randint(15, 40))) for _ in range(3)) for _ in range(60)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(redact.redact_entropy(F.col("t"))).collect()]
    assert got == [plain_redact(t) for t in texts]
    assert [round(one(spark, s, tx.entropy), 5) for s in ("aaaa", "ab", "abc")] == [0.0, 1.0, 1.58496]


@given(st.lists(st.text(alphabet="ab ", min_size=0, max_size=40), max_size=20), st.integers(10, 60), st.integers(0, 20))
def test_chunks_cover_all_words(blocks, target, overlap):
    found = [t for t, _ in chunk.merge(blocks, target, overlap)]
    joined = " ".join(found)
    assert all(w in joined for b in blocks for w in b.split())
    assert not any(b.strip() for b in blocks) or found


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "Short text."), (2, ""), (3, None), (4, "\n\n".join(["word " * 60] * 30))], "document_id long, body string")
    rows = chunk.chunks(docs).collect()
    assert [(r.chunk_index, r.total_chunks) for r in rows if r.document_id == 1] == [(0, 1)]
    assert {r.document_id for r in rows} == {1, 4}
    four = [r for r in rows if r.document_id == 4]
    assert len(four) > 1 and {r.total_chunks for r in four} == {len(four)} and all(r.end_char > r.start_char >= 0 for r in four)


def test_mail_and_markdown():
    mail = "Subject: Hi\nFrom: a@x.org\nTo: b@x.org\nContent-Type: text/plain\n\nbody line\n"
    assert parse._mail(mail) == "Subject: Hi\nFrom: a@x.org\nTo: b@x.org\n\nbody line"
    assert parse._markdown("# One\ntext **b**\n```\ncode *x*\n```\n## Two") == "One\ntext b\n```\ncode *x*\n```\n\nTwo"


def test_stemmer_samples():
    pairs = {"running": "run", "runs": "run", "caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "filing": "file", "sky": "sky", "happy": "happi", "adjustable": "adjust", "computing": "comput", "agreed": "agre"}
    assert {w: stem(w) for w in pairs} == pairs


@pytest.mark.parametrize("query", ["quantum", "quantum computing", "run", "cafe", "quantum-computing", "qubits parallel nothing"])
def test_ranks_like_an_embedded_index(spark, query):
    texts = ["Quantum computing uses qubits for parallel processing", "computing is fun", "cats and dogs running", "the runner runs quantum", "café résumé naïve"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t, tokenize='porter unicode61')")
    db.executemany("insert into f values (?)", [(t,) for t in texts])
    match = " OR ".join(f'"{w}"' for w in query.split())
    want = {str(i): round(r, 6) for i, r in db.execute("select rowid, bm25(f) from f where f match ?", (match,))}
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts, 1)], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    assert {r.chunk_id: round(r["rank"], 6) for r in keyword.bm25(chunks, asked, stem=True).collect()} == want


def test_texts_are_worked_on_in_slices(spark):
    """Python functions see a few hundred rows of a batch at a time, or a megabyte, and give every row."""
    import pandas as pd
    import pyarrow as pa
    from palimpsest.functions.arrow import BYTES, ROWS, of_texts, slices
    from palimpsest.operators import vector

    batch = pa.RecordBatch.from_pydict({"t": [str(i) * (1 + 5000 * (i % 700 == 0)) for i in range(2000)] + ["x" * (2 * BYTES), None, ""]})
    parts = list(slices([batch]))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and max(p.num_rows for p in parts) <= ROWS
    assert all(p.nbytes <= BYTES or p.num_rows == 1 for p in parts)
    rows = spark.range(5000).coalesce(1).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) as content")
    got = rows.select("id", of_texts(lambda t: t + "!")("content").alias("t")).collect()
    assert [r.t for r in got] == [None if r.id % 7 == 0 else f"{r.id}!" for r in got] and len(got) == 5000
    sizes = vector.embedded(rows, "m", "1", lambda t: pd.Series([[float(len(t))]] * len(t))).select("embedding").collect()
    assert len(sizes) == 5000 and max(r.embedding[0] for r in sizes) <= ROWS
