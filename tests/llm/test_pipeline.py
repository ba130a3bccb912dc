"""The corpus pipeline against plain versions of its stages, and on hard cases."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from palimpsest.llm import secrets, simhash
from tests.conftest import SMALL
from tests.llm.test_operators import DDL, ODD, plain_quality, without_repeats


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "suffix_dedup", "secret_scans", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_rules":
            q = {i: plain_quality(t) for i, t in kept.items()}
            kept = {i: t for i, t in kept.items() if q[i][0] >= 20 and 100 * q[i][4] <= 30 * q[i][0]}
        elif name == "simhash_near_dedup":
            sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in kept.items()}
            share = lambda a, b: len(a & b) / max(1, len(a | b))
            ids, left = sorted(kept), {r.doc_id for r in got.collect()}
            gone = [i for i in ids if i not in left]
            assert all(max(share(sets[i], sets[j]) for j in ids if j != i) > 0.65 for i in gone)
            close = [(i, j) for i, j in combinations(ids, 2) if share(sets[i], sets[j]) >= 0.8]
            assert close and sum(i in left and j in left for i, j in close) <= 0.1 * len(close)
            kept = {i: kept[i] for i in left}
        elif name == "suffix_dedup":
            sizes = {i: len(t.encode()) - x[1] for (i, t), x in zip(sorted(kept.items()), without_repeats([t.encode() for _, t in sorted(kept.items())]), strict=True)}
            kept = {r.doc_id: r.text for r in got.collect()}
            assert all(sizes[i] - 3 <= len(t.encode()) <= sizes[i] for i, t in kept.items())
        elif name == "secret_scans":
            patterns = secrets._compiled(secrets.RULES)[0]
            kept = {i: secrets.redact(t, sorted((a, k, b) for k, (r, p) in enumerate(zip(secrets.RULES, patterns, strict=True)) for a, b in secrets.spans_of(r, p, t))) for i, t in kept.items()}
        if name != "best_fit_packing":
            assert got.columns == docs.columns
            assert {r.doc_id: r.text for r in got.collect()} == kept
            assert all(r.n_chars == len(r.text) for r in got.collect())
        else:
            assert {r.doc_id for r in got.collect()} == set(kept)
            assert max(Counter({s: n for s, n in got.groupBy("sequence_id").sum("length").collect()}).values()) <= 2048
        docs = got


def test_hard_cases(spark):
    from pyspark.sql import functions as F

    rows = [(50 + i, "plenty of words stand here so that the text is kept by all rules, number " + " ".join(f"w{j}{i}" for j in range(30)), "en", "s", 1) for i in range(3)]
    docs = spark.createDataFrame(ODD + rows, DDL).withColumn("fp", F.lit(1))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SMALL)
            assert out.count() >= 0 and (k == 4 or out.columns == docs.columns)
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert {r.doc_id for r in kept.collect()} == {50, 51, 52}


def exact_classes(texts):
    """{doc_id: least doc_id} of the components of all pairs whose five-word shingle sets are similar by 0.8 or more."""
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
            root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in texts}


def edited(rng, words, n):
    """words with n of them replaced."""
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"e{rng.integers(1 << 40)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [simhash.BLOCK_SHINGLES, 700])
def test_hot_postings_lose_no_pair(spark, block):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(100)]
    texts = {i: edited(rng, base, 1 + i % 4) for i in range(120)}
    # Pairs near each other and far from the rest, which they meet in postings.
    for k in range(20):
        odd = edited(rng, base, 6).split(" ")
        texts |= {1000 + 2 * k: " ".join(odd), 1001 + 2 * k: edited(rng, odd, 1)}
    want = exact_classes(texts)
    assert len(set(want.values())) > 10 and all(want[1001 + 2 * k] == want[1000 + 2 * k] for k in range(20))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(simhash.near_copies(docs, small_posting=4, block=block).collect()) == want
    assert dict(simhash.near_copies(docs, block=block).collect()) == want


def test_near_copies_like_brute_force(spark):
    """Pairs at similarities all around 0.8, decided as by comparing all pairs: none missed, none too many."""
    rng = np.random.default_rng(4)
    texts, shares = {}, []
    for k in range(250):
        words = [f"w{k}x{i}" for i in range(int(rng.integers(60, 200)))]
        texts |= {2 * k: " ".join(words), 2 * k + 1: edited(rng, words, max(1, round(len(words) * rng.uniform(0.012, 0.035))))}
        a, b = (set(simhash.shingle_hashes(texts[i], 5).tolist()) for i in (2 * k, 2 * k + 1))
        shares.append(len(a & b) / len(a | b))
    assert sum(0.8 <= x < 0.85 for x in shares) > 40 and sum(0.75 <= x < 0.8 for x in shares) > 40
    want = exact_classes(texts)
    assert dict(simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()) == want



def test_simhash_finds_candidates_of_the_stage(spark):
    """The stage's fingerprints go through the byte-position index: its candidates span all sets within 4 bits, no band of minima being asked."""
    rng = np.random.default_rng(5)
    texts = {}
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(400)]
        texts |= {3 * k: " ".join(words), 3 * k + 1: edited(rng, words, 1), 3 * k + 2: edited(rng, words, 2)}
    docs = spark.createDataFrame([*texts.items(), (1000, ""), (1001, " ")], "doc_id long, text string")
    rows = {r.node: r.fp for r in simhash.banded(docs, 5).collect() if r["size"]}
    got = {frozenset(p) for p in simhash.simhash_pairs(simhash.banded(docs, 5).select("node", "size", "fp").distinct()).collect()}
    want = [(a, b) for a, b in combinations(rows, 2) if bin((rows[a] ^ rows[b]) & (1 << 64) - 1).count("1") <= 4]
    root = {n: n for n in rows}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for pair in got:
        a, b = map(top, pair)
        root[a] = b
    assert len(want) > 40 and all(top(a) == top(b) for a, b in want)


def test_only_marked_texts_are_shuffled(spark):
    docs = spark.createDataFrame([(i, i % 7) for i in range(3000)], "doc_id long, text_key long")
    keys = docs.filter("doc_id % 100 = 0")
    marked = {r.doc_id for r in simhash._marked(docs, keys).filter("marked").collect()}
    assert {i for i in range(0, 3000, 100)} <= marked and len(marked) < 60


def test_rounds_and_passes_are_few(spark, monkeypatch):
    """Copies written in between: a round that changes nothing and a copy of each pass's counts filled the disk of small inputs with many partitions."""
    from palimpsest.llm import components, suffixes

    written = []
    for module in (components, suffixes):
        monkeypatch.setattr(module, "checkpointed", lambda df, f=module.checkpointed: written.append(1) or f(df))
    stars = spark.createDataFrame([(1, 2), (3, 1), (1, 2), (8, 9), (None, 4), (5, 5)], "src long, dst long")
    assert {(r.node, r.component) for r in components.connected_components(stars).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)} and len(written) == 1
    text = "".join(chr(97 + i % 26) + str(i) for i in range(90))
    rows = [(7, 1, 1, 1, 10, text[:202].encode()), (7, 1, 2, 2, 0, b"#" + text[:202].encode()), (8, 1, 3, 3, 0, text[:202].encode()), (8, 1, 4, 4, 0, text[:120].encode() + b"#" + text[121:202].encode())]
    written.clear()
    found = suffixes._passes(spark.createDataFrame(rows, "anchor long, weight int, doc_id long, text_key long, start long, context binary")).collect()
    assert {tuple(r) for r in found} == {(1, 1, 10, 3), (2, 2, 1, 3)} and len(written) <= 3
