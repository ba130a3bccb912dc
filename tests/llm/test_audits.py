"""Mixing, divergence and filter interactions against plain versions and their SQL, and on hard cases."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from palimpsest.llm import divergence, interactions, mixing, queries
from tests.conftest import SMALL
from tests.llm.test_operators import DDL, ODD
from tests.test_catalog import TABLES

AUDITS = ("op11_source_mix", "op12_source_divergence", "op13_filter_interactions")
#: Hard cases of the operators, and one text under one null doc_id more often than a run of repeated rows is long.
HARD = [*ODD, *((None, "hot words of one text", "en", "hot", 21) for _ in range(400)), (9, "x" * 500, "", "", 500), (10, "ÀÉ straße Straße", "fr", "b", 16), (11, None, "de", None, None)]
LABELS = [(3, 1, 0), (3, 0, 1), (5, 1, None), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def hard(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(HARD, DDL).withColumns({c: F.lit(7) for c in ("part", "mask", "size", "key", "n", "draw", "target", "row", "term", "p", "copies", "of")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def duck_hard():
    connection = duckdb.connect()
    for name, data, ddl in (("documents", HARD, "doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint"), ("labels", LABELS, "doc_id bigint, quality int, toxic int")):
        connection.execute(f"create table {name} ({ddl})")
        connection.executemany(f"insert into {name} values ({', '.join('?' * len(data[0]))})", data)
    return connection


def same(df, connection, sql: str) -> bool:
    """The rows of a DataFrame and of a query, whatever the order of rows and columns."""
    found = connection.execute(sql)
    names = [c[0] for c in found.description]
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.select(*names).collect()) == sorted(tuple(map(cell, r)) for r in found.fetchall()) and sorted(names) == sorted(df.columns)


def of(name, docs, labels):
    return {"op11_source_mix": mixing.mix_report, "op12_source_divergence": divergence.divergence_report}.get(name, lambda d: interactions.interaction_report(d, labels))(docs)


@pytest.mark.parametrize("name", AUDITS)
def test_same_rows_as_sql(spark, name):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert same(queries.queries()[name](spark, SMALL), connection, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", AUDITS)
def test_hard_cases_have_the_results_of_sql(hard, labels, duck_hard, name):
    assert same(of(name, hard, labels), duck_hard, queries.oracle_sql()[name])
    assert of(name, hard.limit(0), labels.limit(0)).count() == 0


# 11


def plain_targets(sizes: dict) -> dict:
    """Shares by weight, cut and shared again until no target is above three times its source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, fixed = {s: 1 + i % 3 for i, s in enumerate(order)}, {}
    while True:
        open_ = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: 3 * sizes[s] for s, t in now.items() if t > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return fixed | now
        fixed |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"é": 0, "z": 7, "A": 7}, {"s": 3}, {f"s{i}": i * i for i in range(40)}, {None: 0}])
def test_targets(spark, sizes):
    found = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert found.keys() == want.keys() and all(abs(found[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert abs(sum(found.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))


def mix_rows(spark, n=3000):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(i, "w " * int(rng.lognormal(4, 1)), "en", f"s{min(i % 7, 4)}", 0) for i in range(n)], DDL)


def test_words_come_near_their_targets(spark):
    found = mixing.mix_report(mix_rows(spark)).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size and r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        fraction = own[0].target / own[0].source_size % 1
        assert abs(sum(r.copies > int(own[0].target / own[0].source_size) for r in own) / len(own) - fraction) < 0.1
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix_report(mix_rows(spark).repartition(3)).collect()))


def test_bare_draws_have_the_fraction(spark):
    found = mixing.mix_report(mix_rows(spark), calibrated=False).collect()
    for s in {r.source for r in found}:
        own = [r for r in found if r.source == s]
        rate = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) / len(own) - rate) < 5 * 0.5 / len(own) ** 0.5


def test_mixed_gives_the_rows_of_the_report(spark, hard, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 50)
    report = Counter()
    for r in mixing.mix_report(hard).collect():
        report[r.doc_id, r.source] += r.copies
    got = mixing.mixed(hard)
    assert got.columns == hard.columns
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +report
    assert {(r.text, r.part) for r in got.collect() if r.source == "hot"} == {("hot words of one text", 7)}


# 12


def terms_in(text):
    data = np.frombuffer(text.encode(), np.uint8)
    names, _, term, n = divergence.counted(data, np.array([0, len(data)]))
    return dict(zip(names.take(pa.array(term)).to_pylist(), n.tolist(), strict=True))


def test_sketch_never_underestimates_and_filters(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text")
    df = Counter()
    for r in docs.collect():
        df.update((r.lang, t) for t in terms_in(r.text))
    for bits in (12, 20):
        sketch = divergence.sketch_of(docs, 10, bits)
        langs, terms = zip(*df, strict=True)
        h = divergence._hashes(list(langs), pa.array(terms, pa.large_string()), np.arange(len(df)), np.arange(len(df)))
        estimate = np.min([sketch[d, divergence.places(h, d, bits)] for d in range(divergence.DEPTH)], axis=0)
        assert (estimate >= np.minimum(list(df.values()), 10)).all()
    assert (estimate == np.minimum(list(df.values()), 10)).mean() > 0.99  # wide enough to tell the terms apart


def test_a_saturated_sketch_changes_no_result(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(map(tuple, divergence.divergence_report(docs).collect()))
    assert want == sorted(map(tuple, divergence.divergence_report(docs, width_bits=12, depth=1).collect()))


def test_terms_of_a_text():
    text = "Straße ÉTÉ don't x1y�2 日本　語 A_b \U0001f600! " * 3
    want = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
    assert terms_in(text) == want and terms_in("") == terms_in(" 1 ") == {}


def test_a_long_text_is_counted_piece_by_piece(monkeypatch):
    texts = ["alpha beta-" * 300 + "x" * 5000 + " beta", "", "gamma beta", "d " * 3000]
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [terms_in(t) for t in texts]
    for piece in (1000, 64):
        monkeypatch.setattr(divergence, "PIECE", piece)
        names, row, term, n = divergence.counted(data, at)
        got = [{} for _ in texts]
        for r, t, k in zip(row.tolist(), names.take(pa.array(term)).to_pylist(), n.tolist(), strict=True):
            assert t not in got[r]
            got[r][t] = k
        assert got == want


# 13


def plain_audit(docs, labels):
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    first = {}
    for r in docs:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    found = defaultdict(Counter)
    for r in docs:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": r.doc_id is not None and first[t] < r.doc_id}
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = found[r.source or "", "".join(order), step]
                c["removed"] += own[f] and not gone
                c["redundant"] += own[f] and gone
                c["unique_fails"] += own[f] and sum(own.values()) == 1
                c["good_lost"] += own[f] and not gone and r.doc_id in good - {None}
                c["toxic_lost"] += own[f] and not gone and r.doc_id in toxic - {None}
                gone = gone or own[f]
                c["kept"] += not gone
    return found


def test_interactions_against_a_plain_walk(spark, hard, labels):
    want = plain_audit(hard.collect(), LABELS)
    total = Counter()
    for (part, order, step), c in want.items():
        total[part, order[step - 1]] += c["removed"]
    got = interactions.interaction_report(hard, labels).collect()
    assert len(got) == len(want) == 600 * len({k[0] for k in want})
    for r in got:
        c = want[r.part, r.filter_order, r.step]
        assert {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")} == {k: c[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
        assert r.shapley == total[r.part, r.filter]


def test_metrics_of_other_filters(spark):
    """Any table of mask cells, here of three filters."""
    table = spark.createDataFrame([("p", 0b011, 5, 1, 0), ("p", 0b100, 2, 0, 2), ("p", 0, 3, 3, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): r for r in interactions.order_metrics(table, "xyz").collect()}
    assert len(got) == 18
    r = got["yxz", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) == (5, 0, 5, 0, 0, 15)
    r = got["yxz", 3]
    assert (r.kept, r.removed, r.unique_fails, r.toxic_lost, r.shapley) == (3, 2, 2, 2, 12)
