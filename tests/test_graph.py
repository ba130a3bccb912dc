"""Relations: pairs are counted by numbers of names."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
from palimpsest.operators import graph
from pyspark.sql import functions as F


def test_pairs_are_shuffled_as_numbers(spark):
    rng = np.random.default_rng(1)
    held = {i: sorted({f"Name{min(int(rng.zipf(1.5)), 60)}" for _ in range(8)}) for i in range(80)}
    rows = spark.createDataFrame([(i, n) for i, names in held.items() for n in names], "document_id long, name string")
    own = Counter(n for names in held.values() for n in names)
    both = Counter(p for names in held.values() for p in permutations(names, 2))
    want = {(a, b, n, round(n / own[a], 9)) for (a, b), n in both.items() if n >= 2 and n / own[a] >= 0.5}
    found = graph.cooccurrences(rows)
    assert want and {(r.subject, r.object, r.n_documents, round(r.confidence, 9)) for r in found.collect()} == want
    assert "keys=[number" in found._jdf.queryExecution().executedPlan().toString() and "keys=[subject" not in found._jdf.queryExecution().executedPlan().toString()


def test_changes_are_added_up_by_their_reader(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "B")], "document_id long, name string")
    assert sorted(map(tuple, graph.pair_deltas(rows, -1, summed=False).collect())) == [("A", "B", -1)] * 2


def test_more_hops_handle_queries_as_bits(spark):
    rng = np.random.default_rng(2)
    rows = sorted({(int(d), f"N{n}") for d, n in zip(rng.integers(0, 2500, 6000), rng.integers(0, 3000, 6000), strict=True)})
    links = spark.createDataFrame([*rows, (None, "N1"), (5, None)], "document_id long, name string").repartition(5)
    held, by_name = {}, {}
    for d, n in rows:
        held.setdefault(d, set()).add(n)
        by_name.setdefault(n, set()).add(d)
    by_name["N1"].add(None)  # reached, but leads nowhere
    seeds = [(d if d else None, n) for d, n in rows if d < 1500]  # more queries than a row holds bits
    names = spark.createDataFrame(seeds, "query_id long, name string")
    first = {(q, d) for q, n in seeds for d in by_name[n]}
    further = lambda pairs: pairs | {(q, e) for q, d in pairs for n in held.get(d, ()) for e in by_name[n]}
    assert len({q for q, _ in seeds}) > 1024
    two = graph.neighbours(names, links, 2)
    got = [tuple(r) for r in two.collect()]
    assert len(got) == len(set(got)) and set(got) == further(first)
    assert "bit_or" in two._jdf.queryExecution().executedPlan().toString()
    assert graph.neighbours(names, links, 1).count() == len(first)


def _rows_shuffled(spark) -> int:
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_hop_shuffles_pairs_of_query_and_document(spark):
    links = spark.createDataFrame([(d, n) for d in range(400) for n in ("Common", f"Own{d // 2}")], "document_id long, name string").repartition(4)
    seeds = links.withColumnRenamed("document_id", "query_id")
    before = _rows_shuffled(spark)
    assert graph.neighbours(seeds, links, 2).count() == 400 * 400
    assert _rows_shuffled(spark) - before < 20_000


def test_hops_with_no_queries_or_links_and_with_names_as_ids(spark):
    links = spark.createDataFrame([("a", "X"), ("b", "X"), ("b", "Y"), ("c", "Y"), ("c", "Z"), ("d", "Z")], "document_id string, name string")
    seeds = spark.createDataFrame([("q", "X"), ("r", "none")], "query_id string, name string")
    reached = lambda hops: sorted(map(tuple, graph.neighbours(seeds, links, hops).collect()))
    assert reached(2) == [("q", d) for d in "abc"] and reached(3) == [("q", d) for d in "abcd"]
    assert graph.neighbours(seeds.limit(0), links, 2).collect() == graph.neighbours(seeds, links.limit(0), 2).collect() == []


def test_changes_add_up_by_numbers_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = sorted({(int(d), f"N{min(int(n), 40)}") for d, n in zip(rng.integers(0, 90, 900), rng.zipf(1.4, 900), strict=True)})
    added = spark.createDataFrame([*rows, (None, "N1"), *((d, f"Own{d}") for d in range(90))], "document_id long, name string").withColumns({"captured_at": F.lit(None).cast("timestamp"), "entity_type": F.lit("CONCEPT")})
    changes = [(added.filter("document_id < 50"), 1), (added.filter("document_id >= 50 or document_id is null"), 1), (added.filter("document_id % 5 = 2"), -1)]
    left = added.filter("document_id % 5 <> 2 or document_id is null")
    told = lambda df: {(r.subject, r.object, r.n_documents, round(r.confidence, 9)) for r in df.collect()}
    want = told(graph.cooccurrences(left))
    monkeypatch.setattr(graph, "TASK_PAIRS", 300)  # several slices
    found = graph.relations_after(changes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert want and told(found) == want
    assert plan.count("Aggregate [_groupingexpression") > 1 and "Aggregate [low" not in plan
    assert graph.relations_after([(added.limit(0), 1)]).collect() == []
