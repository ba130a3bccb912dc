"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from palimpsest.llm import components, packing, quality, secrets, sentencepieces, sharding, simhash, suffixes, topk, toxicity, urls
from palimpsest.llm.common import GOLDEN, mix
from tests.conftest import SMALL

DDL = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet, " * 6000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "no id here, but words", "en", "a", 21),
    (4, "é ß 日本 \U0001f600 \x00 tab\tend\r\n", "fr", "b", 20), (5, LONG, "en", "b", len(LONG)), (6, " \n \t", "en", "b", 4), (7, "x" * 500, "en", None, 500), (8, "x" * 500, "en", None, 500),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every hard case, and further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, DDL).withColumns({"row_key": F.lit("k"), "text_key": F.lit("t"), "spans": F.lit(1), "salt": F.lit(2), "fp": F.lit(3), "rank": F.lit(4), "kind": F.lit("z"), "host": F.lit("h")})


HELPERS = ("row", "text_key", "host", "lost", "kept", "_doc_id", "_text_key", "_spans", "_copy", "_bad_id", "_bad_text", "_found_id", "_found_key", "node", "least", "first", "spans")


@pytest.mark.parametrize("keep", [quality.keep_good, simhash.drop_near_copies, suffixes.remove_repeats, secrets.redact_secrets])
def test_columns_named_as_helpers_are_kept(spark, keep):
    """Each column comes back as it went in, whatever it is called."""
    from pyspark.sql import functions as F

    words = " ".join(f"word{i} of a text" for i in range(30))
    table = spark.createDataFrame([(1, words, "s"), (5, words, "s"), (5, words.replace("word", "other"), "s"), (None, words, None)], "doc_id long, text string, source string").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS} | {"a b.c": F.lit(7)})
    rows = keep(table).collect()
    assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in HELPERS) and all(r["a b.c"] == 7 for r in rows)


def test_of_near_copies_the_first_stays(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (None, a), (None, "alone " + b[::-1]), (9, a), (9, a + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.drop_near_copies(docs).collect())) == Counter([(1, a), (5, b), (None, "alone " + b[::-1])])


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


# 1


def enumerated(vocab, text):
    """All segmentations of a short text with their probability."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    s, out = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE), {}

    def grow(at, parts, weight):
        if at == len(s):
            out[tuple(parts)] = weight
        for to in range(at + 1, min(len(s), at + 16) + 1):
            if s[at:to] in ids:
                grow(to, [*parts, ids[s[at:to]]], weight + vocab.log_weight[ids[s[at:to]]])

    grow(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: float(np.exp(v - total)) for k, v in out.items()}


def test_segmentations_follow_their_law():
    vocab = sentencepieces.vocabulary(PIECES, "rank", 1.0)
    want, n = enumerated(vocab, "the cat"), 4000
    found = sentencepieces.sample_documents(vocab, mix(np.arange(n, dtype=np.uint64) * GOLDEN), ["the cat"] * n, 3)
    first, second = (Counter(tuple(s[i][2].tolist()) for s, _ in found) for i in (0, 1))
    for k, p in want.items():
        assert abs(first[k] / n - p) < 0.03
        then = sum(a * p / (1 - a) for j, a in want.items() if j != k)
        assert abs(second[k] / n - then) < 0.03
    for samples, kappa in found[:200]:
        assert len({tuple(x[2].tolist()) for x in samples}) == 3 and all(abs(np.exp(x[1]) - want[tuple(x[2].tolist())]) < 1e-9 for x in samples)
        assert samples[0][0] >= samples[1][0] >= samples[2][0] >= kappa
    weighted = [sum(np.exp(x[1] - sentencepieces.log_inclusion(x[1], kappa)) for x in s) for s, kappa in found]
    assert abs(np.mean(weighted) - 1) < 0.05


def test_segmentations_do_not_depend_on_the_batch(docs):
    vocab = sentencepieces.vocabulary(PIECES, "rank", 1.0)
    texts = [t for _, t in pairs(docs)[:12]]
    keys = mix(np.arange(12, dtype=np.uint64))
    together = sentencepieces.sample_documents(vocab, keys, texts, 2)
    for i in (0, 5, 11):
        alone = sentencepieces.sample_documents(vocab, keys[i : i + 1], texts[i : i + 1], 2)[0]
        assert [x[2].tolist() for x in alone[0]] == [x[2].tolist() for x in together[i][0]]


def test_segmentations_round_trip(odd, none):
    rows = sentencepieces.sampled_segmentations(odd, PIECES).collect()
    assert all(r.round_trip for r in rows) and all(len(r.ids) == r.n_pieces for r in rows)
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 4, None: 2, 4: 2, 5: 2, 6: 2, 7: 2, 8: 2}
    assert sentencepieces.sampled_segmentations(none, PIECES).count() == 0


def test_encode_and_decode(spark):
    import sentencepiece
    from pyspark.sql import functions as F

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["the cat sat", "", None, "é ß 日本 \U0001f600", " two  spaces ", "line\nend", "x" * 5000]
    table = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("ids", sentencepieces.encode(F.col("text"), PIECES))
    for r in table.withColumn("back", sentencepieces.decode(F.col("ids"), PIECES)).collect():
        assert (r.ids, r.back) == ((None, None) if r.text is None else (sp.encode(r.text), sp.decode(sp.encode(r.text))))
    assert table.limit(0).withColumn("back", sentencepieces.decode(F.col("ids"), PIECES)).count() == 0


def test_rows_without_doc_id_have_a_seed_of_their_own(spark):
    rows = sentencepieces.sampled_segmentations(spark.createDataFrame([(0, "some words to cut in pieces"), (None, "some words to cut in pieces")], "doc_id long, text string"), PIECES).collect()
    assert len({r.perturbed for r in rows}) == 4


# 2


def without_repeats(texts, length=200):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [20_000, 2])
def test_repeats_like_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(rng.choice(list("abcde"), 5)) for _ in range(n))
    shared, other = word(60), word(45)
    texts = [word(80), word(20) + shared + word(30), shared + word(5), word(10) + shared[50:], "ab" * 400, "ü" * 150, other + word(3) + other, word(5) + shared[: 3 * 70] + word(9), word(100), word(7)]
    texts += [texts[0][:300] + str(k) + texts[0][301:] for k in range(6)] + [texts[8], None, ""]
    rows = suffixes.repeat_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), limit).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == without_repeats([(t or "").encode() for t in texts])


def test_passes_like_counting():
    """Windows of skewed bytes: the groups of the passes are those of the literal windows."""
    rng = np.random.default_rng(17)
    for length in (8, 24, 200):
        raw = np.concatenate((np.tile(rng.integers(0, 2, 300), 3), rng.integers(0, 2, 500), np.zeros(300))).astype(np.uint8)
        at = np.concatenate((np.arange(len(raw) - length), rng.integers(0, len(raw) - length, 50)))
        group, weight = rng.integers(0, 3, len(at)), rng.integers(1, 3, len(at))
        total = Counter()
        for a, g, w in zip(at.tolist(), group.tolist(), weight.tolist(), strict=True):
            total[g, raw[a : a + length].tobytes()] += w
        want = [i for i, (a, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)) if total[g, raw[a : a + length].tobytes()] > 1]
        assert sorted(suffixes.repeated_windows(np.concatenate((raw, np.zeros(8, np.uint8))), at, group, weight, length).tolist()) == want


def test_repeats_in_hard_cases(odd, none):
    rows = suffixes.repeat_report(odd).collect()
    want = Counter((i, *x) for (i, *_), x in zip(ODD, without_repeats([(r[1] or "").encode() for r in ODD]), strict=True))
    assert Counter(map(tuple, rows)) == want
    cut = suffixes.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}[7] == ("", 0)
    assert suffixes.repeat_report(none).count() == suffixes.remove_repeats(none).count() == 0


# 3


def test_shards(spark, docs, odd, none):
    for table in (docs, odd):
        rows, texts = sharding.shard_rows(table).collect(), pairs(table)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.shard_rows(none).count() == 0
    rows = sharding.shard_rows(docs).collect()
    sizes, of_text = Counter(), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r["size"]
        of_text[r.text_crc32].add(r.shard)
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * max(sizes.values()) and all(len(s) == 1 for s in of_text.values())


def spreads(rows, words):
    """Of bytes, tokens and rows: (largest - smallest shard) / mean."""
    totals = defaultdict(lambda: [0] * 8)
    for r in rows:
        for name, n in (("bytes", r["size"]), ("tokens", words[r.doc_id]), ("rows", 1)):
            totals[name][r.shard] += n
    return {k: (max(v) - min(v)) / (sum(v) / 8) for k, v in totals.items()}


def test_all_dimensions_are_balanced(spark):
    docs = spark.read.parquet(SMALL.replace("sf0.001", "sf0.01") + "/documents.parquet")
    words = {i: len(t.split()) for i, t in pairs(docs)}
    found = spreads(sharding.shard_rows(docs).collect(), words)
    assert found["bytes"] < 0.01 and found["tokens"] < 0.05 and found["rows"] < 0.1, found


@pytest.mark.parametrize("copies", [120, 400])
def test_hot_groups(spark, copies):
    """A group over a shard's rows is split; one under it stays whole."""
    table = spark.createDataFrame([(i, "same text " * 20) for i in range(copies)] + [(1000 + i, f"text {i} " * 20) for i in range(1200 - copies)], "doc_id long, text string")
    rows = sharding.shard_rows(table).collect()
    found = spreads(rows, {i: len(t.split()) for i, t in pairs(table)})
    assert found["bytes"] < 0.03 and max(found.values()) < 0.08, found  # a group of 120 stands in one shard of 150 rows
    assert (len({r.shard for r in rows if r.doc_id < copies}) == 1) == (copies == 120)


# 4


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, values, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if linked(values[i], values[j]):
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("dense", [simhash.DENSE_RUN, 3])
def test_near_duplicates_like_brute_force(spark, docs, odd, none, dense):
    extra = [(900 + k, "alpha beta gamma delta epsilon " * 30 + f"tail {k} " * (k % 3)) for k in range(40)]
    for table in (docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")), odd):
        texts = pairs(table)
        values = [plain_fingerprint(t) for _, t in texts]
        want = smallest_reachable([i for i, _ in texts], values, lambda a, b: (a ^ b).bit_count() <= 4)
        got = simhash.near_duplicates(table, dense_run=dense).collect()
        assert Counter(map(tuple, got)) == Counter((i, f"{v:016x}", c) for (i, _), v, c in zip(texts, values, want, strict=True))
    assert simhash.near_duplicates(none).count() == 0


def test_triples_meet_every_four_positions():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_dense_postings_lose_no_link(spark):
    rng = np.random.default_rng(2)
    values = np.unique((np.uint64(0xABCDEF0123456789) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64), axis=1)).view(np.int64))
    table = spark.createDataFrame([(int(v),) for v in values], "fp long")
    for dense in (10, 100_000):
        got = {r.node: r.component for r in components.connected_components(simhash.fingerprint_links(table, 4, dense)).collect()}
        want = smallest_reachable([int(v) for v in values], [int(v) for v in values], lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
        assert len(set(want)) == len({got.get(int(v), int(v)) for v in values})


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(61)}


# 5


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 40, "query_rows": 2}])
def test_top_k_like_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.standard_normal((150, 16)) / 4, np.round(rng.standard_normal((50, 16)))))
    x[160] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (550, []), (600, [1.0, None]), (650, [float("nan")] * 16), (700, [float("inf")] * 16), (750, [0.5] * 8), (None, [1.0] * 16), (10, x[10].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as cell", "3 as part")
    usable = [(i if i is not None else np.iinfo(np.int64).max, np.floor(256 * np.array([*v, *[0.0] * (16 - len(v))])).astype(int)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, v in usable:
        if q != np.iinfo(np.int64).max and q % 50 == 0:
            best = sorted((-int(u @ v), i) for i, u in usable if i != q)[:5]
            want += [(q, k, i if i != np.iinfo(np.int64).max else None, -s) for k, (s, i) in enumerate(best, 1)]
    assert Counter(map(tuple, topk.top_k(table, **blocks).collect())) == Counter(want)
    assert topk.top_k(table.limit(0)).count() == 0
    assert topk.top_k(table.filter("vec_id in (50, 51)")).count() == 1


def test_large_components(spark):
    """Products beyond 64 bits: exact order, scores at the nearest 64-bit number."""
    rows = [(50, [1e17, 1.0]), (1, [1e17, 0.5]), (2, [-1e17, 2.0]), (3, [3e16, 1.0]), (4, [1e-9, 1e300]), (5, [0.0, 0.0])]
    number = lambda v: [p * 256 // q for p, q in map(float.as_integer_ratio, v)]
    exact = sorted((-sum(a * b for a, b in zip(number(v), number(rows[0][1]), strict=True)), i) for i, v in rows[1:])
    got = [(r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    clipped = [(i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, i in exact]
    assert sorted(got) == sorted(clipped) and [s for _, s in got] == [s for _, s in sorted(((i, s) for i, s in clipped), key=lambda x: (-x[1], x[0]))]


def test_carry_save_adds():
    rng = np.random.default_rng(6)
    planes = {w: [rng.integers(0, 1 << 63, 3).astype(np.uint64) for _ in range(n)] for w, n in ((0, 5), (1, 8), (4, 2))}
    digits = topk.carry_save({w: list(p) for w, p in planes.items()})
    bit = lambda p, i: 0 if p is None else int(p[i // 64] >> np.uint64(i % 64) & np.uint64(1))
    for i in range(192):
        assert sum(bit(d, i) << k for k, d in enumerate(digits)) == sum(bit(p, i) << w for w, own in planes.items() for p in own)


# 6


def test_packing(docs, odd, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table in (docs, odd):
        rows = packing.best_fit_packing(table, RANKS).collect()
        want = Counter()
        for i, t in pairs(table):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
            cut = len(ids) % 2048 or 2048
            bounds = [0, *range(cut, len(ids) + 1, 2048)]
            want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)))
        assert Counter(tuple(r)[:5] for r in rows) == want
        at = defaultdict(list)
        for r in rows:
            at[r.sequence_id].append((r.offset, r.length))
        for own in at.values():
            own.sort()
            assert [o for o, _ in own] == np.concatenate(([0], np.cumsum([n for _, n in own])[:-1])).tolist() and sum(n for _, n in own) <= 2048
        least = -(-sum(r.length for r in rows) // 2048)
        assert len(at) <= 1.02 * least + 2
    assert packing.best_fit_packing(none, RANKS).count() == 0


def test_encoder_like_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder(RANKS)
    for t in ["a  b\n c", "  x ", "<|endoftext|> hi<|endoftext|>", "", " ", "\n\n x", "don't  stop ", "x  y", "a\x1c b", "é \t\t日本 1234 !?"]:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_patterns_use_each_length_once():
    rng = np.random.default_rng(8)
    for top in (30, 300, 2000):
        histogram = Counter(rng.integers(1, top, 3000).tolist())
        patterns = packing.pack_lengths(dict(histogram))
        used = Counter()
        for parts, m in patterns:
            assert sum(parts) <= 2048 and m > 0
            for p in parts:
                used[p] += m
        assert used == histogram
        assert sum(m for _, m in patterns) <= 1.02 * sum(k * n for k, n in histogram.items()) / 2048 + 1


def fewest(lengths, capacity):
    """The optimum by search over sorted lengths."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def put(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for g in sorted(set(gaps)):
            if g >= lengths[i]:
                k = gaps.index(g)
                put(i + 1, [*gaps[:k], g - lengths[i], *gaps[k + 1 :]])
        put(i + 1, [*gaps, capacity - lengths[i]])

    put(0, [])
    return best


def test_packing_near_the_optimum():
    rng = np.random.default_rng(15)
    over = 0
    for _ in range(120):
        capacity = int(rng.integers(12, 40))
        lengths = []
        for _ in range(int(rng.integers(1, 4))):  # sequences that two, three or four lengths fill exactly, and some more
            cuts = np.sort(rng.choice(np.arange(1, capacity), int(rng.integers(1, 4)), replace=False))
            lengths += np.diff([0, *cuts, capacity]).tolist()
        lengths += rng.integers(1, capacity, rng.integers(0, 3)).tolist()
        patterns = packing.pack_lengths(dict(Counter(lengths)), capacity)
        counts = np.bincount(lengths, minlength=capacity + 1)
        got, plain = (sum(m for _, m in p) for p in (patterns, packing._best_fit(counts, capacity)))
        best = fewest(lengths, capacity)
        assert best <= got <= min(plain, best + 1)
        over += got > best
    assert over <= 6


def test_combinations_are_in_the_plan_and_cost_nothing(docs):
    rng = np.random.default_rng(16)
    histogram = Counter(np.minimum(rng.lognormal(5.5, 1.2, 4000).astype(int) + 1, 2047).tolist())
    patterns = packing.pack_lengths(dict(histogram))
    counts = np.bincount(list(histogram.elements()), minlength=2049)
    assert sum(m for _, m in patterns) <= sum(m for _, m in packing._best_fit(counts, 2048))
    assert {len(p) for p, _ in patterns if sum(p) == 2048} >= {2, 3}


# 7


def plain_secrets(text):
    rules = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]
    return sorted((m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(rules) for m in p.finditer(text) if len(m[g]) >= n)


SECRETS = ["PassWord = 'abcdefghijkl' and token:short", "x AKIAABCDEFGHIJKLMN0 y AKIAX", "token=secret:abcdefghijklmnop", "é API_KEY=\"0123456789abcdef0\" ſecret=abcdefghijklmno", "deadbeefdeadbeef" * 3, "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----\nMIIE\n-----END RSA PRIVATE KEY-----", "AKI A tok en"]


def test_secrets_like_plain_rules(spark, docs, odd, none):
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(SECRETS, 5000)), "doc_id long, text string"))
    want = Counter()
    for i, t in pairs(table):
        s = plain_secrets(t)
        want[(i, *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in s).encode()).hexdigest())] += 1
    rows = secrets.secret_report(table).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert {r.doc_id: r.spans.split(":")[0] for r in rows}[5005] == "forge" and "pem:0" in {r.doc_id: r.spans for r in rows}[5006]
    assert secrets.secret_report(none).count() == 0


PATTERNS = [r"abc+d?e{2,3}[xyz]w", r"(?:foo|ba[rz]+q|quux)\d", r"(?i:KeY)_?(?:one|two){1,2}", r"x(?=yz)yzab", r"[^a]bc", r"a|bcd", r"^head\btail$", r"(ab)\1cde", r"é+fgh", r"k{0}lmnop", r"(?:aa|bb){3}", r"z*?yes(?:no)?"]


def test_derived_queries_lose_no_match():
    """For rules and odd patterns: a text with a match, found by a full scan, answers the derived query."""
    rng = np.random.default_rng(14)
    rules = [*secrets.RULES, *(secrets.Rule(f"p{i}", p, any_case=i % 3 == 0) for i, p in enumerate(PATTERNS))]
    bits = ["abc", "d", "eee", "xw", "foo", "baz", "q", "quux", "7", "KEY", "key", "_", "one", "two", "x", "yzab", "bc", "headtail", "ab", "cde", "é", "fgh", "lmnop", "aa", "bb", "yes", "no", "z", "Pass", "word", "passwd:", "api", "Key='", "AKIA", "ghp_", "xoxb-", "AIza", "sk-", "k_live_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", " ", "A1b2C3d4" * 6]
    patterns, queries, _, _ = secrets._compiled(tuple(rules))
    found = Counter()
    texts = ["abcdeexw", "ababcde", "éééfgh", "eyJ" + "a1" * 5 + ".eyJ" + "b2" * 5 + "." + "c3" * 5, "sk_live_" + "a1" * 8, "aabbaa", *("".join(rng.choice(bits, rng.integers(1, 9))) for _ in range(6000))]
    for text in texts:
        held = secrets.trigrams(text)
        answers = lambda q: q is None or (q <= held if isinstance(q, frozenset) else (all if q[0] == "all" else any)(map(answers, q[1])))  # noqa: E731, B023
        for rule, pattern, query in zip(rules, patterns, queries, strict=True):
            if pattern.search(text):
                found[rule.kind] += 1
                assert answers(query), (rule, text)
    assert set(found) == {r.kind for r in rules} - {"p6"}  # which has a word border inside a word
    free = {r.kind for r, q in zip(rules, queries, strict=True) if q is None}
    assert free == {"hex", "p1", "p4", "p5"}  # no three bytes that each match holds


def test_redacted_texts_hold_no_secret(spark, odd):
    table = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(SECRETS)], "doc_id long, text string, n_chars long")
    for r in secrets.redact_secrets(table).collect():
        assert not [x for x in plain_secrets(r.text) if x[3] == "access"] and r.n_chars == len(r.text) and "deadbeefdeadbeef" not in r.text
    out = secrets.redact_secrets(odd)
    assert out.columns == odd.columns and Counter(r.text for r in out.collect()) == Counter(r[1] for r in ODD)


# 8


def test_segments_like_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(300):
        s = rng.integers(-3, 4, rng.integers(0, 14)).astype(float)
        total = np.concatenate(([0.0], np.cumsum(s)))
        # maximal: every proper prefix and suffix scores positive, and no such segment holds it
        good = [(i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if all(total[k] > total[i] for k in range(i + 1, j + 1)) and all(total[j] > total[k] for k in range(i, j))]
        want = sorted((i, j, total[j] - total[i]) for i, j in good if not any((a, b) != (i, j) and a <= i and j <= b for a, b in good))
        assert toxicity.maximal_segments(s) == want


def test_toxic_passages_are_found(spark, odd, none):
    rng = np.random.default_rng(10)
    plain = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, 60))
        bad = i % 5 == 0
        if bad:
            words[20:20] = list(rng.choice(["vile", "rotten", "nasty"], 4))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(table, marks).toPandas()
    held = got[got.held_out]
    assert ((held.doc_id % 5 == 0) == (held.predicted == 1)).mean() > 0.97 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    assert got.evidence[got.n_passages == 0].max() <= 2 * toxicity.FAINT < got.evidence[got.n_passages > 0].min()
    assert got.score[got.predicted == 0].nunique() > 0.9 * (got.predicted == 0).sum()  # graded below significance too
    hard = toxicity.toxicity_report(odd, marks.limit(0)).toPandas()
    assert len(hard) == len(ODD) and hard.score.between(0, 1).all()
    assert toxicity.toxicity_report(none, marks).count() == 0


def test_near_copies_share_a_weight(spark):
    """Whatever their labels: thirty copies of one clean text weigh as one document."""
    text = "a clean text of some length that was copied many times over in the sample"
    rows = [*((i, text) for i in range(30)), *((100 + i, " ".join(f"{x}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for x in ("one", "two", "three", "four", "five"))) for i in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 30 == 0)) for i, _ in rows], "doc_id long, toxic int")
    options = toxicity.ToxicityOptions()
    sample = toxicity.training_documents(docs, marks, options).collect()
    used = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r.doc_id for r in sample) == used and abs(sum(r.weight for r in sample if r.doc_id < 30) - 1) < 1e-9
    assert all(r.weight == 1 for r in sample if r.doc_id >= 100)


@pytest.mark.parametrize(("up", "gain"), [(0.2, 1), (0.4, 1), (0.1, 2)])
def test_lambda_and_scale_are_those_of_the_walk(up, gain):
    """Steps of +gain with probability up and -1 otherwise: lambda solves up e^(lambda gain) + (1 - up) e^(-lambda) = 1 (for gain 1 it is
    ln((1 - up) / up)), and chance texts have about as many significant segments as the law says."""
    scores, corpus = np.array([gain, -1.0]), np.array([up, 1 - up]) * 1000
    rate = toxicity.solve_lambda(scores, corpus)
    assert abs(up * np.exp(rate * gain) + (1 - up) * np.exp(-rate) - 1) < 1e-6
    if gain == 1:
        assert abs(rate - np.log((1 - up) / up)) < 1e-6
    rng, n, texts = np.random.default_rng(4), 400, 400
    best = [max((s for _, _, s in toxicity.maximal_segments(np.where(rng.random(n) < up, gain, -1.0))), default=0.0) for _ in range(texts)]
    at = np.quantile(best, 0.7)  # the share above a high score falls by e^-lambda for each unit of score
    share = [np.mean(np.array(best) >= at + k * gain) for k in (0, 1)]
    assert abs(share[1] / share[0] - np.exp(-rate * gain)) < 0.2


# 9


def test_urls(spark):
    rows = [
        (1, "http://a.net/x", "<link rel='canonical' href='https://b.example.org/es/1'>"), (2, "http://c.net/y#f", '<META HTTP-EQUIV="refresh" content="0; url=http://a.net/x">'), (3, "http://A.com/de/1?x", None), (4, None, None), (4, "", ""),
        (5, "http://c.net/z", '<link href="/q" rel=canonical>'), (6, "http://c.net/q", '<meta http-equiv=refresh content="5;URL=http://d.com/fr/2">'), (7, "http://Z.ORG", ""), (8, "http://c.net/q", "<link rel=canonical href=http://d.com/de/2>"),
        (9, "https://x.example.org/en/17/a?b#c", ""), (10, "ftp://borg/", "x"), (11, "no scheme /es/", "x"),
    ]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'v' as verdict", "'r' as rule", "'h' as host", "1 as own")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_pages(table).collect()), key=str)
    assert got == sorted([
        (1, "a.net", "/x", None, "block"), (2, "c.net", "/y", None, "block"), (3, "a.com", "/de/1", "com/de/", "block"), (4, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "c.net", "/z", None, "allow"),
        (6, "c.net", "/q", None, "allow"), (7, "z.org", "", None, "allow"), (8, "c.net", "/q", None, "allow"), (9, "x.example.org", "/en/17/a", "example.org/en/1", "block"), (10, "borg", "/", None, "allow"), (11, "", "", None, "allow"),
    ], key=str)
    assert urls.judge_pages(table.limit(0)).count() == 0


LINKS = [
    ("http://h.com/x", "?p=2", "h.com/x?p=2"), ("http://h.com/a/b/c", "../f", "h.com/a/f"), ("http://h.com/a/b/c", "./g?y=1#z", "h.com/a/b/g?y=1"), ("http://h.com/a/b/", "../../../k", "h.com/k"),
    ("http://h.com/a", "//O.net/q/./r", "o.net/q/r"), ("http://h.com/a", "https://O.net", "o.net/"), ("http://h.com/a?b", "/c/..", "h.com/"), ("http://h.com", "d", "h.com/d"), ("http://h.com/a/", ".", "h.com/a/"),
    ("http://h.com/a", "#top", None), ("http://h.com/a", "mailto:x@y.z", None), ("http://h.com/a", "b?c&amp;d", "h.com/b?c&d"), ("http://h.com/a", "http://h.com/%7Eu/&#x2f;v", "h.com/%7Eu//v"), ("http://h.com/a?q", "?", "h.com/a?"),
]


def test_links_are_resolved(spark):
    forms = ['<link rel="alternate canonical" href="{}">', "<LINK data-href=z href='{}' rel='canonical'>", "<link rel=canonical  href = {}>", '<meta content="3; url={}" http-equiv="refresh">']
    rows = [(n * 100 + k, u, "<p>x</p>" + f.format(t) + '<a href="/other">') for k, (u, t, _) in enumerate(LINKS) for n, f in enumerate(forms)]
    rows += [(1000, "http://h.com/z", '<link rel="canonicals" href="/bad"><link rel=stylesheet href="/canonical">'), (1001, "no scheme", '<link rel=canonical href="/bad">')]
    got = Counter(map(tuple, urls.alias_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("dst is not null").collect()))
    source = lambda u: u[7:] if "/" in u[7:] else u[7:] + "/"
    assert got == Counter((source(u), want) for u, _, want in LINKS if want for _ in forms)


def test_urls_like_sql(spark):
    """Aliases of every form, with the registered SQL: the driver's pages hold no such link."""
    import duckdb
    from palimpsest.llm.queries import oracle_sql

    rng = np.random.default_rng(13)
    hosts, paths = ["a.net", "b.example.org", "c.com", "example.org", "d.io"], ["/", "/es/x", "/de/1", "/fr/2", "/en/17", "/q?x=1", "/u/v/w", ""]
    rows = []
    for i in range(400):
        url = f"http://{rng.choice(hosts)}{rng.choice(paths)}"
        link = rng.choice(["../" + rng.choice(paths).strip("/"), "//" + rng.choice(hosts) + rng.choice(paths), "https://" + rng.choice(hosts).upper() + rng.choice(paths), "?x=1", rng.choice(paths), "#f", "v/./w", "mailto:a@b", "/q?x=1&amp;y", "/u/../de/1"])
        html = rng.choice([f'<link rel="x canonical" href="{link}">', f"<link href='{link}' rel=canonical />", f'<META http-equiv=refresh content="0;url={link}">', "<p>none</p>", f'<a href="{link}">'], p=[0.15, 0.1, 0.1, 0.5, 0.15])
        rows.append((i, str(url), str(html)))
    rows += [(900, None, None), (901, "", "x"), (902, "http://a.net/", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    connection = duckdb.connect()
    connection.register("pages", table.toPandas())
    got = urls.judge_pages(table).toPandas()
    want = connection.execute(oracle_sql()["op9_url_filter"]).df()[list(got.columns)]
    key = lambda pdf: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in pdf.itertuples(index=False, name=None))
    assert key(got) == key(want) and got.by_alias.sum() > 20


# 10


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n")]
    repeats = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_quality_like_plain_rules(spark, docs, odd, none):
    texts = ["a b c d e f g h " * 3, "a a a a a a a a a", "x\nx\n \n \nx", "a b c d e f g h i a b c d e f g h", "one two   three"]
    table = docs.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source").filter("doc_id is null or doc_id <> 5")).unionByName(spark.createDataFrame([(7000 + i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    want = Counter()
    for i, t in pairs(table):
        q = plain_quality(t)
        want[(i, *q, q[0] < 20 or 100 * q[4] > 30 * q[0])] += 1
    rows = quality.line_report(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert Counter(map(tuple, rows)) == want
    assert quality.line_report(none).count() == quality.keep_good(none).count() == 0
    assert quality.keep_good(odd).columns == odd.columns and {r.doc_id for r in quality.keep_good(odd).collect()} == set()


def plain_boilerplate(rows, rules):
    """(row -> lines to remove) by comparing whole sets of normalised lines."""
    plain = lambda x: " ".join(re.sub("[0-9]", "0", x.lower()).split())
    docs = [frozenset(plain(x) for x in (t or "").split("\n") if plain(x)) for _, t, _ in rows]
    hosts, held = Counter(h or "" for _, _, h in rows), defaultdict(set)
    for d, (_, _, h) in zip(docs, rows, strict=True):
        for x in d:
            held[h or "", x].add(d)
    limit = lambda h: min(max(rules.line_docs, rules.line_share * hosts[h]), rules.line_docs_most)
    common = {k for k, v in held.items() if len(v) > limit(k[0])}
    return [{x for x in d if (h or "", x) in common} for d, (_, _, h) in zip(docs, rows, strict=True)], plain


@pytest.mark.parametrize("shared", [5, 12, 40])
def test_line_frequency_like_brute_force(spark, shared):
    """Documents with many common lines, copies, copies but for digits and case, one text in two hosts, and one doc_id twice."""
    rng = np.random.default_rng(shared)
    words = lambda n: " ".join("".join(rng.choice(list("abcdeéß"), 5)) for _ in range(n))
    lines = [words(int(rng.integers(1, 9))) for _ in range(shared)]
    rows = [(i, "\n".join([*rng.permutation(lines)[: int(rng.integers(1, shared + 1))], words(int(rng.integers(5, 40))), "", " page 17 of 20 "]), "h") for i in range(90)]
    rows += [(300 + i, lines[0].upper() + "\n" + words(30).replace("a", str(i % 10)), "h") for i in range(30)]
    rows += [(400 + i, rows[i % 3][1], "h") for i in range(60)] + [(500 + i, rows[i][1], "other") for i in range(25)] + [(rows[0][0], words(30), None), (600, None, "h"), (601, "", None), (None, rows[1][1], "h")]
    rules = quality.QualityRules(line_docs=20, line_share=0.05, line_docs_most=60)
    lost, plain = plain_boilerplate(rows, rules)
    want, kept = Counter(), Counter()
    for (i, t, h), gone in zip(rows, lost, strict=True):
        q = plain_quality(t or "")
        own = [x for x in (t or "").split("\n") if plain(x)]
        n = sum(len(x.split()) for x in own if plain(x) in gone)
        good = q[0] >= 20 and 100 * q[4] <= 30 * q[0] and q[0] - n >= 20
        want[i, h or "", n, len(gone), good] += 1
        if good:
            left = "\n".join(x for x in t.split("\n") if plain(x) not in gone)
            kept[i, left, h, len(left)] += 1
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = Counter((r.doc_id, r.host, r.n_boilerplate_words, r.n_boilerplate_lines, r.kept) for r in quality.line_report(table, rules).collect())
    assert got == want and sum(n for k, n in want.items() if k[3] > 0) > 50
    assert Counter(map(tuple, quality.keep_good(table, rules).collect())) == kept


def test_boilerplate_is_counted_once_per_content(spark):
    rng = np.random.default_rng(11)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    licence, copied = words(30), words(40) + "\n" + words(40)
    rows = [(i, licence + "\n" + words(12), "h") for i in range(60)] + [(100 + i, licence + "\n" + words(25), "h") for i in range(60)] + [(200 + i, copied, "h") for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.line_report(table, quality.QualityRules(line_docs=100)).collect()}
    assert not any(got[i].kept for i in range(60)) and all(got[100 + i].kept and got[100 + i].n_boilerplate_words == 30 for i in range(60))
    assert all(got[200 + i].kept and not got[200 + i].n_boilerplate_words for i in range(150))


def test_documents_that_share_most_lines_count_each(spark):
    rng = np.random.default_rng(12)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    template = "\n".join(words(6) for _ in range(20))
    table = spark.createDataFrame([(i, template + "\n" + words(12), "h") for i in range(500)], "doc_id long, text string, source string")
    rows = quality.line_report(table, quality.QualityRules(line_docs=100)).collect()
    assert len(rows) == 500 and all((r.n_boilerplate_lines, r.n_boilerplate_words, r.kept) == (20, 120, False) for r in rows)


# Long and repeated inputs


@pytest.mark.parametrize("group_limit", [2000, 1])
def test_rows_repeated_under_one_id_are_one_text(spark, group_limit):
    """Against brute force, with a passage of the repeated text in others, and short repeated rows beside it."""
    rng = np.random.default_rng(3)
    long, other = ("".join(rng.choice(list("abcdefgh "), 900)) for _ in range(2))
    rows = [*((None, long) for _ in range(60)), *((7, "short text") for _ in range(5)), (1, other + long[100:400]), (2, "x" * 50 + other[:250]), (None, other[300:]), *((3, other) for _ in range(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, *x[:4]) for (i, _), x in zip(rows, without_repeats([t.encode() for _, t in rows]), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeat_report(docs, group_limit).collect()) == want
    left = Counter((r.doc_id, len(r.text.encode())) for r in suffixes.remove_repeats(docs, group_limit).collect())
    assert left == Counter({(i, n - lost): 0 for i, n, lost, _, _ in want}) + Counter([(i, n - lost) for (i, n, lost, _, _), k in want.items() for _ in range(k)])


def test_many_repeated_rows_take_no_longer_than_many_copies(spark):
    import time

    text, took = " ".join(f"w{i * 7919 % 10007}" for i in range(1400)), {}
    for name in ("warm", "distinct", "null"):
        docs = spark.createDataFrame([(i if name != "null" else None, text) for i in range(3000)], "doc_id long, text string")
        began = time.time()
        assert suffixes.repeat_report(docs).agg({"n_removed": "sum"}).first()[0] == 3000 * len(text)
        took[name] = time.time() - began
    assert took["null"] < 2 * took["distinct"] + 5


def test_web_spans_are_those_of_the_pattern():
    rule = next(r for r in secrets.RULES if r.kind == "web")
    rng = np.random.default_rng(5)
    parts = ["eyJ", "eyJabcdefgh", ".", ".", "ab", "eyJeyJ", "zzzzzzzz", " ", "-", "eyJ12345678.eyJ12345678.12345678"]
    for _ in range(4000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert secrets.web_spans(text) == [m.span() for m in re.finditer(rule.pattern, text)], text


ADVERSE = {
    "assign": ["token" + " " * 1_000_000, "token" * 200_000, "token=" * 160_000, "password\"" * 100_000], "access": ["AKIA" * 250_000, "AKIA " * 200_000], "hex": ["0123456789abcde " * 60_000, "f" * 1_000_000],
    "forge": ["ghp_" * 250_000, "ghp_" + "a" * 30 + "ghp_" * 240_000], "chat": ["xoxb-" * 200_000, "xoxb-a " * 140_000], "maps": ["AIza" * 250_000], "model": ["sk-" * 330_000, "sk-a " * 200_000], "pay": ["sk_live_" * 120_000],
    "web": ["eyJ" * 330_000, "eyJabcdefgh" * 90_000, "eyJabcdefgh." * 80_000, "a" * 1_000_000], "pem": ["-----BEGIN " + "A " * 500_000, "-----BEGIN " * 90_000, "-----BEGIN " + "A" * 1_000_000, "-----BEGIN PRIVATE KEY-----" + "-----END " * 100_000],
}


@pytest.mark.parametrize("kind", [r.kind for r in secrets.RULES])
def test_each_rule_is_linear_on_adverse_texts(kind):
    """About 1 MB each, made so that starts of matches are many or matches break off late."""
    import time

    rule, pattern = next((r, p) for r, p in zip(secrets.RULES, secrets._compiled(secrets.RULES)[0], strict=True) if r.kind == kind)
    for text in ADVERSE[kind]:
        began = time.time()
        secrets.spans_of(rule, pattern, text)
        assert time.time() - began < 2, text[:40]


def test_a_hosts_documents_are_counted_as_those_of_a_line(spark):
    """Copies count once on both sides: a host of very many copies gets no limit that its lines cannot reach."""
    line = "the very same line of many words stands in each of these documents of the host"
    letters = "abcdefghijklmnopqrstuvwxyzäöüé"
    own = [(i, f"{line}\nown words " + " ".join(letters[i] * 3 + x for x in letters), "h") for i in range(30)]
    copies = [(1000 + i, "a text that was copied " + " ".join(letters), "h") for i in range(4000)]
    rows = quality.line_report(spark.createDataFrame(own + copies, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in rows if r.n_boilerplate_lines} == set(range(30))
