"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k, without replacement.

The lattice of a text has all its segmentations into vocabulary pieces; a segmentation's probability is the
product of its pieces' weights, normalised over the lattice. No piece holds a word border, so the lattice is a
chain of independent word lattices, which are built once per slice of a batch for each distinct word. `encode` and
`decode` are plain column functions for the model's own segmentation.

Search. Every segmentation's log-probability is perturbed by Gumbel noise; the k highest are a sample without
replacement. They are found best first, as in A* sampling: the queue holds disjoint sets of segmentations (a prefix of
pieces and the choices left at its end) by the maximum of their perturbed values, drawn top-down from the set's exact
log-mass and truncated at the value of the set that it was cut from. The best set's best member is a sample of the
set; taking it out splits the set along the member's path. The value of the best set left after k members is the
threshold kappa, and 1 - exp(-exp(log_prob - kappa)) a member's inclusion score.

All randomness is a hash of the seed, the row key, the number of the sample and the place, so results do not depend
on how rows are dealt to tasks. The pieces' weights are a parameter: the model's scores (unigram models), or
1/(rank + 1) for models whose scores are merge ranks.

Defined cases. Null or empty text: one sample without pieces (`encode`, `decode`: null stays null). Null doc_id: a seed of its own. Fewer than k segmentations: all of them, inclusion
1. Characters outside the vocabulary become byte pieces. U+2581 decodes to a space. Repeated rows: the same samples
each. Memory grows with the longest text, at least a part of a batch. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import GOLDEN, U64, Batches, mix, rows_to_batch, slices, texts_of

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_DENSE = 128  #: characters with a row of their own in the transition table
_PART_ROWS, _PART_CHARS = 800, 1_500_000
_LOOK = 512  #: places of a path whose sets are looked at first


@dataclass(frozen=True)
class SampleOptions:
    k: int = 2
    seed: int = 17
    theta: float = 1.0  #: exponent of probabilities; below 1 flattens
    weights: str = "rank"  #: or "score"


class Vocabulary:
    """Pieces of a SentencePiece model as a trie of arrays."""

    def __init__(self, model_path: str, weights: str = "rank", theta: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.raw = np.empty(n, object)
        self.raw[:] = [bytes([int(names[i][3:5], 16)]) if byte[i] else b"" if special[i] else names[i].encode().replace(_SPACE_BYTES, b" ") for i in range(n)]
        usable = [i for i in range(n) if not special[i] and not byte[i]]
        if any(SPACE in names[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece crosses a word border")
        if weights == "rank":
            value = -np.log(np.arange(len(usable)) + 1.0)
            value -= np.log(np.exp(value).sum())
        else:
            value = np.array([sp.get_score(i) for i in usable])
        self.log_weight = np.zeros(n + 1)
        self.log_weight[usable] = theta * value
        self.log_weight[n] = theta * (value.min() - 10.0)  # a character spelled in bytes
        self.spelled = n
        self._build(usable, names)

    def _build(self, usable: list[int], names: list[str]) -> None:
        count: dict[str, int] = {}
        for i in usable:
            for c in names[i]:
                count[c] = count.get(c, 0) + 1
        self.code = np.zeros(0x110000, np.int32)
        for k, c in enumerate(sorted(count, key=lambda c: (-count[c], c)), 1):
            self.code[ord(c)] = k
        self.width = max(map(len, (names[i] for i in usable)))
        nodes: list[dict[int, int]] = [{}]
        piece = [-1]
        for i in usable:
            at = 0
            for c in names[i]:
                k = int(self.code[ord(c)])
                if k not in nodes[at]:
                    nodes[at][k] = len(nodes)
                    nodes.append({})
                    piece.append(-1)
                at = nodes[at][k]
            piece[at] = i
        self.piece = np.array(piece, np.int32)
        self.marked = SPACE in (names[i] for i in usable)  # else a mark may be spelled in bytes
        self.dense = np.zeros((len(nodes), _DENSE), np.int32)
        rare = []
        self.span = len(count) + 1
        for at, own in enumerate(nodes):
            for k, to in own.items():
                if k < _DENSE:
                    self.dense[at, k] = to
                else:
                    rare.append((at * self.span + k, to))
        rare.sort()
        self.rare_key = np.array([r[0] for r in rare] or [-1], np.int64)
        self.rare_to = np.array([r[1] for r in rare] or [0], np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next trie node of each; 0 where there is none."""
        far = np.flatnonzero(code >= _DENSE)
        if not len(far):
            return self.dense.ravel()[state * _DENSE + code]
        out = self.dense.ravel()[state * _DENSE + np.where(code < _DENSE, code, 0)]
        key = state[far].astype(np.int64) * self.span + code[far]
        at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
        out[far] = np.where(self.rare_key[at] == key, self.rare_to[at], 0)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text."""
        out = b"".join(self.raw[ids].tolist())
        return out[1:] if self.marked else out.replace(_SPACE_BYTES, b" ")[1:]


@lru_cache(maxsize=2)
def vocabulary(model_path: str, weights: str, theta: float) -> Vocabulary:
    return Vocabulary(model_path, weights, theta)


class Lattices:
    """Word lattices of distinct words (each led by one SPACE) and the chance of each edge on the way to the word's end."""

    def __init__(self, vocab: Vocabulary, words: list[str]) -> None:
        # A node per character and one after each word; no character has the code 0 of the latter, so walks end there.
        text = "".join([SPACE + w + "\0" for w in words])
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.points)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.word_end = np.cumsum(sizes) - 1
        self.word_start = self.word_end - sizes + 1
        code = np.zeros(n + vocab.width, np.int32)
        code[:n] = vocab.code[self.points]
        code[self.word_end] = 0
        at = np.ones(n, bool)
        at[self.word_end] = False
        at = np.flatnonzero(at).astype(np.int32)
        state, alone = np.zeros(len(at), np.int32), np.zeros(n, bool)
        alone[self.word_end] = True
        starts, ends, pieces = [], [], []
        for k in range(vocab.width):
            state = vocab.step(state, code[at + k])
            on = state > 0
            at, state = at[on], state[on]
            if not len(at):
                break
            piece = vocab.piece[state]
            here = piece >= 0
            own = at[here]
            starts.append(own)
            ends.append(own + np.int32(k + 1))
            pieces.append(piece[here])
            if k == 0:
                alone[own] = True
        missing = np.flatnonzero(~alone).astype(np.int32)
        start, finish, piece = np.concatenate([*starts, missing]), np.concatenate([*ends, missing + np.int32(1)]), np.concatenate([*pieces, np.full(len(missing), vocab.spelled, np.int32)])
        order = np.argsort(start, kind="stable")
        self.edge_start, self.edge_end, self.edge_piece = start[order], finish[order], piece[order]
        self.first = np.zeros(n + 1, np.int32)
        np.cumsum(np.bincount(self.edge_start, minlength=n), out=self.first[1:])
        weight = vocab.log_weight[self.edge_piece]
        beyond = np.zeros(n)
        end_of = np.repeat(self.word_end.astype(np.int32), sizes)
        left = end_of[self.edge_start] - self.edge_start  # characters to the word's end
        by_level = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 1 << 16 else left, kind="stable")
        cuts = np.searchsorted(left[by_level], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = by_level[a:b]
            if not len(e):
                continue
            value = weight[e] + beyond[self.edge_end[e]]
            own = self.edge_start[e]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            most = np.maximum.reduceat(value, first)
            total = np.add.reduceat(np.exp(value - np.repeat(most, np.diff(np.concatenate((first, [len(e)]))))), first)
            beyond[own[first]] = most + np.log(total)
        self.log_chance = np.minimum(weight + beyond[self.edge_end] - beyond[self.edge_start], 0.0)
        degree = np.diff(self.first)
        self.single = (degree == 1)[self.edge_start]
        self.log_chance[self.single] = 0.0
        self.rest = np.where(self.single, 0.0, -np.expm1(self.log_chance))
        total = np.concatenate(([0.0], np.cumsum(np.exp(self.log_chance))))
        low = total[self.first[self.edge_start]]
        self.up_to = (total[1:] - low) / (total[self.first[self.edge_start + 1]] - low)
        self.halvings = int(degree.max(initial=1)).bit_length()

    def walk(self, node: np.ndarray, last: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges from each node to its word's last node, end to end, and how many each has; base: random keys."""
        count = np.zeros(len(node), np.int64)
        live = np.flatnonzero(node < last)
        now, taken, step = node[live], [], 0
        while len(live):
            u = (mix(base[live] + np.full(1, step, np.uint64) * GOLDEN) >> U64(11)) * 2.0**-53
            e, high = self.first[now], self.first[now + 1] - 1
            for _ in range(self.halvings):  # first edge of the node whose share reaches beyond u
                middle = (e + high) >> 1
                below = self.up_to[middle] <= u
                e, high = np.where(below & (e < high), middle + 1, e), np.where(below, high, middle)
            taken.append((live, e))
            count[live] += 1
            now = self.edge_end[e]
            on = now < last[live]
            live, now, step = live[on], now[on], step + 1
        place = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for k, (i, e) in enumerate(taken):
            out[place[i] + k] = e
        return out, count


def words_of(text: str) -> list[str]:
    """Words of a text after the leading space mark is put before it, each less one mark; joined with marks they are the text."""
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return words
    out, marks = [], 0
    for w in words:
        if w:
            out.append(SPACE * marks + w)
            marks = 0
        else:
            marks += 1
    return [*out, SPACE * (marks - 1)] if marks else out


def numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of each text as places in a list of different words: words of each text, places end to end, the list."""
    plain = np.array([not t or not (SPACE in t or "  " in t or t[0] == " " or t[-1] == " ") for t in texts])  # no word has marks of its own
    split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain.tolist(), strict=True) if p], pa.large_string()), " ")
    marked = [words_of(t) for t, p in zip(texts, plain.tolist(), strict=True) if not p]
    coded = pa.concat_arrays([split.flatten(), pa.array(list(itertools.chain.from_iterable(marked)), pa.large_string())]).dictionary_encode()
    sizes = np.empty(len(texts), np.int64)
    sizes[plain], sizes[~plain] = pc.list_value_length(split).to_numpy(zero_copy_only=False), list(map(len, marked))
    code, of_plain = coded.indices.to_numpy().astype(np.int64), np.repeat(plain, sizes)
    unit = np.empty(len(code), np.int64)
    unit[of_plain], unit[~of_plain] = np.split(code, [int(of_plain.sum())])
    held = np.repeat([bool(t) for t in texts], sizes)  # an empty text has no words, though a split gives it one
    sizes[[not t for t in texts]] = 0
    return sizes, unit[held], coded.dictionary.to_pylist()


def _uniform(key: np.ndarray | np.uint64, *parts: int) -> np.ndarray:
    x = np.atleast_1d(np.asarray(key, np.uint64))
    for p in parts:
        x = mix(x + U64((p * int(GOLDEN) + 1) & 0xFFFFFFFFFFFFFFFF))
    return ((x >> U64(11)) + 0.5) * 2.0**-53


class _Path:
    """One emitted segmentation of a document: its edges, the perturbed value, and the sets left along it."""

    def __init__(self, lat: Lattices, edges: np.ndarray, word: np.ndarray, value: float, fork: int, barred: list[int], seed: np.uint64, need: int) -> None:
        self.edges, self.word, self.value, self.fork, self.barred = edges, word, value, fork, barred
        log_chance = lat.log_chance[edges]
        self.log_prob = float(log_chance.sum())
        # A set of mass m has the truncated maximum -log(exp(-value) + E / m), E exponential: the larger m / E, the better.
        self.odds = np.zeros(len(edges))
        before = float(log_chance[:fork].sum())
        for at, stop in ((fork, min(fork + _LOOK, len(edges))), (fork + _LOOK, len(edges))):
            if at >= stop:
                break
            own = log_chance[at:stop]
            total = before + np.cumsum(own)
            mass = np.exp(total - own) * lat.rest[edges[at:stop]]
            if at == fork and barred:
                node = lat.edge_start[edges[fork]]
                more = len(barred) < lat.first[node + 1] - lat.first[node]
                mass[0] = max(1.0 - np.exp(lat.log_chance[barred]).sum(), 1e-300) * np.exp(before) if more else 0.0
            odds = mass / -np.log(_uniform(seed + np.arange(at, stop, dtype=np.uint64) * GOLDEN, 3))
            self.odds[at:stop] = odds
            before = float(total[-1])
            # E is at least 2^-54, so later sets stay under this bound: where it is low, they cannot be needed.
            if stop >= len(edges) or (len(odds) >= need and np.exp(before) * 2.0**54 < np.partition(odds, -need)[-need]):
                break

    def best(self) -> tuple[float, int]:
        """Perturbed maximum of the best set left, and its place."""
        if not len(self.odds):
            return -np.inf, 0
        j = int(np.argmax(self.odds))
        odds = self.odds[j]
        return (float(-np.logaddexp(-self.value, -np.log(odds))), j) if odds > 0 else (-np.inf, j)


def sample_documents(vocab: Vocabulary, keys: np.ndarray, texts: list[str], k: int) -> list[tuple[list[tuple[float, float, np.ndarray]], float]]:
    """For each text: up to k (perturbed value, log probability, piece ids), best first, and kappa (-inf: nothing is left)."""
    sizes, unit, words = numbered(texts)
    if not len(unit):
        return [([(0.0, 0.0, np.empty(0, np.int64))], -np.inf) for _ in texts]
    lat = Lattices(vocab, words)
    doc = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(unit)) - begin[doc]
    paths: list[list[_Path]] = [[] for _ in texts]
    last = lat.word_end[unit]
    with np.errstate(over="ignore"):
        word_key = mix(keys[doc] + place.astype(np.uint64) * GOLDEN)
    live = [d for d in range(len(texts)) if sizes[d]]
    for r in range(k):
        with np.errstate(over="ignore"):
            base = mix(word_key + U64(r + 1))
            seeds = mix(keys * GOLDEN) + mix(np.full(1, r, np.uint64) * GOLDEN)
        drawn = _uniform(keys, 5, r) if r else -np.log(-np.log(_uniform(keys, 1)))
        if r == 0:
            node, fresh, forks = lat.word_start[unit], np.ones(len(unit), bool), {}
        else:
            node, fresh, forks = lat.word_start[unit].copy(), np.zeros(len(unit), bool), {}
            for d in list(live):
                (value, j), best = max(((p.best(), p) for p in paths[d]), key=lambda x: x[0][0])
                if value == -np.inf:
                    live.remove(d)
                    continue
                best.odds[j] = 0.0
                barred = [*best.barred, int(best.edges[j])] if j == best.fork and best.barred and int(best.edges[j]) not in best.barred else [*best.barred] if j == best.fork and best.barred else [int(best.edges[j])]
                at = int(lat.edge_start[best.edges[j]])
                options = np.arange(lat.first[at], lat.first[at + 1])
                for b in barred:
                    options = options[options != b]
                chance = np.cumsum(np.exp(lat.log_chance[options]))
                pick = min(int(np.searchsorted(chance, drawn[d] * chance[-1], side="right")), len(options) - 1)
                alternative = int(options[pick])
                w = int(begin[d] + best.word[j])
                fresh[w : begin[d] + sizes[d]] = True
                node[w] = lat.edge_end[alternative]
                forks[d] = (best, j, value, [*barred, alternative], alternative)
        chosen = np.flatnonzero(fresh)
        edges, count = lat.walk(node[chosen], last[chosen], base[chosen])
        word = np.repeat(place[chosen], count)
        cut = np.searchsorted(np.repeat(doc[chosen], count), np.arange(len(texts) + 1))
        for d in live:
            own, at = edges[cut[d] : cut[d + 1]], word[cut[d] : cut[d + 1]]
            if r == 0:
                paths[d].append(_Path(lat, own, at, float(drawn[d]), 0, [], seeds[d], k + 1))
            else:
                best, j, value, barred, alternative = forks[d]
                own = np.concatenate((best.edges[:j], [alternative], own))
                at = np.concatenate((best.word[: j + 1], at))
                paths[d].append(_Path(lat, own, at, value, j, barred, seeds[d], k + 1))
    ids = iter(piece_ids(vocab, lat, [p.edges for own in paths for p in own]))
    out = []
    for d in range(len(texts)):
        if not sizes[d]:
            out.append(([(0.0, 0.0, np.empty(0, np.int64))], -np.inf))
            continue
        kappa = max(p.best()[0] for p in paths[d])
        out.append(([(p.value, p.log_prob, next(ids)) for p in paths[d]], kappa))
    return out


def piece_ids(vocab: Vocabulary, lat: Lattices, paths: list[np.ndarray]) -> list[np.ndarray]:
    """Pieces of each path; a spelled character becomes its bytes."""
    edges = np.concatenate(paths)
    ends = np.cumsum(list(map(len, paths)))
    pieces = lat.edge_piece[edges]
    spelled = pieces == vocab.spelled
    if not spelled.any():
        return np.split(pieces, ends[:-1])
    raw = [chr(c).encode("utf-8", "surrogatepass") for c in lat.points[lat.edge_start[edges[spelled]]].tolist()]
    sizes = np.ones(len(pieces), np.int64)
    sizes[spelled] = list(map(len, raw))
    out = np.repeat(pieces, sizes)
    out[np.repeat(spelled, sizes)] = vocab.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
    return np.split(out, np.cumsum(sizes)[ends - 1][:-1])


def log_inclusion(log_prob: float, kappa: float) -> float:
    """log(1 - exp(-exp(log_prob - kappa))), without underflow."""
    if kappa == -np.inf:
        return 0.0
    x = log_prob - kappa
    return x if x < -40 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


_SAMPLES = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("ids", pa.list_(pa.int32())), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])
_SAMPLES_DDL = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids array<int>, decoded_crc32 long, round_trip boolean"


def parts_of(texts: list[str], most: int = _PART_CHARS):
    """Row ranges of about `most` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_NO_ID = U64(0x5851F42D4C957F2D)  #: seed of rows without a doc_id, beside those of all numbers


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = mix(np.ascontiguousarray(ids.fill_null(0).to_numpy(zero_copy_only=False)).view(np.uint64) + U64(seed) * GOLDEN)
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), mix(keys + _NO_ID), keys)


def sampled_segmentations(docs: DataFrame, model_path: str, options: SampleOptions = SampleOptions()) -> DataFrame:
    """doc_id, sample, n_pieces, log_prob, perturbed, log_inclusion, ids, decoded_crc32, round_trip; up to k rows per row of docs."""

    def run(batches: Batches) -> Batches:
        vocab = vocabulary(model_path, options.weights, options.theta)
        for b in slices(batches, _PART_ROWS):
            texts, keys = texts_of(b.column("text")), row_keys(b.column("doc_id"), options.seed)
            for i, j in parts_of(texts):
                rows, pieces = [], []
                for n, (samples, kappa) in enumerate(sample_documents(vocab, keys[i:j], texts[i:j], options.k), i):
                    plain = texts[n].replace(SPACE, " ").encode("utf-8", "surrogatepass")
                    for r, (value, log_prob, own) in enumerate(samples, 1):
                        decoded = vocab.decode(own)
                        rows.append((n, r, len(own), log_prob, value, log_inclusion(log_prob, kappa), zlib.crc32(decoded), decoded == plain))
                        pieces.append(own)
                n, r, size, log_prob, value, inclusion, crc, same = zip(*rows, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.concatenate(pieces), pa.int32()))
                yield rows_to_batch(_SAMPLES, [b.column("doc_id").take(pa.array(n)), list(r), list(size), list(log_prob), list(value), list(inclusion), lists, list(crc), list(same)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, _SAMPLES_DDL)


@lru_cache(maxsize=2)
def _processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def encode(text: Column, model_path: str) -> Column:
    """array<int>: the ids of the model's own segmentation of each text."""

    def ids(texts: pd.Series) -> pd.Series:
        held = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        out[held] = pd.Series(_processor(model_path).encode(texts[held].tolist(), num_threads=1), index=texts.index[held], dtype=object)
        return out

    return F.pandas_udf(ids, "array<int>")(text)


def decode(ids: Column, model_path: str) -> Column:
    """string: the text of each list of ids of any segmentation."""

    def texts(lists: pd.Series) -> pd.Series:
        vocab = vocabulary(model_path, "rank", 1.0)
        return lists.map(lambda x: None if x is None else vocab.decode(np.asarray(x, np.int64)).decode("utf-8", "replace"))

    return F.pandas_udf(texts, "string")(ids)
