"""SentencePiece encoding and decoding with sampled segmentations, Gumbel top-k without replacement.

A text's segmentations into pieces of a given vocabulary form a lattice. Blanks become the mark U+2581, one more comes
first, and a character without a piece is a run of byte pieces. No piece holds a mark after another character, so the
lattice is a chain of units, one a word, and each distinct unit's lattice is built once a batch; units that come back in
a later batch are kept, up to KEPT of them. A piece's log probability follows Zipf's law over its merge rank (a byte-pair model stores ranks, no probabilities), and the backward
sums of a unit give exact conditional probabilities of the next piece.

The k segmentations with the largest Gumbel-perturbed log probabilities are found by a best-first (A*) search with no
enumeration: the root's perturbed maximum is a Gumbel variable, a path that attains it is drawn, and each set of
siblings that the path passes gets a maximum of its own, truncated at the path's. The best set is expanded next, below
the prefix that it shares. All draws come from a hash of the row key, sample, word and step: a row's samples depend on
nothing else. log_inclusion is the log probability that the segmentation would be among the k, given the threshold (the
next largest perturbed value). Sets are the other segmentations of one word below a prefix; only a word that is taken
off the queue is split into the sets of its single pieces.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.llm.common import discard, release, stable, unused, written
from skein.llm.exact_dedup import probe

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a literal U+2581 of the text, which is encoded by its bytes: a lone surrogate, which no text holds.
LITERAL_MARK = "\ud800"
SAMPLES = 2
#: Words that are segmented at a time.
BATCH_WORDS = 25_000
#: Batches after which freed memory goes back to the system; it has to be cleared anew when it is taken again.
RELEASE = 16
#: Units whose lattices a worker keeps, characters of them, and places of the table that tells which units have come before.
KEPT, KEPT_CHARS, BEFORE = 50_000, 500_000, 1 << 22

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_SLOT_BITS = 17
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from counters."""
    return ((_mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def load_pieces(model: str = MODEL) -> list[tuple[str, float]]:
    """(piece, score) by id of a SentencePiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


def units(text: str) -> list[str]:
    """The words of a text with the marks before them."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, LITERAL_MARK)
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _UNIT.findall(MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", " " + MARK)).split(" ")


class Vocabulary:
    """Hashes of pieces and of their beginnings in an open-addressed table, weights, and byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.bytes_at = np.zeros(256, dtype=np.int32)
        self.raw: list[bytes] = []
        normal: list[tuple[str, int, float]] = []
        for i, (p, score) in enumerate(pieces):
            if m := re.fullmatch("<0x([0-9A-F]{2})>", p):
                self.bytes_at[int(m[1], 16)] = i
                self.raw.append(bytes([int(m[1], 16)]))
            else:
                special = p in ("<unk>", "<s>", "</s>")
                self.raw.append(b"" if special else p.replace(MARK, " ").encode())
                if not special:
                    normal.append((p, i, -score))
        self.longest = max(len(p) for p, _, _ in normal)
        total = math.log(sum(1.0 / (1.0 + r) for _, _, r in normal))
        self.weight = np.full(len(pieces), -math.log(1.0 + len(pieces)) - total)
        self.byte_weight = float(self.weight[0])
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.ids = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        known: dict[int, int] = {}  # of all pieces and their beginnings, which are no pieces: -1
        for p, i, rank in normal:
            self.weight[i] = -math.log(1.0 + rank) - total
            h = 0
            for c in p:
                h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
                known.setdefault(h, -1)
            known[h] = i
        for h, i in known.items():
            at = self._slot(h)
            while self.slots[at]:
                at = (at + 1) % len(self.slots)
            self.slots[at], self.ids[at] = h, i

    @staticmethod
    def _slot(h: int) -> int:
        return ((h * int(_STEP)) % (1 << 64)) >> (64 - _SLOT_BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 for what only begins a piece, -2 for others."""
        at = (h * _STEP >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        got = self.slots[at]
        hit = got == h
        out = np.where(hit, self.ids[at], np.int32(-2))
        open_ = np.flatnonzero(~hit & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            got = self.slots[at[open_]]
            hit = got == h[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out


class Lattice:
    """The lattices of distinct units: states are the characters' places, of the units added together ordered by their
    distance to the unit's end.

    Edges of a state lie together, longest first: piece id (below 0: -1 less the code point whose bytes it stands for),
    next state (-1: the end), log probability given the state, and its running sum of probabilities (in single precision:
    draws tell probabilities of 2**-24 apart). cut() takes off the units that were added last.
    """

    #: Arrays by unit, state (first: of one more) and edge.
    ARRAYS = {"root": (0, np.int32), "first": (1, np.int64), "piece": (2, np.int32), "next": (2, np.int32), "state": (2, np.int32), "log_p": (2, np.float64), "up_to": (2, np.float32)}

    def __init__(self, vocab: Vocabulary, names: list[str] = ()):
        self.vocab, self.sizes = vocab, (0, 0, 0)
        for name, (_, kind) in self.ARRAYS.items():
            setattr(self, name, np.zeros(1, dtype=kind))
        if names:
            self.add(names)

    def cut(self, sizes: tuple[int, int, int]) -> None:
        """Back to the units, states and edges that self.sizes were."""
        self.sizes = sizes

    def _grow(self, sizes: tuple[int, int, int]) -> None:
        for name, (by, _) in self.ARRAYS.items():
            old, need = getattr(self, name), sizes[by] + 1
            if need > len(old):
                new = np.zeros(need + need // 4, dtype=old.dtype)
                new[: self.sizes[by] + 1] = old[: self.sizes[by] + 1]
                setattr(self, name, new)

    def add(self, names: list[str]) -> None:
        """Units that are not there yet; they are numbered on."""
        vocab = self.vocab
        sizes = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
        codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(sizes)
        n = len(codes)
        rem = (np.repeat(ends, sizes) - np.arange(n)).astype(np.int32)
        by_rem = np.argsort(rem.astype(np.uint16) if n and rem.max() < 1 << 16 else rem, kind="stable")
        state = np.empty(n, dtype=np.int32)
        state[by_rem] = np.arange(n, dtype=np.int32)
        # Pieces by length, in order of state: states and places where a piece of that many characters starts.
        found: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
        symbols, degree = codes.astype(np.uint64) + np.uint64(1), np.zeros(n, dtype=np.int32)
        place, at, left, h = by_rem.astype(np.int32), np.arange(n, dtype=np.int32), rem[by_rem], np.zeros(n, dtype=np.uint64)
        for length in range(1, vocab.longest + 1):
            if not len(place):
                break
            h = h * _BASE
            h += symbols[place + (length - 1)]
            ids = vocab.find(h)
            if length == 1:
                ids[codes[place] == ord(LITERAL_MARK)] = -2
                found.append((at, place, 1, ids))
                degree += 1
            else:
                hit = np.flatnonzero(ids >= 0)
                found.append((at[hit], place[hit], length, ids[hit]))
                degree[found[-1][0]] += 1
            go = np.flatnonzero((ids > -2) & (left > length))  # where a longer piece may begin
            place, at, left, h = place[go], at[go], left[go], h[go]
        units, states, edges = self.sizes
        first = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(degree, out=first[1:])
        new = int(first[-1])
        self._grow((units + len(names), states + n, edges + new))
        self.root[units : units + len(names)] = state[ends - sizes] + states
        self.first[states : states + n + 1] = first + edges
        piece, next_, w = self.piece[edges : edges + new], np.empty(new, dtype=np.int32), np.empty(new)
        fill = first[:-1].copy()
        for s, places, length, ids in reversed(found):
            e = fill[s]
            fill[s] += 1
            piece[e] = ids
            next_[e] = np.where(rem[places] == length, -1, state[np.minimum(places + length, n - 1)])
            w[e] = vocab.weight[ids]
            if length == 1 and (raw := np.flatnonzero(ids < 0)).size:
                c = codes[places[raw]]
                c = np.where(c == ord(LITERAL_MARK), ord(MARK), c)
                width = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
                piece[e[raw]] = -1 - c.astype(np.int32)
                w[e[raw]] = vocab.byte_weight * width
        del found, h, symbols, fill
        back = np.zeros(n + 1)  # the last one, reached by -1, is the end
        p = np.empty(new)
        steps = np.bincount(rem, minlength=1).cumsum() if n else np.zeros(1, dtype=np.int64)
        for a, b in zip(steps[:-1], steps[1:]):
            if a == b:
                continue
            lo, hi = first[a], first[b]
            starts, sizes_ = first[a:b] - lo, degree[a:b]
            x = w[lo:hi] + back[next_[lo:hi]]
            top = np.maximum.reduceat(x, starts)
            share = np.exp(x - np.repeat(top, sizes_))
            total = np.add.reduceat(share, starts)
            back[a:b] = top + np.log(total)
            p[lo:hi] = share / np.repeat(total, sizes_)
            w[lo:hi] = x - np.repeat(back[a:b], sizes_)
        self.next[edges : edges + new] = np.where(next_ >= 0, next_ + states, -1)
        self.state[edges : edges + new] = np.repeat(np.arange(states, states + n, dtype=np.int32), degree)
        np.minimum(w, 0.0, out=self.log_p[edges : edges + new])
        run = np.cumsum(p, out=p)
        run -= np.repeat(np.concatenate(([0.0], run))[first[:-1]], degree)
        up_to = self.up_to[edges : edges + new]
        up_to[:] = run
        if new:
            up_to[first[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        self.sizes = (units + len(names), states + n, edges + new)

    def log_rest(self, e: np.ndarray) -> np.ndarray:
        """Log probability of an edge's siblings together, -inf if it has none."""
        s = self.state[e]
        out = np.log(-np.expm1(np.minimum(self.log_p[e], -1e-16)))
        out[self.first[s + 1] - self.first[s] == 1] = -np.inf
        return out

    def walk(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each start state to the end of its unit: edges in order, and the number of each start's edges."""
        live, s, step, kept = np.arange(len(start)), start, 0, []
        while len(live):
            u = _uniform(seed[live] + np.uint64(step) * _M2)
            e = self.first[s]
            more = np.flatnonzero(u > self.up_to[e])
            while len(more):
                e[more] += 1
                more = more[u[more] > self.up_to[e[more]]]
            kept.append((live.astype(np.int32), e.astype(np.int32)))
            s = self.next[e]
            go = s >= 0
            live, s, step = live[go], s[go], step + 1
        if not kept:
            return np.empty(0, dtype=np.int32), np.zeros(len(start), dtype=np.int64)
        n = np.zeros(len(start), dtype=np.int64)
        for which, _ in kept:
            n[which] += 1
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), dtype=np.int32)
        for k, (which, e) in enumerate(kept):
            out[at[which] + k] = e
        return out, n


class _Row:
    """A row's search: paths so far (edges), their scores, the sets left, and the path to draw next.

    A set: less its maximum, the path it branches from, the edges in question, the edges taken there (none: the set of a
    word's other segmentations), the log probability before it, and its word. To draw: bound, edges and log probability of
    the prefix, the state to go on from (-1: none), and the next word.
    """

    __slots__ = ("key", "words", "paths", "scores", "queue", "todo")

    def __init__(self, key: int, words: np.ndarray):
        self.key, self.words = key, words
        self.paths: list[np.ndarray] = []
        self.scores: list[tuple[float, float]] = []
        self.queue: list[tuple[float, int, int, int, tuple[int, ...], float, int]] = []
        self.todo: tuple[float, np.ndarray, float, int, int] | None = None


def _gumbel(u):
    return -np.log(-np.log(u))


def _bounded(phi: np.ndarray, u: np.ndarray, bound) -> np.ndarray:
    """Maxima of sets of log weight phi, given that they are below bound."""
    return -np.logaddexp(-bound, -(phi + _gumbel(u)))


def search(lattice: Lattice, rows: list[_Row], samples: int) -> None:
    """Fills paths and scores of the rows: up to `samples` distinct paths each, best first, and leaves the queue's next."""
    for r, top in zip(rows, _gumbel(_uniform(np.array([r.key for r in rows], dtype=np.uint64))).tolist()):
        r.todo = (top, np.empty(0, np.int32), 0.0, -1, 0)
    for k in range(samples):
        active = [r for r in rows if r.todo is not None]
        if not active:
            return
        starts: list[np.ndarray] = []
        places: list[np.ndarray] = []
        for r in active:
            _, _, _, state, word = r.todo
            s, w = lattice.root[r.words[word:]], np.arange(word, len(r.words), dtype=np.uint64)
            if state >= 0:
                s, w = np.concatenate(([state], s)), np.concatenate((np.array([word - 1], dtype=np.uint64), w))
            starts.append(s)
            places.append(w)
        sizes = np.array([len(s) for s in starts])
        keys = np.repeat(np.array([r.key for r in active], dtype=np.uint64), sizes)
        seeds = _mixed(keys + np.uint64(k + 1) * _M1 + np.concatenate(places) * _STEP)
        edges, n = lattice.walk(np.concatenate(starts), seeds)
        at = np.append(np.cumsum(n) - n, len(edges))
        lo = np.append(np.cumsum(sizes) - sizes, sizes.sum())
        if len(edges):
            log_p = np.add.reduceat(lattice.log_p[edges], at[:-1])  # of the words' segmentations
            upto = np.cumsum(log_p)
            began = (upto - log_p)[np.minimum(lo[:-1], len(log_p) - 1)]
            before = np.repeat(np.array([r.todo[2] for r in active]) - began, sizes) + upto - log_p
            rest = np.log(-np.expm1(np.minimum(log_p, -1e-16)))
            rest[log_p == 0] = -np.inf  # a word with one segmentation
            g = _bounded(before + rest, _uniform(seeds + _M2), np.repeat(np.array([r.todo[0] for r in active]), sizes))
        for i, r in enumerate(active):
            bound, head, so_far, state, word = r.todo
            a, b = int(lo[i]), int(lo[i + 1])
            e = int(at[a])
            r.paths.append(np.concatenate((head, edges[e : at[b]])))
            r.scores.append((float(before[b - 1] + log_p[b - 1]) if b > a else so_far, bound))
            own = g[a:b] if b > a else np.empty(0)
            best = np.argpartition(-own, samples)[:samples] if len(own) > samples else np.arange(len(own))
            for j in best.tolist():
                if own[j] > -np.inf:
                    first = len(head) - e
                    heapq.heappush(r.queue, (-float(own[j]), k, first + int(at[a + j]), first + int(at[a + j + 1]), (), float(before[a + j]), word + j - (state >= 0)))
            r.todo = None
        if k + 1 < samples:
            for r in active:
                if r.queue:
                    _expand(lattice, r, k)


def _expand(lattice: Lattice, r: _Row, k: int) -> None:
    """Takes the best set off the queue and draws an edge of it to go on from; what is left of the set goes back."""
    minus, of, lo, hi, taken, before, word = heapq.heappop(r.queue)
    path = r.paths[of]
    key = np.uint64(r.key)
    if not taken:  # a word: the piece at which its segmentation changes
        own = path[lo:hi]
        log_p = lattice.log_p[own]
        each = before + np.cumsum(log_p) - log_p
        phi = each + lattice.log_rest(own)
        share = np.cumsum(np.exp(phi - phi.max()))
        u = _uniform(key + np.uint64(2 * k + 5001) * _M1 + np.arange(len(own) + 1, dtype=np.uint64) * _STEP)
        j = min(int(np.searchsorted(share, u[-1] * share[-1])), len(own) - 1)
        for i, g in enumerate(_bounded(phi, u[:-1], -minus).tolist()):
            if i != j and g > -math.inf:
                heapq.heappush(r.queue, (-g, of, lo + i, lo + i + 1, (int(own[i]),), float(each[i]), word))
        lo, taken, before = lo + j, (int(own[j]),), float(each[j])
    state = int(lattice.state[path[lo]])
    edges = np.array([e for e in range(int(lattice.first[state]), int(lattice.first[state + 1])) if e not in taken])
    p = np.exp(lattice.log_p[edges])
    u = _uniform(key + np.array([2 * k + 1001, 2 * k + 1002], dtype=np.uint64) * _M1)
    pick = min(int(np.searchsorted(np.cumsum(p), u[0] * p.sum())), len(edges) - 1)
    e = int(edges[pick])
    left = float(p.sum() - p[pick])
    if left > 0 and len(edges) > 1:
        g = float(_bounded(np.array([before + math.log(left)]), u[1:], -minus)[0])
        heapq.heappush(r.queue, (-g, of, lo, lo + 1, (*taken, e), before, word))
    r.todo = (-minus, np.append(path[:lo], np.int32(e)), before + float(lattice.log_p[e]), int(lattice.next[e]), word + 1)


class Segmenter:
    """Sampled segmentations of batches of texts."""

    def __init__(self, pieces: list[tuple[str, float]] | Vocabulary, samples: int = SAMPLES):
        self.vocab, self.samples = pieces if isinstance(pieces, Vocabulary) else Vocabulary(pieces), samples
        self.lattice, self.known, self.before = Lattice(self.vocab), {}, np.zeros(BEFORE, dtype=bool)
        self.kept = self.lattice.sizes

    def ids(self, lattice: Lattice, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the edges, bytes spelled out, and where each edge's ids begin (and the last one's end)."""
        piece = lattice.piece[path]
        raw = np.flatnonzero(piece < 0)
        c = -1 - piece[raw].astype(np.int64)
        n = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        at = np.zeros(len(path) + 1, dtype=np.int64)
        at[1:] = 1
        at[raw + 1] = n
        np.cumsum(at, out=at)
        out = np.empty(int(at[-1]), dtype=np.int32)
        out[at[:-1]] = piece
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            m = n > k
            bits = c[m] >> (6 * (n[m] - 1 - k))
            byte = np.where(n[m] == 1, c[m], lead[n[m]] | bits) if k == 0 else 0x80 | (bits & 0x3F)
            out[at[raw[m]] + k] = self.vocab.bytes_at[byte]
        return out, at

    @staticmethod
    def _indexed(texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Of each text its units as places in a list of the distinct ones, which stand there without their first mark.

        Texts whose words lie between single blanks are split and told apart by Arrow, others one by one.
        """
        plain = [bool(t) and "  " not in t and t[0] != " " and t[-1] != " " and MARK not in t for t in texts]
        parts = pc.split_pattern(pa.array(list(compress(texts, plain)), pa.string()), " ")
        found = parts.flatten().dictionary_encode()
        at, ends = found.indices.to_numpy(), (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
        names, rows = found.dictionary.to_pylist(), iter([at[a:b] for a, b in zip(ends, ends[1:])])
        if all(plain):
            return list(rows), names
        place = dict(zip(names, range(len(names))))
        out = [next(rows) if p else np.array([place.setdefault(u[1:], len(place)) for u in units(t)], dtype=np.int32) for t, p in zip(texts, plain)]
        return out, list(place)

    def _numbered(self, names: list[str]) -> np.ndarray:
        """Numbers of distinct units; lattices of units that are new here are added, those that are not to be kept last."""
        out = np.fromiter(map(self.known.get, names, repeat(-1)), dtype=np.int32, count=len(names))
        new = np.flatnonzero(out < 0)
        fresh = [names[k] for k in new.tolist()]
        at = np.fromiter(map(hash, fresh), dtype=np.int64, count=len(fresh)) & (BEFORE - 1)
        back = self.before[at]
        self.before[at] = True
        sizes = np.fromiter(map(len, fresh), dtype=np.int64, count=len(fresh)) + 1
        room = min(KEPT - len(self.known), int(np.searchsorted(np.cumsum(sizes[back]), KEPT_CHARS - self.lattice.sizes[1], side="right")))
        stays = back.copy()
        stays[np.flatnonzero(back)[max(0, room) :]] = False
        stay, go, k = list(compress(fresh, stays.tolist())), list(compress(fresh, (~stays).tolist())), len(self.known)
        self.known.update(zip(stay, range(k, k + len(stay))))
        out[new[stays]] = np.arange(k, k + len(stay))
        out[new[~stays]] = np.arange(k + len(stay), k + len(fresh))
        if stay:
            self.lattice.add([MARK + u for u in stay])
        self.kept = self.lattice.sizes
        if go:
            self.lattice.add([MARK + u for u in go])
        return out

    def sample(self, keys: list[int], texts: list[str]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to `samples` (ids, log_prob, perturbed, log_inclusion), best first."""
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            places, names = self._indexed(texts)
            numbers, lattice = self._numbered(names), self.lattice
            rows = [_Row(key % (1 << 64), numbers[at].astype(np.int64)) for key, at in zip(keys, places)]
            del places, names
            search(lattice, rows, self.samples)
        paths = [path for r in rows for path in r.paths]
        flat = np.concatenate(paths) if paths else np.empty(0, dtype=np.int64)
        ids, at = self.ids(lattice, flat)
        cuts = at[np.concatenate(([0], np.cumsum([len(x) for x in paths], dtype=np.int64)))].tolist()
        out, k = [], 0
        for r in rows:
            limit = -r.queue[0][0] if len(r.scores) == self.samples and r.queue else -math.inf
            got = []
            for log_p, g in r.scores:
                x = log_p - limit
                inclusion = 0.0 if x > 3.6 or limit == -math.inf else (x if x < -30 else math.log(-math.expm1(-math.exp(x))))
                got.append((ids[cuts[k] : cuts[k + 1]], log_p, g, inclusion))
                k += 1
            out.append(got)
        lattice.cut(self.kept)
        return out


def _encoder(vocab: Vocabulary, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(vocab, samples)
        raw = pa.array(segmenter.vocab.raw, pa.binary())
        made = 0
        for b in batches:
            ids, keys, texts = b.column(0), b.column(1).to_pylist(), b.column(2)
            lo = 0
            while lo < b.num_rows:
                hi, size, some = lo, 0, []
                while hi < b.num_rows and size < BATCH_WORDS:
                    some.append(texts[hi].as_py() or "")
                    size += len(some[-1]) // 6 + 1
                    hi += 1
                found = segmenter.sample(keys[lo:hi], some)
                row = [k for k, got in enumerate(found) for _ in got]
                flat = [x for got in found for x in got]
                sizes = np.fromiter((len(x[0]) for x in flat), dtype=np.int64, count=len(flat))
                pieces_of = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate([x[0] for x in flat]) if flat else np.empty(0, np.int32), pa.int32()))
                same = pc.equal(joined(raw, pieces_of), pa.array([b" " + some[k].encode() if some[k] else b"" for k in row], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(row, pa.int64())),
                        pa.array([k for got in found for k in range(1, len(got) + 1)], pa.int32()),
                        pa.array(sizes), pieces_of, *(pa.array([x[k] for x in flat], pa.float64()) for k in (1, 2, 3)), same,
                    ],
                    names=["doc_id", "sample", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion", "round_trip"],
                )
                lo = hi
                del found, flat, some, pieces_of, same
                made += 1
                if made % RELEASE == 0:
                    release()
        release()

    return run


def with_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one more column last: 0, or 0, 1, 2... over the rows of one id and text, which are alike, so it is no matter
    which has which number.

    Ids that repeat are found without texts. Only their rows are numbered, inside the parts of the scan and by the counts of the
    parts before, so that a row that is there a billion times is numbered in as many tasks as read it; and only they are joined
    with their numbers.
    """
    docs = stable(docs, "encoded")
    rid, copy = unused(docs, "_rid", "_copy")
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    ids = written(docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64(F.lit("id"), "id").alias("h")), "repeated-ids")
    if ids.isEmpty():
        discard(ids)
        return docs.withColumn(copy, F.lit(0).cast("long"))
    own = F.xxhash64(F.lit("id"), F.col(id_col))
    maybe = probe(ids, "h")(own)
    some = written(rows.where(maybe).select(F.col(rid).alias("r"), F.sha2(F.to_json(F.struct(F.col(id_col).cast("string"), F.col(text_col).cast("string"))).cast("binary"), 256).alias("same")), "repeated-rows")
    some = some.withColumn("part", F.shiftright("r", 33))
    counts = some.groupBy("same", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("same").orderBy("part")) - F.col("n")).drop("n")
    place = F.row_number().over(W.partitionBy("same", "part").orderBy("r")) - 1
    numbers = some.withColumn("place", place).join(before, ["same", "part"]).select(F.col("r").alias(rid), (F.col("place") + F.col("base")).cast("long").alias(copy))
    alone = rows.where(~maybe).withColumn(copy, F.lit(0).cast("long"))
    return alone.unionByName(rows.where(maybe).join(numbers, rid)).drop(rid)


def encode_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, samples: int = SAMPLES) -> DataFrame:
    """doc_id, sample (1 is the best), n_pieces, ids, log_prob, perturbed, log_inclusion, round_trip: up to `samples` rows per
    input row. round_trip: whether the pieces decode to the text again.

    Texts with fewer segmentations have fewer rows, at least one; null text counts as empty, whose one segmentation has
    no pieces. The row's key is its id (a null one too) and, where rows repeat an id and text, the row's number among them: each
    has samples of its own, the same whatever the order of rows. Segmentations of equal score come in order of their pieces'
    places in the search. Other columns are ignored. An empty table gives an empty result. docs is written first if it is no scan.
    """
    copies = with_copies(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text")
    key = F.xxhash64(F.lit("pieces"), F.col("doc_id").cast("string"))
    key = F.when(F.col("_copy") == 0, key).otherwise(F.xxhash64(F.lit("pieces"), F.col("doc_id").cast("string"), F.col("_copy")))
    rows = copies.select("doc_id", key.alias("key"), "text")
    return rows.mapInArrow(_encoder(Vocabulary(load_pieces(model)), samples), "doc_id long, sample int, n_pieces long, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean")


def joined(raw: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The bytes that lists of piece ids stand for: a text's, with one blank more at its start if it is not empty."""
    start, end = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
    parts = pa.ListArray.from_arrays(pc.subtract(ids.offsets, start), raw.take(ids.values.slice(start, end - start)))
    return pc.binary_join(parts, b"")


def decoded(raw: list[bytes], ids) -> str:
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with a column `decoded`: the text of the ids (null for null ids)."""
    raw = Vocabulary(load_pieces(model)).raw

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decoded(raw, x) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))
