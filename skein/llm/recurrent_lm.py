"""Language-model scoring with a gated recurrent network, in numpy.

The network is a GRU over the WORDS most frequent tokens, the end of a document and one symbol for all other words. Its
output is class-factored: words sorted by frequency form CLASSES classes of equal size, and log p(word) is log p(class)
plus log p(word | class). A word that the network has no symbol for gets the symbol's probability times its share of the
unigram mass of such words, so that the score is a probability over the same tokens as the unigram base.

Documents are laid end to end in LANES lanes and worked off in windows of WINDOW tokens: the state is carried from a
window to the next through a whole document and reset at the next one's start. Training (truncated backpropagation: one
update a window) and scoring share these lanes, which take the next document whenever one ends, so a task holds the
documents in its lanes and no others.

Every token of every training document is trained on: the documents are cut into ROUNDS parts, and in each part shards (one
for each SHARD_TOKENS) train side by side and are averaged, a group of FAN at a time until one network is left. A corpus has
passes for ENOUGH tokens in all, PASSES at most: one pass is too few updates for a small one. Output biases start at the
unigram distribution. Token counts cover all words of all training documents.

Texts are read twice: for the counts, and to code them as symbols, which training and scoring read. The DICTIONARY most
frequent words (of at most WORD_BYTES bytes: a bounded table) are looked up on the worker; all other words are joined
with the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import crc_mod, small_batches, written

HIDDEN, CLASSES, CLASS_SIZE = 24, 32, 32
SYMBOLS = CLASSES * CLASS_SIZE
END, OTHER, WORDS = 0, 1, SYMBOLS - 2
WINDOW, LANES = 16, 256
SHARD_TOKENS, ROUNDS, FAN, ENOUGH, PASSES = 4_000_000, 2, 64, 1_200_000, 24
#: Texts of more tokens come first in a task, the longest before all: no lane is left alone with one at the end.
LONG = 2048
#: The rate rises over the first WARM_UP updates of a shard, so that few tokens move the network little from the unigram distribution.
LEARNING_RATE, WARM_UP = 1e-2, 64
DICTIONARY, WORD_BYTES = 1 << 17, 64
#: Rows of a task's word counts that are held before they are combined, or passed on if that leaves over half of them.
HELD = 1_000_000
#: Tokens of a window in scoring, where windows are only a matter of speed.
SCORED = 8
#: Windows that the lanes are filled for at a time.
AHEAD = 32
ALPHA = 0.1


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, A-Z lower-cased (null: none), and where each text's begin and the last one's
    end. The end token is not among them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    whole = pc.not_equal(flat, "")  # blanks at a text's ends leave empty pieces
    return flat.filter(whole), np.concatenate(([0], np.cumsum(whole.to_numpy(zero_copy_only=False))))[ends]


def _slices(kinds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the tokens by class, and each class with the first and last place that it takes in it."""
    ends = np.cumsum(np.bincount(kinds, minlength=CLASSES)).tolist()
    return np.argsort(kinds.astype(np.uint8), kind="stable"), [(c, lo, hi) for c, (lo, hi) in enumerate(zip([0, *ends], ends)) if hi > lo]


def _row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)  # a product is faster than a sum over short rows


class Network:
    """Parameters: x (input projections of the symbols, gates z, r and candidate n), u, class and word outputs.

    A gate is (1 + tanh(a)) / 2 of its input a: the logistic function of twice the input.
    """

    SHAPES = {"x": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (CLASSES, HIDDEN, CLASS_SIZE), "bw": (CLASSES, CLASS_SIZE)}

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 7) -> Network:
        """counts: of the symbols; biases give their unigram distribution."""
        rng = np.random.default_rng(seed)
        c = np.maximum(counts.astype(np.float64), ALPHA).reshape(CLASSES, CLASS_SIZE)
        p = {k: (rng.standard_normal(s) * (0.3 if k == "u" else 0.1)).astype(np.float32) for k, s in cls.SHAPES.items()}
        p["ww"] *= 0.3
        p["wc"] *= 0.3
        p["bc"] = np.log(c.sum(1) / c.sum()).astype(np.float32)
        p["bw"] = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
        return cls(p)

    def pack(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).astype(np.float32).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        flat, at, p = np.frombuffer(data, dtype=np.float32), 0, {}
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            p[k] = flat[at : at + n].reshape(s).copy()
            at += n
        return cls(p)

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next state, from projected inputs."""
        return self._step(x, h, h @ self.p["u"], np.empty((len(h), 2 * HIDDEN), h.dtype), np.empty_like(h), np.empty_like(h))

    @staticmethod
    def _step(x: np.ndarray, h: np.ndarray, g: np.ndarray, zr: np.ndarray, n: np.ndarray, out: np.ndarray) -> np.ndarray:
        """out, from h and its projection g; fills zr (the gates) and n (the candidate)."""
        np.add(x[:, : 2 * HIDDEN], g[:, : 2 * HIDDEN], out=zr)
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        np.multiply(zr[:, HIDDEN:], g[:, 2 * HIDDEN :], out=n)
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[:, :HIDDEN]
        out += n
        return out

    def states(self, ids: np.ndarray, h0: np.ndarray, keep: bool = True) -> tuple[np.ndarray, ...]:
        """Over ids [time, lane] from h0: the states after each step, and (keep: of all steps, else of the last) the states
        before, projections of those onto the candidate, gates, candidates. A lane whose input is END begins a document: its
        state before is 0."""
        (steps, lanes), kind, x, u = ids.shape, self.p["u"].dtype, self.p["x"], self.p["u"]
        after, kept = np.empty((steps, lanes, HIDDEN), kind), steps if keep else 1
        before, gn, n = (np.empty((kept, lanes, HIDDEN), kind) for _ in range(3))
        zr, xs, g = np.empty((kept, lanes, 2 * HIDDEN), kind), np.empty((lanes, 3 * HIDDEN), kind), np.empty((lanes, 3 * HIDDEN), kind)
        starts = ids == END
        some = starts.any(1).tolist()
        for t in range(steps):
            k = t if keep else 0
            h = before[k]
            h[:] = after[t - 1] if t else h0
            if some[t]:
                h[starts[t]] = 0.0
            np.take(x, ids[t], axis=0, out=xs, mode="clip")
            np.matmul(h, u, out=g)
            gn[k] = g[:, 2 * HIDDEN :]
            self._step(xs, h, g, zr[k], n[k], after[t])
        return after, before, gn, zr, n

    def log_p(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target symbol after state h."""
        p, n = self.p, np.arange(len(target))
        cls, word = target // CLASS_SIZE, target % CLASS_SIZE
        logits = h @ p["wc"]
        logits += p["bc"]
        out = logits[n, cls].astype(np.float64)
        out -= np.log(_row_sums(np.exp(logits, out=logits)))
        order, parts = _slices(cls)
        h, word, logits = h.take(order, axis=0), word[order], np.empty((len(target), CLASS_SIZE), h.dtype)
        for c, lo, hi in parts:
            np.matmul(h[lo:hi], p["ww"][c], out=logits[lo:hi])
            logits[lo:hi] += p["bw"][c]
        own = logits[n, word]
        out[order] += own.astype(np.float64) - np.log(_row_sums(np.exp(logits, out=logits)))
        return out

    def gradients(self, ids: np.ndarray, target: np.ndarray, valid: np.ndarray, h0: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the mean loss over a window: ids, target, valid [time, lane]; state before it. Also the state after it, and the loss."""
        p, (steps, lanes) = self.p, ids.shape
        after, before, gn, zr, n = self.states(ids, h0)
        d, dh_all, loss = self._output_gradients(after.reshape(-1, HIDDEN), target.ravel(), valid.ravel())
        dh_all = dh_all.reshape(steps, lanes, HIDDEN)
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        by_z, by_n, by_r = (before - n) * z, 1 - n * n, gn * r  # each times what the gate's slope leaves
        by_z *= 2 * (1 - z)
        by_n *= 1 - z
        by_r *= 2 * (1 - r)
        dg, dn, starts = np.empty((steps, lanes, 3 * HIDDEN), n.dtype), np.empty_like(n), ids == END
        some = starts.any(1).tolist()
        back, dh, more = np.ascontiguousarray(p["u"].T), np.zeros((lanes, HIDDEN), n.dtype), np.empty((lanes, HIDDEN), n.dtype)
        for t in range(steps - 1, -1, -1):
            dh += dh_all[t]
            np.multiply(dh, by_z[t], out=dg[t, :, :HIDDEN])
            np.multiply(dh, by_n[t], out=dn[t])
            np.multiply(dn[t], by_r[t], out=dg[t, :, HIDDEN : 2 * HIDDEN])
            np.multiply(dn[t], r[t], out=dg[t, :, 2 * HIDDEN :])
            dh *= z[t]
            dh += np.matmul(dg[t], back, out=more)
            if some[t]:
                dh[starts[t]] = 0.0
        flat = dg.reshape(-1, 3 * HIDDEN)
        d["u"] = before.reshape(-1, HIDDEN).T @ flat
        dg[:, :, 2 * HIDDEN :] = dn  # from here on the gradients of the inputs
        d["x"] = np.zeros_like(p["x"])
        common = ids.ravel() == OTHER  # about half of all, summed by a product
        d["x"][OTHER] = common.astype(flat.dtype) @ flat
        rest = np.flatnonzero(~common)
        seen = ids.ravel()[rest].astype(np.int16)
        order = np.argsort(seen, kind="stable")
        seen = seen[order]
        first = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1]))) if len(seen) else rest
        if len(first):
            d["x"][seen[first]] = np.add.reduceat(flat.take(rest[order], axis=0), first, axis=0)
        return d, after[-1], loss

    def _output_gradients(self, h: np.ndarray, target: np.ndarray, valid: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the outputs' parameters and of the states h, and the mean loss of the valid targets."""
        p, n = self.p, np.arange(len(target))
        scale = (valid / max(1, int(valid.sum()))).astype(h.dtype)
        cls, word = target // CLASS_SIZE, target % CLASS_SIZE
        soft = h @ p["wc"]
        soft += p["bc"]
        np.exp(soft, out=soft)
        soft /= _row_sums(soft)[:, None]
        loss = -float((np.log(soft[n, cls]) * scale).sum())
        soft[n, cls] -= 1.0
        soft *= scale[:, None]
        d = {"wc": h.T @ soft, "bc": soft.sum(0), "ww": np.zeros(self.SHAPES["ww"], h.dtype), "bw": np.zeros(self.SHAPES["bw"], h.dtype)}
        dh = soft @ p["wc"].T
        order, parts = _slices(cls)
        h, word, scale, soft = h.take(order, axis=0), word[order], scale[order], np.empty((len(target), CLASS_SIZE), h.dtype)
        for c, lo, hi in parts:
            np.matmul(h[lo:hi], p["ww"][c], out=soft[lo:hi])
            soft[lo:hi] += p["bw"][c]
        np.exp(soft, out=soft)
        soft /= _row_sums(soft)[:, None]
        loss -= float((np.log(soft[n, word]) * scale).sum())
        soft[n, word] -= 1.0
        soft *= scale[:, None]
        more = np.empty_like(h)
        for c, lo, hi in parts:
            np.matmul(h[lo:hi].T, soft[lo:hi], out=d["ww"][c])
            d["bw"][c] = soft[lo:hi].sum(0)
            np.matmul(soft[lo:hi], p["ww"][c].T, out=more[lo:hi])
        dh[order] += more
        return d, dh, loss


class Lanes:
    """Windows over documents that are laid end to end in lanes; a document is a number and its symbols, END last.

    Iteration gives (kept, ids, target, owner): the lanes of the window before that go on (None at the start), inputs and
    targets [time, lane], and the number of each target's document, -1 where a lane has come to its end. At a document's
    start the input is END.
    """

    def __init__(self, docs: Iterator[tuple[int, np.ndarray]], lanes: int | None = None, window: int | None = None):
        self.docs, self.most, self.window = iter(docs), lanes or LANES, window or WINDOW
        self.over = False

    def _next(self) -> tuple[int, np.ndarray] | None:
        doc = None if self.over else next(self.docs, None)
        self.over = doc is None
        return doc

    def __iter__(self) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]]:
        lanes: list[list[tuple[int, np.ndarray]]] = []  # what each lane has still to give
        while len(lanes) < self.most and (doc := self._next()):
            lanes.append([doc])
        last, span, begun = np.full(len(lanes), END, dtype=np.int64), AHEAD * self.window, False
        while lanes:
            symbols, owner = np.full((len(lanes), span), END, dtype=np.int64), np.full((len(lanes), span), -1, dtype=np.int64)
            for k, own in enumerate(lanes):
                at = 0
                while at < span and (own or (doc := self._next())):
                    who, rest = own.pop() if own else doc
                    n = min(len(rest), span - at)
                    symbols[k, at : at + n], owner[k, at : at + n] = rest[:n], who
                    at += n
                    if n < len(rest):
                        own.append((who, rest[n:]))
            size = (owner >= 0).sum(1)
            order = np.argsort(-size, kind="stable")[: int((size > 0).sum())]  # lanes that end come last
            symbols, owner, size, last = symbols[order].T, owner[order].T, size[order], last[order]
            for lo in range(0, span, self.window):
                live = int((size > lo).sum())
                if not live:
                    break
                target = symbols[lo : lo + self.window, :live]
                ids = np.concatenate((last[None, :live], target[:-1]))
                yield (np.arange(live) if lo else order if begun else None), ids, target, owner[lo : lo + self.window, :live]
                last, begun = target[-1], True
            full = int((size == span).sum())
            lanes, last = [lanes[k] for k in order[:full]], last[:full]


class Trainer:
    """Adam over windows of lanes."""

    def __init__(self, net: Network, rate: float = LEARNING_RATE):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros(s, dtype=np.float32) for k, s in Network.SHAPES.items()}
        self.v = {k: np.zeros(s, dtype=np.float32) for k, s in Network.SHAPES.items()}
        self.room = {k: np.empty(s, dtype=np.float32) for k, s in Network.SHAPES.items()}

    def update(self, d: dict[str, np.ndarray]) -> None:
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in d.values()))
        shrink = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        self.t += 1
        step = np.float32(self.rate * min(1.0, self.t / WARM_UP) * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, g in d.items():  # in place: m += 0.1 (g - m), v += 0.001 (g * g - v), p -= step * m / sqrt(v)
            m, v, room = self.m[k], self.v[k], self.room[k]
            g *= shrink
            np.subtract(g, m, out=room)
            room *= np.float32(0.1)
            m += room
            g *= g
            g -= v
            g *= np.float32(0.001)
            v += g
            np.sqrt(v, out=room)
            room += np.float32(1e-6)
            np.divide(m, room, out=room)
            room *= step
            self.net.p[k] -= room

    def texts(self, rows: Iterator[np.ndarray]) -> int:
        """One update a window over all lanes; rows: symbols, END before and after. Returns the tokens trained on.

        Where few lanes are left, the gradients of several windows make one update, so that a last text weighs no more than others.
        """
        least, n = WINDOW * LANES // 2, 0
        held: dict[str, np.ndarray] = {}
        size, h = 0, np.zeros((0, HIDDEN), dtype=np.float32)
        for kept, ids, target, owner in Lanes((0, r[1:]) for r in rows):
            h = np.zeros((ids.shape[1], HIDDEN), dtype=np.float32) if kept is None else h[kept]
            valid = owner >= 0
            d, h, _ = self.net.gradients(ids, target, valid, h)
            now = int(valid.sum())
            n += now
            if size or now < least:
                for k, g in d.items():
                    held[k] = held.get(k, 0.0) + g * np.float32(now / least)
                size += now
                if size < least:
                    continue
                d = {k: g * np.float32(least / size) for k, g in held.items()}
                held, size = {}, 0
            self.update(d)
        if size:
            self.update(held)
        return n


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def combined() -> pa.Table:
        out = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return out.select(["word", "n_sum"]).rename_columns(["word", "n"])

    for b in batches:
        found = pc.value_counts(words_of(b.column(0))[0])
        held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
        held.append(pa.table({"word": pa.array([""]), "n": pa.array([b.num_rows], pa.int64())}))
        if sum(t.num_rows for t in held) > HELD:
            held = [combined()]
            if held[0].num_rows > HELD // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from combined().to_batches()


class Lexicon:
    """The dictionary: base log10 probabilities and symbols of its words, and the constants of the rest."""

    def __init__(self, words: list[tuple[str, int]], total: int, distinct: int):
        """words: most frequent first, without the end (whose word is empty), which comes as an entry too."""
        self.total, self.distinct = total, distinct
        self.floor = total + ALPHA * (distinct + 1)
        self.table = pa.array([w for w, _ in words], pa.string())
        n = np.array([c for _, c in words], dtype=np.float64)
        self.base = np.log10((n + ALPHA) / self.floor)
        self.symbol = np.full(len(words), OTHER, dtype=np.int16)
        ranked = [k for k, (w, _) in enumerate(words) if w][:WORDS]
        self.symbol[ranked] = np.arange(2, 2 + len(ranked))
        self.end = next(k for k, (w, _) in enumerate(words) if not w)
        self.symbol[self.end] = END
        self.counts = np.zeros(SYMBOLS)
        np.add.at(self.counts, self.symbol, n)
        self.counts[OTHER] = max(0.0, total - self.counts.sum() + self.counts[OTHER])
        inside = self.symbol != OTHER
        #: log10 of the base's mass of words without a symbol, the unknown type included.
        self.log_other = math.log10(max(1e-12, 1.0 - float((10.0 ** self.base[inside]).sum())))

    @property
    def words(self) -> dict[bytes, int]:
        return {w.encode(): k for k, w in enumerate(self.table.to_pylist())}

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Places in the dictionary, -1 for words that are not there."""
        return pc.fill_null(pc.index_in(words, value_set=self.table), -1).to_numpy()

    def symbols(self, found: np.ndarray) -> np.ndarray:
        return np.where(found >= 0, self.symbol[found], OTHER)


CODED = "symbols binary, n_tokens long, known long, base double, other double, rare array<string>"


def _symbols(lexicon: Lexicon):
    """For the last column, a text, of each whole document (CODED, after the other columns): its symbols, END before and
    after; the tokens; of those in the dictionary how many and their base log10 probability; what the score adds to the
    network's for words without a symbol; the words that are not in the dictionary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, at = words_of(b.column(b.num_columns - 1))
            sizes, row, found = np.diff(at), np.arange(b.num_rows), lexicon.look_up(words)
            tokens = np.full(len(found) + len(row), lexicon.end, dtype=np.int32)  # each text's words, then the end
            tokens[np.arange(len(found)) + np.repeat(row, sizes)] = found
            first = at[:-1] + row
            symbols, inside = lexicon.symbols(tokens), tokens >= 0
            other, base = symbols == OTHER, np.where(inside, lexicon.base[tokens], 0.0)
            more = np.add.reduceat(np.where(other, base, 0.0), first) - lexicon.log_other * np.add.reduceat(other.astype(np.int64), first)
            coded = np.full(len(tokens) + len(row), END, dtype=np.int16)
            coded[np.arange(len(tokens)) + np.repeat(row + 1, sizes + 1)] = symbols
            places = pa.py_buffer((np.append(first + row, len(coded)) * 2).astype(np.int32))
            missing = found < 0
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(missing)))[at].astype(np.int32)), words.filter(pa.array(missing)))
            cols = [
                pa.Array.from_buffers(pa.binary(), len(row), [None, places, pa.py_buffer(coded)]), pa.array(sizes + 1, pa.int64()), pa.array(np.add.reduceat(inside.astype(np.int64), first)),
                pa.array(np.add.reduceat(base, first)), pa.array(more), rare,
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], "symbols", "n_tokens", "known", "base", "other", "rare"])

    return run


def _training(start: bytes, passes: int = 1):
    """One row: the tokens trained on in a pass and the network. More than one pass is only for few tokens, which are held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (np.frombuffer(s, dtype=np.int16) for b in batches for s in b["symbols"])
        trainer, held = Trainer(Network.unpack(start)), rows if passes == 1 else list(rows)
        for _ in range(passes):
            n = trainer.texts(held)
        if n:
            yield pd.DataFrame({"n": [n], "net": [trainer.net.pack()]})

    return run


def _average(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of rows n, net: the networks' mean, each as often as it has tokens."""
    rows = rows.sort_values(["n", "net"])
    total = int(rows["n"].sum())
    flat = sum(np.frombuffer(net, dtype=np.float32).astype(np.float64) * (n / total) for n, net in zip(rows["n"], rows["net"]))
    return pd.DataFrame({"n": [total], "net": [flat.astype(np.float32).tobytes()]})


def averaged(nets: DataFrame) -> bytes | None:
    """The mean of a table of networks (n, net), merged FAN at a time on the executors; the driver sees FAN of them at most."""
    while (count := nets.count()) > FAN:
        group = F.pmod(F.xxhash64("n", "net"), F.lit(-(-count // FAN)))
        nets = written(nets.withColumn("group", group).groupBy("group").applyInPandas(_average, "n long, net binary"), "lm-nets")
    return bytes(_average(nets.toPandas())["net"][0]) if count else None


def _long_first() -> Column:
    return F.desc(F.greatest(F.length("symbols"), F.lit(2 * LONG)))


def train(coded: DataFrame, lexicon: Lexicon) -> Network:
    """coded: columns key (long: shard, part and order follow from it) and symbols of the training documents, as a table.

    A shard is a partition, its network a row of a table in the shared folder.
    """
    net = Network.start(lexicon.counts)
    size = int(coded.agg(F.sum(F.length("symbols") / 2 - 1)).first()[0] or 0)
    shards, passes = max(1, size // SHARD_TOKENS), min(PASSES, max(1, ENOUGH // max(1, size)))
    for part in range(ROUNDS):
        own = coded.where(F.pmod(F.shiftright("key", 32), F.lit(ROUNDS)) == part)
        dealt = own.select("key", "symbols").repartition(shards, "key").sortWithinPartitions(_long_first(), "key", "symbols").select("symbols")
        mean = averaged(written(dealt.mapInPandas(_training(net.pack(), passes), "n long, net binary"), "lm-nets"))
        net = Network.unpack(mean) if mean else net
    return net


def _scores(net: Network, docs: Iterator[tuple[int, np.ndarray]], lanes: int | None = None) -> Iterator[tuple[int, float]]:
    """(number, log10 probability) of documents (symbols, END last), each as soon as it is over."""
    sums: dict[int, float] = {}
    h = np.zeros((0, HIDDEN), dtype=np.float32)
    for kept, ids, target, owner in Lanes(docs, lanes, SCORED):
        h = np.zeros((ids.shape[1], HIDDEN), dtype=np.float32) if kept is None else h[kept]
        states = net.states(ids, h, keep=False)[0]
        h, valid = states[-1], owner >= 0
        log_p = net.log_p(states.reshape(-1, HIDDEN), target.ravel()).reshape(target.shape)
        log_p[~valid] = 0.0
        over = (target == END) & valid
        rest = np.ones(ids.shape[1], dtype=bool)  # lanes in which no document ends are summed at once
        rest[over.any(0)] = False
        for who, s in zip(owner[0, rest].tolist(), log_p[:, rest].sum(0).tolist()):
            sums[who] = sums.get(who, 0.0) + s
        for k in np.flatnonzero(~rest).tolist():
            lo = 0
            for hi in [*(np.flatnonzero(over[:, k]) + 1).tolist(), int(valid[:, k].sum())]:
                if hi > lo:
                    who = int(owner[lo, k])
                    sums[who] = sums.get(who, 0.0) + float(log_p[lo:hi, k].sum())
                    if over[hi - 1, k]:
                        yield who, sums.pop(who) / math.log(10)
                lo = hi


def score_symbols(net: Network, rows: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each row of symbols (the last one END), all of a row with one state carried through."""
    out = np.zeros(len(rows))
    for k, s in _scores(net, enumerate(rows)):
        out[k] = s
    return out


def _scoring(net_bytes: bytes):
    """(rid, symbols) to (rid, score); rows come as their documents end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids: dict[int, int] = {}

        def docs() -> Iterator[tuple[int, np.ndarray]]:
            n = 0
            for b in batches:
                for rid, s in zip(b.column(0), b.column(1)):
                    rids[n] = rid.as_py()
                    yield n, np.frombuffer(s.as_py(), dtype=np.int16)[1:]
                    n += 1

        def out(rows: list[tuple[int, float]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.float64())], names=["rid", "net"])

        rows: list[tuple[int, float]] = []
        for k, s in _scores(Network.unpack(net_bytes), docs()):
            rows.append((rids.pop(k), s))
            if len(rows) == 10_000:
                yield out(rows)
                rows = []
        yield out(rows)

    return run


def count_words(rows: DataFrame) -> DataFrame:
    """word, n over all words of column text; the empty word stands for the ends."""
    return rows.select("text").mapInArrow(_counting, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = DICTIONARY) -> list[tuple[str, int]]:
    """The words as frequent as the most frequent `most` or fewer, whole ranks of frequency; the end is always there."""
    short = counts.where((F.octet_length("word") <= WORD_BYTES) & (F.col("word") != ""))
    ranks = short.groupBy("n").agg(F.count("*").alias("k"))  # a row per distinct count, about the square root of the tokens
    cut = ranks.withColumn("upto", F.sum("k").over(W.orderBy(F.desc("n")))).where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    got = [] if cut is None else [(r.word, r.n) for r in short.where(F.col("n") >= cut).toLocalIterator()]
    ends = counts.where(F.col("word") == "").first()
    return [("", ends.n if ends else 0), *sorted(got, key=lambda x: (-x[1], x[0]))]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null text counts as empty, whose one token is the end. A null id is not held out and is learned from. Without any
    training document base_score and score are 0. Rows that repeat are scored one by one, alike. Other columns are
    ignored. An empty table gives an empty result.
    """
    held = F.coalesce(crc_mod(id_col, 10) == 0, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = written(count_words(rows.where(~F.col("held_out"))), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lexicon = Lexicon(frequent(counts), total, distinct)
    schema = T.StructType([*rows.drop("text").schema, *T.StructType.fromDDL(CODED)])
    with small_batches(docs.sparkSession):
        coded = written(rows.mapInArrow(_symbols(lexicon), schema), "lm-symbols")
    learned = coded.where(~F.col("held_out")).select(F.xxhash64("doc_id", "symbols").alias("key"), "symbols")
    net = train(learned, lexicon) if total else Network.start(lexicon.counts)
    nets = coded.select("rid", "symbols").sortWithinPartitions(_long_first()).mapInArrow(_scoring(net.pack()), "rid long, net double")

    own = F.log10((F.coalesce("n", F.lit(0)) + ALPHA) / lexicon.floor)
    rare = coded.select("rid", F.explode("rare").alias("word")).groupBy("rid", "word").agg(F.count("*").alias("times"))
    more = (
        rare.join(counts, "word", "left").groupBy("rid")
        .agg(F.sum(own * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    zero = F.lit(0.0)
    add = F.coalesce("more", zero)
    known = F.coalesce("more_known", F.lit(0)) + F.col("known") - F.lit(0 if total else 1)
    out = coded.drop("rare", "symbols").join(written(nets, "lm-scores"), "rid").join(more, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + add if total else zero).alias("base_score"), (F.col("net") + F.col("other") + add if total else zero).alias("score"),
    )
