"""Language-model scoring: a gated recurrent network in numpy with a class-factored output, over exact token counts.

Tokens are longest runs of bytes other than ASCII white space, A-Z lower-cased, then one end for each text. Tokens
are told apart by 64-bit hashes. Counts cover all training texts. The most frequent tokens, at
most HEAD of them, are the head, which every worker holds; the others are rare, and their counts reach the texts that
have them by a join.

The network predicts the next token's class, and for the WORDS most frequent tokens the word within it; within the
other classes (bins of head tokens by frequency, and one for all rare and unknown tokens) a token has its share of the
class by count. So each token of a text has a probability. Biases begin at the training frequencies. Training is
truncated backpropagation over windows of WINDOW tokens, with the state carried from window to window. Each training
text is learned once, in one of ROUNDS rounds and there in one of as many shards as the number of tokens says; both,
and the order within, follow from a hash of the row. In a round each shard trains a copy of the network, and the copies
are averaged by tokens seen, in the order of shards; the next round begins there. So equal tables give equal networks,
however their rows are dealt over files and tasks. Scoring carries the state over windows from a text's first token to
its end.

Edge cases: a null text is an empty one: its end is its only token. Rows get a number of their own before the join, so
null and repeated ids are safe. Without training texts counts are 0 and the network stays at its start. Equal counts
are ordered by hash. Training rows that are equal in all columns go to one shard."""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asserta.llm._common import chunks, one_thread, written
from asserta.llm.textvec import words

HEAD = 1 << 20
GROUPS, PER_GROUP, BINS = 32, 32, 15
WORDS = GROUPS * PER_GROUP  # the end among them
CLASSES = GROUPS + BINS + 1
RARE = WORDS + BINS  # the network's number of a rare token; bins come before it
DIM, HIDDEN = 24, 32
ROUNDS, PER_SHARD, SHARDS = 4, 500_000, 4096  # tokens of a shard, unless more than SHARDS were needed in a round
TRAIN_LANES, WINDOW, WINDOWS = 256, 20, 150  # as many lanes as leave WINDOWS windows, if that isn't too many
RATES, WARM = (6e-3, 6e-3, 4e-3, 2e-3), 50  # by round; the first one's rises over WARM steps
DOOR = 20  # upper bits of a hash that the head is entered by
LANES, STEPS, WASTE = 256, 64, 4  # a grid has at most about WASTE times as many cells as tokens
CELLS = 2048  # what tokens give is computed for so many at once, as the processor's cache holds it
END = np.uint64(0x656E64206F662074).astype(np.int64)


class Counts(NamedTuple):
    """The head by ascending hash, and what is known of all training tokens."""

    keys: np.ndarray
    logs: np.ndarray  # log10(count + 0.5)
    number: np.ndarray  # the network's number: a word, or WORDS and a bin
    within: np.ndarray  # log10 of the share of the class; 0 for words
    total: int
    kinds: int
    rare_total: int
    rare_kinds: int
    start_class: np.ndarray  # log of each class's frequency
    start_word: np.ndarray
    door: np.ndarray  # by the upper part of a hash, its first key


def tokens(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends among them, and where each text's begin and the last end."""
    w = words(texts)
    counts = np.diff(w.first)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(at[-1], END, np.int64)
    is_word = np.ones(at[-1], bool)
    is_word[at[1:] - 1] = False
    out[is_word] = w.hash.view(np.int64)
    return out, at


def count(docs: DataFrame) -> DataFrame:
    """Each training token's hash and count. docs has a column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(tokens(piece)[0], return_counts=True) for _, piece in chunks(batch.column(0))]
            if found:
                keys, n = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(np.add.reduceat(n, at))], names=["token", "n"])

    return docs.select(F.col("text").alias("text_read")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def step_of(n: str) -> Column:
    return F.floor(F.log2(F.col(n)) * 8)


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[Counts, int]:
    """What workers hold, and the least step of frequency in the head; a doubling has eight steps. counts: written, as
    it is read twice. The tally has a row for each step; the head at most `most` rows."""
    tally = sorted((tuple(r) for r in counts.groupBy(step_of("n").alias("step")).agg(F.count("*").alias("c"), F.sum("n").alias("sum")).collect()), reverse=True)
    kept, least = 0, 1 << 62
    for step, c, _ in tally:
        if kept + c > most:
            break
        kept, least = kept + c, step
    head = counts.where(step_of("n") >= least).toArrow()
    keys, n = (np.asarray(head.column(i).to_numpy(), np.int64) for i in range(2))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    if END not in keys:
        at = np.searchsorted(keys, END)
        keys, n = np.insert(keys, at, END), np.insert(n, at, 0)
    total, kinds = sum(n for _, _, n in tally), sum(c for _, c, _ in tally)
    rare_total, rare_kinds = total - int(n.sum()), kinds - kept
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, -n, keys != END))] = np.arange(len(keys))
    number = np.where(rank < WORDS, rank, 0)
    rest = rank >= WORDS
    # Bins by rank, each up to twice the ranks of the one before
    edges = WORDS * 2.0 ** (np.arange(1, BINS) * np.log2(max(2.0, len(keys) / WORDS)) / BINS)
    bins = np.searchsorted(edges, rank, "right")
    number[rest] = WORDS + bins[rest]
    mass = np.bincount(bins[rest], n[rest], BINS) + 0.5 * np.bincount(bins[rest], minlength=BINS)
    within = np.zeros(len(keys))
    within[rest] = np.log10((n[rest] + 0.5) / mass[bins[rest]])
    word = np.full(WORDS, 0.5)
    word[number[~rest]] += n[~rest]
    classes = np.concatenate([word.reshape(GROUPS, PER_GROUP).sum(1), mass + 0.5, [rare_total + 0.5 * (rare_kinds + 1)]])
    start_class = np.log(classes / classes.sum())
    return Counts(keys, np.log10(n + 0.5), number, within, total, kinds, rare_total, rare_kinds, start_class.astype(np.float32), np.log(word).astype(np.float32), doors(keys)), least


def look_up(c: Counts, hashes: np.ndarray) -> np.ndarray:
    """Places in the head, -1 for others: keys are ascending, and `door` tells where those with each upper part begin,
    so few are compared."""
    at = _upper(hashes)
    at, end = c.door[at], c.door[at + 1]
    out = np.full(len(hashes), -1)
    left = np.flatnonzero(at < end)
    while len(left):
        hit = c.keys[at[left]] == hashes[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < end[left]]
    return out


def _upper(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.int64(64 - DOOR)) + (1 << DOOR - 1)


def doors(keys: np.ndarray) -> np.ndarray:
    return np.searchsorted(_upper(keys), np.arange((1 << DOOR) + 1))


def lanes(at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end in at most `width` lanes, the longest first, each on the shortest lane. Gives by step and
    lane the token's number, or -1 past a lane's end, and whether a text begins there. Beside one very long text there
    are fewer lanes, so that cells stay in proportion to tokens."""
    size = np.diff(at)
    width = min(width, max(1, WASTE * int(at[-1]) // int(size.max())))
    order = np.argsort(-size, kind="stable")
    load = [0] * width
    heap = [(0, k) for k in range(width)]
    own: list[list[int]] = [[] for _ in range(width)]
    for d in order.tolist():
        used, k = heapq.heappop(heap)
        own[k].append(d)
        load[k] = used + int(size[d])
        heapq.heappush(heap, (load[k], k))
    grid = np.full((max(load), width), -1, np.int64)
    fresh = np.zeros((max(load), width), bool)
    for k, texts in enumerate(own):
        step = 0
        for d in texts:
            grid[step : step + size[d], k] = np.arange(at[d], at[d + 1])
            fresh[step, k] = True
            step += int(size[d])
    return grid, fresh


def sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def exps(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of each row, less its greatest number where any is too large or small for that; and the rows' sums. logit is
    changed."""
    if logit.max() > 60 or logit.min() < -60:
        logit -= logit.max(1, keepdims=True)
    e = np.exp(logit)
    return e, e @ np.ones(logit.shape[1], e.dtype)


class Network:
    """Shapes of all parameters in one vector, forward and backward."""

    SHAPES = {"emb": (RARE + 1, DIM), "wx": (DIM, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (GROUPS, PER_GROUP, HIDDEN), "bw": (GROUPS, PER_GROUP)}

    def __init__(self, vector: np.ndarray):
        at = 0
        self.vector = vector
        self.p: dict[str, np.ndarray] = {}
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            self.p[name] = vector[at : at + n].reshape(shape)
            at += n

    @classmethod
    def start(cls, c: Counts) -> Network:
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values()), np.float32))
        rng = np.random.Generator(np.random.PCG64(6))
        for name in ("emb", "wx", "wh"):
            net.p[name][:] = rng.normal(0, 1 / np.sqrt(net.p[name].shape[-2] if name != "emb" else DIM), net.p[name].shape)
        net.p["bc"][:] = c.start_class
        net.p["bw"][:] = c.start_word.reshape(GROUPS, PER_GROUP)
        return net

    def states(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """x: numbers of the tokens read, by step and lane. The states after each step; what backward needs: by step,
        the state before it, both gates, the new part and what the state adds to it. Inside, lanes are the last axis, so
        that each part is contiguous."""
        p, (steps, width) = self.p, x.shape
        dtype, rz = p["wh"].dtype, 2 * HIDDEN
        # Gates' inputs are negated, as their function needs them
        sign = np.ones((3 * HIDDEN, 1), dtype)
        sign[:rz] = -1
        wh, wx, b = sign * p["wh"].T, sign * p["wx"].T, sign * p["b"][:, None]
        out = np.empty((steps, HIDDEN, width), dtype)
        saved = np.empty((steps if keep else 1, 5, HIDDEN, width), dtype)
        g = np.empty((3 * HIDDEN, width), dtype)
        to_gates, to_new = g[:rz], g[rz:]
        before, r, z, n, gn = saved[0]
        gates = saved[0, 1:3].reshape(rz, width)
        h, begins = np.ascontiguousarray(h.T), fresh.any(1).tolist()
        block = max(1, CELLS // width)
        for t in range(steps):
            if t % block == 0:
                a = np.matmul(wx, p["emb"].take(x[t : t + block], 0).transpose(0, 2, 1))
                a += b
            if begins[t]:
                h = np.where(fresh[t], dtype.type(0), h)
            if keep:
                before, r, z, n, gn = saved[t]
                gates = saved[t, 1:3].reshape(rz, width)
            read, new = a[t % block], out[t]
            np.matmul(wh, h, out=g)
            np.add(read[:rz], to_gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(r, to_new, out=n)
            n += read[rz:]
            np.tanh(n, out=n)
            if keep:
                before[:], gn[:] = h, to_new
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
        return out.transpose(0, 2, 1), saved.transpose(0, 1, 3, 2)

    def outputs(self, h: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target's class, and word if it is one; the loss's gradient by h. Targets are
        ordered by class, so that each class's are a slice."""
        p = self.p
        klass = np.where(y < WORDS, y // PER_GROUP, y - WORDS + GROUPS).astype(np.int16)
        order = np.argsort(klass, kind="stable")
        h, klass, y = h.take(order, 0), klass[order], y[order]
        logit = h @ p["wc"]
        logit += p["bc"]
        e, s = exps(logit)
        rows = np.arange(len(y))
        found = logit[rows, klass] - np.log(s)
        dh = None
        if grad is not None:
            e *= (1 / s)[:, None]
            e[rows, klass] -= 1
            grad["wc"] += h.T @ e
            grad["bc"] += np.ones(len(y), e.dtype) @ e
            dh = e @ p["wc"].T
        edge = np.searchsorted(klass, np.arange(GROUPS + 1)).tolist()
        own = [(k, slice(edge[k], edge[k + 1])) for k in range(GROUPS) if edge[k] < edge[k + 1]]
        if own:
            rows, word = rows[: edge[-1]], y[: edge[-1]] % PER_GROUP
            logit = np.empty((edge[-1], PER_GROUP), e.dtype)
            for k, at in own:
                np.matmul(h[at], p["ww"][k].T, out=logit[at])
            logit += p["bw"].take(klass[: edge[-1]], 0)
            e, s = exps(logit)
            found[: edge[-1]] += logit[rows, word] - np.log(s)
            if grad is not None:
                e *= (1 / s)[:, None]
                e[rows, word] -= 1
                for k, at in own:
                    grad["ww"][k] += e[at].T @ h[at]
                    dh[at] += e[at] @ p["ww"][k]
                grad["bw"][[k for k, _ in own]] += np.add.reduceat(e, [at.start for _, at in own])
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return found[back], None if dh is None else dh.take(back, 0)

    def backward(self, x: np.ndarray, fresh: np.ndarray, saved: np.ndarray, dout: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        p, (steps, width) = self.p, x.shape
        saved, dout = np.asarray(saved).transpose(0, 1, 3, 2), np.ascontiguousarray(dout.transpose(0, 2, 1))
        emb = np.concatenate([p["emb"], np.ones((RARE + 1, 1), dout.dtype)], 1).take(x, 0)  # the bias is as of one more
        begins = fresh.any(1).tolist()
        wh = np.ascontiguousarray(p["wh"])
        # A step's gradients, for the new part as the token gives it, both gates, and the new part as the state gives it
        d = np.empty((4, HIDDEN, width), dout.dtype)
        to_new, gates, to_old = d[0], d[1:3], d[3]
        by_token, by_state = d[:3].reshape(3 * HIDDEN, width), d[1:].reshape(3 * HIDDEN, width)
        turn = np.roll(np.arange(3 * HIDDEN), HIDDEN)  # from the parameters' order to by_token's
        wx = p["wx"][:, turn]
        by_emb, to_wx = np.empty((steps, DIM, width), dout.dtype), np.zeros((DIM + 1, 3 * HIDDEN), dout.dtype)
        dh, rest = np.zeros((HIDDEN, width), dout.dtype), np.empty((2, HIDDEN, width), dout.dtype)
        for t in range(steps - 1, -1, -1):
            h, r, z, n, gn = saved[t]
            dh += dout[t]
            np.subtract(1, saved[t, 1:3], out=rest)
            np.multiply(n, n, out=to_new)
            np.subtract(1, to_new, out=to_new)
            to_new *= rest[1]
            np.multiply(to_new, r, out=to_old)
            np.multiply(to_old, gn, out=gates[0])
            np.subtract(h, n, out=gates[1])
            gates[1] *= z
            gates *= rest
            d *= dh
            grad["wh"] += h @ by_state.T
            to_wx += emb[t].T @ by_token.T
            np.matmul(wx, by_token, out=by_emb[t])
            dh *= z
            dh += wh @ by_state
            if begins[t]:
                dh[:, fresh[t]] = 0
        grad["wx"][:, turn] += to_wx[:DIM]
        grad["b"][turn] += to_wx[DIM]
        # Sums by the token read
        seen = x.ravel().astype(np.int16)
        order = np.argsort(seen, kind="stable")
        seen = seen[order]
        begin = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        grad["emb"][seen[begin]] += np.add.reduceat(by_emb.transpose(0, 2, 1).reshape(-1, DIM).take(order, 0), begin)


def read_tokens(c: Counts, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the head, the network's number, the number read before it: the end at a text's first)."""
    place = look_up(c, hashes)
    y = np.where(place >= 0, c.number[place], RARE)
    x = np.concatenate([[0], y[:-1]])
    x[at[:-1]] = 0
    return place, y, x


class Adam:
    def __init__(self, n: int):
        self.first, self.second, self.step = np.zeros(n, np.float32), np.zeros(n, np.float32), 0

    def move(self, vector: np.ndarray, d: np.ndarray, rate: float) -> None:
        self.step += 1
        self.first += np.float32(0.1) * (d - self.first)
        self.second += np.float32(0.01) * (d * d - self.second)
        vector -= np.float32(rate / (1 - 0.9**self.step)) * self.first / (np.sqrt(self.second * np.float32(1 / (1 - 0.99**self.step))) + np.float32(1e-6))


def train(pieces: Iterable[tuple[np.ndarray, np.ndarray]], c: Counts, vector: np.ndarray, round_: int) -> tuple[np.ndarray, int]:
    """The parameters after truncated backpropagation over pieces (hashes, where texts begin), and tokens seen. A
    piece's tokens are one stream, dealt in equal parts to lanes."""
    net = Network(vector.astype(np.float32))
    adam, seen = Adam(len(net.vector)), 0
    for hashes, at in pieces:
        _, y, x = read_tokens(c, hashes, at)
        n = len(y)
        width = max(1, min(TRAIN_LANES, n // (WINDOW * WINDOWS)))
        height = -(-n // width)
        grid = np.arange(width * height).reshape(width, height).T
        begins = np.zeros(width * height, bool)
        begins[at[:-1]] = True
        x, y = (np.append(a, np.zeros(width * height - n, np.int64))[grid] for a in (x, y))
        begins, there = begins[grid], grid < n
        h = np.zeros((width, HIDDEN), np.float32)
        for t in range(0, height, WINDOW):
            read, target, fresh, on = (a[t : t + WINDOW] for a in (x, y, begins, there))
            out, saved = net.states(read, fresh, h, True)
            grad = Network(np.zeros_like(net.vector))
            k = int(on.sum())
            if k == on.size:
                dout = net.outputs(out.reshape(-1, HIDDEN), target.ravel(), grad.p)[1].reshape(out.shape)
            else:  # a lane's end is past the last token
                dout = np.zeros_like(out)
                dout[on] = net.outputs(out[on], target[on], grad.p)[1]
            net.backward(read, fresh, saved, dout, grad.p)
            d = grad.vector
            d *= np.float32(min(1.0 / k, 1.0 / (float(np.sqrt(d @ d)) + 1e-9 * k)))
            adam.move(net.vector, d, RATES[round_] * (min(1.0, (adam.step + 1) / WARM) if not round_ else 1.0))
            h = out[-1]
            seen += k
    return net.vector, seen


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows (shard, text) in order, as (shard, hashes, where texts begin and the last ends): pieces of PER_SHARD tokens,
    or up to one text more, whatever the batches are. A shard's rest of under half a piece goes with the piece before,
    as a piece of its own would take nearly as many steps, over few lanes."""
    shard, held, sizes = None, [], []

    def piece(n: int) -> tuple[int, np.ndarray, np.ndarray]:
        return shard, np.concatenate(held[:n]), np.concatenate([[0], np.cumsum(sizes[:n])])

    for batch in batches:
        of = batch.column(0).to_numpy()
        for start, texts in chunks(batch.column(1)):
            hashes, at = tokens(texts)
            for d in range(len(texts)):
                if held and of[start + d] != shard:
                    yield piece(len(held))
                    held, sizes = [], []
                if not held:
                    shard, whole, more = int(of[start + d]), 0, 0  # texts of a whole piece, tokens of the next one
                held.append(hashes[at[d] : at[d + 1]])
                sizes.append(int(at[d + 1] - at[d]))
                more += sizes[-1]
                if whole and more >= PER_SHARD // 2:
                    yield piece(whole)
                    held, sizes, whole = held[whole:], sizes[whole:], 0
                if not whole and more >= PER_SHARD:
                    whole, more = len(held), 0
    if held:
        yield piece(len(held))


def averaged(docs: DataFrame, c: Counts) -> np.ndarray:
    """The network after all rounds over docs, the training texts."""
    spark, vector = docs.sparkSession, Network.start(c).vector
    shards = min(SHARDS, math.ceil(c.total / (ROUNDS * PER_SHARD)))
    if not shards:
        return vector
    groups = math.ceil(math.sqrt(shards))
    counts = spark.sparkContext.broadcast(c)
    key = F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns])
    rows = docs.select(F.pmod(key, F.lit(ROUNDS)).alias("round"), F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), key.alias("key"), F.col("text").alias("text_read"))
    for round_ in range(ROUNDS):
        start = spark.sparkContext.broadcast(vector)

        def run(batches: Iterator[pa.RecordBatch], round_=round_, start=start) -> Iterator[pa.RecordBatch]:
            one_thread()
            for shard, own in itertools.groupby(pieces_of(batches), lambda x: x[0]):
                trained, seen = train(((hashes, at) for _, hashes, at in own), counts.value, start.value, round_)
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([seen]), pa.array([trained.astype(np.float64).tobytes()])], names=["shard", "seen", "vector"])

        own = rows.where(F.col("round") == round_).repartition(shards, "shard").sortWithinPartitions("shard", "key").select("shard", "text_read")
        copies = own.mapInArrow(run, "shard long, seen long, vector binary").withColumn("group", F.col("shard") % groups)
        sums = copies.repartition(groups, "group").sortWithinPartitions("group", "shard").select("group", "seen", "vector").mapInArrow(summed, "group long, seen long, vector binary")
        found = sorted((r["group"], r["seen"], r["vector"]) for r in sums.collect())  # the root of the shards' number, at most 64
        if found:
            vector = sum(np.frombuffer(v) for _, _, v in found) / sum(n for _, n, _ in found)
    return vector.astype(np.float32)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, seen, vector) in order: each group's tokens and its vectors' sum, weighted by them."""
    rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3))))
    for group, own in itertools.groupby(rows, lambda r: r[0]):
        total, vector = 0, None
        for _, seen, x in own:
            add = np.frombuffer(x) * seen
            total, vector = total + seen, add if vector is None else vector + add
        yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([total]), pa.array([vector.tobytes()])], names=["group", "seen", "vector"])


def log_likelihood(c: Counts, net: Network, y: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 of what the network gives each token's class, and word if it is one."""
    grid, fresh = lanes(at, min(LANES, max(1, len(at) - 1)))
    out = np.zeros(len(y))
    h, live = np.zeros((grid.shape[1], HIDDEN), np.float32), np.arange(grid.shape[1])
    for t in range(0, len(grid), STEPS):
        on = grid[t, live] >= 0  # lanes that have ended stay so
        live, h = live[on], h[on]
        g, f = grid[t : t + STEPS, live], fresh[t : t + STEPS, live]
        there = g >= 0
        states, _ = net.states(np.where(there, x[g], 0), f, h)
        spot = g[there]
        out[spot] = net.outputs(states.reshape(-1, HIDDEN) if len(spot) == g.size else states[there], y[spot])[0]
        h = states[-1]
    return out / np.log(10)


def score(docs: DataFrame, training: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, then n_tokens, n_known, train_tokens, base_score and score. Both tables have a
    column text; `keep` has none of the new names."""
    counts = written(count(training), "tokens")
    c, least = head_of(counts)
    held = docs.sparkSession.sparkContext.broadcast((c, averaged(training, c)))
    kept = [F.col(f"`{k}`") for k in keep]
    tail = T.ArrayType(T.StructType([T.StructField("token", T.LongType()), T.StructField("times", T.IntegerType())]))
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("head_tokens", T.LongType()), T.StructField("head_base", T.DoubleType()), T.StructField("part", T.DoubleType()), T.StructField("rare", tail)]
    schema = T.StructType(docs.select(*kept).schema.fields + new)
    kind = pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int32())]))
    norm = np.log10(c.total + 0.5 * (c.kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        c, vector = held.value
        net = Network(vector)
        for batch in batches:
            for start, piece in chunks(batch.column(batch.num_columns - 1), 1 << 23):
                hashes, at = tokens(piece)
                place, y, x = read_tokens(c, hashes, at)
                known = place >= 0
                base = np.where(known, c.logs[place] - norm, 0.0)
                part = log_likelihood(c, net, y, x, at) + np.where(known, c.within[place], 0.0)
                # Rare tokens by text: (text, token) pairs and how often each occurs
                spot = np.flatnonzero(~known)
                text = np.searchsorted(at, spot, "right") - 1
                order = np.lexsort((hashes[spot], text))
                text, token = text[order], hashes[spot][order]
                edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (token[1:] != token[:-1])])) if len(spot) else spot
                times = np.diff(np.append(edge, len(spot))).astype(np.int32)
                offsets = np.searchsorted(text[edge], np.arange(len(piece) + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(token[edge]), pa.array(times)], fields=list(kind.value_type)))
                made = [pa.array(np.diff(at)), pa.array(np.add.reduceat(known.astype(np.int64), at[:-1])), pa.array(np.add.reduceat(base, at[:-1])), pa.array(np.add.reduceat(part, at[:-1])), rare]
                rest = [batch.column(i).slice(start, len(piece)) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[f.name for f in schema.fields])

    rows = docs.select(*kept, F.col("text").alias("text_read")).mapInArrow(run, schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    each = rows.select("row", F.inline("rare"))
    rare = counts.where(step_of("n") < least)
    n = F.coalesce("n", F.lit(0))
    sums = each.join(rare, "token", "left").groupBy("row").agg(F.sum("times").alias("times"), F.sum(F.when(n > 0, F.col("times"))).alias("met"), F.sum(F.log10(n + 0.5) * F.col("times")).alias("logs"))
    joined = rows.drop("rare").join(sums, "row", "left")
    times, met, logs = (F.coalesce(x, F.lit(0)) for x in ("times", "met", "logs"))
    rare_norm = float(np.log10(c.rare_total + 0.5 * (c.rare_kinds + 1)))
    return joined.select(
        *kept,
        "n_tokens",
        (F.col("head_tokens") + met - (F.lit(0) if c.logs[look_up(c, np.array([END]))[0]] > 0 else F.lit(1))).alias("n_known"),
        F.lit(int(c.total)).cast("long").alias("train_tokens"),
        (F.col("head_base") + logs - times * float(norm)).alias("base_score"),
        (F.col("part") + logs - times * rare_norm).alias("score"),
    )
