"""LM scoring by masked pseudo-likelihood, with a bidirectional window network trained in numpy.

The network predicts a token from the ``SIDE`` tokens on each side, never from itself: one input table for each place,
summed, tanh, and a binary decision at each node of a Huffman tree on the way to the token, so probabilities add up to 1
over a vocabulary of any size. A document's score is the sum over its words of the log-probability of the word given both
sides (its pseudo-log-likelihood).

The vocabulary follows the corpus: the most frequent words, ``GROWTH`` times the root of the number of tokens, counted
over all documents, and a quarter as many classes by hash for the rest. A word of a class has the class's probability
divided by the number of words in it. ``MOST`` bounds the words, since the model is sent to every executor; it is reached
at 1.7e10 tokens.

Documents are written once as token numbers and dealt to parts by a hash of the document; the number of parts follows
the root of the number of tokens, so what the parts send back grows as the corpus does. In each of ``ROUNDS`` rounds every
part starts from the same weights, reads its documents in the order of their hashes, with one token in ``ROUNDS`` masked,
drawn by document and place, and sends its weights; the rounds' draws are disjoint and together mask every token once.
The mean of the weights, weighted by tokens, starts the next round. So neither files nor partitions nor batches change
the model. Spark sums the weights in pieces; the driver sees one model and no text.

Tokens are runs of ASCII letters in lower case, digits and other characters from 0x80. A null text, or one without
tokens, scores 0 with no mean. Repeated rows give a row each. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import cut, release
from tidemark.llm import words as W

WORDS, BUCKETS, GROWTH, MOST = 224, 32, 2, 1 << 18  # least numbers of words and classes, words by the root of the tokens, most words
SIDE, HIDDEN = 2, 16  # the last hidden unit is always 1, so it carries the bias
ROUNDS, BATCH, RATE = 2, 8192, 0.2  # a batch has about the root of the number of tokens, BATCH at most
PIECE, NEAR = 1 << 13, 96
TOKENS_A_PART = 800  # times the root of the number of tokens
PLACES = [i for i in range(-SIDE, SIDE + 1) if i]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, held, size = W.alnum_table(), [], 0
    for b in batches:
        for block in W.blocks(b.column("text"), table, lower=True):
            held.append(np.unique(block.hashes(), return_counts=True))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield _merged(held)
                held, size = [], 0
    if held:
        yield _merged(held)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    key, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    total = np.bincount(where, np.concatenate([c for _, c in held]), len(key)).astype(np.int64)
    return W.batch({"word": (W.signed(key), pa.int64()), "c": (total, pa.int64())})


@dataclass
class Vocabulary:
    """Words by hash, in order, with their tokens 0, 1, ...; after them come the classes, ``log_size`` being a class's words."""

    words: np.ndarray
    counts: np.ndarray  # of each token in the corpus
    log_size: np.ndarray

    @property
    def size(self) -> int:
        return len(self.counts)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        token = (len(self.words) + (h % W.U(len(self.log_size)))).astype(np.int32)
        if len(self.words):
            at = np.searchsorted(self.words, h)
            at[at == len(self.words)] = 0
            same = self.words[at] == h
            token[same] = at[same]
        return token

    def shares(self) -> np.ndarray:
        """The logarithm of the number of words behind each token."""
        return np.append(np.zeros(len(self.words)), self.log_size)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The most frequent words of all documents, and classes of the others."""
    counts = docs.select("text").mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = cut(counts, "words")
    levels = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("c", ascending=False)  # one row a count
    c, n = levels["c"].to_numpy(np.int64), levels["n"].to_numpy(np.int64)
    wanted = min(MOST, max(WORDS, math.ceil(GROWTH * math.sqrt((c * n).sum()))))
    whole = int(np.searchsorted(np.cumsum(n), wanted, "right"))  # counts of which all words are taken
    least = int(c[whole - 1]) if whole else 2**62
    is_known = F.col("c") >= least
    if whole < len(c):  # of the next count, words drawn by hash
        part = (wanted - int(n[:whole].sum())) / int(n[whole])
        is_known |= (F.col("c") == int(c[whole])) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(part * (1 << 20)))
    top = counts.where(is_known).toArrow()
    word, count = top["word"].to_numpy().view(W.U), top["c"].to_numpy()
    order = np.argsort(word)
    classes = 1 << max(BUCKETS.bit_length() - 1, math.ceil(math.log2(max(1, len(word) / 4))))
    rest = counts.where(~is_known).groupBy(F.pmod("word", F.lit(classes)).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    held, words = np.zeros(classes, np.int64), np.ones(classes)
    held[rest["k"].to_numpy()] = rest["c"].to_numpy()
    words[rest["k"].to_numpy()] = rest["n"].to_numpy()
    release(counts)
    return Vocabulary(word[order], np.concatenate([count[order], held]), np.log(words))


def _encode(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = Vocabulary(*sent.value), W.alnum_table()
        for b in batches:
            for block in W.blocks(b.column("text"), table, lower=True):
                tokens = pa.ListArray.from_arrays(pa.array(block.first, pa.int32()), pa.array(known.tokens(block.hashes()), pa.int32()))
                part = b.slice(block.lo, block.rows)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), tokens], names=["key", "doc_id", "tokens"])

    return run


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """The written table (key, doc_id, tokens) of the documents; ``key`` is a hash of a document's id and text."""
    sent = docs.sparkSession.sparkContext.broadcast((known.words, known.counts, known.log_size))  # MOST words at most, as plain arrays
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long"), "text")
    return cut(rows.mapInArrow(_encode(sent), "key long, doc_id long, tokens array<int>"), "tokens")


def _rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words of each, tokens, tokens around them by place), about 64k tokens at a time; beyond a document stands token ``size``."""
    for b in batches:
        lengths = pa.compute.list_value_length(b.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, lo = np.append(0, np.cumsum(lengths)), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + (1 << 16), "right")) - 1)
            part, n = b.slice(lo, hi - lo), lengths[lo:hi]
            token = part.column("tokens").flatten().to_numpy()
            padded = np.full(len(token) + (hi - lo + 1) * SIDE, size, np.int32)  # documents are SIDE tokens apart
            at = np.arange(len(token)) + np.repeat(np.arange(1, hi - lo + 1) * SIDE, n)
            padded[at] = token
            yield part, n, token, np.stack([padded[at + i] for i in PLACES])
            lo = hi


class Tree:
    """A Huffman tree over tokens: each token's inner nodes from the leaf up, and the side (1 or -1) taken at each.

    Inner nodes are numbered by weight, so the last ``NEAR`` are on most of all steps. They are kept apart as a token's
    near steps, the others as its far steps.
    """

    NAMES = ("near_first", "near_node", "near_side", "far_first", "far_node", "far_side")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        for name in Tree.NAMES:
            setattr(self, name, arrays[name])
        self.size = len(self.near_first) - 1
        self.lo = max(0, self.size - 1 - NEAR)

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name) for name in Tree.NAMES}

    @staticmethod
    def build(counts: np.ndarray) -> Tree:
        n = len(counts)
        order = np.argsort(counts, kind="stable")
        weight = [*(counts[order].astype(float) + 1).tolist(), *[0.0] * (n - 1)]
        parent, side = [0] * (2 * n - 1), [1.0] * (2 * n - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):  # leaves and inner nodes both come in order of weight
            for s in (1.0, -1.0):
                if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, inner = inner, inner + 1
                parent[at], side[at] = new, s
                weight[new] += weight[at]
        parent, side = np.array(parent), np.array(side, np.float32)
        at, who = np.arange(n), np.arange(n)
        nodes, sides, whose = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
        while (below := at != 2 * n - 2).any():
            at, who = at[below], who[below]
            nodes.append((parent[at] - n).astype(np.int32))
            sides.append(side[at])
            whose.append(order[who])
            at = parent[at]
        node, side, whose = np.concatenate(nodes), np.concatenate(sides), np.concatenate(whose)
        by_token = np.argsort(whose, kind="stable")
        node, side, whose = node[by_token], side[by_token], whose[by_token]
        out = {}
        near = node >= max(0, n - 1 - NEAR)
        for name, part in (("near", near), ("far", ~near)):
            out |= {f"{name}_first": np.searchsorted(whose[part], np.arange(n + 1)), f"{name}_node": node[part], f"{name}_side": side[part]}
        return Tree(out)


def _steps(first: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps of each token, the token's row by step, place of each step)."""
    start = first[token]
    length = first[token + 1] - start
    upto = np.cumsum(length)
    row = np.repeat(np.arange(len(token)), length)
    return length, row, np.arange(len(row)) + (start - upto + length)[row]


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order of keys from 0 up: by halves of 16 bits, which numpy sorts by counting."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    if len(key) and key.max() > 0xFFFF:
        order = order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the rows of each key."""
    order = _order(key)
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.add.reduceat(values.take(order, axis=0), at, axis=0)


class Network:
    """``inputs``: a row for each place and token; ``outputs``: a row for each inner node of the tree."""

    def __init__(self, tree: Tree, inputs: np.ndarray | None = None, outputs: np.ndarray | None = None) -> None:
        draw, self.tree = np.random.default_rng(0), tree
        first = inputs is None
        self.inputs = (draw.standard_normal((len(PLACES), tree.size + 1, HIDDEN)) * 0.1).astype(np.float32) if first else inputs.copy()
        self.outputs = (draw.standard_normal((max(1, tree.size - 1), HIDDEN)) * (np.arange(HIDDEN) < HIDDEN - 1) * 0.1).astype(np.float32) if first else outputs.copy()

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inputs.ravel(), self.outputs.ravel()])

    @staticmethod
    def unflat(values: np.ndarray, tree: Tree) -> Network:
        form = (len(PLACES), tree.size + 1, HIDDEN)
        n = int(np.prod(form))
        return Network(tree, values[:n].reshape(form), values[n:].reshape(-1, HIDDEN))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.inputs[0].take(around[0], axis=0)
        for i in range(1, len(PLACES)):
            total += self.inputs[i].take(around[i], axis=0)
        np.tanh(total, out=total)
        total[:, -1] = 1
        return total

    def _forward(self, token: np.ndarray, h: np.ndarray) -> tuple:
        """Signed logits of the near steps and of the far ones, with what leads to them."""
        t, out = self.tree, self.outputs
        near_length, row, step = _steps(t.near_first, token)
        cell, near_side = row * (len(out) - t.lo) + (t.near_node[step] - t.lo), t.near_side[step]
        near = (h @ out[t.lo :].T).ravel().take(cell) * near_side
        far_length, far_row, step = _steps(t.far_first, token)
        node, far_side = t.far_node[step], t.far_side[step]
        here, there = h.take(far_row, axis=0), out.take(node, axis=0)
        far = np.einsum("ij,ij->i", here, there) * far_side
        return (near, cell, near_side, near_length), (far, node, far_side, far_length, far_row, here, there)

    def log_probability(self, token: np.ndarray, around: np.ndarray) -> np.ndarray:
        out = np.empty(len(token))
        for lo in range(0, len(token), BATCH):
            part = slice(lo, lo + BATCH)
            (near, *_, near_length), (far, _, _, far_length, *_) = self._forward(token[part], self.hidden(around[:, part]))
            total = np.zeros(len(token[part]))
            for z, length in ((near, near_length), (far, far_length)):
                cost = np.append(0, np.cumsum(np.maximum(-z, 0) + np.log1p(np.exp(-np.abs(z))), dtype=float))
                upto = np.cumsum(length)
                total -= cost[upto] - cost[upto - length]
            out[part] = total
        return out

    def sparse(self, token: np.ndarray, around: np.ndarray) -> list[tuple[str, object, np.ndarray]]:
        """(name, rows, gradient there) of the summed negative log-probability, where it is not 0."""
        h, t, out = self.hidden(around), self.tree, self.outputs
        (near, cell, near_side, _), (far, node, far_side, far_length, _, here, there) = self._forward(token, h)
        top = out[t.lo :]
        pull = np.zeros((len(token), len(top)), np.float32)
        pull.ravel()[cell] = -near_side / (1 + np.exp(np.minimum(near, 80)))
        back = pull @ top
        found = [("outputs", slice(t.lo, None), pull.T @ h)]
        if len(node):
            pull = (-far_side / (1 + np.exp(np.minimum(far, 80))))[:, None]
            some = np.flatnonzero(far_length)
            begin = np.cumsum(far_length[some]) - far_length[some]
            back[some] += np.add.reduceat(pull * there, begin, axis=0)
            found.append(("outputs", *_summed(node, pull * here)))
        back *= 1 - h * h
        for i in range(len(PLACES)):
            at, g = _summed(around[i], back)
            found.append(("inputs", (i, at), g))
        return found

    def learn(self, token: np.ndarray, around: np.ndarray, squares: dict[str, np.ndarray]) -> None:
        """One step of AdaGrad."""
        for name, at, g in self.sparse(token, around):
            mine, sums = getattr(self, name), squares[name]
            if name == "inputs":
                mine, sums, at = mine[at[0]], sums[at[0]], at[1]
            whole = isinstance(at, slice)
            now = g * g
            now += sums[at] if whole else sums.take(at, axis=0)
            sums[at] = now
            np.sqrt(now, out=now)
            np.divide(g, now, out=now)
            now *= -RATE
            if whole:
                mine[at] += now
            else:
                now += mine.take(at, axis=0)
                mine[at] = now

    def squares(self) -> dict[str, np.ndarray]:
        return {"inputs": np.ones_like(self.inputs), "outputs": np.ones_like(self.outputs)}


def masked(key: np.ndarray, lengths: np.ndarray, turn: int) -> np.ndarray:
    """Which tokens of documents with these keys and lengths a round masks."""
    row, place = W.spread(lengths)
    return np.flatnonzero(W.mix(key.view(W.U)[row] + place.astype(W.U)) % W.U(ROUNDS) == turn)


def _pieces(net: Network, seen: int) -> Iterator[pa.RecordBatch]:
    flat = net.flat()
    for lo in range(0, len(flat), 64 * PIECE):
        pieces = [flat[k : k + PIECE].tobytes() for k in range(lo, min(len(flat), lo + 64 * PIECE), PIECE)]
        yield W.batch({"k": (lo // PIECE + np.arange(len(pieces)), pa.int32()), "seen": (np.full(len(pieces), seen), pa.float64()), "v": (pieces, pa.binary())})


def _train(sent, turn: int, batch: int):
    """The weights of each part; a partition has whole parts, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, inputs, outputs = sent.value
        tree = Tree(arrays)
        now, net, squares, held, waiting, seen = None, None, None, [], 0, 0

        def step(least: int) -> None:
            nonlocal held, waiting
            token, around = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held], axis=1)
            lo = 0
            while len(token) - lo >= least:
                net.learn(token[lo : lo + batch], around[:, lo : lo + batch], squares)
                lo += batch
            held, waiting = [(token[lo:], around[:, lo:])], max(0, len(token) - lo)

        for part, lengths, token, around in _rows(batches, tree.size):
            ends = np.append(0, np.cumsum(lengths))
            which, key = part.column("part").to_numpy(), part.column("key").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if which[a] != now:
                    if waiting:
                        step(1)
                    if seen:
                        yield from _pieces(net, seen)
                    now, net, held, waiting, seen = which[a], Network(tree, inputs, outputs), [], 0, 0
                    squares = net.squares()
                at = ends[a] + masked(key[a:b], lengths[a:b], turn)
                if len(at):
                    held.append((token[at], around[:, at]))
                    waiting += len(at)
                    seen += len(at)
                if waiting >= batch:
                    step(batch)
        if waiting:
            step(1)
        if seen:
            yield from _pieces(net, seen)

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of each piece of the weights, weighted by tokens."""
    total: dict[int, np.ndarray] = {}
    weight: dict[int, float] = {}
    for b in batches:
        for k, seen, v in zip(b.column("k").to_pylist(), b.column("seen").to_pylist(), b.column("v"), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(v.as_buffer(), np.float32).astype(float) * seen
            weight[k] = weight.get(k, 0) + seen
    for k in total:
        yield W.batch({"k": ([k], pa.int32()), "v": ([(total[k] / weight[k]).astype(np.float32).tobytes()], pa.binary())})


def train(rows: DataFrame, known: Vocabulary) -> Network:
    """The network, learned from all rows of :func:`encoded`."""
    spark = rows.sparkSession
    net = Network(Tree.build(known.counts))
    root = math.sqrt(int(known.counts.sum()))
    parts, batch = max(1, round(root / TOKENS_A_PART)), min(BATCH, max(256, 1 << math.ceil(math.log2(max(1.0, root)))))
    dealt = rows.where(F.size("tokens") > 0).withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((net.tree.arrays(), net.inputs, net.outputs))  # one model, as plain arrays
        ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "key", "doc_id").select("part", "key", "tokens")
        found = ordered.mapInArrow(_train(sent, turn, batch), "k int, seen double, v binary").repartition("k").mapInArrow(_mean, "k int, v binary").toArrow()
        sent.unpersist()
        if not len(found):
            break
        pieces = dict(zip(found["k"].to_pylist(), found["v"].to_pylist(), strict=True))
        net = Network.unflat(np.frombuffer(b"".join(pieces[k] for k in sorted(pieces)), np.float32), net.tree)
    return net


def score(rows: DataFrame, known: Vocabulary, net: Network) -> DataFrame:
    """Return (doc_id, n_tokens, log_likelihood, mean_log_likelihood) of each row of :func:`encoded`."""
    sent = rows.sparkSession.sparkContext.broadcast((known.shares(), net.tree.arrays(), net.inputs, net.outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, arrays, inputs, outputs = sent.value
        net = Network(Tree(arrays), inputs, outputs)
        for part, lengths, token, around in _rows(batches, net.tree.size):
            each = np.append(0, np.cumsum(net.log_probability(token, around) - shares[token]))
            upto = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(each[upto] - each[upto - lengths], pa.float64())], names=["doc_id", "n_tokens", "log_likelihood"])

    out = rows.select("doc_id", "tokens").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))


def fit_and_score(docs: DataFrame) -> DataFrame:
    """:func:`score` of all documents by a network learned from them."""
    known = vocabulary(docs)
    rows = encoded(docs, known)
    return score(rows, known, train(rows, known))
