"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here in numpy, by backpropagation through time, on
windows of a bounded sample of labelled documents.  It labels every byte of a
text; a document's probabilities are the mean of those of its bytes.  Texts are
read whole, in windows that run side by side, so a step works on thousands of
bytes at once and memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quadrille.llm.common import col, pick

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: the place after a window's end; its gates are shut, so a state that passes it is zero
PAD = 256
#: windows that run side by side in a task
ABREAST = 2048


@dataclass(frozen=True)
class Recipe:
    """Sample and training.  At most ``languages`` languages (those with most
    documents) are learned, each from at most ``docs`` documents with
    ``pieces`` windows of ``window`` bytes spread over the text."""
    languages: int = 256
    docs: int = 400
    pieces: int = 4
    window: int = 64
    hidden: int = 8
    steps: int = 220
    batch: int = 192
    rate: float = 0.02
    seed: int = 11


@dataclass
class Direction:
    """A gated recurrent layer over bytes.  ``table`` holds the input weights of
    each byte, ``u`` the recurrent weights: update, reset and candidate parts."""
    table: np.ndarray      # 256, 3 h
    u: np.ndarray          # h, 3 h
    bias: np.ndarray       # h, inside the reset

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, h) over ``x`` (windows, steps); ``keep`` takes what the way back needs."""
        n, steps = x.shape
        h = self.bias.size
        shut = np.concatenate([np.full(2 * h, -90), np.zeros(h)]).astype(self.table.dtype)
        table, u = np.vstack([self.table, shut]), self.u.copy()
        table[:, :2 * h] *= 0.5      # sigmoid(a) is tanh(a / 2) / 2 + 1 / 2
        u[:, :2 * h] *= 0.5
        columns = np.ascontiguousarray(x.T)
        states = np.empty((steps, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        given, inner, gates = np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32), np.empty((n, 2 * h), np.float32)
        for t in range(steps):
            np.take(table, columns[t], axis=0, out=given, mode="clip")
            np.matmul(state, u, out=inner)
            np.add(given[:, :2 * h], inner[:, :2 * h], out=gates)
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :h], gates[:, h:]
            inside = inner[:, 2 * h:] + self.bias
            new = r * inside
            new += given[:, 2 * h:]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((z.copy(), r.copy(), new.copy(), inside, state))
            state = np.subtract(state, new, out=states[t])
            state *= z
            state += new
        return states

    def back(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of table, u and bias from those of the states, through time."""
        h = self.bias.size
        d_u, d_bias, carried = np.zeros_like(self.u), np.zeros_like(self.bias), np.zeros_like(d_states[0])
        d_given = np.empty((x.shape[1], x.shape[0], 3 * h), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            z, r, new, inside, before = kept[t]
            d = carried + d_states[t]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * z * (1 - z)
            d_r = d_new * inside * r * (1 - r)
            d_inside = d_new * r
            d_inner = np.concatenate([d_z, d_r, d_inside], axis=1)
            d_given[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u += before.T @ d_inner
            d_bias += d_inside.sum(axis=0)
            carried = d * z + d_inner @ self.u.T
        d_table = np.zeros((PAD + 1, 3 * h), np.float32)
        np.add.at(d_table, x.T.ravel(), d_given.reshape(-1, 3 * h))
        return d_table[:PAD], d_u, d_bias


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out_ahead: np.ndarray      # h, languages
    out_behind: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.table, self.ahead.u, self.ahead.bias, self.behind.table, self.behind.u, self.behind.bias,
                self.out_ahead, self.out_behind, self.out_bias]

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(languages, steps * windows) for every byte of the windows, step by step."""
        kept = ([], []) if keep is not None else (None, None)
        flat = lambda a: a.reshape(-1, a.shape[2])
        ahead, behind = self.ahead.run(x, kept[0]), self.behind.run(x[:, ::-1], kept[1])
        scores = flat(ahead) @ self.out_ahead
        # the other direction's steps come in reverse order
        scores.reshape(*ahead.shape[:2], -1)[:] += (flat(behind) @ self.out_behind).reshape(*ahead.shape[:2], -1)[::-1]
        scores = np.ascontiguousarray(scores.T)
        scores += self.out_bias[:, None]
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=0)
        if keep is not None:
            keep.update(kept=kept, ahead=flat(ahead), behind=flat(behind[::-1]))
        return scores

    def gradients(self, x: np.ndarray, truth: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the bytes of the windows and its gradients."""
        keep: dict = {}
        p = self.probabilities(x, keep)
        inside = (x.T != PAD).ravel()
        right = np.tile(truth, x.shape[1]), np.arange(p.shape[1])
        loss = float(-(np.log(np.maximum(p[right], 1e-9)) * inside).sum() / inside.sum())
        p[right] -= 1
        p *= (inside / inside.sum()).astype(np.float32)
        d = np.ascontiguousarray(p.T)
        shaped = lambda a: a.reshape(x.shape[1], x.shape[0], -1)
        d_ahead = self.ahead.back(x, keep["kept"][0], shaped(d @ self.out_ahead.T))
        d_behind = self.behind.back(x[:, ::-1], keep["kept"][1], shaped(d @ self.out_behind.T)[::-1])
        return loss, [*d_ahead, *d_behind, keep["ahead"].T @ d, keep["behind"].T @ d, d.sum(axis=0)]


def fresh(languages: list[str], recipe: Recipe) -> Network:
    rng, h, k = np.random.default_rng(recipe.seed), recipe.hidden, len(languages)
    some = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    direction = lambda: Direction(some(256, 3 * h, by=0.3), some(h, 3 * h, by=0.4 / h ** 0.5), np.zeros(h, np.float32))
    return Network(languages, direction(), direction(), some(h, k, by=0.3), some(h, k, by=0.3), np.zeros(k, np.float32))


def windows(pieces: list[bytes], size: int) -> np.ndarray:
    x = np.full((len(pieces), size), PAD, np.uint16)
    for row, piece in zip(x, pieces, strict=True):
        row[:len(piece)] = np.frombuffer(piece, np.uint8)
    return x


def train(examples: list[tuple[str, bytes]], recipe: Recipe = Recipe()) -> Network | None:
    """A network from (language, window) examples, every language weighing the same; None without examples."""
    examples = sorted(e for e in examples if e[1])
    languages = sorted({lang for lang, _ in examples})
    if not languages:
        return None
    rng = np.random.default_rng(recipe.seed)
    x = windows([piece[:recipe.window] for _, piece in examples], recipe.window)
    truth = np.array([languages.index(lang) for lang, _ in examples])
    of = [np.flatnonzero(truth == k) for k in range(len(languages))]
    net = fresh(languages, recipe)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, recipe.steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(len(of), size=recipe.batch)])
        _, grads = net.gradients(x[pick], truth[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = recipe.rate * min(1.0, 1.5 * (1 - step / (recipe.steps + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return net


def sampled(docs: DataFrame, recipe: Recipe) -> list[tuple[str, bytes]]:
    """At most ``recipe.docs`` documents a language, by a hash of the id, as windows."""
    spark, docs = docs.sparkSession, pick(docs, doc_id="doc_id", text="text", lang="lang")
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(recipe.languages).collect()
    if not counts:
        return []
    # a hash range that holds about twice the documents wanted goes into the exact choice
    bars = spark.createDataFrame([(r["lang"], min(1.0, 2.0 * recipe.docs / r["n"])) for r in counts], "lang string, share double")
    hashed = known.join(F.broadcast(bars), "lang").withColumn("h", F.xxhash64("doc_id", F.lit(recipe.seed)))
    near = hashed.filter((F.col("h") / 2.0 ** 64 + 0.5) <= F.col("share"))
    raw, size = F.col("text").cast("binary"), F.octet_length("text")
    at = [F.floor(F.greatest(size - recipe.window, F.lit(0)) * (k / max(1, recipe.pieces - 1))).cast("int") for k in range(recipe.pieces)]
    near = near.select("lang", "h", F.array(*[F.substring(raw, a + 1, F.lit(recipe.window)) for a in at]).alias("pieces"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "pieces"))
    rows = near.withColumn("r", rank).filter(F.col("r") <= recipe.docs).select("lang", "pieces").collect()
    return [(r["lang"], bytes(p)) for r in rows for p in set(map(bytes, r["pieces"]))]


def learned(docs: DataFrame, recipe: Recipe = Recipe()) -> Network | None:
    """A network from a bounded sample of ``docs`` (doc_id, text, lang)."""
    return train(sampled(docs, recipe), recipe)


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id's digits leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Pool:
    """Sums of byte probabilities and of labels per document of a batch."""

    def __init__(self, net: Network, window: int, documents: int):
        self.net, self.window = net, window
        self.sums = np.zeros((documents, len(net.languages)))
        self.labels = np.zeros((documents, len(net.languages)), np.int64)
        self.pieces: list[tuple[int, np.ndarray]] = []
        self.waiting = 0

    def add(self, document: int, text: bytes) -> None:
        data, step = np.frombuffer(text, np.uint8), ABREAST * self.window
        for at in range(0, len(data), step):
            piece = data[at:at + step]
            self.pieces.append((document, piece))
            self.waiting += -(-len(piece) // self.window)
            if self.waiting >= ABREAST:
                self.flush()

    def flush(self) -> None:
        if not self.pieces:
            return
        x = np.full((self.waiting, self.window), PAD, np.uint16)
        owner, row = np.empty(self.waiting, np.int64), 0
        for document, piece in self.pieces:
            rows = -(-len(piece) // self.window)
            x[row:row + rows].reshape(-1)[:len(piece)] = piece
            owner[row:row + rows] = document
            row += rows
        p = self.net.probabilities(x)
        inside = (x.T != PAD).ravel()
        p *= inside
        most = p.max(axis=0)
        free = inside.copy()      # ties go to the first language
        for k, of in enumerate(p):
            label = free & (of == most)
            free &= ~label
            add = lambda a: a.reshape(self.window, -1).sum(axis=0)
            self.sums[:, k] += np.bincount(owner, add(of), len(self.sums))
            self.labels[:, k] += np.bincount(owner, add(label), len(self.sums)).astype(np.int64)
        self.pieces, self.waiting = [], 0


def predicted(docs: DataFrame, net: Network | None, window: int = Recipe.window, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, n_bytes and n_labelled.

    ``score`` is the mean probability of ``lang_pred`` over the bytes of the
    text, ``n_labelled`` how many of them carry its label.  Null texts, texts
    without a letter, and all texts if nothing was learned give ``und`` and 0.
    Ties go to the first language by name; repeated rows stay.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), held_out(col(doc_id)).alias("held_out"), col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spoken = [t is not None and net is not None and LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
            names, score, agree = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            sizes = np.array([len(t or b"") for t in texts], np.int64)
            if any(spoken):
                pool = Pool(net, window, len(texts))
                for k, (t, s) in enumerate(zip(texts, spoken, strict=True)):
                    if s:
                        pool.add(k, t)
                pool.flush()
                best = pool.sums.argmax(axis=1)
                for k in np.flatnonzero(spoken):
                    names[k] = net.languages[best[k]]
                    score[k] = min(1.0, pool.sums[k, best[k]] / sizes[k])
                    agree[k] = pool.labels[k, best[k]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(sizes), pa.array(agree)],
                ["doc_id", "held_out", "lang_pred", "score", "n_bytes", "n_labelled"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_bytes long, n_labelled long")
