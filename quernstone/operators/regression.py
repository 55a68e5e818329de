"""Logistic regressions of one outcome on several choices of columns, fitted side by side over stored blocks of rows.

A block holds its rows as arrays of numbers: shape (dense), codes of intake values (one a column), and words (indices, counts, one over
the vector's length). Every regression asks for a gradient or for a product with its matrix of second derivatives; what all of them ask
for is answered in one pass over the blocks, so the number of passes is that of the slowest. Half the squared weights are added to the
summed loss; the intercept isn't penalised.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

#: Rows a block, tasks a pass at most (each sends its sums to the driver).
ROWS, TASKS = 2048, 32
#: A step's system is solved with the second derivatives of so many leading columns exactly inverted; their estimate takes so many blocks.
LEADING, BLOCKS = 2048, 8
#: Steps at most, and how far probabilities may be from those at the minimum: a step's largest change times the share of it left unsolved.
STEPS, SETTLED = 60, 1e-5


def packed(y: np.ndarray, shape: np.ndarray, codes: np.ndarray, row: np.ndarray, index: np.ndarray, tf: np.ndarray, scale: np.ndarray) -> bytes:
    """A block: ``row``, ``index`` and ``tf`` of the words by row, ``scale`` a row."""
    many, high = np.flatnonzero(tf > 1), np.flatnonzero(index > 0xFFFF)
    parts = [y.astype(np.uint8), shape.astype("<f8"), codes.astype("<i4"), scale.astype("<f8"), np.bincount(row, minlength=len(y)).astype("<u4"), (index & 0xFFFF).astype("<u2"), high.astype("<u4"), (index[high] >> 16).astype("<u2"), many.astype("<u4"), tf[many].astype("<u4")]
    head = np.array([len(y), shape.shape[1], codes.shape[1], len(index), len(high), len(many)], "<i8")
    return b"".join([head.tobytes(), *[p.tobytes() for p in parts]])


class Block:
    def __init__(self, data: bytes):
        n, a, b, words, high, many = np.frombuffer(data, "<i8", 6).tolist()
        at = 48

        def take(kind, size):
            nonlocal at
            out = np.frombuffer(data, kind, size, at)
            at += out.nbytes
            return out

        self.n, self.y = n, take(np.uint8, n).astype(float)
        self.shape, self.codes, self.scale = take("<f8", n * a).reshape(n, a), take("<i4", n * b).reshape(n, b), take("<f8", n)
        self.counts, self.index = take("<u4", n).astype(np.int64), take("<u2", words).astype(np.intp)
        at_high = take("<u4", high)
        self.index[at_high] += take("<u2", high).astype(np.intp) << 16
        self.many, self.more = take("<u4", many).astype(np.intp), 1 + np.log(take("<u4", many))
        self.filled = np.flatnonzero(self.counts)
        self.start = (np.cumsum(self.counts) - self.counts)[self.filled]


class Layout:
    """Where the columns stand in a weight vector: shape, codes and one that stands for no code, words, intercept."""

    def __init__(self, shape: int, codes: int, idf: np.ndarray):
        self.idf = idf
        self.parts = {"shape": slice(0, shape), "codes": slice(shape, shape + codes + 1), "words": slice(shape + codes + 1, shape + codes + 1 + len(idf))}
        self.size = shape + codes + 2 + len(idf)

    def columns(self, has: str, own: slice | None = None) -> np.ndarray:
        """The columns of a part, of the codes without the one for none."""
        at = np.arange(self.size)[self.parts[has]]
        return at[:-1][own or slice(None)] if has == "codes" else at

    def scaled(self, v: np.ndarray) -> np.ndarray:
        """The vector as ``times`` takes it: the words' weights with their idf."""
        out = v.copy()
        out[self.parts["words"]] *= self.idf
        return out

    def times(self, b: Block, v: np.ndarray, has: tuple[str, ...]) -> np.ndarray:
        """Block times a ``scaled`` vector; complex vectors are two."""
        z = np.full(b.n, v[-1])
        if "shape" in has:
            z += b.shape @ v[self.parts["shape"]]
        if "codes" in has:
            z += v[self.parts["codes"]][b.codes].sum(axis=1)
        if "words" in has and len(b.filled):
            each = v[self.parts["words"]][b.index]
            each[b.many] *= b.more
            z[b.filled] += np.add.reduceat(each, b.start) * b.scale[b.filled]
        return z

    def back(self, b: Block, u: np.ndarray, has: tuple[str, ...], power: int = 1) -> np.ndarray:
        """Transposed block (its values to ``power``) times vector."""
        out = np.zeros(self.size)
        out[-1] = u.sum()
        if "shape" in has:
            out[self.parts["shape"]] = u @ b.shape**power
        if "codes" in has:
            out[self.parts["codes"]] = np.bincount(b.codes.ravel(), np.repeat(u, b.codes.shape[1]), self.parts["codes"].stop - self.parts["codes"].start)
        if "words" in has:
            each = np.repeat(u * b.scale**power, b.counts)
            each[b.many] *= b.more**power
            out[self.parts["words"]] = np.bincount(b.index, each, len(self.idf)) * self.idf**power
        return out

    def dense(self, b: Block, columns: np.ndarray) -> np.ndarray:
        """The block's values in some columns."""
        to = np.full(self.size, len(columns))
        to[columns] = np.arange(len(columns))
        out, row = np.zeros((b.n, len(columns) + 1), np.float32), np.arange(b.n)
        out[:, to[self.parts["shape"]]] = b.shape
        out[np.repeat(row, b.codes.shape[1]), to[self.parts["codes"]][b.codes.ravel()]] = 1
        value = self.idf[b.index]
        value[b.many] *= b.more
        out[np.repeat(row, b.counts), to[self.parts["words"]][b.index]] = value * np.repeat(b.scale, b.counts)
        out[:, to[-1]] = 1
        return out[:, :-1]


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def answer(layout: Layout, b: Block, kind: str, has: tuple[str, ...], xq: np.ndarray | None) -> tuple[float, float, np.ndarray]:
    """squares: of all columns. gradient: loss, largest change since ``x - q``, gradient. product: with ``q``, at ``x``. ``xq``: both, scaled."""
    if kind == "squares":
        return 0.0, 0.0, layout.back(b, np.ones(b.n), has, 2)
    both = layout.times(b, xq, has)
    z, p = both.real, _chance(both.real)
    if kind == "product":
        return 0.0, 0.0, layout.back(b, p * (1 - p) * both.imag, has)
    loss = float((np.logaddexp(0, z) - b.y * z).sum())
    return loss, float(np.abs(p - _chance(z - both.imag)).max(initial=0)), layout.back(b, p - b.y, has)


class Passes:
    """Answers over all blocks. Files that every machine reads by their path go to the workers by name, a task's share each; others by Spark."""

    def __init__(self, blocks: DataFrame, layout: Layout):
        self.blocks, self.layout, context = blocks, layout, blocks.sparkSession.sparkContext
        self.shared, names = context.broadcast(layout), blocks.inputFiles()
        self.tasks = max(1, min(TASKS, context.defaultParallelism))
        self.files = None
        if names and all(n.startswith("file:") for n in names):
            paths = [unquote(urlparse(n).path) for n in names]
            self.files = context.parallelize([paths[i :: self.tasks] for i in range(self.tasks)], self.tasks)

    def ask(self, asked: list[tuple]) -> list[tuple[float, float, np.ndarray]]:
        """One pass: the answers, summed (the changes' largest)."""
        shared, wanted = self.shared, self.blocks.sparkSession.sparkContext.broadcast(asked)

        def sums(blocks: Iterator[pa.Buffer]) -> list[list]:
            layout = shared.value
            out = [[0.0, 0.0, np.zeros(layout.size)] for _ in wanted.value]
            todo = [(kind, has, None if x is None else layout.scaled(x + 1j * q)) for kind, has, x, q in wanted.value]
            for data in blocks:
                b = Block(data)
                for s, one in zip(out, todo):
                    loss, change, g = answer(layout, b, *one)
                    s[0], s[1] = s[0] + loss, max(s[1], change)
                    s[2] += g
            return [[i, s[0], s[1], s[2].tobytes()] for i, s in enumerate(out)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sums(data.as_buffer() for batch in batches for data in batch["data"])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.float64(), pa.binary()))], names=["i", "loss", "change", "g"])

        def opened(paths: list[str]) -> Iterator[pa.Buffer]:
            for path in paths:
                for batch in pq.ParquetFile(path).iter_batches(16, columns=["data"]):
                    yield from (data.as_buffer() for data in batch["data"])

        if self.files is None:
            found = self.blocks.select("data").coalesce(self.tasks).mapInArrow(run, "i int, loss double, change double, g binary").collect()
        else:
            found = self.files.flatMap(lambda paths: sums(opened(paths))).collect()
        out = [[0.0, 0.0, np.zeros(self.layout.size)] for _ in asked]
        for i, loss, change, g in found:
            out[i][0], out[i][1] = out[i][0] + loss, max(out[i][1], change)
            out[i][2] += np.frombuffer(g)
        wanted.destroy()
        return [tuple(s) for s in out]


def _newton(layout: Layout, some: list[Block], n: int, rate: float, squares: np.ndarray, has: tuple[str, ...], columns: np.ndarray) -> Generator[tuple, tuple, np.ndarray]:
    """Asks for what it needs and returns the weights."""
    penalty, free = np.zeros(layout.size), np.zeros(layout.size, bool)
    penalty[columns], free[[*columns, -1]] = 1, True
    leading = np.append(columns[np.argsort(-squares[columns], kind="stable")[:LEADING]], layout.size - 1)
    x, still = np.zeros(layout.size), np.zeros(layout.size)
    x[-1] = np.log(rate / (1 - rate))
    diagonal = rate * (1 - rate) * squares + 1
    inverse = None

    def told(reply):
        loss, change, g = reply
        return loss + x @ (penalty * x) / 2, change, np.where(free, g + penalty * x, 0)

    def near(g):
        out = np.where(free, g / diagonal, 0)
        out[leading] = inverse @ g[leading].astype(np.float32)
        return out

    loss, _, g = told((yield "gradient", has, x, still))
    for step in range(STEPS):
        if step in (0, 2):
            square, seen = np.diag(penalty[leading]), sum(b.n for b in some)
            for b in some:
                p = _chance(layout.times(b, layout.scaled(x), has))
                a = layout.dense(b, leading) * np.sqrt(p * (1 - p)).astype(np.float32)[:, None]
                square += (a.T @ a).astype(float) * (n / seen)
            inverse = np.linalg.inv(square + np.diag(np.full(len(leading), 1e-9))).astype(np.float32)
            del square, a
        # conjugate gradients
        unsolved, s, rest = 0.1 if step < 3 else 0.01, np.zeros(layout.size), -g
        q = z = near(rest)
        now = first = rest @ z
        if first <= 1e-20:
            return x
        for _ in range(200):
            _, _, h = yield "product", has, x, q
            h = np.where(free, h + penalty * q, 0)
            a = now / (q @ h)
            s, rest = s + a * q, rest - a * h
            z = near(rest)
            now, before = rest @ z, now
            if now < unsolved**2 * first:
                break
            q = z + now / before * q
        old, t = x, 1.0
        while True:
            x = old + t * s
            new, change, h = told((yield "gradient", has, x, t * s))
            if new <= loss + 1e-4 * t * (g @ s) + 1e-10 * abs(loss):
                break
            t /= 2
            if t < 1e-9:
                raise ValueError("a regression finds no better weights")
        loss, g = new, h
        if change * unsolved < SETTLED:
            return x
    raise ValueError(f"a regression isn't settled after {STEPS} steps")


def fit(blocks: DataFrame, layout: Layout, models: list[tuple[tuple[str, ...], np.ndarray]]) -> list[np.ndarray]:
    """Weights of each model, given as the parts that it reads and its columns. Without train rows raises; with one outcome only its chance is certain."""
    every = tuple(layout.parts)
    passes = Passes(blocks, layout)
    _, _, squares = passes.ask([("squares", every, None, None)])[0]
    n = round(squares[-1])
    if not n:
        raise ValueError("no train row")
    none = np.zeros(layout.size)
    _, _, g = passes.ask([("gradient", (), none, none)])[0]
    rate = 0.5 - g[-1] / n
    if not 0.5 < rate * n < n - 0.5:
        none[-1] = 800.0 if rate > 0.5 else -800.0
        return [none] * len(models)
    some = [Block(r["data"]) for r in blocks.orderBy("key").limit(BLOCKS).select("data").collect()]
    running = [_newton(layout, some, n, rate, squares, has, columns) for has, columns in models]
    asked, out = {i: next(r) for i, r in enumerate(running)}, [none] * len(models)
    while asked:
        replies, at, asked = passes.ask([*asked.values()]), [*asked], {}
        for i, reply in zip(at, replies):
            try:
                asked[i] = running[i].send(reply)
            except StopIteration as end:
                out[i] = end.value
    return out


def chances(blocks: DataFrame, layout: Layout, models: list[tuple[tuple[str, ...], np.ndarray]], found: list[np.ndarray], names: list[str]) -> DataFrame:
    """(complaint_id, split, y) of the blocks' rows and P(y = 1) by each model, a column each."""
    shared = blocks.sparkSession.sparkContext.broadcast((layout, [has for has, _ in models], found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, parts, found = shared.value
        found = [layout.scaled(w) for w in found]
        for batch in batches:
            for ids, splits, data in zip(batch["ids"], batch["splits"], batch["data"]):
                b = Block(data.as_buffer())
                p = [pa.array(_chance(layout.times(b, w, has))) for has, w in zip(parts, found)]
                yield pa.RecordBatch.from_arrays([ids.values, splits.values, pa.array(b.y.astype(np.int32)), *p], names=["complaint_id", "split", "y", *names])

    rows = blocks.select("ids", "splits", "data").mapInArrow(run, "complaint_id string, split string, y int, " + ", ".join(f"{n} double" for n in names))
    return rows.select("complaint_id", "split", "y", *[F.round(n, 6).alias(n) for n in names])
