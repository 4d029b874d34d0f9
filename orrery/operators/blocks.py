"""Products with a graph's normalised adjacency, block by block.

Nodes (whole numbers) are cut by id into ranges of about equal numbers of edge ends. A block keeps, in the shared folder, its nodes, the roots of their degrees
and its edges as positions in the other blocks; the weight of an edge is the product of its ends' roots and is not stored. A step is one job without a
shuffle: each block reads the last values of the blocks that it has edges to, one after the other, and writes its own. So memory is bounded by a block and
disk by the edges once and the values twice, whatever the number of steps. Ends of edges that are no nodes count in degrees and carry no value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import released, shared_folder

ENDS = 1 << 21  # edge ends of a block, about
KINDS = {"i": np.int32, "l": np.int64, "d": np.float64}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri("file:///" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(store, fs.LocalFileSystem) else store), path


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other behind their lengths; the file appears whole, a repeated task puts the same again."""
    store, path = _store(folder)
    target = f"{path}/{name}"
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(part := f"{target}.{uuid.uuid4().hex}") as out:
        out.write(np.array([a.size for a in arrays], np.int64).tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).data.cast("B") if a.size else b"")
    store.move(part, target)


def _load(folder: str, name: str, kinds: str) -> list[np.ndarray]:
    """The arrays of a file; kinds: i, l, d each."""
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        data = f.read_buffer()
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(data, KINDS[kind], n, at))
        at += out[-1].nbytes
    return out


def _block(c: Column, bounds: list[int], lo: int = 0, hi: int | None = None) -> Column:
    """How many of the sorted bounds are at most c."""
    hi = len(bounds) if hi is None else hi
    mid = (lo + hi) // 2
    return F.lit(lo) if lo == hi else F.when(c < F.lit(bounds[mid]), _block(c, bounds, lo, mid)).otherwise(_block(c, bounds, mid + 1, hi))


def _write_nodes(folder: str, classes: int, table: pa.Table, b: int) -> None:
    x = table.combine_chunks()
    ids, first = np.unique(x["node"].to_numpy(), return_index=True)
    _save(folder, f"nodes/{b}", ids.astype(np.int64), x["own"].to_numpy()[first].astype(np.int64), np.array([x[f"c{k}"].to_numpy()[first] for k in range(classes)], float))


def _write_edges(folder: str, bounds: np.ndarray, table: pa.Table, b: int) -> None:
    """Roots of the degrees, and by other block the rows with edges to it, where each row's edges start, and their positions there."""
    ids = _load(folder, f"nodes/{b}", "lld")[0]
    own, other = table["own"].to_numpy(), table["other"].to_numpy()
    del table
    if len(ids):
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        keep = ids[at] == own
        own, other = (at, other) if keep.all() else (at[keep], other[keep])
    else:
        own = other = np.zeros(0, np.int64)
    degree = np.ones(len(ids), np.int64)
    block = np.searchsorted(bounds, other, side="right").astype(np.int32)
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(len(bounds) + 2))
    del block
    parts: list[list[np.ndarray]] = [[], [], []]
    ends = []
    for f in range(len(bounds) + 1):
        take = order[cuts[f] : cuts[f + 1]]
        o, t = own[take], other[take]
        there = _load(folder, f"nodes/{f}", "lld")[0] if len(take) else ids[:0]
        at = np.searchsorted(there, t)
        known = there[np.minimum(at, len(there) - 1)] == t if len(there) else np.zeros(len(t), bool)
        if not known.all():
            lost = np.unique(np.array([o[~known], t[~known]]), axis=1)
            degree += np.bincount(lost[0], minlength=len(ids))
            o, at = o[known], at[known]
        key = o * max(1, len(there)) + at
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        o, at = np.divmod(key, max(1, len(there)))
        start = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
        degree += np.bincount(o, minlength=len(ids))
        for p, a in zip(parts, (o[start], start, at), strict=True):
            p.append(a.astype(np.int32))
        ends += [len(start), len(at)]
    _save(folder, f"edges/{b}", np.array(ends, np.int64), 1 / np.sqrt(degree.astype(float)), *[np.concatenate(p) for p in parts])


def _value(folder: str, name: str, f: int, rows: int) -> np.ndarray:
    return _load(folder, f"{name}/{f}", "d")[0].reshape(rows, -1)


def _advance(folder: str, classes: int, start: str, old: str, new: str, alpha: float, clip: bool, b: int) -> None:
    """One block's values after a step. Values are kept times their nodes' roots, as the neighbours' sums need them."""
    ends, root, rows, starts, cols = _load(folder, f"edges/{b}", "ldiii")
    total = _value(folder, old, b, classes).copy()  # the diagonal
    r = c = 0
    for f, (nr, nc) in enumerate(ends.reshape(-1, 2)):
        if nc:
            at, begin, row = cols[c : c + nc].astype(np.intp), starts[r : r + nr].astype(np.intp), rows[r : r + nr].astype(np.intp)
            for t, v in zip(total, _value(folder, old, f, classes), strict=True):
                t[row] += np.add.reduceat(v.take(at, mode="clip"), begin)
        r, c = r + nr, c + nc
    x = alpha * root * total + (1 - alpha) * _value(folder, start, b, classes)
    _save(folder, f"{new}/{b}", (np.maximum(x, 0.0) if clip else x) * root)


class Blocks:
    """The blocks of a graph; base: (node, own, c0, c1, ...), own the position of a train node's label among the classes, else -1."""

    def __init__(self, edges: DataFrame, base: DataFrame, classes: int, ends: int = ENDS):
        self.spark, self.classes = base.sparkSession, classes
        self.folder = f"{shared_folder(self.spark)}/blocks-{uuid.uuid4().hex}"
        e = edges.where("src is not null and dst is not null and src != dst").select(F.col("src").cast("bigint").alias("own"), F.col("dst").cast("bigint").alias("other"))
        e = e.unionByName(e.select(F.col("other").alias("own"), F.col("own").alias("other")))
        base = base.where("node is not null")
        wide, n = self.spark.sparkContext.defaultParallelism, e.count()
        self.n = 1 if n <= ends // 16 else wide * -(-n // (ends * wide))
        ids = e.select("own").unionByName(base.select(F.col("node").cast("bigint").alias("own")))
        cuts = ids.agg(F.percentile_approx("own", [k / self.n for k in range(1, self.n)], 20 * self.n).alias("cuts")).first()["cuts"] if self.n > 1 else []  # one number a block
        self.bounds = sorted(set(cuts or []))
        self.n = len(self.bounds) + 1
        # keys whose hashes fall into one partition each
        keys = self.spark.range(64 * self.n + 64).groupBy(F.expr(f"pmod(hash(id), {self.n})").alias("p")).agg(F.min("id").alias("id")).collect()  # one row a block
        self.keys = [r["id"] for r in sorted(keys, key=lambda r: r["p"])]
        folder, cut = self.folder, np.array(self.bounds, np.int64)
        self._grouped(base.withColumn("node", F.col("node").cast("bigint")), "node", lambda t, b: _write_nodes(folder, classes, t, b))
        self._grouped(e, "own", lambda t, b: _write_edges(folder, cut, t, b))
        del e, ids, base
        released(self.spark)

    def _grouped(self, df: DataFrame, by: str, write: Callable[[pa.Table, int], None]) -> None:
        """Hands each block its rows, none too."""
        key = F.element_at(F.array(*map(F.lit, self.keys)), _block(F.col(by), self.bounds) + 1)
        places = {k: b for b, k in enumerate(self.keys)}

        def task(key: tuple, _: pa.Table, right: pa.Table) -> pa.Table:
            write(right, places[key[0].as_py()])
            return pa.table({"b": pa.array([], pa.int64())})

        every = self.spark.createDataFrame([(k,) for k in self.keys], "k bigint").repartition(self.n, "k")
        every.groupBy("k").cogroup(df.withColumn("k", key.cast("bigint")).repartition(self.n, "k").groupBy("k")).applyInArrow(task, "b bigint").count()

    def each(self, f: Callable[[int], None]) -> None:
        self.spark.sparkContext.parallelize(range(self.n), self.n).foreach(f)

    def start(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], name: str, last: str | None = None) -> None:
        """Sets the start values f(own, prior, last values), class by node."""
        folder, classes = self.folder, self.classes

        def task(b: int) -> None:
            _, own, prior = _load(folder, f"nodes/{b}", "lld")
            root = _load(folder, f"edges/{b}", "ldiii")[1]
            x = f(own, prior.reshape(classes, -1), _value(folder, last, b, classes) / root if last else None)
            _save(folder, f"{name}/{b}", x)
            _save(folder, f"{name}-0/{b}", x * root)

        self.each(task)

    def propagate(self, name: str, alpha: float, steps: int, clip: bool = False) -> str:
        """x <- (1 - alpha) x0 + alpha A x, `steps` times, from the start values of that name; the name of the last values."""
        folder, classes = self.folder, self.classes

        def step(b: int, k: int) -> None:
            _advance(folder, classes, name, f"{name}-{k - 1}", f"{name}-{k}", alpha, clip, b)

        if self.n == 1:  # nothing to exchange
            self.each(lambda b: [step(b, k) for k in range(1, steps + 1)] and None)
            return f"{name}-{steps}"
        store, path = _store(folder)
        for k in range(1, steps + 1):
            self.each(lambda b, k=k: step(b, k))
            store.delete_dir(f"{path}/{name}-{k - 1}")
        return f"{name}-{steps}"

    def rows(self, last: str) -> DataFrame:
        """(node, k, v) of the last values; the edges are not needed any more and go."""
        folder, classes, size = self.folder, self.classes, 1 << 16

        def keep(b: int) -> None:
            _save(folder, f"values/{b}", _load(folder, f"nodes/{b}", "lld")[0], _value(folder, last, b, classes) / _load(folder, f"edges/{b}", "ldiii")[1])

        def read(batches):
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    ids, x = _load(folder, f"values/{b}", "ld")
                    x = x.reshape(classes, -1)
                    for i in range(0, len(ids), size):
                        v = x[:, i : i + size]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + size], classes)), pa.array(np.tile(np.arange(classes, dtype=np.int32), v.shape[1])), pa.array(v.T.ravel())], ["node", "k", "v"])

        self.each(keep)
        store, path = _store(folder)
        for x in store.get_file_info(fs.FileSelector(path)):
            if x.base_name != "values":
                store.delete_dir(x.path)
        return self.spark.range(0, self.n, 1, self.n).mapInArrow(read, "node bigint, k int, v double")
