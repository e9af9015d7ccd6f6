"""Near-duplicate vectors by product quantisation with an exact rerank.

Coarse cells are pairs of centres, one for each half of a vector, so that few
centres make many cells; they grow with the table and hold inverted lists. A
vector's residual is coded by subspace. A vector asks the cells whose borders it
is near enough to; table look-ups give asymmetric distances to the coded members,
and those that the coding error could bring within the radius are compared
exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .vectors import filled, matrix, usable, width_of

#: Rows a cell should hold, most centres of a half, and most vectors and bytes that come to the driver for the fit.
ROWS_A_CELL, MOST_CENTRES, MOST_ROWS, MOST_BYTES = 32, 2048, 32_768, 128 << 20
#: Members that a task holds, and vectors that ask them.
MEMBERS, ASKERS = 4096, 32_768


@dataclass
class Index:
    halves: list[np.ndarray]  # two times (centres, width of the half)
    books: np.ndarray  # (subspaces, codes, width / subspaces)
    radius: float  # distance of unit vectors at the least cosine
    slack: float  # how far beyond a border a partner may lie, as a part of the radius

    @property
    def cells(self) -> tuple[int, int]:
        return len(self.halves[0]), len(self.halves[1])

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.halves[0].shape[1]
        return x[:, :cut], x[:, cut:]

    def borders(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest centre of each row, and the row's distance to the border plane towards every centre."""
        out = []
        for part, centres in zip(self._split(x), self.halves, strict=True):
            norm = (centres**2).sum(1)
            square = np.maximum((part * part).sum(1)[:, None] + norm[None] - 2 * part @ centres.T, 0)
            own = square.argmin(1)
            apart = np.sqrt(np.maximum(norm[:, None] + norm[None] - 2 * centres @ centres.T, 1e-30))
            out.append((own, (square - square[np.arange(len(x)), own][:, None]) / (2 * apart[own])))
        return out

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each row; and the cells that rows ask, as rows and cells."""
        (a, near), (b, far) = self.borders(x)
        reach = (self.slack * self.radius) ** 2 + 1e-12
        second = self.cells[1]
        rows, cells = [np.arange(len(x))], [a * second + b]
        # Only centres that alone are within reach can be in a pair that is.
        p, i = np.nonzero((near**2 <= reach) & np.isfinite(near))
        for k in range(0, len(p), 4096):
            q, j = np.nonzero(near[p[k : k + 4096], i[k : k + 4096]][:, None] ** 2 + far[p[k : k + 4096]] ** 2 <= reach)
            rows.append(p[k : k + 4096][q])
            cells.append(i[k : k + 4096][q] * second + j)
        pair = np.unique(np.concatenate(rows).astype(np.int64) * (self.cells[0] * second) + np.concatenate(cells))
        return a * second + b, pair // (self.cells[0] * second), pair % (self.cells[0] * second)

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return np.concatenate([self.halves[0][cell // self.cells[1]], self.halves[1][cell % self.cells[1]]], axis=1)

    def code(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the distance that coding moves each vector."""
        parts = self._parts(x - self.centre(own))
        codes = np.empty(parts.shape[:2], np.uint8)
        rest = np.zeros(len(x))
        for s, book in enumerate(self.books):
            square = ((parts[:, s, None] - book[None]) ** 2).sum(2)
            codes[:, s] = square.argmin(1)
            rest += square.min(1)
        return codes, np.sqrt(rest)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        subspaces, _, size = self.books.shape
        wide = np.zeros((len(x), subspaces * size))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), subspaces, size)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each row's subspaces with all codes: (rows, subspaces, codes)."""
        return np.einsum("rsd,scd->rsc", self._parts(x), self.books, optimize=True)

    def norms(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared lengths of the coded vectors."""
        subspaces, _, size = self.books.shape
        rest = self.books[np.arange(subspaces), codes].reshape(len(codes), subspaces * size)
        centre = self._parts(self.centre(cell)).reshape(len(codes), subspaces * size)
        return ((centre + rest) ** 2).sum(1)

    def look_up(self, x: np.ndarray, tables: np.ndarray, cell: int, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Asymmetric distances from the rows of x, with their tables, to the coded members of a cell."""
        product = np.repeat((x @ self.centre(np.array([cell]))[0])[:, None], len(codes), axis=1)
        for s in range(codes.shape[1]):
            product += tables[:, s][:, codes[:, s]]
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + norms[None] - 2 * product, 0))


def _centres(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([((centres**2).sum(1)[None] - 2 * part @ centres.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        total, count = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def fit(sample: np.ndarray, centres: int, least: float, slack: float, subspaces: int = 8, codes: int = 64, seed: int = 7) -> Index:
    """Centres and code books of a sample of unit vectors. Neighbouring numbers of a half's centres lie near each other."""
    rng = np.random.default_rng(seed)
    cut, halves = sample.shape[1] // 2, []
    for part in (sample[:, :cut], sample[:, cut:]):
        found = _centres(part, max(1, min(centres, len(sample))), 6, rng)
        main = np.linalg.svd(found - found.mean(0), full_matrices=False)[2][:1] if found.shape[1] else np.zeros((0, 0))
        halves.append(found[np.argsort((found @ main.T)[:, 0], kind="stable")] if len(main) else found)
    index = Index(halves, np.zeros((subspaces, 1, -(-sample.shape[1] // subspaces))), float(np.sqrt(max(2 - 2 * least, 0))), slack)
    own = np.concatenate([index.probes(part)[0] for part in np.array_split(sample, max(1, len(sample) // 4096))])
    parts = index._parts(sample - index.centre(own))
    index.books = np.stack([_centres(parts[:, s], min(codes, len(sample)), 6, rng) for s in range(subspaces)])
    return index


def near_vectors(vectors: DataFrame, least: float = 0.95, slack: float = 0.4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link if their cosine in double precision is at least ``least``; what
    is linked is so exactly, and a partner is missed only if both lie more than
    ``slack`` of the radius beyond the other's borders (1: none is missed). A
    vector that is null, empty, zero or holds null, NaN or infinity links with
    nothing and is its own component. Equal vectors form one class and are not
    compared with each other. Shorter vectors count as filled up with zeros. Rows
    that repeat an id count each; a row with a null id counts as a partner, its
    own component and ``kept`` are null unless others are in its class. An empty
    table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    width = width_of(rows.where(good), "v")
    if not width:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").cast("bigint").alias("component_id"), (F.col("id") == F.col("id")).alias("kept"))
    v = F.when(good, filled(F.col("v"), width))
    of = rows.select("id", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), v.alias("v"))
    classes = of.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").cast("bigint").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    number = classes.count()
    centres = int(np.clip(round((number / ROWS_A_CELL) ** 0.5), 1, MOST_CENTRES))
    rows_to_fit = min(max(8192, 16 * centres), MOST_ROWS, max(MOST_BYTES // (8 * width), 1))
    sample = classes.orderBy(F.xxhash64("h1", "h2")).limit(rows_to_fit).select("v").toPandas()["v"]
    sample = np.stack(sample.to_list()).astype(float)
    shared = vectors.sparkSession.sparkContext.broadcast(fit(sample / np.linalg.norm(sample, axis=1)[:, None], centres, least, slack))
    first, second = shared.value.cells
    #: Cells are grouped by their first centre and by runs of the second, so that a group has about MEMBERS rows.
    runs = int(np.clip(number / first / MEMBERS, 1, second))
    run = -(-second // runs)
    exact = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                x = matrix(part.column("v"), width)
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                own, row, cell = index.probes(unit)
                codes, moved = index.code(unit, own)
                bounds = np.append(0, np.cumsum(np.bincount(row, minlength=len(x))))
                asks = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(cell.astype(np.int32)))
                columns = [part.column("rep"), part.column("copies"), pa.array([r.tobytes() for r in x.astype(exact)], pa.binary()), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(moved), pa.array(index.norms(own, codes)), asks]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "copies", "v", "cell", "codes", "moved", "norm", "asks"])

    coded = stored(classes.select("rep", "copies", "v").mapInArrow(assign, "rep bigint, copies bigint, v binary, cell int, codes binary, moved double, norm double, asks array<int>"), "coded")
    group_of = lambda cell: (F.floor(cell / second) * runs + F.floor((cell % second) / run)).cast("int")
    members = coded.withColumn("g", group_of(F.col("cell")))
    askers = coded.select(*[F.col(c).alias(c) for c in ("rep", "copies", "v", "cell", "asks")], F.explode(F.array_distinct(F.transform("asks", group_of))).alias("g"))
    # A group with more rows than one task should hold is dealt into blocks; each block of members meets each part of the askers.
    blocks = members.groupBy("g").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    parts = askers.groupBy("g").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("parts"))
    numbers = stored(blocks.join(parts, "g"), "numbers")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = members.join(numbers, "g").withColumn("block", deal("blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
    askers = askers.join(numbers, "g").withColumn("part", deal("parts")).withColumn("block", every("blocks")).drop("blocks", "parts")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        index = shared.value
        root: dict[int, int] = {}
        gained = [np.zeros((2, 0), np.int64)]
        if left.num_rows and right.num_rows:
            y, y_rep, y_copies, y_cell, y_row, y_asks = _read(left, exact, width)
            x, x_rep, x_copies, x_cell, x_row, x_asks = _read(right, exact, width)
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(y), -1)
            moved, length = left["moved"].to_numpy(), left["norm"].to_numpy()
            x_unit = x / np.linalg.norm(x, axis=1)[:, None]
            y_size, x_size = np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1)
            asked = np.sort(y_row * (first * second) + y_asks)  # which cells a member asks
            by_cell = np.argsort(x_asks, kind="stable")
            cells, where = np.unique(y_cell, return_inverse=True)
            order = np.argsort(where, kind="stable")
            limits = np.append(0, np.cumsum(np.bincount(where)))
            low, high = np.searchsorted(x_asks[by_cell], cells), np.searchsorted(x_asks[by_cell], cells, side="right")
            for n, cell in enumerate(cells.tolist()):
                own, asking = order[limits[n] : limits[n + 1]], x_row[by_cell[low[n] : high[n]]]
                for k in range(0, len(asking), 1024):
                    who = asking[k : k + 1024]
                    far = index.look_up(x_unit[who], index.tables(x_unit[who]), cell, codes[own], length[own])
                    q, m = np.nonzero(far <= index.radius + moved[own] + 1e-7)
                    a, b = who[q], own[m]
                    other = x_rep[a] != y_rep[b]
                    a, b = a[other], b[other]
                    for s in range(0, len(a), 200_000):
                        p, r = a[s : s + 200_000], b[s : s + 200_000]
                        near = np.einsum("ij,ij->i", x[p], y[r]) / (x_size[p] * y_size[r]) >= least
                        p, r = p[near], r[near]
                        if not len(p):
                            continue
                        # A pair that the other side asks for too is counted there for the other side.
                        want = r * (first * second) + x_cell[p]
                        at = np.minimum(np.searchsorted(asked, want), len(asked) - 1)
                        alone = asked[at] != want
                        for rep, number in ((x_rep[p], y_copies[r]), (y_rep[r[alone]], x_copies[p[alone]])):
                            ids, at = np.unique(rep, return_inverse=True)
                            gained.append(np.stack([ids, np.bincount(at, number, minlength=len(ids)).astype(np.int64)]))
                        _join(root, x_rep[p], y_rep[r])
        all_ = np.concatenate(gained, axis=1)
        nodes, at = np.unique(all_[0], return_inverse=True)
        return pa.table({"rep": pa.array(nodes), "gained": pa.array(np.bincount(at, all_[1], minlength=len(nodes)).astype(np.int64)), "top": pa.array([_top(root, n) for n in nodes.tolist()], pa.int64())})

    keys = ["g", "block", "part"]
    found = stored(members.groupBy(*keys).cogroup(askers.groupBy(*keys)).applyInArrow(compare, "rep bigint, gained bigint, top bigint"), "gained")
    groups = components(found, "rep", "top")
    links = found.groupBy("rep").agg(F.sum("gained").alias("gained"))
    by_class = classes.select("h1", "h2", "rep", "least_id", "copies").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    by_class = stored(by_class.select("h1", "h2", "label", "least_id", (F.col("copies") - 1 + F.coalesce("gained", F.lit(0))).alias("linked")), "by-class")
    smallest = by_class.groupBy("label").agg(F.min("least_id").alias("component"))
    by_class = by_class.join(smallest, "label").select("h1", "h2", "linked", "component")
    out = of.select("id", "h1", "h2", F.col("v").isNotNull().alias("good")).join(by_class, ["h1", "h2"], "left")
    component = F.when(F.col("good"), F.col("component")).otherwise(F.col("id")).cast("bigint")
    return out.select(F.col("id").alias(id_col), F.when(F.col("good"), F.col("linked")).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _read(rows: pa.Table, exact, width: int):
    """Vectors, their ids, copies and cells, and the cells they ask as rows and cells."""
    x = np.frombuffer(b"".join(rows["v"].to_pylist()), exact).reshape(-1, width).astype(float)
    asks = rows["asks"].combine_chunks()
    size = np.fromiter(map(len, asks), np.int64, len(asks)) if len(asks) else np.zeros(0, np.int64)
    return x, rows["rep"].to_numpy(), rows["copies"].to_numpy(), rows["cell"].to_numpy().astype(np.int64), np.repeat(np.arange(len(x)), size), asks.flatten().to_numpy().astype(np.int64)


def _top(root: dict[int, int], x: int) -> int:
    while root.get(x, x) != x:
        root[x] = root.get(root[x], root[x])
        x = root[x]
    return x


def _join(root: dict[int, int], a: np.ndarray, b: np.ndarray) -> None:
    """Join the ends of links, each end's smallest partner first, so that few links need the slow way."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    ids, low = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(ids))
    p, q = low[: len(a)], low[len(a) :]
    while True:
        x, y = label[p], label[q]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    for i, t in zip(ids.tolist(), ids[label].tolist(), strict=True):
        u, w = _top(root, i), _top(root, t)
        if u != w:
            root[max(u, w)] = min(u, w)
