"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions by random Gaussian matrices, one for each
table, and decoded to the nearest point of the E8 lattice: this is the vector's cell. A pair
is a candidate if, in some table, one vector's cell is the other's or is among the nearest
neighbouring cells of the other. Candidates are verified by their cosine in
double precision. With the defaults, pairs at a cosine of 0.98 are found with a probability of 0.99
(measured on random pairs; closer pairs more surely).

Vectors that are equal in all components and labels are one class, which is hashed once and
counted with its size, so copies are never expanded into pairs. In cells of few members candidates are joined by
key. Members of a large cell are cut into blocks: a task holds a block of the vectors that live in the cell and one of those that ask
for it, multiplies them, and emits of each vector how many links it has and links that span the blocks' components,
never pairs. Two vectors that share several cells count in the least of their large cells, or, without one, once
among the joined pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import cut, map_arrow
from rankflow.llm.components import components, spanning

#: Candidate pairs up to which a cell is joined, and members of a block beyond.
FEW_PAIRS, BLOCK = 256, 512


def lattice_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with evenly many minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [list(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


NEIGHBOURS = lattice_neighbours()


def _even_integers(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd, round the worst entry the other way."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: E8 is the even integers and their copy moved by one half."""
    whole, half = _even_integers(x), _even_integers(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit keys of lattice points (twice a point is integer) and a salt."""
    key = salt.astype(np.uint64)
    for column in (2 * points).astype(np.int64).astype(np.uint64).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _hash_vectors(tables: int, width: float, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(batch.column("embedding").offsets.to_numpy())
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                for i in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[i : i + 2048]))
                    ids = part.column("cid").to_numpy()
                    label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), dim)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    if dim not in matrices:
                        matrices[dim] = np.random.default_rng([seed, int(dim)]).normal(size=(tables, dim, 8)) / width
                    keys, owners, home = [], [], []
                    for t in range(tables):
                        y = x @ matrices[dim][t]
                        cell = decode(y)
                        salt = (label * 1_000_003 + int(dim)) * 64 + t
                        near = np.argpartition(-((y - cell) @ NEIGHBOURS.T), probes, axis=1)[:, :probes]
                        around = (cell[:, None, :] + NEIGHBOURS[near]).reshape(-1, 8)
                        keys += [_keys(cell, salt), _keys(around, np.repeat(salt, probes))]
                        owners += [ids, np.repeat(ids, probes)]
                        home += [np.ones(len(ids), bool), np.zeros(len(ids) * probes, bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(home))], ["cell", "cid", "home"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c) for c in ("va", "vb"))
        sizes = np.diff(a.offsets.to_numpy())
        x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for v in (a, b))
        starts = np.cumsum(sizes) - sizes
        if len(starts) == 0:
            continue
        # scaled, so that squares of very large and very small components stay finite
        x, y = (v / np.repeat(np.maximum.reduceat(np.abs(v), starts), sizes) for v in (x, y))
        dot, xx, yy = (np.add.reduceat(v, starts) for v in (x * y, x * x, y * y))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(dot / np.sqrt(xx * yy))], ["a", "b", "cosine"])


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors, scaled first so that squares of very large and small components stay finite."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _shares_earlier(cell: int, homes: list, asks: list, other_homes: list, other_asks: list) -> np.ndarray:
    """Which pairs of two lists of vectors share a large cell below ``cell``; of each vector its large cells are given."""
    known = {c: i for i, c in enumerate(sorted({c for some in (*homes, *asks) for c in some if c < cell} & {c for some in (*other_homes, *other_asks) for c in some}))}

    def table(cells: list) -> np.ndarray:
        out = np.zeros((len(cells), len(known)), np.float32)
        for i, some in enumerate(cells):
            out[i, [known[c] for c in some if c in known]] = 1
        return out

    return (table(homes) @ table(other_asks).T + table(asks) @ table(other_homes).T) > 0


def _block_links(threshold: float):
    """Links of a block of homes (side 0) with a block of askers (side 1) of one cell."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, cell = rows.column("side").to_numpy(), rows.column("cell")[0].as_py()
        parts = [rows.filter(pa.array(side == s)) for s in (0, 1)]
        ids, n, label, size = zip(*[[p.column(c).to_numpy() for c in ("cid", "n", "label", "size")] for p in parts])
        also_home = parts[1].column("home").to_numpy(zero_copy_only=False)
        # a pair that lives in the cell together would meet twice
        mask = (label[0][:, None] == label[1][None, :]) & (size[0][:, None] == size[1][None, :]) & (ids[0][:, None] != ids[1][None, :])
        mask &= ~also_home[None, :] | (ids[0][:, None] < ids[1][None, :])
        for dim in np.unique(np.concatenate(size)):
            i, j = (np.flatnonzero(s == dim) for s in size)
            if len(i) and len(j):
                x, y = (_unit(p.column("embedding").combine_chunks().take(pa.array(at))) for p, at in zip(parts, (i, j)))
                mask[np.ix_(i, j)] &= x @ y.T >= threshold
        if mask.any():
            homes, asks = ([p.column(c).to_pylist() for p in parts] for c in ("homes", "asks"))
            mask &= ~_shares_earlier(cell, homes[0], asks[0], homes[1], asks[1])
        out = [(int(a), None, int(m)) for a, m in [*zip(ids[0], mask @ n[1]), *zip(ids[1], n[0] @ mask)] if m]
        at_i, at_j = np.nonzero(mask)
        _, node = np.unique(np.concatenate(ids), return_inverse=True)
        x, y = node[at_i], node[len(ids[0]) + at_j]
        out += [(int(ids[0][at_i[k]]), int(ids[1][at_j[k]]), 0) for k in spanning(x, y, len(node))]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("a", "b", "more"), zip(*out) if out else ([], [], []))})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tables: int = 4, width: float = 0.7, probes: int = 12, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each vector: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null, their lengths agree and their cosine is at least
    ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without an id, link with nothing: they have 0 links and their own id as component.
    Rows of equal vectors link with each other, also if they repeat an id. An empty table
    gives an empty result; other columns are ignored. Smaller ``width`` makes cells finer (fewer
    candidates), more ``tables`` and ``probes`` find more.
    """
    v = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.withColumn("cid", F.when(usable & fine, F.xxhash64("label", "embedding")))

    classes = cut(rows.where("cid is not null").groupBy("label", "embedding", "cid").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")))
    cells = map_arrow(classes.select("cid", F.hash("label").cast("long").alias("label"), "embedding"), _hash_vectors(tables, width, probes, seed), "cell long, cid long, home boolean")
    # cells next to a vector's own count only where some vector lives in them
    lives = cut(cells.where("home").select("cell", "cid"))
    living = lives.groupBy("cell").agg(F.count("*").alias("homes"))
    hits = cut(cells.where("not home").select("cell", "cid").join(living, "cell"))
    asking = hits.groupBy("cell").agg(F.count("*").alias("hits"))
    sizes_of = living.join(asking, "cell", "left").select("cell", "homes", (F.col("homes") + F.coalesce("hits", F.lit(0))).alias("asks")).where("asks > 1")
    members = lives.withColumn("home", F.lit(True)).union(hits.select("cell", "cid", F.lit(False)))
    members = cut(members.join(sizes_of, "cell"))  # who lives in a cell asks for it as well

    few = members.where(f"homes * asks <= {FEW_PAIRS}")
    homes, asks = few.where("home").select("cell", F.col("cid").alias("x")), few.select("cell", F.col("cid").alias("y"))
    pairs = homes.join(asks, "cell").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    left, right = (classes.select(F.col("cid").alias(k), F.col("embedding").alias(f"v{k}"), F.col("label").alias(f"l{k}")) for k in "ab")
    checked = pairs.join(left, "a").join(right, "b").where("la = lb and size(va) = size(vb)").select("a", "b", "va", "vb")
    linked = cut(map_arrow(checked, _cosines, "a long, b long, cosine double").where(F.col("cosine") >= threshold).select("a", "b"))

    # large cells: of each vector those that it lives in and asks for, tables * (1 + probes) at most
    many = members.where(f"homes * asks > {FEW_PAIRS}")
    own = many.groupBy("cid").agg(F.collect_set(F.when(F.col("home"), F.col("cell"))).alias("homes"), F.collect_set("cell").alias("asks"))
    own = cut(own)
    sides = many.select("cell", "cid", F.explode(F.expr("if(home, array(0, 1), array(1))")).alias("side"), F.ceil(F.col("homes") / BLOCK).cast("int").alias("h"), F.ceil(F.col("asks") / BLOCK).cast("int").alias("q"))
    sides = sides.select("*", F.expr("cast(pmod(xxhash64(cid, 'block'), if(side = 0, h, q)) as int)").alias("block"), F.explode(F.expr("sequence(0, if(side = 0, q, h) - 1)")).alias("with"))
    sides = sides.select("cell", "cid", "side", F.expr("if(side = 0, block, with)").alias("i"), F.expr("if(side = 0, with, block)").alias("j"))
    full = sides.join(own, "cid").join(classes.select("cid", "n", F.xxhash64("label").alias("label"), F.size("embedding").alias("size"), "embedding"), "cid")
    full = full.withColumn("home", F.array_contains("homes", F.col("cell")))
    found = cut(full.groupBy("cell", "i", "j").applyInArrow(_block_links(threshold), "a long, b long, more long"))

    # joined pairs that share a large cell have been counted there
    cells_of = [own.select(F.col("cid").alias(k), F.col("homes").alias(f"h{k}"), F.col("asks").alias(f"q{k}")) for k in "ab"]
    both = linked.join(cells_of[0], "a", "left").join(cells_of[1], "b", "left")
    counts = both.where(~F.coalesce(F.arrays_overlap("ha", "qb") | F.arrays_overlap("qa", "hb"), F.lit(False))).select("a", "b")
    sizes = classes.select("cid", "n")
    more = counts.union(counts.select("b", "a")).toDF("cid", "other").join(sizes.toDF("other", "m"), "other").select("cid", "m")
    more = more.union(found.where("b is null").select("a", "more")).groupBy("cid").agg(F.sum("m").alias("more"))
    joined = components(linked.union(found.where("b is not null").select("a", "b"))).toDF("cid", "component")
    grouped = classes.select("cid", "least", "n").join(joined, "cid", "left").join(more, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    result = grouped.join(least, "component").select("cid", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "component_id")
    out = rows.select("vec_id", "cid").join(result, "cid", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
