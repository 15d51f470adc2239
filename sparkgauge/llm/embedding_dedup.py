"""Near-duplicate vectors by product quantisation over inverted lists, with exact cosine in the end."""

from __future__ import annotations

from math import isqrt, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop, numbered


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of at most k clusters; Lloyd's algorithm from a seeded choice of points."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Quantizer:
    """Coarse centroids in one or two levels, and code books of the residuals' subspaces. Unlike lists have unlike numbers."""

    def __init__(self, x: np.ndarray, lists: int, fine: int, parts: int, codes: int):
        self.coarse = kmeans(x, lists)
        left = x - self.coarse[nearest(x, self.coarse)]
        self.fine = kmeans(left, fine, seed=5) if fine > 1 else np.zeros((1, x.shape[1]))
        left -= self.fine[nearest(left, self.fine)]
        self.parts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
        self.books = [kmeans(left[:, p], codes, seed=11 + k) for k, p in enumerate(self.parts)]

    def centre(self, at):
        return self.coarse[at // len(self.fine)] + self.fine[at % len(self.fine)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance between each vector and what its codes stand for)."""
        at = nearest(x, self.coarse)
        at = at * len(self.fine) + nearest(x - self.coarse[at], self.fine)
        left = x - self.centre(at)
        codes = np.stack([nearest(left[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            left[:, p] -= b[codes[:, k]]
        return at, codes.astype(np.uint8), np.sqrt((left * left).sum(1))

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """The lists that hold a near vector of x, level by level: x must come within `reach` of the plane between its own centroid and the list's."""
        out = []
        for i, near in enumerate(cells_near(x, self.coarse, reach)):
            if len(self.fine) == 1:
                out.append(near)
                continue
            inner = cells_near(x[i] - self.coarse[near], self.fine, reach)
            out.append(np.concatenate([c * len(self.fine) + f for c, f in zip(near, inner, strict=True)]))
        return out

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of whole vectors x to coded ones of one list, from a table of each subspace."""
        r = x - self.centre(at)
        out = np.zeros((len(x), len(codes)))
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            table = (r[:, p] ** 2).sum(1)[:, None] - 2 * r[:, p] @ b.T + (b * b).sum(1)
            out += table[:, codes[:, k]]
        return np.sqrt(np.maximum(0, out))


def cells_near(x: np.ndarray, c: np.ndarray, reach: float) -> list[np.ndarray]:
    """For each x the centroids c whose cell begins within `reach`, its own among them."""
    out = []
    for i in range(0, len(x), 1024):  # bounded memory
        y = x[i : i + 1024]
        d2 = (y * y).sum(1)[:, None] - 2 * y @ c.T + (c * c).sum(1)
        own = d2.argmin(1)
        gap = np.sqrt(np.maximum(0, ((c[own] ** 2).sum(1)[:, None] - 2 * c[own] @ c.T + (c * c).sum(1))))
        hit = d2 - d2[np.arange(len(y)), own][:, None] <= 2 * reach * gap + 1e-9
        out += [np.flatnonzero(h) for h in hit]
    return out


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, sample: int = 20_000, z: float = 2.5, parts: int = 8, codes: int = 64, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector; links join vectors of one label with cosine >= `cosine`.

    The quantiser is fitted on at most `sample` vectors, chosen by a hash of the row (the only bounded
    step); every vector is indexed. Lists grow with the root of the number of vectors: a second level
    divides those of the first when the sample can't carry more of them. A vector probes the lists whose
    cell begins within `z` standard deviations of what a difference as long as the cosine allows, in a
    random direction, moves it across the plane between two centroids; `z` of the root of the dimension
    is every list that can matter. At 2.5 a pair just at the threshold is missed with a chance below one
    in a hundred, a nearer pair hardly ever. Table distances drop only what the coding errors rule out;
    the exact cosine decides. Equal vectors are collapsed first. Lists are cut into blocks of about
    `block` members on both sides, so no group is gathered in one task, and each cell gives link counts
    and a spanning forest, never its pairs. Vectors that are null, empty, zero or hold null or non-finite
    parts, and those without a label, link with nothing. Vectors of unlike length never link. Rows of a
    repeated id are different vectors; a null id is never a component's id, and a component without any
    id has a null one and keeps its rows. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    base = numbered(base.withColumn("good", good), "row")
    # Equal vectors become one class.
    reps = cut(base.where("good").groupBy("label", "v").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("n")))
    fit = [np.array(r.v) for r in reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()]
    alone = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), "good")
    if not fit:
        return alone.drop("good")
    by_width: dict[int, list] = {}
    for x in fit:
        by_width.setdefault(len(x), []).append(x / np.abs(x).max())
    lists = max(1, isqrt(reps.count()) // 2)
    first = min(lists, max(1, sample // 20))
    quantizers = spark.sparkContext.broadcast({w: Quantizer(np.stack([y / np.sqrt((y * y).sum()) for y in x]), min(first, max(1, len(x) // 16)), -(-lists // first), parts, codes) for w, x in by_width.items()})
    radius = sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def index(batches):
        for b in batches:
            width = b["v"].map(len)
            for w, rows in b.groupby(width):
                x = np.stack(rows["v"].to_numpy()).astype(float)
                x /= np.abs(x).max(1)[:, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                if (q := quantizers.value.get(w)) is None:
                    at, cs, err, probe = np.zeros(len(x), int), [b""] * len(x), np.zeros(len(x)), [np.array([0])] * len(x)
                else:
                    at, c, err = q.encode(x)
                    cs, probe = [y.tobytes() for y in c], q.probes(x, radius * min(1.0, z / sqrt(w)))
                yield pd.DataFrame({"id": rows["id"], "label": rows["label"], "n": rows["n"], "w": w, "unit": list(x), "list": at, "codes": cs, "err": err, "probes": [p.tolist() for p in probe]})

    label = reps.schema["label"].dataType.simpleString()
    shape = f"id long, label {label}, n long, w int, unit array<double>, list int, codes binary, err double, probes array<int>"
    indexed = cut(reps.mapInPandas(index, shape))
    key = ["label", "w", "list"]
    sizes = indexed.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    asked = indexed.select("id", "label", "w", F.explode("probes").alias("list"))
    asks = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("asks"))
    cells = cut(sizes.join(asks, key).select(*key, F.ceil(F.col("size") / block).cast("int").alias("mb"), F.ceil(F.col("asks") / block).cast("int").alias("qb")))
    side = lambda name, n: F.pmod(F.xxhash64("id", F.lit(name)), F.col(n)).cast("int").alias(name)
    members = indexed.join(cells, key).select(*key, side("m", "mb"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "id", "n", "unit", "codes", "err")
    queries = indexed.select("id", "label", "w", "n", "unit", F.explode("probes").alias("list")).join(cells, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), side("q", "qb"), F.col("id").alias("id"), F.col("n").alias("n"), F.col("unit").alias("unit"))

    def search(key, m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(m) or not len(q):
            return pd.DataFrame({"id": [], "links": [], "low": []})
        _, w, at = key[:3]
        x, y = np.stack(q["unit"].to_numpy()), np.stack(m["unit"].to_numpy())
        qid, mid = q["id"].to_numpy(), m["id"].to_numpy()
        may = qid[:, None] != mid[None]
        if (z := quantizers.value.get(int(w))) is not None:
            may &= z.distances(x, int(at), np.stack([np.frombuffer(c, np.uint8) for c in m["codes"]])) <= radius + m["err"].to_numpy()[None] + 1e-9
        a, b = np.nonzero(may)
        near = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], y[b[i : i + 65536]]) >= cosine for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
        a, b = a[near], b[near]
        links = np.bincount(a, m["n"].to_numpy(float)[b], len(q))
        # Spanning forest: smallest id reachable within the cell.
        ids, inv = np.unique(np.concatenate([qid, mid]), return_inverse=True)
        u, v, low = inv[: len(q)][a], inv[len(q) :][b], np.arange(len(ids))
        while True:
            new = low.copy()
            np.minimum.at(new, u, low[v])
            np.minimum.at(new, v, low[u])
            new = new[new]
            if (new == low).all():
                break
            low = new
        found = np.unique(np.concatenate([u, v]))
        count = np.zeros(len(ids))
        count[inv[: len(q)]] = links
        return pd.DataFrame({"id": ids[found], "links": count[found].astype(np.int64), "low": ids[low[found]]})

    on = [*key, "m", "q"]
    queries = queries.toDF(*queries.columns)
    members = members.toDF(*members.columns)
    found = cut(members.groupBy(*on).cogroup(queries.groupBy(*on)).applyInPandas(search, "id long, links long, low long"))
    comp = connected_components(found.select("id", "low"), "id", "low")
    of = reps.select("label", "v", F.col("id").alias("rep"), "n")
    of = of.join(found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")), "rep", "left").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = cut(base.where("good").join(of, ["label", "v"]).select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    least = linked.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = linked.join(least, "component").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    drop(reps, indexed, cells, found, comp)
    return linked.unionByName(alone.where("not good").drop("good"))
