"""Distances, nearest places and accessibility."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweft.functions.exprs import _col
from panelweft.session import ship, stored

#: WGS 84.
A, INV_F, K0 = 6378137.0, 298.257223563, 0.9996
#: Places up to which they are an expression of the scan; more are met through leaves.
FEW_PLACES = 2_000
#: Places that a leaf may have, and leaves that the driver holds: beyond that leaves grow.
LEAF, MAX_LEAVES = 256, 1 << 17


def utm(lat: Column | str, lon: Column | str, zone: int = 45) -> tuple[Column, Column]:
    """Easting and northing in metres, by the series in the third flattening (millimetres within a zone)."""
    n = 1 / (2 * INV_F - 1)
    big = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(_col(lat)), F.radians(_col(lon) - float(6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(alpha)), F.lit(0.0))
    return 500000.0 + K0 * big * east, K0 * big * north


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p, q = F.radians(_col(lat1)), F.radians(_col(lat2))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_col(lon2) - _col(lon1)) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(h))


def nearest_place(points: DataFrame, places: DataFrame, *, x: str, y: str, place: str, px: str, py: str, few: int = FEW_PLACES, leaf: int = LEAF) -> DataFrame:
    """points with place and distance of the nearest place (least name among equals).

    Few places (counted first) become an expression of the scan; more are met through the
    leaves of a k-d partition (see _by_leaves), with the same result.
    """
    known = places.select(place, F.col(px).cast("double").alias(px), F.col(py).cast("double").alias(py)).filter(F.col(px).isNotNull() & F.col(py).isNotNull())
    rows = known.limit(few + 1).collect()
    if len(rows) > few:
        return _by_leaves(points, known, x, y, place, px, py, leaf)
    if not rows:
        return points.withColumns({place: F.lit(None).cast(places.schema[place].dataType), "distance": F.lit(None).cast("double")})
    table = places.sparkSession.createDataFrame([([tuple(r) for r in rows],)], f"_places array<struct<p:{places.schema[place].dataType.simpleString()},x:double,y:double>>")
    best = F.array_min(F.transform("_places", lambda r: F.struct(F.sqrt(F.pow(r["x"] - F.col(x), 2) + F.pow(r["y"] - F.col(y), 2)).alias("d"), r["p"].alias("p"))))
    return points.crossJoin(F.broadcast(table)).withColumn("_b", best).withColumns({place: F.col("_b.p"), "distance": F.col("_b.d")}).drop("_b", "_places")


class Leaves:
    """A k-d tree of the plane: inner nodes cut at x or y; leaves have a number and the box of their places."""

    def __init__(self) -> None:
        self.axis, self.cut, self.low, self.high, self.leaf = [-1], [0.0], [-1], [-1], [0]
        self.n = 1

    def split(self, node: int, x: np.ndarray, y: np.ndarray, most: int) -> None:
        """Cut a leaf node by medians of a sample of its places, until a leaf has at most `most` of the sample."""
        todo = [(node, np.stack([x, y]))]
        while todo:
            at, p = todo.pop()
            spread = p.max(axis=1) - p.min(axis=1)
            axis = int(np.argmax(spread))
            if p.shape[1] <= most or spread[axis] <= 0:
                continue
            c = np.sort(p[axis])
            cut = c[len(c) // 2]
            cut = cut if cut > c[0] else c[np.searchsorted(c, c[0], side="right")]  # both sides get some
            self.axis[at], self.cut[at], self.low[at], self.high[at] = axis, float(cut), len(self.axis), len(self.axis) + 1
            for leaf in (self.leaf[at], self.n):
                self.axis.append(-1), self.cut.append(0.0), self.low.append(-1), self.high.append(-1), self.leaf.append(leaf)
            self.leaf[at] = -1
            self.n += 1
            left = p[axis] < cut
            todo += [(self.low[at], p[:, left]), (self.high[at], p[:, ~left])]

    def frozen(self, boxes: np.ndarray | None = None) -> Leaves:
        """With arrays for lists, and boxes (x0, x1, y0, y1) of all nodes from those of the leaves."""
        out = Leaves()
        out.n = self.n
        for name in ("axis", "low", "high", "leaf"):
            setattr(out, name, np.array(getattr(self, name), np.int64))
        out.cut = np.array(self.cut)
        if boxes is not None:
            out.box = np.empty((len(out.axis), 4))
            for i in range(len(out.axis) - 1, -1, -1):  # children come after their parent
                a, b = (out.box[k] for k in (out.low[i], out.high[i])) if out.axis[i] >= 0 else (boxes[out.leaf[i]],) * 2
                out.box[i] = min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])
        return out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each spot."""
        node = np.zeros(len(x), np.int64)
        while len(go := np.flatnonzero(self.axis[node] >= 0)):
            k = node[go]
            c = np.where(self.axis[k] == 0, x[go], y[go])
            node[go] = np.where(c < self.cut[k], self.low[k], self.high[k])
        return self.leaf[node]

    def near(self, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(spot, leaf) of all leaves whose box is within d of a spot."""
        spot, node, found = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(spot):
            b = self.box[node]
            dx = np.maximum(np.maximum(b[:, 0] - x[spot], x[spot] - b[:, 1]), 0)
            dy = np.maximum(np.maximum(b[:, 2] - y[spot], y[spot] - b[:, 3]), 0)
            ok = np.hypot(dx, dy) <= d[spot] * (1 + 1e-12)
            spot, node = spot[ok], node[ok]
            end = self.axis[node] < 0
            found.append((spot[end], self.leaf[node[end]]))
            spot, node = np.repeat(spot[~end], 2), np.stack([self.low[node[~end]], self.high[node[~end]]], axis=1).ravel()
        return np.concatenate([s for s, _ in found]), np.concatenate([k for _, k in found])


def _mapped(df: DataFrame, columns: Sequence[str], f, schema: str) -> DataFrame:
    """f(arrays of the columns) -> arrays, batch by batch."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = f(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    return df.select(*columns).mapInArrow(run, schema)


def partitioned(spots: DataFrame, leaf: int = LEAF, sample: int = 1 << 16) -> tuple[Leaves, int]:
    """Leaves of at most so many of the distinct spots (_px, _py), or of n / MAX_LEAVES where that is more; and that bound.

    The tree comes from samples, taken by hash: of all spots, then of the leaves that turn out too large.
    """
    n = spots.count()
    bound = max(leaf, -(-n // MAX_LEAVES))
    tree = Leaves()
    share = min(1.0, sample / max(n, 1))
    pick = lambda part, salt: F.pmod(F.xxhash64(F.lit(salt), "_px", "_py"), F.lit(1 << 30)) < int(part * (1 << 30))
    rows = spots.filter(pick(share, 0)).select("_px", "_py").toPandas()  # some `sample` rows
    if len(rows):
        tree.split(0, rows["_px"].to_numpy(), rows["_py"].to_numpy(), max(1, int(bound * share / 2)))
    for salt in range(1, 64):
        held = tree.frozen()
        placed = _mapped(spots, ["_px", "_py"], lambda x, y: (x, y, held.of(x, y)), "_px double, _py double, leaf long")  # noqa: B023
        large = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > bound).orderBy(F.desc("n"), "leaf").limit(256).collect()}
        if not large:
            return held, bound
        node = {k: i for i, k in enumerate(tree.leaf) if k in large}
        rows = placed.filter(F.col("leaf").isin(list(large)) & pick(min(1.0, sample / sum(large.values())), salt)).toPandas()
        for k, own in rows.groupby("leaf"):
            tree.split(node[k], own["_px"].to_numpy(), own["_py"].to_numpy(), max(1, bound * len(own) // (2 * large[k])))
    raise ValueError("leaves stay above their bound")


def _by_leaves(points: DataFrame, places: DataFrame, x: str, y: str, place: str, px: str, py: str, leaf: int) -> DataFrame:
    """The nearest place by a k-d partition: the best of a spot's own leaf, then of all leaves that are as near as that.

    A leaf has a bounded number of places wherever they crowd, and two joins are enough.
    """
    ship(points.sparkSession)
    spots = stored(places.groupBy(F.col(px).alias("_px"), F.col(py).alias("_py")).agg(F.min(place).alias("_p")))
    tree, _ = partitioned(spots, leaf)
    number = F.xxhash64("_px", "_py")
    placed = _mapped(spots.withColumn("_h", number), ["_px", "_py", "_h"], lambda a, b, h: (a, b, h, tree.of(a, b)), "_px double, _py double, _h long, _leaf long")
    held = stored(placed.join(spots, ["_px", "_py"]).groupBy("_leaf").agg(F.collect_list(F.struct("_px", "_py", "_p")).alias("_own"), F.min("_px").alias("x0"), F.max("_px").alias("x1"), F.min("_py").alias("y0"), F.max("_py").alias("y1")))
    boxes = np.full((tree.n, 4), [np.inf, -np.inf, np.inf, -np.inf])
    for r in held.select("_leaf", "x0", "x1", "y0", "y1").toLocalIterator():  # MAX_LEAVES rows and some
        boxes[r["_leaf"]] = r["x0"], r["x1"], r["y0"], r["y1"]
    whole = tree.frozen(boxes)
    leaves = held.select(F.col("_leaf").alias("_k"), "_own")

    def best(asked: DataFrame) -> DataFrame:
        distance = lambda r: F.sqrt(F.pow(r["_px"] - F.col("_x"), 2) + F.pow(r["_py"] - F.col("_y"), 2))
        return asked.join(leaves, F.col("_leaf") == F.col("_k")).select("_x", "_y", F.array_min(F.transform("_own", lambda r: F.struct(distance(r).alias("d"), r["_p"].alias("p")))).alias("_b"))

    mine = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna().distinct()
    first = best(_mapped(mine, ["_x", "_y"], lambda a, b: (a, b, tree.of(a, b)), "_x double, _y double, _leaf long"))
    first = stored(first.select("_x", "_y", "_b", F.col("_b.d").alias("_d")))

    def around(a, b, d):
        spot, k = whole.near(a, b, d)
        other = k != whole.of(a, b)[spot]
        return a[spot[other]], b[spot[other]], k[other]

    second = best(_mapped(first, ["_x", "_y", "_d"], around, "_x double, _y double, _leaf long"))
    done = first.select("_x", "_y", "_b").unionByName(second).groupBy("_x", "_y").agg(F.min("_b").alias("_b"))
    return points.join(done, (points[x] == done["_x"]) & (points[y] == done["_y"]), "left").select(points["*"], F.col("_b.p").alias(place), F.col("_b.d").alias("distance"))


def accessibility(km: Column | str) -> Column:
    """10 within two kilometres, then falling exponentially."""
    return 10 * F.exp(-0.15 * F.greatest(F.lit(0.0), _col(km) - 2))


def exclusion(access: Column | str, speaks: Column | str) -> Column:
    """10 less accessibility, 1.4 times that where nobody speaks the language, at most 10."""
    base = 10 - _col(access)
    return F.least(F.lit(10.0), F.when(_col(speaks), base).otherwise(base * 1.4))
