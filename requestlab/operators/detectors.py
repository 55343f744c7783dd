"""One-class detectors: fitted on valid traffic, higher scores are more anomalous."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from requestlab.sources import store

from . import features, joins, metrics


class NotFitted(RuntimeError):
    """A detector was used before fit()."""


class Detector:
    """``fit`` learns ``params`` (arrays and numbers), ``score`` adds the column ``score``, null where there is no vector."""

    name = ""

    def __init__(self, **options):
        self.options, self.params, self.threshold = options, None, None

    def fit(self, normal: DataFrame) -> Detector:
        raise NotImplementedError

    def _scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """A plain function from a block of vectors to scores, sent to the tasks."""
        raise NotImplementedError

    def score(self, df: DataFrame) -> DataFrame:
        if self.params is None:
            raise NotFitted(f"{self.name}: fit first")
        run = self._scorer()

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            out, there = np.full(len(x), None, object), x.notna().to_numpy()
            if there.any():
                out[there] = run(np.stack(x[there]).astype(float))
            return pd.Series(out)

        return df.withColumn("score", score("embedding"))

    def set_threshold(self, normal: DataFrame, max_fpr: float = 0.05) -> tuple[float, float]:
        """F8: (threshold, false-positive rate it gives on these rows)."""
        row = metrics.threshold_at_fpr(self.score(normal.withColumn("label", F.lit(metrics.VALID))), max_fpr).first()
        self.threshold = row["threshold"]
        return row["threshold"], row["actual_fpr"]

    def default_threshold(self) -> float:
        raise ValueError(f"{self.name}: no threshold set")

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        """``score`` and ``prediction`` = score > threshold; the argument overrides the stored one."""
        cut = threshold if threshold is not None else self.threshold
        return metrics.predict(self.score(df), self.default_threshold() if cut is None else cut)

    # Models as one-row Parquet tables
    def body(self, path: str) -> dict:
        """What is saved, as plain values; larger parts are written below ``path``."""
        if self.params is None:
            raise NotFitted(f"{self.name}: nothing to save")
        plain = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.params.items()}
        return {"params": plain, "options": self.options, "threshold": self.threshold}

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.name, json.dumps(self.body(path)))]
        spark.createDataFrame(row, "name string, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def _restored(cls, spark: SparkSession, body: dict) -> Detector:
        out = cls(**body["options"])
        out.params = {k: np.array(v) if isinstance(v, list) and k != "trees" else v for k, v in body["params"].items()}
        out.threshold = body["threshold"]
        return out


def load(spark: SparkSession, path: str) -> Detector:
    """A saved detector with the scores it had."""
    row = spark.read.parquet(path).first()
    return restore(spark, row["name"], json.loads(row["body"]))


def restore(spark: SparkSession, name: str, body: dict) -> Detector:
    return DETECTORS[name]._restored(spark, body)


class Mahalanobis(Detector):
    """biased covariance and pseudo-inverse, squared distance."""

    name = "mahalanobis"

    def fit(self, normal: DataFrame) -> Mahalanobis:
        _, mean, cov = features.mean_and_covariance(normal, ddof=0)
        self.params = {"mean": mean, "precision": np.linalg.pinv(cov)}
        return self

    def _scorer(self):
        mean, precision = self.params["mean"], self.params["precision"]
        return lambda x: np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)


class RidgeMahalanobis(Detector):
    """unbiased covariance plus a small ridge, distance itself; ``condition`` of the covariance."""

    name = "mahalanobis_ridge"

    def fit(self, normal: DataFrame) -> RidgeMahalanobis:
        _, mean, cov = features.mean_and_covariance(normal, ddof=1)
        cov = cov + self.options.get("ridge", 1e-6) * np.eye(len(mean))
        self.params = {"mean": mean, "precision": np.linalg.inv(cov), "condition": float(np.linalg.cond(cov))}
        return self

    def _scorer(self):
        mean, precision = self.params["mean"], self.params["precision"]
        return lambda x: np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)))


class Hypersphere(Detector):
    """squared distance to the mean vector; radius = (1 - nu) percentile of the fitted rows' scores."""

    name = "hypersphere"

    def fit(self, normal: DataFrame) -> Hypersphere:
        n, s, _ = features._moments(normal)
        self.params = {"center": s / n}
        self.params["radius"] = metrics.percentile(self.score(normal), "score", 1 - self.options.get("nu", 0.05))
        return self

    def default_threshold(self) -> float:
        return self.params["radius"]

    def _scorer(self):
        center = self.params["center"]
        return lambda x: ((x - center) ** 2).sum(axis=1)


def _log_density(x: np.ndarray, weights, means, chols) -> np.ndarray:
    """log(weight) + log N(x) for every component; ``chols`` are Cholesky factors of covariances, or their diagonals if that is all."""
    out = []
    for w, m, c in zip(weights, means, chols, strict=True):
        z, own = ((x - m).T / c[:, None], c) if c.ndim == 1 else (np.linalg.solve(c, (x - m).T), np.diag(c))
        out.append(math.log(max(w, 1e-300)) - 0.5 * (len(m) * math.log(2 * math.pi) + (z * z).sum(axis=0)) - np.log(own).sum())
    return np.stack(out, axis=1)


def _logsumexp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


class GaussianMixture(Detector):
    """EM with full, tied, diag or spherical covariances, best of ``n_init`` starts; score = -log density.

    All starts go through the rows together: one iteration is one pass, in which tasks send the sums of
    responsibilities, means and Gram matrices of every start that still moves, added as they stream
    (``features.task_sums``).  Starts are drawn far apart (k-means||), never two equal vectors.
    """

    name = "gmm"

    def fit(self, normal: DataFrame) -> GaussianMixture:
        self.params = self.fit_all(normal, [self.options])[0].params
        return self

    @classmethod
    def fit_all(cls, normal: DataFrame, options: list[dict]) -> list[GaussianMixture]:
        """A mixture for each of the options, all of them moved by the same passes."""
        rows = store.materialize(normal.where("embedding IS NOT NULL"), "vectors")
        n, mean, cov = features.mean_and_covariance(rows, ddof=0)
        fits, drawn = [], {}
        for at, o in enumerate(options):
            key = o.get("n_init", 5), o.get("seed", 42)
            if key not in drawn:  # means are picked one after the other, so fewer components take the first of them
                most = max(p.get("k", 3) for p in options if (p.get("n_init", 5), p.get("seed", 42)) == key)
                drawn[key] = cls.starts(rows, most, *key)
            reg = o.get("reg", 1e-6) * np.eye(len(mean))
            for means in drawn[key]:
                m = means[: o.get("k", 3)]
                fits.append({"of": at, "reg": reg, "w": np.full(len(m), 1 / len(m)), "m": m, "c": np.stack([cov + reg] * len(m)), "before": -np.inf, "value": -np.inf, "passes": 0})
        moving = [f for f in fits if options[f["of"]].get("max_iter", 200) > 0]
        while moving:
            still = []
            for f, (nk, sums, grams, value) in zip(moving, cls._pass(rows, moving), strict=True):
                o, nk = options[f["of"]], np.maximum(nk, 1e-12)
                f["w"], f["m"], f["value"], f["passes"] = nk / nk.sum(), sums / nk[:, None], value, f["passes"] + 1
                if grams.ndim == 2:  # squares alone
                    covs = np.stack([np.diag(v) for v in grams / nk[:, None] - f["m"] ** 2])
                else:
                    covs = grams / nk[:, None, None] - np.einsum("ki,kj->kij", f["m"], f["m"])
                f["c"] = cls._shape(covs, f["w"], o.get("covariance", "full")) + f["reg"]
                f["narrow"] = o.get("covariance", "full") in ("diag", "spherical")
                if abs(value - f["before"]) / n >= o.get("tol", 1e-3) and f["passes"] < o.get("max_iter", 200):
                    still.append(f)
                f["before"] = value
            moving = still
        store.discard(rows)
        out = []
        for at, o in enumerate(options):
            best = max((f for f in fits if f["of"] == at), key=lambda f: f["value"])
            weights, means, covs, value = best["w"], best["m"], best["c"], best["value"]
            k, d = means.shape
            free = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d, "spherical": k}[o.get("covariance", "full")] + k * d + k - 1
            model = cls(**o)
            model.params = {
                "weights": weights, "means": means, "covs": covs,
                "loglik": value, "aic": 2 * free - 2 * value, "bic": free * math.log(n) - 2 * value,
            }
            out.append(model)
        return out

    @staticmethod
    def starts(rows: DataFrame, k: int, n_init: int, seed: int, rounds: int = 3) -> list[np.ndarray]:
        """Means of every start by k-means|| (Bahmani et al. 2012): rounds of draws in proportion to the squared distance.

        A row's luck is a hash of its columns, so starts do not depend on how rows are dealt.  A round
        draws about 2 k rows a start, which are weighed by the rows nearest to them and thinned to
        k; fewer, if there are fewer distinct vectors.
        """
        kinds = [c for c, t in rows.dtypes if "map" not in t]
        luck = [F.shiftrightunsigned(F.xxhash64(*kinds, F.lit(seed + s), F.lit(r)), 11) / F.lit(float(1 << 53)) for r in range(rounds) for s in range(n_init)]
        rows = rows.select("embedding", F.array(*luck).alias("u"))
        held = [np.empty((0, 0))] * n_init
        first = rows.select("embedding", F.posexplode(F.slice("u", 1, n_init)).alias("s", "u")).groupBy("s").agg(F.min_by("embedding", F.struct("u", "embedding")).alias("v")).collect()
        for r in first:
            held[r["s"]] = np.array([r["v"]], float)

        def gaps(x: np.ndarray, means: np.ndarray) -> np.ndarray:
            """Squared distances by differences, so that equal vectors are exactly 0 apart."""
            return np.stack([((x - m) ** 2).sum(1) for m in means], axis=1)

        for r in range(rounds):
            now = list(held)

            def spread(frames: Iterator[pd.DataFrame], now=now) -> np.ndarray:
                total = np.zeros(n_init)
                for pdf in frames:
                    if len(pdf):
                        x = np.stack(pdf["embedding"]).astype(float)
                        total += [gaps(x, m).min(1).sum() for m in now]
                return total

            phi = np.maximum(features.task_sums(rows, spread), 1e-300)

            def draw(frames: Iterator[pd.DataFrame], now=now, phi=phi, r=r) -> Iterator[pd.DataFrame]:
                for pdf in frames:
                    if len(pdf):
                        x, u = np.stack(pdf["embedding"]).astype(float), np.stack(pdf["u"])[:, r * n_init : (r + 1) * n_init]
                        for s, m in enumerate(now):
                            at = np.flatnonzero(u[:, s] < 2 * k * gaps(x, m).min(1) / phi[s])
                            if len(at):
                                yield pd.DataFrame({"s": np.full(len(at), s), "v": list(x[at])})

            drawn = rows.mapInPandas(draw, "s int, v array<double>").distinct().collect()  # about 2 k rows a start
            for s in range(n_init):
                held[s] = np.array([*map(tuple, held[s]), *sorted(tuple(r["v"]) for r in drawn if r["s"] == s)])

        while few := [s for s in range(n_init) if len(held[s]) < k]:  # luck left some out: the farthest row joins

            def far(frames: Iterator[pd.DataFrame], few=few, now=tuple(held)) -> Iterator[pd.DataFrame]:
                for pdf in frames:
                    if len(pdf):
                        x = np.stack(pdf["embedding"]).astype(float)
                        for s in few:
                            d = gaps(x, now[s]).min(1)
                            yield pd.DataFrame({"s": [s], "d": [d.max()], "v": [x[d.argmax()]]})

            best = rows.mapInPandas(far, "s int, d double, v array<double>").where("d > 0").groupBy("s").agg(F.max_by("v", F.struct("d", "v")).alias("v")).collect()
            if not best:
                break
            for r in best:
                held[r["s"]] = np.vstack([held[r["s"]], r["v"]])

        def weigh(frames: Iterator[pd.DataFrame]) -> np.ndarray:
            total = np.zeros(sum(map(len, held)))
            for pdf in frames:
                if len(pdf):
                    x, at = np.stack(pdf["embedding"]).astype(float), 0
                    for m in held:
                        total[at : at + len(m)] += np.bincount(gaps(x, m).argmin(1), minlength=len(m))
                        at += len(m)
            return total

        mass = np.split(features.task_sums(rows, weigh), np.cumsum([len(m) for m in held])[:-1])
        out = []
        for s, (m, w) in enumerate(zip(held, mass, strict=True)):
            rng, pick = np.random.Generator(np.random.PCG64(seed + s)), [int(w.argmax())]
            while len(pick) < k:
                far = w * gaps(m, m[pick]).min(1)
                if not far.any():
                    break
                pick.append(int(rng.choice(len(m), p=far / far.sum())))
            out.append(m[pick])
        return out

    @staticmethod
    def _shape(covs: np.ndarray, weights: np.ndarray, kind: str) -> np.ndarray:
        d = covs.shape[1]
        if kind == "tied":
            return np.stack([np.einsum("k,kij->ij", weights, covs)] * len(covs))
        if kind == "diag":
            return np.stack([np.diag(np.maximum(np.diag(c), 0)) for c in covs])
        if kind == "spherical":
            return np.stack([np.eye(d) * max(np.trace(c) / d, 0) for c in covs])
        return covs

    @staticmethod
    def _pass(df: DataFrame, fits: list[dict]) -> list[tuple]:
        """Sums of responsibilities, of vectors and of their products, and the log likelihood, for each start."""
        # without covariances between dimensions, squares are all that travels
        models = [(f["w"], f["m"], np.sqrt(np.einsum("kii->ki", f["c"])) if f.get("narrow") else np.linalg.cholesky(f["c"])) for f in fits]

        def fold(frames: Iterator[pd.DataFrame]) -> np.ndarray:
            total = [[np.zeros(1), np.zeros(len(w)), np.zeros(m.shape), np.zeros(c.shape)] for w, m, c in models]
            for pdf in frames:
                if len(pdf):
                    x = np.stack(pdf["embedding"]).astype(float)
                    for sums, model in zip(total, models, strict=True):
                        logp = _log_density(x, *model)
                        norm = _logsumexp(logp)
                        r = np.exp(logp - norm[:, None])
                        products = r.T @ (x * x) if model[2].ndim == 2 else np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
                        for t, more in zip(sums, (norm.sum(), r.sum(0), r.T @ x, products), strict=True):
                            t += more
            return np.concatenate([t.ravel() for sums in total for t in sums])

        v, out, at = features.task_sums(df.select("embedding"), fold), [], 0
        for w, m, c in models:
            cut = np.split(v[at : at + 1 + len(w) + m.size + c.size], np.cumsum([1, len(w), m.size]))
            at += 1 + len(w) + m.size + c.size
            out.append((cut[1], cut[2].reshape(m.shape), cut[3].reshape(c.shape), cut[0][0]))
        return out

    def _scorer(self):
        w, m, chols = self.params["weights"], self.params["means"], np.linalg.cholesky(self.params["covs"])
        return lambda x: -_logsumexp(_log_density(x, w, m, chols))


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


class IsolationForest(Detector):
    """trees on samples of at most 256 rows, one task a tree; score 2^(-mean path / c(sample)).

    A tree's sample is the ``size`` rows of lowest hash: of all of a row's columns and the tree, so that equal
    vectors of different rows are drawn apart and the model does not depend on how rows are dealt.
    Rows equal in all columns are one entry with a count.
    """

    name = "isolation_forest"

    def _samples(self, rows: DataFrame, n: int, trees: int, size: int, seed: int) -> DataFrame:
        """``tree, h, embedding, c``: enough rows of lowest hash for every tree, equal ones counted."""
        # The row is hashed once (bound to ``x``), a tree's hash follows from that number.
        kinds = [c for c, t in rows.dtypes if "map" not in t]
        u = F.flatten(
            F.transform(
                F.array(F.xxhash64(*kinds, F.lit(seed))),
                lambda x: F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(x, t).alias("h"))),
            )
        )
        share = min(1.0, (1.5 * size + 20) / n)
        while True:
            low = int((2 * share - 1) * (2**63 - 1)) if share < 1 else 2**63 - 1
            picked = F.filter(u, lambda x: x["h"] <= F.lit(low))
            some = rows.select("embedding", F.explode(picked).alias("x")).groupBy("x.tree", "x.h").agg(F.first("embedding").alias("embedding"), F.count("*").alias("c"))
            some = store.materialize(some, "samples")
            full = some.groupBy("tree").agg(F.sum("c").alias("c")).where(F.col("c") >= size).count()
            if full == trees or share >= 1:
                return some
            store.discard(some)
            share = min(1.0, 8 * share)  # few distinct rows: a hash range may hold none

    def fit(self, normal: DataFrame) -> IsolationForest:
        self.params = self.fit_all(normal, [self.options])[0].params
        c = self.options.get("contamination")
        if c:
            self.params["offset"] = metrics.percentile(self.score(normal), "score", 1 - c)
        return self

    @classmethod
    def fit_all(cls, normal: DataFrame, options: list[dict]) -> list[IsolationForest]:
        """A forest for each of the options (``offset`` left open): one draw of rows a seed, each tree grown once a sample size."""
        rows = normal.where("embedding IS NOT NULL")
        n = rows.count()
        if n == 0:
            raise ValueError("no vectors to fit on")
        size = lambda o: min(o.get("max_samples", 256), n)
        grown: dict = {}
        for seed in {o.get("seed", 42) for o in options}:
            own = [o for o in options if o.get("seed", 42) == seed]
            trees, sizes = max(o.get("n_estimators", 100) for o in own), sorted({size(o) for o in own})
            picked = cls()._samples(rows, n, trees, sizes[-1], seed)
            got = picked.groupBy("tree").applyInPandas(cls._grower(sizes, seed), "tree int, size int, nodes array<double>").collect()  # the model: one row a tree
            store.discard(picked)
            grown |= {(seed, r["size"], r["tree"]): r["nodes"] for r in got}
        out = []
        for o in options:
            model = cls(**o)
            model.params = {"trees": [grown[o.get("seed", 42), size(o), t] for t in range(o.get("n_estimators", 100))], "size": size(o)}
            out.append(model)
        return out

    @staticmethod
    def _grower(sizes: list[int], seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def grow(x: np.ndarray, size: int, tree: int) -> np.ndarray:
            rng = np.random.Generator(np.random.PCG64(seed + tree))
            limit, nodes = math.ceil(math.log2(max(size, 2))), []
            stack = [(np.arange(len(x)), 0, -1, 0)]
            while stack:
                rows_, depth, parent, side = stack.pop()
                at = len(nodes)
                if parent >= 0:
                    nodes[parent][2 + side] = at
                part = x[rows_]
                wide = np.flatnonzero(part.max(0) > part.min(0)) if len(rows_) > 1 and depth < limit else []
                if len(wide) == 0:
                    nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows_)))])
                    continue
                f = int(rng.choice(wide))
                cut = rng.uniform(part[:, f].min(), part[:, f].max())
                nodes.append([f, cut, -1, -1, 0.0])
                low = part[:, f] < cut
                stack += [(rows_[~low], depth + 1, at, 1), (rows_[low], depth + 1, at, 0)]
            return np.array(nodes, float).ravel()

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, tree = pdf.sort_values("h").head(sizes[-1]), int(pdf["tree"].iloc[0])
            x = np.repeat(np.stack(pdf["embedding"]).astype(float), np.minimum(pdf["c"], sizes[-1]), axis=0)
            return pd.DataFrame({"tree": tree, "size": sizes, "nodes": [grow(x[:s], s, tree) for s in sizes]})

        return build

    def default_threshold(self) -> float:
        return self.params.get("offset", 0.5)

    def _scorer(self):
        return lambda x, run=self.scorers([self])[0]: run(x)[:, 0]

    @staticmethod
    def scorers(models: list[IsolationForest]) -> list[Callable[[np.ndarray], np.ndarray]]:
        """One function for all: a column a model.  A forest that begins another one is scored on the way."""
        plans: dict[int, tuple[list, list]] = {}
        for i, m in enumerate(models):
            longest = plans.setdefault(id(m.params["trees"][0]), (m.params["trees"], []))
            if len(m.params["trees"]) > len(longest[0]):
                plans[id(m.params["trees"][0])] = longest = (m.params["trees"], longest[1])
            longest[1].append((len(m.params["trees"]), i, float(average_path(m.params["size"])) or 1.0))
        walks = [([np.asarray(t, float).reshape(-1, 5) for t in trees], sorted(stops)) for trees, stops in plans.values()]

        def run(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), len(models)))
            for trees, stops in walks:
                total, due = np.zeros(len(x)), list(stops)
                for done, t in enumerate(trees, 1):
                    at = np.zeros(len(x), int)
                    while True:
                        f = t[at, 0].astype(int)
                        live = np.flatnonzero(f >= 0)
                        if not len(live):
                            break
                        low = x[live, f[live]] < t[at[live], 1]
                        at[live] = np.where(low, t[at[live], 2], t[at[live], 3]).astype(int)
                    total += t[at, 4]
                    while due and due[0][0] == done:
                        _, i, scale = due.pop(0)
                        out[:, i] = 2.0 ** (-total / done / scale)
            return out

        return [run]

    def body(self, path):
        out = super().body(path)
        out["params"]["trees"] = [list(map(float, t)) for t in out["params"]["trees"]]
        return out


class LocalOutlierFactor(Detector):
    """novelty LOF by exact neighbour joins; the model is a written table (id, vector, k-distance, lrd, neighbours).

    A scored row that is a row of the model, by id and vector, has itself and the neighbours kept there, so only other
    rows are joined again.
    """

    name = "lof"

    def __init__(self, k: int = 100, offset: float = 1.5):
        super().__init__(k=k, offset=offset)
        self.k, self.offset, self.model = k, offset, None

    def fit(self, normal: DataFrame, id_col: str = "vec_id", near: DataFrame | None = None) -> LocalOutlierFactor:
        """``near``: neighbours of the rows among themselves, if they are known already (k of them or more)."""
        rows = normal.select(F.col(id_col).alias("vec_id"), "embedding").where("embedding IS NOT NULL")
        near = joins.nearest_neighbors(rows, rows, self.k, skip_self=True) if near is None else near.where(F.col("rank") <= self.k)
        kdist = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
        lrd = self._density(near, kdist).select(F.col("id").alias("d_id"), "lrd")
        lists = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("near"))  # k cells
        lists = lists.join(rows.groupBy(F.col("vec_id").alias("id")).agg(F.count("*").alias("n")).where("n = 1").drop("n"), "id").withColumnRenamed("id", "n_id")
        model = rows.join(kdist, rows["vec_id"] == kdist["id"]).join(lrd, F.col("vec_id") == F.col("d_id")).join(lists, F.col("vec_id") == F.col("n_id"), "left")
        self.model = store.materialize(model.select("vec_id", "embedding", "k_distance", "lrd", "near"), "lof")
        self.params = {}
        return self

    def body(self, path: str) -> dict:
        if self.model is not None:
            self.model.write.mode("overwrite").parquet(f"{path}-table")
        return super().body(path) | {"table": f"{path}-table"}

    @classmethod
    def _restored(cls, spark: SparkSession, body: dict) -> LocalOutlierFactor:
        out = super()._restored(spark, body)
        out.model = spark.read.parquet(body["table"])
        return out

    def default_threshold(self) -> float:
        return 0.0

    @staticmethod
    def _density(near: DataFrame, kdist: DataFrame) -> DataFrame:
        """Local reachability density of each id from its neighbours' k-distances."""
        reach = near.join(kdist.select(F.col("id").alias("neighbor"), "k_distance"), "neighbor")
        return reach.groupBy("id").agg((1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("lrd"))

    def _neighbors(self, rows: DataFrame) -> DataFrame:
        """The k nearest of the model, of rows of the model itself by what the fit found; ids that stand for several rows are joined."""
        if "near" not in self.model.columns:  # saved without them
            return joins.nearest_neighbors(rows, self.model, self.k)
        v = F.col("embedding").cast("array<double>")
        one = rows.where("embedding IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.count("*").alias("n"), F.first(v).alias("v")).where("n = 1")
        own = self.model.where("near IS NOT NULL").select(F.col("vec_id").cast("long").alias("m_id"), v.alias("m_v"), "near")
        me = F.array(F.struct(F.lit(0.0).alias("distance"), F.col("id").alias("neighbor")))
        known = one.join(own.hint("merge"), (F.col("id") == F.col("m_id")) & (F.col("v") == F.col("m_v"))).select("id", F.slice(F.array_sort(F.concat(me, "near")), 1, self.k).alias("near"))
        known = store.materialize(known, "known")
        rest = rows.join(known.select(F.col("id").alias("k_id")).hint("merge"), F.col("vec_id").cast("long") == F.col("k_id"), "left_anti")
        known = known.select("id", F.posexplode("near").alias("rank", "x")).select("id", "x.neighbor", "x.distance", (F.col("rank") + 1).alias("rank"))
        return joins.nearest_neighbors(rest, self.model, self.k).select(*known.columns).unionByName(known)

    def score(self, df: DataFrame, id_col: str = "vec_id", max_k: DataFrame | None = None) -> DataFrame:
        if self.model is None:
            raise NotFitted("lof: fit first")
        rows = df.select(F.col(id_col).alias("vec_id"), "embedding")
        near = max_k if max_k is not None else self._neighbors(rows)
        near = near.where(F.col("rank") <= self.k)
        side = self.model.select(F.col("vec_id").alias("neighbor"), "k_distance", F.col("lrd").alias("lrd_n"))
        got = near.join(side, "neighbor").groupBy("id").agg(
            (1 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("lrd"), F.avg("lrd_n").alias("lrd_n")
        )
        got = got.select(F.col("id").alias(id_col), (F.col("lrd_n") / F.col("lrd") - self.offset).alias("score"))
        return df.join(got, id_col, "left")


class OneClassSVM(Detector):
    """RBF one-class SVM on random Fourier features, full subgradient steps; score = -(w z - rho).

    An approximation by design: the kernel becomes ``n_features`` cosines, and the primal is
    minimised by averaged subgradients, each one pass that adds up in the tasks.
    """

    name = "ocsvm"

    def fit(self, normal: DataFrame) -> OneClassSVM:
        self.params = self.fit_all(normal, [self.options])[0].params
        return self

    @classmethod
    def fit_all(cls, normal: DataFrame, options: list[dict]) -> list[OneClassSVM]:
        """A model for each of the options: one pass a step for all of them, features made once a map."""
        rows = store.materialize(normal.where("embedding IS NOT NULL").select("embedding"), "vectors")
        n, mean, cov = features.mean_and_covariance(rows, ddof=0)
        d, var = len(mean), float(np.trace(cov) / len(mean))
        models, maps = [], {}
        for o in options:
            gamma = o.get("gamma", "scale")
            gamma = 1 / (d * max(var, 1e-12)) if gamma == "scale" else 1 / d if gamma == "auto" else float(gamma)
            m = o.get("n_features", 256)
            if (key := (gamma, m, o.get("seed", 42))) not in maps:
                rng = np.random.Generator(np.random.PCG64(key[2]))
                maps[key] = (len(maps), rng.standard_normal((d, m)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, m))
            at, proj, phase = maps[key]
            model = cls(**o)
            model.params = {"proj": proj, "phase": phase, "w": np.zeros(m), "rho": 0.0}
            models.append((model, at))
        pairs = [(proj, phase) for _, proj, phase in maps.values()]

        def sums(state: list[tuple] | None) -> list[tuple]:
            """For each model the rows below its margin and the sum of their features; all rows without a state."""

            def fold(frames: Iterator[pd.DataFrame]) -> np.ndarray:
                total = [[0.0, np.zeros(len(m.params["w"]))] for m, _ in models]
                for pdf in frames:
                    if len(pdf):
                        x = np.stack(pdf["embedding"]).astype(float)
                        z = [math.sqrt(2 / len(b)) * np.cos(x @ a + b) for a, b in pairs]
                        for i, (t, (_, at)) in enumerate(zip(total, models, strict=True)):
                            out = np.ones(len(x), bool) if state is None else z[at] @ state[i][0] < state[i][1]
                            t[0], t[1] = t[0] + out.sum(), t[1] + z[at][out].sum(axis=0)
                return np.concatenate([np.append(c, g) for c, g in total])

            v = np.split(features.task_sums(rows, fold), np.cumsum([1 + len(m.params["w"]) for m, _ in models])[:-1])
            return [(x[0], x[1:]) for x in v]

        state = [(g / n, float(g @ g) / n / n * 0.5) for _, g in sums(None)]  # the mean feature: the solution for nu = 1
        for step in range(max(o.get("max_iter", 30) for o in options)):
            rate, moved = 1.0 / (step + 2), []
            for (w, rho), (inside, grad), o in zip(state, sums(state), options, strict=True):
                if step < o.get("max_iter", 30):
                    nu = o.get("nu", 0.05)
                    w = w - rate * (w - grad / (nu * n))
                    rho = rho + rate * (1 - inside / (nu * n)) * float(np.linalg.norm(w))
                moved.append((w, rho))
            state = moved
        for (model, _), (w, rho) in zip(models, state, strict=True):
            model.params |= {"w": w, "rho": rho}
        models = [m for m, _ in models]
        # nu of the fitted rows lie outside: all scores at once, then each model's own percentile
        shares = sorted({o.get("nu", 0.05) for o in options})
        scorers = [m._scorer() for m in models]

        @F.pandas_udf("array<double>")
        def all_scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            v = np.stack(x).astype(float)
            return pd.Series(list(np.stack([s(v) for s in scorers], axis=1)))

        long = store.materialize(rows.select(all_scores("embedding").alias("s")), "scores").select(F.posexplode("s").alias("model", "score"))
        for r in metrics.percentiles(long, "score", [1 - x for x in shares], ["model"]).collect():  # a row a model
            m = models[r["model"]]
            m.params["rho"] = float(m.params["rho"] - r[1 + shares.index(options[r["model"]].get("nu", 0.05))])
        store.discard(rows)
        return models

    def default_threshold(self) -> float:
        return 0.0

    def _scorer(self):
        p = self.params

        def run(x: np.ndarray) -> np.ndarray:
            z = math.sqrt(2 / len(p["phase"])) * np.cos(x @ p["proj"] + p["phase"])
            return p["rho"] - z @ p["w"]

        return run


class PcaDetector(Detector):
    """PCA and any detector as one model."""

    name = "pca"

    def __init__(self, inner: Detector, k: int):
        super().__init__(k=k)
        self.inner, self.k, self.pca = inner, k, None

    def fit(self, normal: DataFrame) -> PcaDetector:
        self.pca = features.PCA.fit(normal, self.k)
        self.inner.fit(self.pca.transform(normal))
        self.params = self.inner.params
        return self

    def score(self, df: DataFrame) -> DataFrame:
        if self.pca is None:
            raise NotFitted("pca: fit first")
        return self.inner.score(self.pca.transform(df))

    def default_threshold(self) -> float:
        return self.inner.default_threshold()

    def body(self, path: str) -> dict:
        if self.pca is None:
            raise NotFitted("pca: nothing to save")
        inner = {"name": self.inner.name, "body": self.inner.body(f"{path}-inner")}
        return {"pca": self.pca.params(), "inner": inner, "k": self.k, "threshold": self.threshold}

    @classmethod
    def _restored(cls, spark: SparkSession, body: dict) -> PcaDetector:
        out = cls(restore(spark, body["inner"]["name"], body["inner"]["body"]), body["k"])
        out.pca, out.params, out.threshold = features.PCA(**body["pca"]), out.inner.params, body["threshold"]
        return out


DETECTORS: dict[str, type] = {
    c.name: c for c in (Mahalanobis, RidgeMahalanobis, Hypersphere, GaussianMixture, IsolationForest, LocalOutlierFactor, OneClassSVM, PcaDetector)
}


def ensemble_any(joined: DataFrame, models: list[str]) -> DataFrame:
    """a row is flagged when any model flags it."""
    either = F.col(models[0])
    for m in models[1:]:
        either = either | F.col(m)
    return joined.withColumn("prediction", either)
