"""Quality classifier by positive-unlabelled learning.

A linear model over features of the text alone is fitted to minimise the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the logistic loss, trusted positives (labels.quality = 1), all unlabelled documents and an estimated class prior,
so that the score is the model's probability of the class. Labels are read only from rows outside the held-out fold,
and only those of positives.

The prior is estimated from positives and unlabelled rows: a model that tells the two apart, and next one of this risk,
fitted on one half of both, orders the other half; above the best threshold the share of unlabelled rows over the share of positives bounds
the prior from above (the threshold is that with the least upper confidence bound of this ratio). The fit takes the lower
confidence bound there: with a prior that is too large the second part of the risk turns negative before the classes
are apart.

The weight of the squared weights is that with which a model of one half has the least risk on the other. All fits
take Newton steps. Sums over unlabelled rows run over every described row, in tasks; only the matrix that
turns a gradient into a step comes from at most STEERING of them, which decides how fast, not where, a fit ends. Steps
that would make the second part of the risk negative are not taken. At most POSITIVES positives are used, in order of a
hash of doc_id (a bounded sample of labelled rows). Null and empty texts have all features at zero and are scored too.
With no usable labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevance_spark.llm import arrays
from relevance_spark.llm.arrays import U
from relevance_spark.llm.language_model import held_out
from relevance_spark.llm.shared import Workspace, maybe_broadcast

#: Most labelled rows that a fit uses, and most rows that its step matrix comes from.
POSITIVES, STEERING = 6_000, 4_000
#: Steps of a fit, lengths that are tried of each, weights of the squared weights among which unseen rows decide.
STEPS, LENGTHS, DECAYS = 12, (1.0, 0.4, 0.1), (0.1, 0.01, 0.001)
#: What the second part of the risk should gain by a step from its bound.
AWAY = 0.002
#: Partial sums that the driver gets of one pass.
SUMS = 64
#: crc32 residue classes; class 0 is held out.
FOLDS = 5
THRESHOLD = 0.3
#: Texts are described by shares of bytes, of word buckets and these counts.
BUCKETS, STATS = 64, 12


WIDTH = 256 + BUCKETS + STATS


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features per text, in half precision; zeros for a text without words."""
    h, off = arrays.hash_words(texts, fold=False)
    pairs = arrays.window_hashes(h, 2)
    out = np.zeros((len(texts), WIDTH))
    for i, text in enumerate(texts):
        a, b = off[i], off[i + 1]
        n = int(b - a)
        if not n:
            continue
        counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        total = len(text)
        words = h[a:b]
        _, times = np.unique(words, return_counts=True)
        twos = np.unique(pairs[a : b - 1]) if n > 1 else words
        lines = text.split(b"\n")
        full = [x for x in lines if x.strip()]
        letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
        out[i, :256] = np.sqrt(counts / total)
        out[i, 256 : 256 + BUCKETS] = np.sqrt(np.bincount((words & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) / n)
        out[i, 256 + BUCKETS :] = (
            np.log1p(n), total / n / 10, len(times) / n, times.max() / n, len(twos) / max(n - 1, 1), times.max() / np.sqrt(n),
            counts[65:91].sum() / letters, counts[48:58].sum() / total, (total - letters - counts[32] - counts[10]) / total,
            len(lines) / n, 1 - len(set(full)) / max(len(full), 1), min(n, 50) / 50,
        )
    return np.minimum(out, 60_000).astype(np.float16)


def _feature_rows(batches):
    for batch in arrays.pieces(batches):
        x = features(arrays.encode_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def described(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, text) to a written table (doc_id, x), one row per row of docs: the features of its whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ws.save(texts.mapInArrow(_feature_rows, "doc_id long, x binary"), "features")


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float16).reshape(-1, WIDTH).astype(np.float64)


def summed(rows: DataFrame, of) -> np.ndarray:
    """Sum over all rows of of(matrix of features), an array: partial sums per task, added up in SUMS places."""
    from pyspark import TaskContext

    def part(batches):
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                one = of(_matrix(batch.column("x").slice(a, 4096).to_pylist()))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS]), pa.array([total.tobytes()], pa.binary())], ["place", "v"])

    def added(table):
        return pa.table({"v": pa.array([np.sum([np.frombuffer(x) for x in table.column("v").to_pylist()], axis=0).tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(part, "place long, v binary").groupBy("place").applyInArrow(added, "v binary").collect()
    return np.sum([np.frombuffer(r.v) for r in parts], axis=0) if parts else np.zeros(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in standard deviations, and a one for the bias."""
    return np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])


def risk_parts(w: np.ndarray, p: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk of positives as positives and as negatives, and the gradient of each."""
    z = p @ w
    return np.logaddexp(0, -z).mean(), np.logaddexp(0, z).mean(), p.T @ (_sigmoid(z) - 1) / len(p), p.T @ _sigmoid(z) / len(p)


def unlabelled_sums(ws: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row of weights the summed risk of u as negatives and its gradient, flat."""
    z = u @ ws.T
    return np.concatenate([np.logaddexp(0, z).sum(0), (_sigmoid(z).T @ u).ravel()])


def fit(p: np.ndarray, of_unlabelled, steering: np.ndarray, plus: float, minus: float, steps: int = STEPS, decay: float = DECAYS[0]) -> np.ndarray:
    """Weights that minimise plus * R+(p) + max(0, R-(u) - minus * R-(p)) and decay.

    of_unlabelled(weights) gives, per row of weights, the mean risk of all unlabelled rows as negatives and its
    gradient. For the logistic loss and plus = minus the risk is convex where its second part is positive.
    """
    ridge = np.full(p.shape[1], decay)
    ridge[-1] = 0.0

    def at(w, risk, gradient):
        up, down, g_up, g_down = risk_parts(w, p)
        rest = risk - minus * down
        g_rest = gradient - minus * g_down
        return plus * up + max(0.0, rest) + (ridge * w * w).sum() / 2, rest, plus * g_up + g_rest + ridge * w, g_rest

    w = np.zeros(p.shape[1])
    risk, gradient = of_unlabelled(w[None])
    value, _, g, g_rest = at(w, risk[0], gradient[0])
    shrink, along = 1.0, False
    for _ in range(steps):
        s = _sigmoid(steering @ w)
        t = _sigmoid(p @ w)
        hessian = (steering * (s * (1 - s))[:, None]).T @ steering / len(steering) + (plus - minus) * (p * (t * (1 - t))[:, None]).T @ p / len(p)
        step, back = -np.linalg.solve(hessian + np.diag(ridge + 1e-6), np.stack([g, -g_rest], 1)).T
        if along:
            # At the bound: as far as the second part of the risk stays, and a little back from it.
            step = step + max(0.0, (AWAY - g_rest @ step) / max(g_rest @ back, 1e-12)) * back
        tried = np.array([w + shrink * x * step for x in LENGTHS])
        found = [(*at(v, r, d), v) for v, r, d in zip(tried, *of_unlabelled(tried), strict=True)]
        allowed = [x for x in found if x[1] >= 0 and x[0] < value]
        if not allowed:
            shrink, along = (1.0, True) if not along else (shrink * 0.1, True)
            if shrink < 1e-3:
                break
            continue
        best = min(allowed, key=lambda x: x[0])
        done = value - best[0] < 1e-6
        value, _, g, g_rest, w = best
        if done:
            break
    return w


def prior_bounds(positive: np.ndarray, counts_above, n: int, gamma: float = 0.01, delta: float = 0.1) -> tuple[float, float]:
    """Share of positives among n unlabelled rows, and its lower bound: the ratio of the shares above the threshold whose upper bound is least.

    positive: scores of positives that the model has not seen; counts_above(thresholds): unlabelled rows at or above each.
    """
    if not n or not len(positive):
        return 0.5, 0.5
    cuts = np.unique(np.quantile(positive, np.linspace(0, 1, 257)[:-1]))
    of_p = np.array([(positive >= c).mean() for c in cuts])
    of_u = counts_above(cuts) / n
    slack_u, slack_p = (np.sqrt(np.log(4 / delta) / 2 / m) for m in (n, len(positive)))
    k = np.argmin((of_u + (1 + gamma) * (slack_u + slack_p)) / of_p)
    bounds = of_u[k] / of_p[k], (of_u[k] - slack_u) / min(1.0, of_p[k] + slack_p)
    return tuple(float(np.clip(x, 0.01, 0.99)) for x in bounds)


def train(rows: DataFrame, labels: DataFrame, positives: int = POSITIVES, folds: int = FOLDS) -> dict:
    """Fit on described rows (doc_id, x) outside the held-out fold and the positive ones of labels (doc_id, quality)."""
    rank = F.xxhash64(F.col("doc_id"), F.lit(11))
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(12)), F.lit(2))
    usable = labels.where(~held_out(folds)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality = 1 AND doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    chosen = usable.select("doc_id", rank.alias("k")).orderBy("k", "doc_id").limit(positives).select("doc_id")
    learned = rows.where(~held_out(folds))
    known = learned.join(maybe_broadcast(chosen, positives), "doc_id").dropDuplicates(["doc_id", "x"]).select("x", half.alias("half")).collect()
    nothing = {"w": np.zeros(WIDTH + 1), "mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "prior": 0.5}
    moments = summed(learned, lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    if not known or not len(moments):
        return nothing
    n, mean = moments[0], moments[1 : WIDTH + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[WIDTH + 1 :] / n - mean * mean, 0)) + 1e-3
    shape = lambda values: standardised(_matrix(values), mean, scale)
    p, side = shape([r.x for r in known]), np.array([r.half for r in known])
    steering = shape([r.x for r in learned.select("x", rank.alias("k")).orderBy("k", "x").limit(STEERING).collect()])

    def over(part: DataFrame):
        def mean_risk(ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            total = summed(part, lambda x: np.concatenate([[len(x)], unlabelled_sums(ws, standardised(x, mean, scale))]))
            total = total if len(total) else np.concatenate([[1], np.zeros(len(ws) * (WIDTH + 2))])
            return total[1 : len(ws) + 1] / total[0], total[len(ws) + 1 :].reshape(len(ws), -1) / total[0]

        return mean_risk

    prior, low, decay = 0.5, 0.5, DECAYS[0]
    if {0, 1} <= set(side):
        first, own, other = over(learned.where(half == 0)), p[side == 0], p[side == 1]
        rest, n_rest = learned.where(half == 1), learned.where(half == 1).count()

        def bounds(w: np.ndarray) -> tuple[float, float]:
            above = lambda cuts: summed(rest, lambda x: len(x) - np.searchsorted(np.sort(standardised(x, mean, scale) @ w), cuts).astype(float))
            return prior_bounds(other @ w, above, n_rest)

        _, low = bounds(fit(own, first, steering, 1.0, 0.0))
        tellers = [fit(own, first, steering, low, low, decay=d) for d in DECAYS]
        unseen, _ = over(rest)(np.array(tellers))
        risks = [low * up + max(0.0, u - low * down) for (up, down, _, _), u in zip((risk_parts(w, other) for w in tellers), unseen, strict=True)]
        best = int(np.argmin(risks))
        decay = DECAYS[best]
        prior, low = bounds(tellers[best])
    return {"w": fit(p, over(learned), steering, low, low, decay=decay), "mean": mean, "scale": scale, "prior": prior, "low": low, "decay": decay}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1: the model's probability of label 1."""
    return _sigmoid(standardised(x, model["mean"], model["scale"]) @ model["w"])


def _scorer(model: dict):
    def run(batches):
        for batch in batches:
            p = probabilities(model, _matrix(batch.column("x").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return run


def score(rows: DataFrame, model: dict) -> DataFrame:
    """Described rows (doc_id, x) to (doc_id, score)."""
    return rows.select("doc_id", "x").mapInArrow(_scorer(model), "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = described(docs, Workspace(spark, "classifier"))
    model = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score(rows, model).select("doc_id", held_out(FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
