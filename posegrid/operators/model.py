"""Regression of time on features: Gram matrices by Spark, many small fits spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holdout_splits(sessions: DataFrame, k: int = 3, key: str = "session") -> DataFrame:
    """All combinations of ``k`` sessions, in name order: (split, held), numbered by their names."""
    out = sessions.select(F.array(key).alias("held"))
    for _ in range(k - 1):
        out = out.join(sessions.select(F.col(key).alias("_next")), F.element_at("held", -1) < F.col("_next")).select(F.concat("held", F.array("_next")).alias("held"))
    return out.select(F.array_join("held", "+").alias("split"), "held")


def loso_folds(splits: DataFrame, sessions: DataFrame, key: str = "session") -> DataFrame:
    """(split, held, fold): each session that a split trains on is left out once."""
    return splits.join(sessions.select(F.col(key).alias("fold")), ~F.array_contains("held", F.col("fold")))


def gram(rows: DataFrame, features: list[str], target: str, key: str = "session") -> DataFrame:
    """(session, gram): sums of products of (1, features, target), upper triangle in row order; rows with a missing value are left out.

    One pass: each task multiplies its batches by session, and Spark adds these few hundred numbers by session and place. As
    column expressions, the 666 sums of 36 columns are beyond the code generator's limits.
    """
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    m = len(features) + 2
    upper = np.triu_indices(m)
    kind, named = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    schema = pa.schema([("session", named), ("sums", pa.list_(pa.float64()))])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(m - 1))])
            whole = ~np.isnan(x).any(1)
            codes = batch.column(0).dictionary_encode()
            of = codes.indices.fill_null(-1).to_numpy()
            for code in np.unique(of[whole]):
                own = x[whole & (of == code)]
                name = None if code < 0 else codes.dictionary[int(code)].as_py()
                yield pa.RecordBatch.from_pylist([{"session": name, "sums": (own.T @ own)[upper].tolist()}], schema)

    columns = rows.select(F.col(key).alias("session"), *(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*features, target])))
    parts = columns.mapInArrow(products, f"session {kind}, sums array<double>").select("session", F.posexplode("sums").alias("at", "x"))
    places = parts.groupBy("session", "at").agg(F.sum("x").alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])
    return places.groupBy(F.col("session").alias(key)).agg(ordered.alias("gram"))


def _gap(a, b, c: float, alpha: float, w) -> float:
    """Duality gap of 1/2 (c - 2 b w + w a w) + alpha |w|_1: how far above the least value w can be."""
    import numpy as np

    slope = b - a @ w
    residual = max(c - 2 * b @ w + w @ a @ w, 0.0)
    # The residual, scaled into the dual's feasible set, gives a lower bound.
    steep = np.abs(slope).max(initial=0.0)
    share = 1.0 if steep <= alpha else alpha / steep
    return residual / 2 + alpha * np.abs(w).sum() - (share * (c - b @ w) - share * share / 2 * residual)


def lasso_path(a, b, alphas):
    """Weights at each of the descending ``alphas`` by the homotopy of the lasso: between events the weights are linear in alpha.

    An event is a feature whose slope reaches alpha, or a weight that reaches zero; one small system is solved for each.
    """
    import numpy as np

    out = np.zeros((len(alphas), len(b)))
    at = 0
    alpha = np.abs(b).max(initial=0.0)
    while at < len(alphas) and alphas[at] >= alpha:
        at += 1
    active, signs = ([int(np.abs(b).argmax())], [float(np.sign(b[np.abs(b).argmax()]))]) if at < len(alphas) else ([], [])
    changed = -1
    for _ in range(20 * len(b)):
        if at == len(alphas) or not active:
            break
        block = a[np.ix_(active, active)]
        try:
            u, v = np.linalg.solve(block, np.column_stack([b[active], signs])).T
        except np.linalg.LinAlgError:
            break
        # A feature that the active ones already span can't come in beside them; its slope follows theirs.
        apart = np.diag(a) - np.einsum("ij,ji->i", a[:, active], np.linalg.solve(block, a[active]))
        others = [j for j in range(len(b)) if j not in active and a[j, j] > 1e-12 and apart[j] > 1e-9 * a[j, j]]
        p, q = b[others] - a[np.ix_(others, active)] @ u, a[np.ix_(others, active)] @ v
        events = []
        for j, pj, qj in zip(others, p, q):
            events += [(pj / (1 - qj), 1.0, j) if qj < 1 else (0.0, 1.0, j), (-pj / (1 + qj), -1.0, j) if qj > -1 else (0.0, -1.0, j)]
        events += [(uk / vk if vk else 0.0, 0.0, k) for k, uk, vk in zip(active, u, v)]
        # What has just changed stands at its own event; rounding must not make it change back.
        below = [e for e in events if 0 < e[0] < alpha * (1 - (1e-7 if e[2] == changed else 1e-12))]
        then, sign, which = max(below, default=(0.0, 0.0, -1))
        while at < len(alphas) and alphas[at] >= then:
            out[at, active] = u - alphas[at] * v
            at += 1
        alpha, changed = then, which
        if which < 0:
            break
        if which in active:
            k = active.index(which)
            active.pop(k), signs.pop(k)
        else:
            active.append(which), signs.append(sign)
    for i in range(at, len(alphas)):
        out[i] = out[i - 1] if i else 0.0
    return out


def proven(a, b, c: float, alpha: float, w, tolerance: float, steps: int = 20_000):
    """(weights, gap) with a duality gap within ``tolerance * c``, by coordinate descent from ``w`` where it isn't yet.

    Raises ``ArithmeticError`` if the steps don't suffice.
    """
    import numpy as np

    most = tolerance * max(c, 1e-300)
    for _ in range(steps):
        gap = _gap(a, b, c, alpha, w)
        if gap <= most:
            return w, max(float(gap), 0.0)
        w = w.copy()
        for j in np.flatnonzero(np.diag(a) > 1e-12):
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / a[j, j]
    raise ArithmeticError(f"no lasso fit within a gap of {most} after {steps} steps (alpha {alpha}, gap {gap})")


def lasso_grid(grams: DataFrame, folds: DataFrame, n_features: int, alphas: list[float], key: str = "session", tolerance: float = 1e-9) -> DataFrame:
    """(split, alpha, score, intercept, weights, gap, errors): per split the alpha of least mean fold RMSE, the first on ties, refitted.

    Fits are 1/(2n) |y - b - Xw|^2 + alpha |w|_1 on sums of Gram matrices: one homotopy gives all alphas of a fold, and
    each fit is proven by its duality gap, at most ``tolerance`` of the target's variance (``gap`` is that of the refit). ``errors`` are
    (session, rmse) of the refit on every session, quadratic forms of its Gram matrix. A Gram matrix is a few
    hundred numbers per session, so the table of them is sent to every task; splits are rows, dealt over the cluster, and
    each task holds one at a time.
    """
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_type

    m = n_features + 2
    upper = np.triu_indices(m)
    table = {}
    for name, values in grams.select(key, "gram").toLocalIterator():
        whole = np.zeros((m, m))
        whole[upper] = values
        table[name] = whole + np.triu(whole, 1).T
    sent = grams.sparkSession.sparkContext.broadcast(table)
    falling = sorted(range(len(alphas)), key=lambda i: -alphas[i])

    def centred(total):
        n = total[0, 0]
        mean = total[0, 1:] / n
        moments = total[1:, 1:] / n - np.outer(mean, mean)
        return mean, moments[:-1, :-1], moments[:-1, -1], float(moments[-1, -1])

    def fits(total):
        """(intercept, weights, gap) at every alpha, in their given order."""
        mean, a, b, c = centred(total)
        out = [None] * len(alphas)
        for i, w in zip(falling, lasso_path(a, b, [alphas[i] for i in falling])):
            w, gap = proven(a, b, c, alphas[i], w, tolerance)
            out[i] = mean[-1] - mean[:-1] @ w, w, gap
        return out

    def rmse(one, intercept: float, w) -> float:
        v = np.concatenate([[-intercept], -w, [1.0]])
        return float(np.sqrt(max(v @ one @ v, 0.0) / one[0, 0]))

    kind, named = grams.schema[key].dataType.simpleString(), to_arrow_type(grams.schema[key].dataType)
    schema = f"split string, alpha double, score double, intercept double, weights array<double>, gap double, errors array<struct<session:{kind},rmse:double>>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        arrow = pa.schema(
            [("split", pa.string()), *((c, pa.float64()) for c in ("alpha", "score", "intercept")), ("weights", pa.list_(pa.float64())), ("gap", pa.float64()),
             ("errors", pa.list_(pa.struct([("session", named), ("rmse", pa.float64())])))]
        )
        for batch in batches:
            for split, held, inner in zip(*(batch.column(c).to_pylist() for c in ("split", "held", "folds"))):
                train = sum(of[s] for s in of if s not in held)
                scores = np.zeros(len(alphas))
                for fold in sorted(inner):
                    scores += [rmse(of[fold], intercept, w) / len(inner) for intercept, w, _ in fits(train - of[fold])]
                best = int(np.argmin(scores))
                intercept, w, gap = fits(train)[best]
                row = {"split": split, "alpha": alphas[best], "score": float(scores[best]), "intercept": float(intercept), "weights": w.tolist(), "gap": gap,
                       "errors": [{"session": s, "rmse": rmse(of[s], intercept, w)} for s in of]}
                yield pa.RecordBatch.from_pylist([row], arrow)

    grouped = folds.groupBy("split", "held").agg(F.collect_list("fold").alias("folds"))
    return grouped.mapInArrow(each, schema)


def session_scores(models: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, session, set, rmse) of every model on every session, from the Gram matrices: no row meets a model."""
    errors = models.select("split", F.inline("errors"))
    kind = F.when(F.array_contains("held", F.col("session")), "Test").otherwise("Train")
    return errors.join(splits, "split").select("split", "session", kind.alias("set"), "rmse")


def predict_time(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """Rows (with a ``split``, the model asked for) and their predicted value."""
    parts = [F.get("weights", F.lit(i)) * F.col(f"`{f}`") for i, f in enumerate(features)]
    predicted = sum(parts, F.col("intercept"))
    return rows.join(models.select("split", "intercept", "weights"), "split").withColumn("predicted", predicted).drop("intercept", "weights")


def score_sessions(predicted: DataFrame, splits: DataFrame, target: str, key: str = "session") -> DataFrame:
    """(split, session, set, rmse)."""
    errors = predicted.groupBy("split", key).agg(F.sqrt(F.avg((F.col("predicted") - F.col(target)) * (F.col("predicted") - F.col(target)))).alias("rmse"))
    kind = F.when(F.array_contains("held", F.col(key)), "Test").otherwise("Train")
    return errors.join(splits, "split").select("split", key, kind.alias("set"), "rmse")
