"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Confirmed toxic documents are the positives; other documents of the learning
rows are unlabelled text, whatever their label says. With the class prior p, a
linear classifier minimises the corrected risk

    p * R(positives as toxic) + max(0, R(unlabelled as clean) - p * R(positives as clean)),

and where the second term is negative, the step goes the other way. One
classifier is trained for each fold of the learning sample; scores of the folds
that each has not seen fix the sigmoid that maps its outputs to probabilities.

A document is seen as words and beginnings of words: whether each occurs, and
how often for the length of the text. Nothing else enters a score. All of a text
is read.

Training uses a sample of learning rows, bounded by ``MAX_POSITIVES`` and
``MAX_UNLABELLED`` (the first by a hash of doc_id), so that the matrices on the
driver have a fixed size; the class prior is counted over all learning rows.
Scoring runs inside the scan of all documents and shuffles nothing.

Null and empty texts are scored by the classifier's constant part. Without a
labelled toxic and an unlabelled learning row nothing can be learned, and every
score is 0. Rows that repeat a doc_id are scored each by its own text; rows with
a null doc_id are scored and never learned from. Of contradicting labels of a
document, the higher counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ids_and_texts, stored

MAX_POSITIVES = 4000
MAX_UNLABELLED = 8000
FEATURES = 1024
HASH_SPACE = 1 << 20
BEGINNINGS = (3, 4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
#: Least probability of the toxic class that may be called toxic.
LEAST_CHANCE = 0.3
EPOCHS = 12
BATCH = 512
STEP = 0.02
DECAY = 1e-4
WORDS_REMEMBERED = 200_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves HELD_OUT modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == HELD_OUT, F.lit(False))


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of one word: itself and its beginnings."""
    keys = ["=" + word] + ["^" + word[:n] for n in BEGINNINGS if len(word) >= n]
    return tuple(zlib.crc32(key.encode("utf-8")) % HASH_SPACE for key in keys)


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def feature_counts(words: Counter) -> Counter:
    counts: Counter = Counter()
    for word, times in words.items():
        for feature in word_features(word):
            counts[feature] += times
    return counts


@dataclass
class Model:
    """Columns of the chosen features, and the averaged linear classifier."""

    columns: dict[int, int]
    weights: object
    constant: float

    def scores(self, texts) -> list[float]:
        import numpy as np

        size = len(self.columns)
        remembered: dict[str, tuple[int, ...]] = {}
        found = []
        for text in texts:
            words = words_of(text)
            rates: dict[int, float] = {}
            total = max(1, sum(words.values()))
            for word, times in words.items():
                own = remembered.get(word)
                if own is None:
                    if len(remembered) > WORDS_REMEMBERED:
                        remembered.clear()
                    own = tuple(self.columns[f] for f in word_features(word) if f in self.columns)
                    remembered[word] = own
                for column in own:
                    rates[column] = rates.get(column, 0) + times
            z = self.constant + self.weights[2 * size] * length_value(sum(words.values()))
            for column, times in rates.items():
                z += self.weights[column] + self.weights[size + column] * rate_value(times, total)
            found.append(float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))))
        return found


def rate_value(times: float, total: int) -> float:
    return min(times / total**0.5, 2.0)


def length_value(total: int) -> float:
    from math import log1p

    return log1p(total) / 10


def learning_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Sampled learning rows (doc_id, text, positive, unlabelled, toxic) and the class prior."""
    texts = ids_and_texts(docs).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    ids = stored(texts.select("doc_id").distinct().join(known, "doc_id", "left"), "toxicity-ids")
    counts = ids.agg(F.count("toxic").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    order = F.xxhash64("doc_id")
    positives = ids.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_POSITIVES)
    unlabelled = ids.orderBy(order, "doc_id").limit(MAX_UNLABELLED)
    chosen = (
        positives.select("doc_id", "toxic", F.lit(1).alias("p"), F.lit(0).alias("u"))
        .unionByName(unlabelled.select("doc_id", "toxic", F.lit(0).alias("p"), F.lit(1).alias("u")))
        .groupBy("doc_id")
        .agg(
            F.max("toxic").alias("toxic"),
            (F.max("p") == 1).alias("positive"),
            (F.max("u") == 1).alias("unlabelled"),
        )
    )
    # At most MAX_POSITIVES + MAX_UNLABELLED ids.
    sample = texts.join(F.broadcast(chosen), "doc_id")
    return stored(sample, "toxicity-sample"), counts["toxic"] / counts["n"] if counts["n"] else 0.0


def chosen_features(sample: DataFrame) -> list[int]:
    """The features that tell positives from unlabelled text best, at most FEATURES."""
    stats = [f"{name}_{side}" for side in ("p", "u") for name in ("docs", "rate", "square")]
    schema = "feature int, " + ", ".join(f"{s} double" for s in stats)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        sums = np.zeros((6, HASH_SPACE))
        for batch in batches:
            rows = zip(batch["text"], batch["positive"], batch["unlabelled"], strict=True)
            for text, positive, unlabelled in rows:
                words = words_of(text)
                counts = feature_counts(words)
                if not counts:
                    continue
                keys = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
                rates = np.fromiter(counts.values(), dtype=float, count=len(counts))
                rates /= max(1, sum(words.values())) ** 0.5
                for start, wanted in ((0, positive), (3, unlabelled)):
                    if wanted:
                        sums[start, keys] += 1
                        sums[start + 1, keys] += rates
                        sums[start + 2, keys] += rates * rates
        seen = np.flatnonzero(sums[0] + sums[3])
        yield pd.DataFrame({"feature": seen.astype(np.int32)} | {s: sums[i, seen] for i, s in enumerate(stats)})

    n = sample.agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum(F.col("unlabelled").cast("int")).alias("u")
    ).first()
    totals = (
        sample.select("text", "positive", "unlabelled")
        .mapInPandas(count, schema)
        .groupBy("feature")
        .agg(*[F.sum(s).alias(s) for s in stats])
    )
    share = (F.col("docs_u") + 0.5) / (n["u"] + 1)
    by_presence = (F.col("docs_p") - n["p"] * share) / F.sqrt(n["p"] * share * (1 - share) + 1)
    mean = F.col("rate_u") / n["u"]
    spread = F.sqrt(F.greatest(F.col("square_u") / n["u"] - mean * mean, F.lit(0.0)) + 1e-4)
    by_rate = (F.col("rate_p") / n["p"] - mean) / spread * n["p"] ** 0.5
    best = (
        totals.where("docs_p >= 3")
        .select("feature", F.greatest(by_presence, by_rate).alias("z"))
        .orderBy(F.desc("z"), "feature")
        .limit(FEATURES)
    )
    return [row["feature"] for row in best.collect()]


def vectors(sample: DataFrame, columns: dict[int, int]):
    """Dense rows of the sample on the driver, whose size the sampling bounds fix."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                total = sum(words.values())
                counts: Counter = Counter()
                for word, times in words.items():
                    for feature in word_features(word):
                        if feature in columns:
                            counts[columns[feature]] += times
                rows.append((list(counts.keys()), [rate_value(v, max(1, total)) for v in counts.values()], total))
            out = pd.DataFrame(rows, columns=["at", "rates", "total"])
            for name in ("doc_id", "positive", "unlabelled", "toxic"):
                out[name] = batch[name].to_numpy()
            yield out.astype({"toxic": "Int64"})

    schema = (
        "at array<int>, rates array<float>, total bigint, doc_id bigint, positive boolean, "
        "unlabelled boolean, toxic bigint"
    )
    rows = sample.mapInPandas(run, schema).orderBy("doc_id").toPandas()
    size = len(columns)
    matrix = np.zeros((len(rows), 2 * size + 1), dtype=np.float32)
    for i, (at, rates, total) in enumerate(zip(rows["at"], rows["rates"], rows["total"], strict=True)):
        matrix[i, at] = 1
        matrix[i, np.asarray(at, dtype=np.int64) + size] = rates
        matrix[i, 2 * size] = length_value(int(total))
    return matrix, rows


def fit(positives, unlabelled, prior: float, seed: int):
    """Weights and constant of one linear classifier under the corrected logistic risk."""
    import numpy as np

    draw = np.random.default_rng(seed)
    weights = np.zeros(positives.shape[1] + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    batches = max(1, len(unlabelled) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(unlabelled))
        repeated = np.resize(draw.permutation(len(positives)), max(len(positives), 32 * batches))
        for u, p in zip(np.array_split(order, batches), np.array_split(repeated, batches), strict=True):
            own, other = positives[p], unlabelled[u]
            z_own = own @ weights[:-1] + weights[-1]
            z_other = other @ weights[:-1] + weights[-1]
            s_own, s_other = 1 / (1 + np.exp(-z_own)), 1 / (1 + np.exp(-z_other))
            rest = np.logaddexp(0, z_other).mean() - prior * np.logaddexp(0, z_own).mean()
            if rest >= 0:
                g_own, g_other = prior * (s_own - 1) - prior * s_own, s_other
            else:
                g_own, g_other = prior * s_own, -s_other
            g_own, g_other = g_own / len(own), g_other / len(other)
            gradient = np.append(own.T @ g_own + other.T @ g_other, g_own.sum() + g_other.sum())
            gradient[:-1] += DECAY * weights[:-1]
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            weights -= STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def calibration(z, toxic, prior: float) -> tuple[float, float]:
    """Slope and shift of the sigmoid over classifier outputs of rows that it has not seen."""
    import numpy as np

    weight = np.where(toxic == 1, prior / max(1, (toxic == 1).sum()), (1 - prior) / max(1, (toxic == 0).sum()))
    inputs, beta = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(inputs @ beta, -60, 60)))
        gradient = inputs.T @ (weight * (s - toxic)) + 1e-4 * (beta - [1.0, 0.0])
        curve = inputs.T @ (inputs * (weight * s * (1 - s))[:, None]) + 1e-4 * np.eye(2)
        move = np.linalg.solve(curve, gradient)
        beta = beta - np.clip(move, -2, 2)
        if abs(move).max() < 1e-9:
            break
    slope, shift = float(max(beta[0], 1e-3)), float(beta[1])

    # THRESHOLD is put where unseen rows are told apart best (F1).
    order = np.argsort(-z, kind="stable")
    caught = np.cumsum((weight * toxic)[order])
    called = np.cumsum(weight[order])
    best = z[order][int(np.argmax(2 * caught / (called + prior)))]
    chance = float(np.clip(1 / (1 + np.exp(-(slope * best + shift))), LEAST_CHANCE, THRESHOLD))
    logit = lambda p: np.log(p / (1 - p))
    return slope, float(shift + logit(THRESHOLD) - logit(chance))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The averaged classifier of all folds; None where there is nothing to learn from."""
    import numpy as np

    sample, prior = learning_sample(docs, labels)
    if not 0 < prior < 1:
        return None
    columns = {feature: i for i, feature in enumerate(chosen_features(sample))}
    matrix, rows = vectors(sample, columns)
    positive = rows["positive"].to_numpy(dtype=bool)
    unlabelled = rows["unlabelled"].to_numpy(dtype=bool)
    fold = np.array([zlib.crc32(b"fold" + str(i).encode()) % FOLDS for i in rows["doc_id"]])
    toxic = rows["toxic"].astype("float").to_numpy(dtype=float, na_value=np.nan)
    fitted, unseen = [], np.full(len(rows), np.nan)
    for k in range(FOLDS):
        own, other = positive & (fold != k), unlabelled & (fold != k)
        if not own.any() or not other.any():
            continue
        weights = fit(matrix[own], matrix[other], prior, seed=k)
        unseen[fold == k] = matrix[fold == k] @ weights[:-1] + weights[-1]
        fitted.append(weights)
    if not fitted:
        return None
    weights = np.mean(fitted, axis=0)
    usable = ~np.isnan(unseen) & ~np.isnan(toxic)
    slope, shift = 1.0, 0.0
    if len(set(toxic[usable])) == 2:
        slope, shift = calibration(unseen[usable], toxic[usable], prior)
    return Model(columns, slope * weights[:-1], float(slope * weights[-1] + shift))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    model = train(docs, labels)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            scores = model.scores(batch["text"]) if model else [0.0] * len(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": scores})

    scores = ids_and_texts(docs).mapInPandas(run, "doc_id bigint, score double")
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not predict to be toxic; all columns stay."""
    model = train(docs, labels)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.scores(texts), dtype=float)

    return docs.where(score(F.coalesce(docs["text"], F.lit(""))) < THRESHOLD)
