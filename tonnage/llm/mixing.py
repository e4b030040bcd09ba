"""Mixing documents to target weights by soft membership.

A naive Bayes classifier, counted on a bounded sample of the documents that a label table covers, gives every document the
posterior probabilities of the domains (good or poor text, clean or toxic). Nonnegative document rates are then fitted so
that the expected tokens of each domain, the sum of rate x tokens x posterior, come as near as they can to the target
shares of a token budget: projected-gradient least squares from rate 1. A gradient needs only one sum per domain, so each
step is one distributed aggregation over the stored posteriors and a handful of numbers on the driver; a document's rate
is a function of its posteriors and the gradients so far, and no state is kept between steps.

DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonnage.llm.common import bound, written

DOMAINS = ("good_clean", "good_toxic", "poor_clean", "poor_toxic")
TARGETS = {"good_clean": 0.8, "good_toxic": 0.0, "poor_clean": 0.2, "poor_toxic": 0.0}
#: Bound of the training sample (labelled documents, chosen by hash).
FIT_ROWS = 20_000
#: Buckets of features; least documents and log odds (either sign) of a feature that is used.
BUCKETS, LEAST_COUNT, LEAST_ODDS = 1 << 20, 5, 3.0
#: Share of chance features among the used ones, and the cells (of one nat) that their evidence is counted in.
FALSE_SHARE, CELLS = 0.01, 700
#: Most gradient steps; the miss (as a share of the budget) that ends them, and the least share of it a step must gain.
STEPS, MISS, GAIN = 40, 1e-3, 0.01
_SCALE = 1 << 30
P = [f"p_{d}" for d in DOMAINS]


def _marked(documents: DataFrame) -> DataFrame:
    """`documents` with __tokens (lower-case words and runs of punctuation) and __found, the buckets of the features of the
    text: its distinct tokens, the order of its length and the share of its tokens that are distinct."""
    marks = F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"\s+|\b"), "")
    rows = documents.withColumn("__marks", marks)
    rows = rows.withColumn("__kinds", F.array_distinct("__marks")).withColumn("__tokens", F.size("__marks").cast("bigint")).drop("__marks")
    length = F.concat(F.lit("length "), F.floor(F.log2(F.col("__tokens") + 1)).cast("string"))
    varied = F.concat(F.lit("varied "), F.floor(8 * F.size("__kinds") / F.greatest("__tokens", F.lit(1))).cast("string"))
    features = F.concat("__kinds", F.array(length, varied))  # a token holds no space, so these are none
    return rows.withColumn("__found", F.transform(features, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)))).drop("__kinds")


def _listed(buckets: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, buckets))), ",").cast("array<bigint>")


@dataclass(frozen=True)
class Feature:
    bucket: int
    odds: float  # log odds that its presence adds


@dataclass(frozen=True)
class Bayes:
    prior: float  # log odds before any feature is seen
    bare: float  # log odds of a text without any used feature
    features: list[Feature]

    def log_odds(self, found: Column) -> Column:
        if not self.features:
            return F.lit(self.bare)
        keys = _listed([f.bucket for f in self.features])
        worth = F.split(F.lit(",".join(repr(f.odds) for f in self.features)), ",").cast("array<double>")
        weights = F.map_from_arrays(keys, worth)
        summed = F.aggregate(F.array_intersect(found, keys), F.lit(self.prior), lambda total, k: total + F.element_at(weights, k))
        return F.when(F.arrays_overlap(found, keys), summed).otherwise(F.lit(self.bare))

    def posterior(self, found: Column) -> Column:
        odds = F.least(F.greatest(self.log_odds(found), F.lit(-30.0)), F.lit(30.0))
        return 1 / (1 + F.exp(-odds))


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict[str, Bayes]:
    """One classifier per label column (quality, toxic) from at most about `rows` labelled documents.

    Several rows of labels for one document are averaged; a null label or an unlabelled document teaches nothing."""
    known = bound(labels, doc_id="doc_id", quality="quality", toxic="toxic").filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(*[(F.avg(c) >= 0.5).cast("int").alias(c) for c in ("quality", "toxic")])
    n = known.count()
    share = int(_SCALE * min(1.0, rows / n)) if n else 0
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < share)
    taught = bound(documents, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id")  # `rows` bounds the sample
    marked = written(_marked(taught).select("__found", "quality", "toxic"), "sample")
    counts = marked.select(F.explode(F.array_append(F.array_distinct("__found"), F.lit(-1).cast("bigint"))).alias("bucket"), "quality", "toxic")
    sums = [f(F.col(c)).alias(f"{c}_{k}") for c in ("quality", "toxic") for k, f in (("n", F.count), ("yes", F.sum))]
    table = written(counts.groupBy("bucket").agg(*sums), "features")
    return {c: _bayes(marked, table, c) for c in ("quality", "toxic")}


def _evidence(one: Column, zero: Column, yes: int, no: int) -> Column:
    """Whole nats of evidence that a feature of `one` and `zero` documents is no chance draw from `yes` and `no`: minus the log of
    the Chernoff bound of the two-sided binomial tail, which holds at any count (a normal z-score doesn't, for rare words)."""
    q = (yes + 0.5) / (yes + no + 1.0)
    n = one + zero
    part = lambda k, share: F.when(k > 0, k * (F.log(k / n) - math.log(share))).otherwise(F.lit(0.0))
    nats = part(one, q) + part(zero, 1 - q) - math.log(2)
    return F.greatest(F.lit(0), F.least(F.lit(CELLS), F.floor(nats))).cast("int")


def _least_cell(counts: dict[int, int]) -> int:
    """The least evidence above which at most FALSE_SHARE of the features are expected to be chance (Benjamini-Hochberg): it
    grows with the log of the number of tested features. Above all cells if there is none."""
    tested, above, least = sum(counts.values()), 0, CELLS + 1
    for cell in sorted(counts, reverse=True):
        above += counts[cell]
        if tested * math.exp(-cell) <= FALSE_SHARE * above:
            least = cell
    return least


def _bayes(sample: DataFrame, table: DataFrame, label: str) -> Bayes:
    """Naive Bayes over the presence of all buckets whose odds differ surely, and strongly, between the classes; texts without
    any of them get the odds that such texts have in the sample."""
    whole = table.filter("bucket = -1").first()
    n, yes = (whole[f"{label}_n"] or 0, whole[f"{label}_yes"] or 0) if whole else (0, 0)
    no = n - yes
    one, zero = F.coalesce(F.col(f"{label}_yes"), F.lit(0)), F.col(f"{label}_n") - F.coalesce(F.col(f"{label}_yes"), F.lit(0))
    p1, p0 = (one + 0.5) / (yes + 1.0), (zero + 0.5) / (no + 1.0)
    odds = F.log(p1) - F.log(p0)
    tested = table.filter((F.col("bucket") >= 0) & (F.col(f"{label}_n") >= LEAST_COUNT)).withColumns({"odds": odds, "cell": _evidence(one, zero, yes, no)})
    least = _least_cell({r.cell: r.n for r in tested.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()})
    best = tested.filter((F.col("cell") >= least) & (F.abs("odds") >= LEAST_ODDS)).select("bucket", "odds").orderBy("bucket").collect()
    prior, features = math.log((yes + 0.5) / (no + 0.5)), [Feature(r.bucket, r.odds) for r in best]
    if not features:
        return Bayes(prior, prior, features)
    keys = _listed([f.bucket for f in features])
    plain = sample.filter(~F.arrays_overlap("__found", keys)).agg(F.sum(label).alias("yes"), F.count(label).alias("n")).first()
    bare = math.log(((plain["yes"] or 0) + 0.5) / ((plain["n"] or 0) - (plain["yes"] or 0) + 0.5))
    return Bayes(prior, bare, features)


def with_posteriors(documents: DataFrame, models: dict[str, Bayes]) -> DataFrame:
    """`documents` with __tokens and one posterior per domain under its private name."""
    found = F.col("__found")
    out = _marked(documents).withColumns({"__good": models["quality"].posterior(found), "__toxic": models["toxic"].posterior(found)}).drop("__found")
    parts = {"good_clean": (1, 0), "good_toxic": (1, 1), "poor_clean": (0, 0), "poor_toxic": (0, 1)}
    half = lambda name, yes: F.col(name) if yes else 1 - F.col(name)
    return out.withColumns({f"__p_{d}": half("__good", g) * half("__toxic", t) for d, (g, t) in parts.items()}).drop("__good", "__toxic")


def rate_after(gradients: list[list[float]]) -> Column:
    """The rate of a document after the given steps."""
    rate = F.lit(1.0)
    for g in gradients:
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(x) * F.col(f"__p_{d}") for x, d in zip(g, DOMAINS, strict=True)), F.lit(0.0)))
    return rate


def fit_rates(rows: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, steps: int = STEPS) -> list[list[float]]:
    """Gradient steps (already scaled) that bring expected domain tokens to `targets` x `budget` (all tokens, if None)."""
    n = F.col("__tokens")
    pairs = [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]
    p = [F.col(f"__p_{d}") for d in DOMAINS]
    first = rows.agg(F.sum(n).alias("n"), *[F.sum(n * p[i] * p[j]).alias(f"h{i}{j}") for i, j in pairs], *[F.sum(n * p[i]).alias(f"t{i}") for i in range(len(DOMAINS))]).first()
    total = first["n"] or 0
    if not total:
        return []
    curve = np.zeros((len(DOMAINS), len(DOMAINS)))
    for i, j in pairs:
        curve[i, j] = curve[j, i] = first[f"h{i}{j}"]
    # residuals are whitened by the curvature at the start, so that domains count alike and a step of length 1 is safe
    weight = np.linalg.pinv(curve, rcond=1e-9, hermitian=True)
    goal = np.array([targets[d] for d in DOMAINS]) * (total if budget is None else budget)
    now, gradients = np.array([first[f"t{i}"] for i in range(len(DOMAINS))]), []
    miss = np.inf
    for _ in range(steps):
        before, miss = miss, float((now - goal) @ weight @ (now - goal))
        if np.abs(now - goal).max() <= MISS * goal.sum() or miss > (1 - GAIN) * before:
            break
        gradients.append((weight @ (now - goal)).tolist())
        sums = rows.select("__tokens", *p, rate_after(gradients).alias("r")).agg(*[F.sum(n * p[i] * F.col("r")).alias(f"t{i}") for i in range(len(DOMAINS))]).first()
        now = np.array([sums[f"t{i}"] for i in range(len(DOMAINS))])
    return gradients


def rates(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, the posteriors, rate.

    Null and empty texts have no tokens and the posteriors of a text without features; they weigh nothing but get a rate.
    Repeated rows are documents of their own. Without labels every posterior is 1/4. Empty tables give an empty result.
    """
    docs = bound(documents, doc_id="doc_id", text="text")
    rows = written(with_posteriors(docs, fit(documents, labels)).drop("text"), "posteriors")
    gradients = fit_rates(rows, targets, budget)
    return rows.select("doc_id", F.col("__tokens").alias("n_tokens"), *[F.col(f"__{c}").alias(c) for c in P], rate_after(gradients).alias("rate"))


def mixed(documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """The documents that are not called toxic, their columns and `mix_rate` (how often to draw the document, on average).

    A clean document stays whatever its rate, also at 0. A document that is more likely toxic than clean goes, unless a toxic
    domain has a target and the document a positive rate."""
    rows = written(with_posteriors(documents, fit(documents, labels)), "posteriors")
    rows = rows.withColumn("__rate", rate_after(fit_rates(rows, targets, budget)))
    toxic = F.col("__p_good_toxic") + F.col("__p_poor_toxic") > 0.5
    wanted = F.lit(targets["good_toxic"] > 0 or targets["poor_toxic"] > 0) & (F.col("__rate") > 0)
    out = rows.filter(~toxic | wanted)
    return out.select(*[F.col(f"`{c}`") for c in documents.columns if c != "mix_rate"], F.col("__rate").alias("mix_rate"))
