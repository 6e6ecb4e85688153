"""Mixing to target weights by soft membership.

A naive Bayes classifier over hashed words learns domains from a labelled table
and gives every document posteriors over the domains (the log-likelihood is
tempered by the root of the length, else long texts would always be certain).
Then nonnegative document rates are fitted by projected-gradient least squares:
with n the tokens and p the posteriors of a document, rates r minimise the squared
distance of the expected domain tokens sum(r n p) from the targets.  Each step
needs only the domains' sums, one small aggregate; the step of a document is its
p times the residual, scaled by the reciprocal of its own expected share, and is
projected onto [0, ceiling].  A rate means copies: its whole part, and one more
with the probability of the rest, by a hash of the id.

Targets are weights of the expected tokens.  Without a budget the total is the
largest that no domain needs more than rate 1 for, so documents of scarce domains
all stay and only plentiful ones are thinned.

DataFrame functions only.  The weight table has ``buckets`` rows whatever the
input; the classifier learns from at most ``max_examples`` labelled rows in
expectation; all else is computed over all documents.

Edge cases: a null or empty text has no tokens, the prior's posteriors and rate
1, as it moves no sum; null labels teach nothing; a domain without examples has no
posterior, and its target is left out; without any labelled row every rate is 1;
repeated rows are rated row by row and drawn alike; an empty table gives an empty
result; other columns are kept by ``mix`` and ignored by ``rates``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored

BUCKETS = 1 << 14
#: Tokens' worth of the mean distribution added to each domain's counts.
STRENGTH = 2000.0
#: Domains of the labelled table and the weights asked for.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 1 then 'prose' when quality = 0 then 'junk' end"
TARGETS = {"prose": 0.90, "junk": 0.08, "toxic": 0.02}


def _uniform(*columns, seed: int) -> "F.Column":
    """Draws from [0, 1) that depend on the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11)).cast("double") / F.lit(2.0**53)


def _words(rows: DataFrame, *keep: str) -> DataFrame:
    """One row a word: the kept columns and the word's bucket."""
    words = F.split(F.lower("text"), r"[ \n\t\r]+")
    return rows.where("text is not null").select(*keep, F.explode(words).alias("w")).where("w <> ''").select(*keep, F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def fit_domains(labelled: DataFrame, domain_col: str = "domain", text_col: str = "text", name_col: str = "doc_id", max_examples: int = 20_000) -> tuple[DataFrame, list[str], list[float]]:
    """``bucket, w`` (log-likelihoods, one per domain), the domains and their log priors."""
    rows = labelled.select(F.col(domain_col).alias("domain"), F.col(text_col).alias("text"), F.col(name_col).alias("name")).where("domain is not null and text is not null")
    counts = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains, total = sorted(counts), sum(counts.values())
    if not domains:
        return rows.sparkSession.createDataFrame([], "bucket int, w array<double>"), [], []
    if total > max_examples:
        rows = rows.where(_uniform("name", seed=21) < max_examples / total)
    seen = stored(_words(rows, "domain").groupBy("domain", "bucket").agg(F.count("*").alias("n")), "counts")
    sums = {r.domain: r.n for r in seen.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    wide = seen.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(domains)))
    # counts are drawn towards the mean of the domains, so that rare buckets say little
    share = [F.col(f"n{i}") / max(1, sums.get(d, 0)) for i, d in enumerate(domains)]
    mean = sum(share[1:], share[0]) / len(domains)
    back = [F.log((F.col(f"n{i}") + STRENGTH * mean) / (sums.get(d, 0) + STRENGTH)) for i, d in enumerate(domains)]
    weights = wide.select("bucket", F.array(*back).alias("w"))
    prior = [math.log(counts[d] / total) for d in domains]
    return stored(weights, "weights"), domains, prior


def _key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def posteriors(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", power: float = 0.5) -> DataFrame:
    """``row, doc_id, key, n_tokens, p``: tokens and domain posteriors of every row; ``key`` tells rows of one id apart by their texts."""
    weights, domains, prior = model
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), _key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    words = _words(rows, "row", "doc_id", "key")
    scored = words.join(F.broadcast(weights), "bucket", "left")  # BUCKETS rows at most
    k = range(len(domains))
    sums = scored.groupBy("row", "doc_id", "key").agg(F.count("*").alias("n_tokens"), *(F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"s{i}") for i in k))
    best = F.greatest(*(F.col(f"s{i}") for i in k)) if len(domains) > 1 else F.col("s0")
    odds = [F.exp((F.col(f"s{i}") - best) / F.pow(F.col("n_tokens").cast("double"), F.lit(power)) + F.lit(prior[i])) for i in k]
    total = sum(odds[1:], odds[0])
    known = sums.select("row", "doc_id", "key", "n_tokens", F.array(*(o / total for o in odds)).alias("p"))
    blank = rows.where("text is null or not text rlike '[^ \\\\n\\\\t\\\\r]'").select("row", "doc_id", "key", F.lit(0).cast("long").alias("n_tokens"), F.array(*(F.lit(math.exp(x)) for x in prior)).alias("p"))
    return known.unionByName(blank)


def fit_rates(points: DataFrame, targets: list[float], budget: float | None = None, ceiling: float | None = None, floor="0", steps: int = 60, tolerance: float = 1e-4, grain: int = 256) -> DataFrame:
    """``points`` (n_tokens, p) with ``rate``.

    ``targets``: weights by place in p.  ``ceiling`` bounds the rates (1 where no
    budget is given), ``floor`` is an SQL expression for the smallest rate of a row.  Stops when the residual is below ``tolerance`` of the total
    or has not shrunk for some steps.

    A rate follows from p and the residuals of all steps, so the steps are taken on
    bins of alike p (``grain`` to each share, with the exact sums of what they hold), and
    every row's own p then follows them in one pass.  Should that miss the targets by more than
    the bins did, further steps are taken on all rows.
    """
    k = range(len(targets))
    share = lambda r: [F.coalesce(F.sum(r * F.col("n_tokens") * F.col("p")[i]), F.lit(0.0)).alias(f"t{i}") for i in k]
    binned = points.where("n_tokens > 0").groupBy(F.transform("p", lambda x: F.round(x * grain).cast("int")).alias("bin"))
    total = F.sum("n_tokens")
    bins = stored(binned.agg(F.array(*(F.sum(F.col("n_tokens") * F.col("p")[i]) / total for i in k)).alias("p"), total.alias("n_tokens")).drop("bin"), "bins")
    natural = list(bins.agg(*share(F.lit(1.0))).first())
    scale = sum(targets[i] for i in k if natural[i] > 0)
    if not sum(natural) or not scale:
        return points.withColumn("rate", F.lit(1.0))
    weight = [targets[i] / scale if natural[i] > 0 else 0.0 for i in k]
    if budget is None:
        ceiling = 1.0 if ceiling is None else ceiling
        budget = min(natural[i] / weight[i] for i in k if weight[i] > 0) * ceiling
    goal = [w * budget for w in weight]
    # a document's own step: the reciprocal of its expected share of the natural totals
    own = sum((F.col("p")[i] * natural[i] for i in k), F.lit(0.0)) + F.lit(1e-9)
    start = F.lit(min(1.0, ceiling) if ceiling is not None else 1.0)

    def residual(rows: DataFrame, rate: str) -> tuple[list[float], float]:
        gap = [a - b for a, b in zip(rows.agg(*share(F.col(rate))).first(), goal, strict=True)]
        return gap, math.sqrt(sum(g * g for g in gap)) / budget

    def moved(ahead, gap):
        out = F.greatest(F.expr(floor).cast("double"), ahead - sum((F.col("p")[i] * gap[i] for i in k), F.lit(0.0)) / own)
        return out if ceiling is None else F.least(F.lit(float(ceiling)), out)

    def descend(current: DataFrame) -> tuple[DataFrame, list, float]:
        """Accelerated steps from the rates given: the next gradient is taken ahead of the step."""
        current, path = current.withColumn("ahead", F.col("rate")), []
        best, stalled, momentum = float("inf"), 0, 1.0
        for step in range(steps):
            gap, size = residual(current, "ahead")
            stalled = 0 if size < best * 0.999 else stalled + 1
            best = min(best, size)
            if size < tolerance or stalled >= 8:
                break
            following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
            pull, momentum = (momentum - 1) / following, following
            path.append((gap, pull))
            current = current.withColumn("next", moved(F.col("ahead"), gap)).withColumn("ahead", F.col("next") + pull * (F.col("next") - F.col("rate"))).withColumn("rate", F.col("next")).drop("next")
            if step % 6 == 5:
                current = stored(current, "rates")  # else the expression grows with the steps
        return current.drop("ahead"), path, best

    fitted, path, _ = descend(bins.withColumn("rate", start))
    if not path:
        return points.withColumn("rate", start)
    _, reached = residual(fitted, "rate")
    taken = F.array(*(F.struct(F.array(*map(F.lit, gap)).alias("gap"), F.lit(pull).alias("pull")) for gap, pull in path))

    def follow(state, x):
        to = moved(state["ahead"], x["gap"])
        return F.struct(to.alias("rate"), (to + x["pull"] * (to - state["rate"])).alias("ahead"))

    zero = F.struct(start.cast("double").alias("rate"), start.cast("double").alias("ahead"))
    out = stored(points.withColumn("rate", F.aggregate(taken, zero, follow, lambda state: state["rate"])), "rates")
    _, missed = residual(out, "rate")
    return descend(out)[0] if missed > reached + 10 * tolerance else out


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, domain_col: str = "domain", id_col: str = "doc_id", text_col: str = "text", budget: float | None = None, ceiling: float | None = None, max_examples: int = 20_000, protect: str | None = None, seed: int = 7) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>.., rate, copies, key`` for every row of ``docs``.

    Documents whose likeliest domain is ``protect`` are never thinned.
    """
    targets = targets or TARGETS
    model = fit_domains(labelled, domain_col, text_col, id_col, max_examples)
    if not model[1]:
        words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \n\t\r]+"), lambda w: w != ""))
        return docs.select(F.col(id_col).alias("doc_id"), words.cast("long").alias("n_tokens"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), _key(id_col, text_col).alias("key"))
    points = stored(posteriors(docs, model, id_col, text_col), "posteriors")
    floor = f"if(p[{model[1].index(protect)}] >= array_max(p), 1, 0)" if protect in model[1] else "0"
    fitted = fit_rates(points, [targets.get(d, 0.0) for d in model[1]], budget, ceiling, floor)
    rate = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("rate"))
    copies = F.floor("rate") + (_uniform("doc_id", seed=seed) < F.col("rate") - F.floor("rate")).cast("int")
    out = fitted.withColumn("rate", rate)
    return out.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model[1])), "rate", copies.cast("int").alias("copies"), "key")


def mix(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every row repeated as often as its rate came to; rate 0 goes.

    Rows that share an id are told apart by their texts; rows equal in both are rated alike.
    """
    taken = rates(docs, labelled, id_col=id_col, text_col=text_col, **options).groupBy("key").agg(F.min("copies").alias("_copies")).where("_copies > 0").select(F.col("key").alias("_taken"), "_copies")
    joined = docs.select(F.struct("*").alias("row"), _key(id_col, text_col).alias("_of")).join(taken, F.col("_of") == F.col("_taken"))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).select("row.*")


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that ``labels`` covers, with their domain."""
    known = labels.select(F.col("doc_id").alias("_id"), F.expr(DOMAIN).alias("domain")).where("domain is not null")
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")).drop("_id")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rates(docs, labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
