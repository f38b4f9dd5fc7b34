"""Mixing to target weights with soft domain membership.

A classifier learned from the labelled rows (hashed word presence and a few shapes of the text, naive Bayes over the buckets
that tell domains apart, absent ones included) gives each document a score for each domain. Those scores are overconfident, as
words come together, so posteriors are a multinomial logistic regression on them, fitted to scores of labelled rows by
models that haven't seen them (FOLDS). Non-negative document rates are
then fitted by projected gradient descent on the least squares between expected domain tokens
``sum(rate * tokens * posterior)`` and the targets, with a small pull towards rate 1 that makes the
solution unique. A step needs only one aggregate: the rates are an expression of the posteriors and
of the steps since they were last written, and nothing but domain sums is collected. Where those steps
leave a total more than MAX_GAP off its target, Newton's method on the dual problem (one number a
domain; its matrix is one aggregate too) finishes the fit; targets that no rates reach give a warning.

All is DataFrame functions. Bounds: TRAIN_ROWS labelled rows (smallest hashed ids; their scores come to the driver), BUCKETS x
MAX_DOMAINS weights as literals, MAX_STEPS and MAX_NEWTON steps. Edge cases: null and empty texts have no tokens
and are scored by their shape; null ids are kept but not learned from; repeated rows get equal rates and, like rows without id, draw
their copies each by itself; very long texts are read whole; columns with the names of added ones are replaced; a domain without
posterior mass or target is left out of the fit; without labels every document is of the one domain
``unlabelled`` at rate 1; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

TRAIN_ROWS, MAX_DOMAINS = 20_000, 64
BUCKETS = 1 << 14
#: Buckets behind those of words: classes of length, of variety, and of the share of words that end in a mark.
SHAPES, MARKS = 96, "!?#*$%&|<>=+-_~^@/:;)]}'\\\""
#: Models that score the labelled rows which the others learn from, and the pull and steps of the calibration.
FOLDS, CALIBRATION_PULL, CALIBRATION_STEPS = 4, 1e-4, 100
#: A bucket counts if its chi-square over the domains is above this and it has so many documents.
MIN_CHI, MIN_DOCS, SMOOTH = 25.0, 8, 0.5
MAX_STEPS, RIDGE, TOLERANCE = 40, 1e-3, 1e-5
#: The fit is finished if each domain's tokens are this near to the target, as a share of all tokens.
MAX_GAP = 1e-3
#: Newton's method: steps, halvings of a step, pull towards rate 1 and size of the slope at the end.
MAX_NEWTON, MAX_HALVINGS, DUAL_RIDGE, DUAL_TOLERANCE = 60, 30, 1e-6, 1e-6
#: Steps after which the rates (numbers only, no texts) are written to the shared folder.
WRITE_STEPS = 8
#: Target shares of the query.
TARGETS = {"clean": 0.86, "low": 0.08, "toxic": 0.06}


def tokens_of(text_col: str) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[ \t\n\x0B\f\r.,]+"), lambda w: w != "")


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality").isNotNull(), "clean")
    return labels.where(F.col("doc_id").isNotNull()).select("doc_id", domain.alias("domain")).where("domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))


def source_domains(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, domain): each document's source as its domain, to mix sources by what their texts are like."""
    known = docs.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(source_col).alias("domain"))


def buckets_of(words: F.Column) -> F.Column:
    """The distinct buckets of a text's words, and those of its shape."""
    n = F.size(words)
    share = lambda k: F.floor(10.0 * k / F.greatest(n, F.lit(1)))
    found = F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    marked = F.size(F.filter(words, lambda w: F.instr(F.lit(MARKS), F.right(w, F.lit(1))) > 0))
    shape = [F.least(F.lit(63), F.floor(2 * F.log2(n + 1.0))), 64 + share(F.size(F.array_distinct(words))), 80 + share(marked)]
    return F.concat(found, F.array(*((BUCKETS + x).cast("int") for x in shape)))


def _weights(seen: dict[int, dict[str, int]], totals: dict[str, int], names: list[str]) -> tuple[list[float], dict[int, list[float]]]:
    """Prior (with all buckets absent) of each domain, and for each bucket that tells domains apart what its presence adds."""
    n = sum(totals.values())
    prior, weights = [math.log((totals.get(d, 0) + SMOOTH) / (n + SMOOTH * len(names))) for d in names], {}
    for bucket, counts in seen.items():
        total = sum(counts.values())
        if total < MIN_DOCS:
            continue
        chi = sum((counts.get(d, 0) - total * totals[d] / n) ** 2 / (total * totals[d] / n) for d in names if totals.get(d))
        if chi > MIN_CHI:
            whole, row = (total + SMOOTH) / (n + 2 * SMOOTH), []
            for k, d in enumerate(names):
                # The prior takes every bucket as absent; a present one adds the difference.
                share = (counts.get(d, 0) + SMOOTH) / (totals.get(d, 0) + 2 * SMOOTH)
                absent = math.log(1 - share) - math.log(1 - whole)
                row.append(round(math.log(share) - math.log(whole) - absent, 4))
                prior[k] += absent
            weights[bucket] = row
    return prior, weights


def calibrate(scores: np.ndarray, label: np.ndarray, n: int) -> np.ndarray:
    """Matrix (n x (n + 1)) that makes log posteriors of scores (each row less its mean) and a one: regression by Newton's method.

    A pull towards a scale of a tenth keeps it finite where domains part cleanly. Above 16 domains only a scale and a bias for each are fitted.
    """
    x = np.c_[scores - scores.mean(1, keepdims=True), np.ones(len(scores))]
    full = n <= 16
    start = np.c_[0.1 * np.eye(n), np.zeros(n)]
    if not len(x):
        return np.c_[np.eye(n), np.zeros(n)]
    size = np.maximum(np.abs(x).max(0), 1e-9)
    x, w, y = x / size, start * size, np.eye(n)[label]
    home, free = w.copy(), np.ones_like(w, bool) if full else np.c_[np.eye(n, dtype=bool), np.ones(n, bool)]

    def at(w):
        z = x @ w.T
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        return -np.log(np.maximum(p[np.arange(len(x)), label], 1e-300)).mean() + CALIBRATION_PULL / 2 * ((w - home) ** 2).sum(), p

    value, p = at(w)
    for _ in range(CALIBRATION_STEPS):
        slope = (((p - y).T @ x) / len(x) + CALIBRATION_PULL * (w - home))[free]
        if np.abs(slope).max() < 1e-7:
            break
        rows, columns = np.nonzero(free)
        bend = np.zeros((len(rows), len(rows)))
        for a in range(n):
            for b in range(a, n):
                part = (x * (p[:, [a]] * ((a == b) - p[:, [b]]))).T @ x / len(x)
                i, j = np.flatnonzero(rows == a), np.flatnonzero(rows == b)
                bend[np.ix_(i, j)] = part[np.ix_(columns[i], columns[j])]
                bend[np.ix_(j, i)] = bend[np.ix_(i, j)].T
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(bend + CALIBRATION_PULL * np.eye(len(rows)), slope)
        for half in range(30):
            new, q = at(w - step / 2**half)
            if new <= value - 1e-4 / 2**half * float(slope @ step[free]):
                break
        else:
            break
        w, value, p = w - step / 2**half, new, q
    return w / size


def fit_classifier(docs: DataFrame, domains: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Priors, bucket weights by domain and the calibration, from the bounded sample."""
    chosen = domains.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # bounded, so broadcast
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = common.materialize(sample.withColumn("words", tokens_of("text")).select("domain", fold.alias("fold"), buckets_of(F.col("words")).alias("buckets")), "sample")
    names = sorted(r["domain"] for r in sample.select("domain").distinct().collect())
    if not names:
        return {"domains": ["unlabelled"], "prior": [0.0], "weights": {}, "calibration": None}
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    # One row a bucket (-1 stands for all rows), with a count for each domain and fold.
    cells = [(d, k) for d in names for k in range(FOLDS)]
    marked = sample.select("domain", "fold", F.explode(F.concat("buckets", F.array(F.lit(-1)))).alias("bucket"))
    counted = marked.groupBy("bucket").agg(*(F.count(F.when((F.col("domain") == d) & (F.col("fold") == k), 1)).alias(f"c{i}") for i, (d, k) in enumerate(cells)))
    rows = {r[0]: r[1:] for r in counted.collect()}  # BUCKETS + SHAPES + 1 at most
    folds = [k for k in range(FOLDS) if any(n for n, c in zip(rows[-1], cells, strict=True) if c[1] == k)]

    def learned(without: int | None) -> tuple[list[float], dict[int, list[float]]]:
        seen = {}
        for bucket, row in rows.items():
            counts = seen[bucket] = dict.fromkeys(names, 0)
            for n, (d, k) in zip(row, cells, strict=True):
                if k != without:
                    counts[d] += n
        totals = seen.pop(-1)
        return _weights({b: c for b, c in seen.items() if any(c.values())}, totals, names)

    prior, weights = learned(None)
    model = {"domains": names, "prior": prior, "weights": weights, "calibration": None}
    if len(names) > 1:
        number = F.create_map(*(x for k, d in enumerate(names) for x in (F.lit(d), F.lit(k))))[F.col("domain")]
        got = []
        for k in folds:  # TRAIN_ROWS rows in all at most; a plan holds one model's weights at a time
            scores = _scores(F.col("buckets"), *learned(k))
            got += sample.where(F.col("fold") == k).select(number.alias("label"), F.array(*scores).alias("scores")).collect()
        model["calibration"] = calibrate(np.array([r["scores"] for r in got]).reshape(len(got), len(names)), np.array([r["label"] for r in got], int), len(names))
    return model


def _literal(weights: list[float]) -> F.Column:
    """An array literal that Catalyst folds from one string."""
    return F.split(F.lit(",".join("0" if w == 0 else repr(w) for w in weights)), ",").cast("array<double>")


def _sum_of(hits: F.Column, table: F.Column, start: float) -> F.Column:
    return F.aggregate(hits, F.lit(start), lambda total, k: total + F.get(table, k))


def _place(buckets: F.Column, weights: dict[int, list[float]]) -> tuple[F.Column, list[int]]:
    """The numbers (from 1) of the buckets that have weights; only those are looked up."""
    live = sorted(weights)
    at = [0] * (BUCKETS + SHAPES)
    for k, b in enumerate(live):
        at[b] = k + 1
    place = F.split(F.lit(",".join(map(str, at))), ",").cast("array<int>")
    return F.filter(F.transform(buckets, lambda b: F.get(place, b)), lambda k: k > 0), live


def _scores(buckets: F.Column, prior: list[float], weights: dict[int, list[float]]) -> list[F.Column]:
    """One score a domain, of a text's buckets."""
    hits, live = _place(buckets, weights)
    return [_sum_of(hits, _literal([0.0, *(weights[b][k] for b in live)]), start) for k, start in enumerate(prior)]


def with_posteriors(docs: DataFrame, model: dict, text_col: str = "text", prefix: str = "p_", n_col: str = "n_tokens") -> DataFrame:
    """``docs`` with its tokens and one posterior for each domain."""
    words = common.free_name(docs, "_words")
    out = docs.withColumn(words, tokens_of(text_col))
    if len(model["domains"]) == 1:
        return out.withColumns({n_col: F.size(words).cast("long"), prefix + model["domains"][0]: F.lit(1.0)}).drop(words)
    hits = common.free_name(docs, "_hits")
    found, live = _place(buckets_of(F.col(words)), model["weights"])
    out = out.withColumns({n_col: F.size(words).cast("long"), hits: found}).drop(words)
    names = [f"{hits}_{k}" for k in range(len(model["domains"]))]
    out = out.withColumns({x: _sum_of(F.col(hits), _literal([0.0, *(model["weights"][b][k] for b in live)]), model["prior"][k]) for k, x in enumerate(names)})
    mean = sum((F.col(x) for x in names[1:]), F.col(names[0])) / len(names)
    turned = [sum((F.lit(float(w)) * (F.col(x) - mean) for w, x in zip(row[:-1], names, strict=True)), F.lit(float(row[-1]))) for row in model["calibration"]]
    out = out.withColumns({f"{x}_z": z for x, z in zip(names, turned, strict=True)})
    top = F.greatest(*(F.col(f"{x}_z") for x in names))
    parts = [F.exp(F.col(f"{x}_z") - top) for x in names]
    total = sum(parts[1:], parts[0])
    return out.withColumns({prefix + d: p / total for d, p in zip(model["domains"], parts, strict=True)}).drop(hits, *names, *(f"{x}_z" for x in names))


def rate_expression(p: list[F.Column], steps: list[list[float]], rate: F.Column | None = None) -> F.Column:
    """The rate after ``steps`` (scaled residuals by domain), each projected on rates of at least 0."""
    eta = 1.0 / (1.0 + RIDGE)
    rate = F.lit(1.0) if rate is None else rate
    for g in steps:
        slope = sum((p[k] * g[k] for k in range(1, len(p))), p[0] * g[0])
        rate = F.greatest(F.lit(0.0), rate * (1 - eta * RIDGE) + eta * RIDGE - slope * eta)
    return rate


def aims_of(table: DataFrame, domains: list[str], targets: dict[str, float], prefix: str = "p_", n_col: str = "n_tokens", grow: bool = False) -> tuple[int, list[float], list[float], list[float]] | None:
    """Tokens, and for each domain its share of them, the share aimed at and the weight of the gap (0: no aim).

    Targets are shares of the tokens of the domains that have one; other domains are left as they are. With
    ``grow`` the total rises until the domain most above its target stays whole and only others gain.
    """
    p, n = [F.col(prefix + d) for d in domains], F.col(n_col)
    first = table.agg(F.sum(n).alias("n"), *(F.sum(n * x).alias(f"m{k}") for k, x in enumerate(p))).first()
    if not first["n"]:
        return None
    share = [first[f"m{k}"] / first["n"] for k in range(len(p))]
    wanted = sum(targets.get(d, 0.0) for d in domains)
    if not wanted:  # no domain has a target: nothing to fit
        return None
    base = sum(s for s, d in zip(share, domains, strict=True) if d in targets)
    target = [targets[d] / wanted * base if d in targets else s for s, d in zip(share, domains, strict=True)]
    if grow:
        most = max(s / t for s, t, d in zip(share, target, domains, strict=True) if d in targets and t > 0)
        target = [t * most if d in targets else t for t, d in zip(target, domains, strict=True)]
    scale = [1 / s if s > 1e-9 and d in targets else 0.0 for s, d in zip(share, domains, strict=True)]
    return first["n"], share, target, scale


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float], prefix: str = "p_", n_col: str = "n_tokens", grow: bool = False) -> list[list[float]]:
    """Steps of the projected gradient; ``table`` has tokens and posteriors of every document."""
    aims = aims_of(table, domains, targets, prefix, n_col, grow)
    return descend(table, domains, aims, prefix, n_col)[0] if aims else []


def descend(table: DataFrame, domains: list[str], aims: tuple, prefix: str, n_col: str) -> tuple[list[list[float]], list[float]]:
    """Steps of the projected gradient towards ``aims_of``, and the shares that they give."""
    p, n = [F.col(prefix + d) for d in domains], F.col(n_col)
    n_all, share, target, scale = aims
    steps: list[list[float]] = []
    now, table, since = share, table.select(n_col, *(prefix + d for d in domains), F.lit(1.0).alias("rate")), []
    for _ in range(MAX_STEPS):
        g = [scale[k] * (now[k] - target[k]) for k in range(len(p))]
        steps.append(g)
        since.append(g)
        rate = rate_expression(p, since, F.col("rate"))
        if len(since) == WRITE_STEPS:  # keeps expressions short
            table = common.materialize(table.withColumn("rate", rate), "rates")
            since, rate = [], F.col("rate")
        row = table.agg(*(F.sum(n * rate * x).alias(f"m{k}") for k, x in enumerate(p))).first()
        was, now = now, [row[f"m{k}"] / n_all for k in range(len(p))]
        if max(abs(a - b) for a, b in zip(was, now, strict=True)) < TOLERANCE:
            break
    return steps, now


def finish(table: DataFrame, domains: list[str], aims: tuple, prefix: str, n_col: str) -> tuple[list[list[float]], list[float]]:
    """One step that gives the fitted rates, and the shares that it gives.

    The fit with pull ``DUAL_RIDGE`` has rates ``max(0, 1 - sum(x * posterior))`` for one number x a domain, which
    minimises a convex function of K variables: Newton's method with halved steps needs a few aggregates of K x K sums.
    """
    p, n = [F.col(prefix + d) for d in domains], F.col(n_col)
    n_all, _, target, scale = aims
    free = [k for k in range(len(p)) if scale[k]]
    pull = np.array([DUAL_RIDGE / scale[k] for k in free])
    aim = np.array([target[k] for k in free])

    def at(x: np.ndarray):
        whole = [0.0] * len(p)
        for k, v in zip(free, x.tolist(), strict=True):
            whole[k] = v * (1.0 + RIDGE)  # rate_expression divides by it
        rate = rate_expression(p, [whole])
        live = n * (rate > 0).cast("double")
        sums = [F.sum(n * rate * rate).alias("q"), *(F.sum(n * rate * x).alias(f"m{k}") for k, x in enumerate(p))]
        sums += [F.sum(live * p[a] * p[b]).alias(f"h{i}_{j}") for i, a in enumerate(free) for j, b in enumerate(free) if i <= j]
        row = table.agg(*sums).first()
        now = [row[f"m{k}"] / n_all for k in range(len(p))]
        value = float(pull @ (x * x) / 2 + aim @ x + row["q"] / n_all / 2)
        slope = pull * x + aim - np.array([now[k] for k in free])
        bend = np.diag(pull) + np.array([[row[f"h{min(i, j)}_{max(i, j)}"] / n_all for j in range(len(free))] for i in range(len(free))])
        return whole, now, value, slope, bend

    x = np.zeros(len(free))
    here = at(x)
    for _ in range(MAX_NEWTON):
        _, _, value, slope, bend = here
        if np.abs(slope).max() <= DUAL_TOLERANCE:
            break
        step = np.linalg.solve(bend, slope)
        for half in range(MAX_HALVINGS):
            there = at(x - step / 2**half)
            if there[2] <= value - 1e-4 / 2**half * float(slope @ step):
                break
        else:
            break
        x, here = x - step / 2**half, there
    return [here[0]], here[1]


def fit_whole(table: DataFrame, domains: list[str], targets: dict[str, float], prefix: str = "p_", n_col: str = "n_tokens", grow: bool = False) -> list[list[float]]:
    """Steps after which every total is within ``MAX_GAP`` of its target; a warning gives the gaps if no rates do that."""
    aims = aims_of(table, domains, targets, prefix, n_col, grow)
    if aims is None:
        return []
    gap = lambda now: max(abs(a - b) for a, b, s in zip(now, aims[2], aims[3], strict=True) if s)
    if not any(aims[3]):
        return []
    steps, now = descend(table, domains, aims, prefix, n_col)
    if gap(now) > MAX_GAP:
        steps, now = finish(table, domains, aims, prefix, n_col)
    if gap(now) > MAX_GAP:
        warnings.warn("mixing: targets not reached; share of tokens and target: " + ", ".join(f"{d} {a:.4f} {b:.4f}" for d, a, b in zip(domains, now, aims[2], strict=True)), stacklevel=2)
    return steps


def copies_of(rate: F.Column, *draw: str) -> F.Column:
    """Whole copies: the rate's whole part and one more where a hash of the columns ``draw`` falls below the rest."""
    rest = rate - F.floor(rate)
    drawn = F.pmod(F.xxhash64(F.lit("mix"), *draw), F.lit(1_000_000)) / 1_000_000.0
    return (F.floor(rate) + (drawn < rest).cast("long")).cast("long")


def rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, grow: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_tokens, posteriors ``p_*``, ``rate`` and ``copies``."""
    model = fit_classifier(docs, domains, id_col, text_col)
    shown = [*(keep or [id_col]), "n_tokens", *(f"p_{d}" for d in model["domains"])]
    table = with_posteriors(docs, model, text_col).select(*shown, F.monotonically_increasing_id().alias("_at"))
    table = common.materialize(table, "posteriors")
    steps = fit_whole(table, model["domains"], targets, grow=grow)
    rate = rate_expression([F.col(f"p_{d}") for d in model["domains"]], steps)
    if grow:  # the fit comes near 1 for the domain that stays whole; no document of it may go
        rate = F.greatest(F.lit(1.0), rate)
    # Rows that share an id, or have none, draw by their place in the written table, others by their id alone.
    several = table.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_several")).count().where("count > 1").select("_several")
    alone = F.col(id_col).isNotNull()
    if not several.isEmpty():
        table = table.join(several, F.col(id_col) == F.col("_several"), "left")
        alone &= F.col("_several").isNull()
    table = table.withColumns({"_at": F.when(alone, -1).otherwise(F.col("_at")), "rate": F.round(rate, 6)})
    return table.select(*shown, "rate", copies_of(F.col("rate"), id_col, "_at").alias("copies"))


def mix(docs: DataFrame, domains: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", grow: bool = False) -> DataFrame:
    """``docs`` with each row as often as its copies say."""
    packed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*docs.columns).alias("_row"))
    out = rates(packed, domains, targets, "_id", "_text", keep=["_id", "_row"], grow=grow).where("copies > 0")
    once = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return once.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: tokens, domain posteriors, fitted rate and copies of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return rates(docs, domain_of(common.read(spark, sf_dir, "labels")), TARGETS)
