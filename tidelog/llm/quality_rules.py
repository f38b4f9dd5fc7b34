"""Quality rules by weak supervision.

Rules look at a few signals of a text and vote *good*, *bad* or abstain. Expectation maximisation
over the histogram of vote patterns (all documents; at most 3**RULES patterns, whatever the
corpus) estimates how often each rule casts each vote on good and on bad documents, without
labels. The posterior probability of *good* then decides, instead of asking that every rule pass.

Edge cases: a null or empty text has no words and fails the base rules; very long texts are counted
whole; repeated rows are counted and judged as often as they come; an empty table gives an empty
result; other columns, nulls in them included, pass through untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Counts of a text, as returned by ``signals_of``.
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct")
BAD, ABSTAIN, GOOD = 0, 1, 2
MAX_STEPS, TOLERANCE = 200, 1e-9
#: Share of good documents that EM starts from.
START_GOOD = 0.85
#: The rules' thresholds lie far outside clean prose, so on a good document each votes *bad* this
#: often at most. Without that bound EM may take one kind of bad document for the only one, and
#: hide the others (whose rules fire apart from each other) among the good.
MAX_FALSE_BAD = 0.001


def _repeat_words(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: words inside a 3-word window that comes twice or more there, and distinct words."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    flat = [w for ws in words for w in ws]
    codes, _ = pd.factorize(pd.Series(flat, dtype=object), sort=False)
    codes = codes.astype(np.int64)
    doc = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    width = int(codes.max()) + 1
    distinct = np.bincount(np.unique(doc * width + codes) // width, minlength=len(words))
    if total < 3:
        return np.zeros(len(words), np.int64), distinct
    # Exact window ids: pairs first, then pairs with the third word and the text, always renumbered.
    pair = pd.factorize(codes[:-2] * width + codes[1:-1])[0].astype(np.int64)
    inside = doc[:-2] == doc[2:]
    window = pd.factorize(pair * width + codes[2:])[0].astype(np.int64)[inside]
    at = np.flatnonzero(inside)
    ids = pd.factorize(window * len(words) + doc[at])[0]
    twice = np.bincount(ids)[ids] > 1
    hit = np.zeros(total, bool)
    for k in range(3):
        hit[at[twice] + k] = True
    return np.bincount(doc[hit], minlength=len(words)), distinct


def signals_of(texts: list) -> list[np.ndarray]:
    """The SIGNALS of each text, as arrays of 64-bit integers."""
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.int64)
    word_chars = np.array([len(t) - sum(t.count(c) for c in common.SPACE) for t in texts], dtype=np.int64)
    n_symbols = np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], dtype=np.int64)
    n_lines, n_dup, n_upper, n_letters = (np.zeros(len(texts), np.int64) for _ in range(4))
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(common.SPACE)]
        n_lines[i], n_dup[i] = len(lines), len(lines) - len(set(lines))
        # Characters that lower() changes are upper-case letters; those that either case changes are letters.
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low, up = t.lower(), t.upper()
        if len(low) == len(t):
            n_upper[i] = int((np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) != codes).sum())
        else:
            n_upper[i] = sum(c.isupper() for c in t)
        if len(up) == len(t):
            n_letters[i] = n_upper[i] + int((np.frombuffer(up.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) != codes).sum())
        else:
            n_letters[i] = sum(c.isalpha() for c in t)
    n_marks = np.array([t.count("!") + t.count("?") for t in texts], dtype=np.int64)
    repeat, distinct = _repeat_words(words)
    return [n_words, word_chars, n_symbols, n_dup, repeat, n_lines, n_upper, n_letters, n_marks, distinct]


def with_signals(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` and one long column for each signal."""
    return common.with_added(docs, text_col, [(prefix + s, pa.int64(), T.LongType()) for s in SIGNALS], signals_of)


def rules(prefix: str = "") -> list[tuple[str, F.Column]]:
    """(name, vote) of each labelling function."""
    c = {s: F.col(prefix + s) for s in SIGNALS}
    per_word = lambda s: c[s] / F.greatest(c["n_words"], F.lit(1))

    def vote(bad, good=None):
        out = F.when(bad, F.lit(BAD))
        return (out if good is None else out.when(good, F.lit(GOOD))).otherwise(F.lit(ABSTAIN))

    some = c["n_words"] >= 20
    length = c["word_chars"] / F.greatest(c["n_words"], F.lit(1))
    upper = c["n_upper"] / F.greatest(c["n_letters"], F.lit(1))
    lines = c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))
    return [
        ("symbols", vote(per_word("n_symbols") > 0.2)),
        ("upper", vote((upper > 0.5) & (c["n_letters"] > 20))),
        ("repeats", vote((per_word("n_repeat_words") > 0.35) & some, (per_word("n_repeat_words") < 0.15) & some)),
        ("lines", vote((lines > 0.5) & (c["n_lines"] >= 4))),
        ("word_length", vote((length < 2.5) | (length > 12), (length > 3.5) & (length < 9) & some)),
        ("marks", vote(per_word("n_marks") > 0.4)),
        ("variety", vote((per_word("n_distinct") < 0.15) & (c["n_words"] >= 50), (per_word("n_distinct") > 0.3) & some)),
        ("length", vote(c["n_words"] < 5)),
        ("letters", vote(c["n_letters"] < 0.5 * c["word_chars"], c["n_letters"] > 0.7 * c["word_chars"])),
    ]


def fit(patterns: np.ndarray, counts: np.ndarray) -> dict:
    """EM on distinct vote patterns (rows of BAD, ABSTAIN, GOOD) and how often each occurs."""
    n_rules = patterns.shape[1]
    if not len(counts) or not counts.sum():
        return {"prior": START_GOOD, "votes": np.full((2, n_rules, 3), 1 / 3)}
    hot = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    bad = hot[:, :, BAD].sum(1)
    p_good = 1 / (1 + np.exp(-(math.log(START_GOOD / (1 - START_GOOD)) - 4.0 * bad)))
    prior, votes, was = START_GOOD, None, -np.inf
    for _ in range(MAX_STEPS):
        weight = np.stack([(1 - p_good) * counts, p_good * counts])
        # One pseudo-count a vote keeps every chance above zero.
        votes = np.einsum("cp,prv->crv", weight, hot) + 1.0
        votes /= votes.sum(2, keepdims=True)
        over = np.maximum(votes[1, :, BAD] - MAX_FALSE_BAD, 0)
        votes[1, :, BAD] -= over
        votes[1, :, GOOD] += over
        prior = (weight[1].sum() + 1.0) / (counts.sum() + 2.0)
        logs = np.einsum("prv,crv->cp", hot, np.log(votes)) + np.log([[1 - prior], [prior]])
        top = logs.max(0)
        p_good = np.exp(logs[1] - top) / np.exp(logs - top).sum(0)
        now = float(((top + np.log(np.exp(logs - top).sum(0))) * counts).sum())
        if abs(now - was) <= TOLERANCE * abs(now):
            break
        was = now
    return {"prior": float(prior), "votes": votes}


def posterior(model: dict, votes: list[F.Column]) -> F.Column:
    """Probability of *good* as a column: a sum of log odds, one for each rule's vote."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for r, vote in enumerate(votes):
        gain = np.log(model["votes"][1, r]) - np.log(model["votes"][0, r])
        odds = odds + F.when(vote == BAD, float(gain[BAD])).when(vote == GOOD, float(gain[GOOD])).otherwise(float(gain[ABSTAIN]))
    return 1.0 / (1.0 + F.exp(-odds))


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, prefix: str = "", keep_text: bool = True) -> DataFrame:
    """``docs`` with signals, votes, ``base_failed``, ``quality`` (posterior) and ``kept``.

    One pass over the texts, written to the shared folder; EM sees only the pattern histogram.
    """
    named = rules(prefix)
    voted = with_signals(docs, text_col, prefix).withColumns({f"{prefix}vote_{n}": v.cast("byte") for n, v in named})
    voted = common.materialize(voted if keep_text else voted.drop(text_col), "quality")
    names = [f"{prefix}vote_{n}" for n, _ in named]
    seen = voted.groupBy(*names).count().orderBy(*names).collect()  # at most 3**len(rules) rows
    model = fit(np.array([r[:-1] for r in seen], dtype=int).reshape(len(seen), len(names)), np.array([r[-1] for r in seen], dtype=float))
    n_words, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    quality = posterior(model, [F.col(n) for n in names])
    return voted.withColumns({f"{prefix}base_failed": failed, f"{prefix}quality": quality, f"{prefix}kept": ~failed & (quality >= threshold)})


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    prefix = common.free_name(docs, "q_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return judge(docs, text_col, prefix=prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document with its base counts, posterior quality and verdict."""
    common.tune(spark)
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, keep_text=False)
    return out.select("doc_id", *SIGNALS[:5], "base_failed", "kept", "quality", *(f"vote_{n}" for n, _ in rules()))
