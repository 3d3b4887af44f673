"""Quality rules by weak supervision, with DataFrame functions only.

Rules read a few counts of a text and vote good (1), bad (-1) or abstain (0).
Expectation-maximisation over the table of vote patterns, which holds at most
3 ** len(RULES) rows whatever the corpus, estimates the share of good texts and
how often each rule votes each way, or abstains, on good and on bad texts. A
text's posterior probability of being good then replaces the demand that every rule passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import SPACE_GAP, let, materialise, split_words, without

WINDOW = 8
#: Counted once for each way to vote and for each class, so that no estimate is zero.
PSEUDO = 1.0
RULES = ("sentences", "letters", "worded", "word_length", "symbols", "repeats", "lines", "variety", "capitals", "doubled")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_doubled", "n_worded", "n_ended_lines")


def _repeat_words(words: Column) -> Column:
    """Words covered by 8-word windows whose 64-bit hash occurs twice or more in the text.

    Hashes are sorted with their places, so the cost is n log n for any text.
    """

    def covered(places: Column) -> Column:
        step = lambda acc, p: F.struct(
            F.greatest(acc["end"], p + WINDOW).alias("end"),
            (acc["n"] + p + WINDOW - F.greatest(acc["end"], p)).alias("n"),
        )
        return F.aggregate(places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def repeated(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: covered(F.array_sort(F.transform(
            F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(p, i + 1)["h"]).eqNullSafe(True)),
            lambda x: x["i"],
        ))))

    def of(ids: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(ids) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ids, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h)))

    ids = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(ids, of)).otherwise(0)


def features(docs: DataFrame) -> DataFrame:
    """Adds FEATURES (long) to each row; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0)
    letters = F.regexp_replace(text, r"[^\p{L}]+", "")

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).alias("n_words"),
            F.size(F.array_distinct(words)).alias("n_distinct_words"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w, i: (w == F.get(words, i - 1)).eqNullSafe(True))).alias("n_doubled"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).alias("n_worded"),
        )

    out = without(docs, *FEATURES).withColumns({
        "_c": let(split_words(F.col("text"), SPACE_GAP), counts),
        "_l": let(worded, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"), F.size(F.filter(x, lambda line: line.rlike(r"[.!?]\s*$"))).alias("e"))),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")),
        "n_letters": F.length(letters),
        "n_upper": F.length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")),
    })
    out = out.withColumns({
        "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.n") - F.col("_l.d"), "n_ended_lines": F.col("_l.e"),
        **{c: F.col(f"_c.{c}") for c in ("n_words", "n_distinct_words", "n_repeat_words", "n_doubled", "n_worded")},
    }).drop("_c", "_l")
    return out.withColumns({c: F.col(c).cast("long") for c in FEATURES})


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote over FEATURES. Between its two limits, and where a text is too short for it to find fault, a rule abstains.

    worded is the share of words that hold a letter; variety is the logarithm of the different words over that of all words, which long texts do not lower as they lower the plain ratio.
    """
    long = F.col("n_words") >= 20
    ended, letters, length = _ratio("n_ended_lines", "n_lines"), _ratio("n_letters", "word_chars"), _ratio("word_chars", "n_words")
    symbols, repeats, dups = _ratio("n_symbols", "n_words"), _ratio("n_repeat_words", "n_words"), _ratio("n_dup_lines", "n_lines")
    upper, doubled, worded = _ratio("n_upper", "n_letters"), _ratio("n_doubled", "n_words"), _ratio("n_worded", "n_words")
    variety = F.log(F.greatest("n_distinct_words", F.lit(1))) / F.log(F.greatest("n_words", F.lit(2)))
    return {
        "sentences": _vote(ended >= 0.8, (ended < 0.4) & long),
        "letters": _vote(letters >= 0.9, letters < 0.75),
        "worded": _vote(worded >= 0.9, worded < 0.8),
        "word_length": _vote(length.between(3.5, 6.5), (length < 2.5) | (length > 10)),
        "symbols": _vote(symbols <= 0.01, symbols > 0.1),
        "repeats": _vote(repeats <= 0.05, repeats > 0.3),
        "lines": _vote(dups == 0, dups > 0.3),
        "variety": _vote(variety >= 0.85, (variety < 0.7) & long),
        "capitals": _vote(upper <= 0.1, (upper > 0.4) & (F.col("n_letters") >= 20)),
        "doubled": _vote(doubled <= 0.05, doubled > 0.2),
    }


@dataclass(frozen=True)
class Model:
    """prior: P(good). weights: per rule, log P(vote | good) - log P(vote | bad) for the votes -1, 0 and 1."""

    prior: float
    weights: dict[str, dict[int, float]]

    def posterior(self) -> Column:
        """P(good | votes) of columns named like the rules."""
        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, w in self.weights.items():
            logit = logit + F.when(F.col(rule) == 1, w[1]).when(F.col(rule) == -1, w[-1]).otherwise(w[0])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit(patterns: list[tuple[tuple[int, ...], int]], names: tuple[str, ...] = RULES, rounds: int = 500, pseudo: float = PSEUDO) -> Model:
    """EM for two classes with votes independent given the class, over (votes, number of texts) of the whole corpus.

    The start believes any fault that is found. Each round estimates the share of good
    texts and each rule's votes on good and on bad ones, then the
    posteriors, until these stand still. The better class is the one on
    which the rules find less fault. A way to vote that no text shows has weight 0; no patterns give even odds.
    """
    total = sum(c for _, c in patterns)
    if not total:
        return Model(0.5, {r: {-1: 0.0, 0: 0.0, 1: 0.0} for r in names})
    votes, count = np.array([x for x, _ in patterns], np.int8), np.array([c for _, c in patterns], np.float64)
    cast = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)  # pattern, rule, way to vote
    n = np.tensordot(count, cast, 1)
    there = n > 0
    ways = there.sum(axis=1, keepdims=True)
    belief = np.where((votes == -1).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        good, g = belief @ count, np.tensordot(belief * count, cast, 1)
        prior = (good + pseudo) / (total + 2 * pseudo)
        on_good, on_bad = (g + pseudo) / (good + ways * pseudo), (n - g + pseudo) / (total - good + ways * pseudo)
        weights = np.where(there, np.log(on_good / on_bad), 0.0)
        if (on_good - on_bad)[:, 0][there[:, 0]].sum() > 0:  # the classes have changed places
            prior, weights = 1 - prior, -weights
        logits = math.log(prior / (1 - prior)) + np.tensordot(cast, weights, 2)
        before, belief = belief, 1 / (1 + np.exp(-np.clip(logits, -700.0, 700.0)))
        if np.abs(belief - before).max() < 1e-9:
            break
    return Model(float(prior), {r: dict(zip((-1, 0, 1), w, strict=True)) for r, w in zip(names, weights.tolist(), strict=True)})


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds FEATURES, the votes (vote_<rule>), p_good, base_failed and kept to each row of docs (needs a text column).

    Null and empty texts have no words, so base_failed is true. Repeated rows
    are judged alike and all returned; an empty table gives no rows; columns
    of these names in docs are replaced, all others pass through (the text
    itself is read once and not carried along).
    """
    added = [*FEATURES, "p_good", "base_failed", "kept", *(f"vote_{r}" for r in RULES)]
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    seen = features(without(docs, *added)).drop("text").withColumns({f"vote_{r}": v.cast("int") for r, v in rules().items()})
    seen = materialise(seen, "quality")
    votes = [F.col(f"vote_{r}") for r in RULES]
    patterns = [((*row[:-1],), row[-1]) for row in seen.groupBy(*votes).agg(F.count("*").alias("n")).collect()]  # at most 3 ** len(RULES) rows
    model = fit(sorted(patterns))
    judged = seen.withColumnsRenamed({f"vote_{r}": r for r in RULES}).withColumn("p_good", model.posterior())
    return judged.withColumnsRenamed({r: f"vote_{r}" for r in RULES}).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs without the texts that quality() rejects; same columns.

    Ids and digests of rejected rows are broadcast up to broadcast_rows and
    joined by shuffle beyond. Null and empty texts go, as they have no words;
    rows of equal id and text stay or go together, null ids included; an
    empty table gives no rows. Only doc_id and text are read, so other columns may have any names.
    """
    digest = F.md5(F.col("text").cast("binary"))
    judged = quality(docs.select("doc_id", "text", digest.alias("digest")), threshold)
    bad = materialise(judged.where(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("digest").alias("_t")).distinct(), "rejected")
    bad = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & digest.eqNullSafe(bad["_t"]), "left_anti")
