"""Text metrics of a (prediction, gold) pair as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions.text import let, pystrip


def exact_match(pred: Column, gold: Column) -> Column:
    return F.when(pystrip(pred) == pystrip(gold), F.lit(1.0)).otherwise(F.lit(0.0))


def length_ratio(pred: Column, gold: Column) -> Column:
    """Shorter over longer length in code points, unstripped; 0 when gold is empty."""
    p, g = F.length(pred), F.length(gold)
    return F.when(g == 0, F.lit(0.0)).otherwise(F.least(p, g) / F.greatest(p, g, F.lit(1)))


def tokens(text: Column) -> Column:
    """Lower-cased words cut at blanks and LF only; tabs and CR stay inside words."""
    return F.filter(F.split(F.translate(F.lower(pystrip(text)), "\n", " "), " "), lambda t: t != "")


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection: one merge walk over both sorted arrays, linear time."""

    def walk(s: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            a, b = F.get(s["l"], at["i"]), F.get(s["r"], at["j"])
            same, behind = F.coalesce(a == b, F.lit(False)), F.coalesce(a < b, F.lit(False))
            return F.struct(
                (at["i"] + (same | behind).cast("int")).alias("i"),
                (at["j"] + (~behind).cast("int")).alias("j"),
                (at["n"] + same.cast("int")).alias("n"),
            )

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))
        steps = F.sequence(F.lit(1), F.size(s["l"]) + F.size(s["r"]))
        return F.when((F.size(s["l"]) == 0) | (F.size(s["r"]) == 0), F.lit(0)).otherwise(
            F.aggregate(steps, start, step, lambda at: at["n"])
        )

    return let(F.struct(F.sort_array(left).alias("l"), F.sort_array(right).alias("r")), walk)


def f_measure(hits: Column, n_pred: Column, n_gold: Column) -> Column:
    """Harmonic mean of hits/n_pred and hits/n_gold; 0 where it is undefined."""
    precision, recall = hits / n_pred, hits / n_gold
    return F.when((n_pred == 0) | (n_gold == 0) | (hits == 0), F.lit(0.0)).otherwise(
        F.lit(2.0) * precision * recall / (precision + recall)
    )


def token_f1_of(pred_tokens: Column, gold_tokens: Column) -> Column:
    return let(
        F.struct(pred_tokens.alias("p"), gold_tokens.alias("g")),
        lambda t: let(multiset_overlap(t["p"], t["g"]), lambda hits: f_measure(hits, F.size(t["p"]), F.size(t["g"]))),
    )


def token_f1(pred: Column, gold: Column) -> Column:
    return token_f1_of(tokens(pred), tokens(gold))


def _lcs_udf():
    """Built inside a function, so that workers get it by value and need not have this package."""

    def length(a, b) -> int:
        if a is None or b is None or not len(a) or not len(b):
            return 0
        where: dict[str, int] = {}
        for i, token in enumerate(a):
            where[token] = where.get(token, 0) | (1 << i)
        full = (1 << len(a)) - 1
        free = full
        for token in b:
            hit = free & where.get(token, 0)
            free = ((free + hit) | (free - hit)) & full
        return len(a) - free.bit_count()

    def lengths(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([length(a, b) for a, b in zip(left, right)], dtype="int32")

    return F.pandas_udf(lengths, T.IntegerType())


def lcs_len(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two token arrays (bit-vector recurrence)."""
    return _lcs_udf()(left, right)


def rouge_l_of(lcs: Column, pred_tokens: Column, gold_tokens: Column) -> Column:
    return f_measure(lcs, F.size(pred_tokens), F.size(gold_tokens))


# --- BLEU-4 --------------------------------------------------------------------------------

# The public "13a" tokenisation, as (pattern, replacement) in order.
_BLEU_REPLACEMENTS = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
)
_BLEU_SPACING = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def bleu_tokens(text: Column) -> Column:
    out = text
    for pattern, replacement in _BLEU_REPLACEMENTS:
        out = F.regexp_replace(out, pattern, replacement)
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for pattern, replacement in _BLEU_SPACING:
        out = F.regexp_replace(out, pattern, replacement)
    return F.filter(F.split(out, r"\s+"), lambda t: t != "")


def _ngrams(words: Column, n: int) -> Column:
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def bleu4(pred: Column, gold: Column) -> Column:
    """Corpus BLEU of one pair in [0, 1]: clipped 1- to 4-gram precisions, exponential smoothing
    of zero counts, brevity penalty. 0 when the prediction is too short for a 4-gram."""

    def score(t: Column) -> Column:
        n_pred, n_gold = F.size(t["p"]), F.size(t["g"])
        hits = F.array(*[multiset_overlap(_ngrams(t["p"], n), _ngrams(t["g"], n)) for n in range(1, 5)])

        def combine(h: Column) -> Column:
            log_sum, halving = F.lit(0.0), F.lit(1.0)
            for n in range(1, 5):
                found, total = F.get(h, F.lit(n - 1)), n_pred - (n - 1)
                halving = F.when(found == 0, halving * 2).otherwise(halving)
                share = F.when(found == 0, 1.0 / (halving * total)).otherwise(found / total)
                log_sum = log_sum + F.ln(share)
            penalty = F.when(n_pred < n_gold, F.exp(1.0 - n_gold / n_pred)).otherwise(F.lit(1.0))
            return penalty * F.exp(log_sum / 4)

        return F.when(n_pred < 4, F.lit(0.0)).otherwise(
            let(hits, lambda h: F.when(F.get(h, F.lit(0)) == 0, F.lit(0.0)).otherwise(combine(h)))
        )

    return let(F.struct(bleu_tokens(pred).alias("p"), bleu_tokens(gold).alias("g")), score)
