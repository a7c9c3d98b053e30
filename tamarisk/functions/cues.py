"""Expressions over scored candidate analyses.

``candidates`` is an array of struct<score, pos, rat, gen, form_gen, stemcat>,
at most a hundred long, so it stays nested and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of speech that can be cues, and those that never are.
CONTENT_POS = ("noun", "noun_prop", "adj", "verb", "adj_comp", "noun_quant")
EXCLUDED_POS = ("prep", "conj", "part", "pron", "punc", "digit", "abbrev")
RATIONALITY = ("r", "i", "n")
TOP_N = 100


def is_cue_pos(pos: Column) -> Column:
    return F.coalesce(pos.isin(*CONTENT_POS), F.lit(False))


def carries_gender(gen: Column) -> Column:
    return F.coalesce(gen.isin("m", "f"), F.lit(False))


def form_divergence(gen: Column, form_gen: Column) -> Column:
    """AB5: both genders are real and they differ."""
    return carries_gender(gen) & carries_gender(form_gen) & (gen != form_gen)


def top(candidates: Column, field: str) -> Column:
    """A field of the first candidate, null if there is none."""
    return F.get(candidates, F.lit(0))[field]


def is_cue(candidates: Column) -> Column:
    """The first candidate's part of speech is content and any candidate is gendered."""
    gendered = F.coalesce(F.exists(candidates, lambda c: carries_gender(c["gen"])), F.lit(False))
    return is_cue_pos(top(candidates, "pos")) & gendered


def exact_sum(values: Column) -> Column:
    """Order-independent sum of an array: Neumaier's compensation over sorted values."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def add(state: Column, x: Column) -> Column:
        t = state["s"] + x
        lost = F.when(F.abs(state["s"]) >= F.abs(x), (state["s"] - t) + x).otherwise((x - t) + state["s"])
        return F.struct(t.alias("s"), (state["c"] + lost).alias("c"))

    known = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.aggregate(known, zero, add, lambda z: z["s"] + z["c"])


def _scores(candidates: Column) -> Column:
    return F.transform(candidates, lambda c: c["score"].cast("double"))


def rationality_mass(candidates: Column) -> Column:
    """struct<r, i, n>: each rationality's share of all candidates' scores.

    Candidates of other or null rationality stay in the denominator, so shares
    needn't add up to 1. A share is null where no candidate has it, and all
    are where the scores add up to nothing.
    """
    total = exact_sum(_scores(candidates))

    def share(k: str) -> Column:
        own = F.filter(candidates, lambda c: c["rat"] == k)
        return F.when((total > 0) & (F.size(own) > 0), F.try_divide(exact_sum(_scores(own)), total)).alias(k)

    return F.struct(*map(share, RATIONALITY))


def gender_disagreement(candidates: Column) -> Column:
    """AB4: candidates of both genders."""
    has = lambda g: F.coalesce(F.exists(candidates, lambda c: c["gen"] == g), F.lit(False))
    return has("m") & has("f")


def dominant_gender(candidates: Column) -> Column:
    """The gender of the highest score among gendered candidates; m wins ties."""
    real = F.filter(candidates, lambda c: c["gen"].isin("m", "f"))
    ranked = F.transform(real, lambda c: F.struct(c["score"].cast("double").alias("s"), (c["gen"] == "m").alias("m"), c["gen"].alias("g")))
    return F.array_max(ranked)["g"]


def canonical_set(values: Column) -> Column:
    """A set of rationalities in the order r, i, n."""
    return F.filter(F.array(*map(F.lit, RATIONALITY)), lambda x: F.array_contains(values, x))


def retained(candidates: Column, keep: int = TOP_N) -> Column:
    """The first ``keep`` candidates; any other number than 100 is an error."""
    if keep != TOP_N:
        raise ValueError(f"retention must be {TOP_N}, got {keep}")
    return F.slice(candidates, 1, keep)
