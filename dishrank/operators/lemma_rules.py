"""Lemmas of forms that no table lists, by suffix rewrites learned from those it lists.

A listed pair tells how an ending is rewritten: what follows the letters that form and
lemma share. The pair counts for this ending and for the longer ones with up to
``CONTEXT`` letters before it. Of the rewrites of one ending the most frequent holds. A new
form takes the rule of its longest ending that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of context before what is rewritten, letters of an ending in all.
CONTEXT = 3
ENDING = 8
# Pairs a rule needs, and the share of all pairs with its ending that must follow it.
LEAST_PAIRS = 3
LEAST_SHARE = 0.5
# Letters of a form that no rule takes away.
STEM = 2


def _shared(form: Column, lemma: Column) -> Column:
    """Letters of the common beginning, ``STEM`` at least being asked for."""
    letters = F.sequence(F.lit(1), F.least(F.length(form), F.length(lemma)))
    same = F.filter(letters, lambda n: F.substr(form, F.lit(1), n) == F.substr(lemma, F.lit(1), n))
    return F.coalesce(F.array_max(same), F.lit(0))


def learn_rules(
    lemma_table: DataFrame, least_pairs: int = LEAST_PAIRS, least_share: float = LEAST_SHARE, context: int = CONTEXT
) -> DataFrame:
    """``(ending, becomes, pairs)``: one rule per ending, from pairs ``(form, lemma)``.

    Pairs that share fewer than ``STEM`` letters are irregular and teach nothing. A form
    that is its own lemma counts against the rules of its endings.
    """
    pairs = lemma_table.where(F.col("form").isNotNull() & F.col("lemma").isNotNull()).select("form", "lemma").distinct()
    pairs = pairs.withColumn("shared", _shared(F.col("form"), F.col("lemma"))).where(F.col("shared") >= STEM)
    starts = F.sequence(F.greatest(F.col("shared") - context, F.lit(STEM)), F.col("shared"))
    cut = pairs.select("form", "lemma", F.explode(starts).alias("start"))
    rewrites = cut.select(
        F.substr("form", F.col("start") + 1, F.length("form")).alias("ending"),
        F.substr("lemma", F.col("start") + 1, F.length("lemma")).alias("becomes"),
    ).where(F.length("ending").between(1, ENDING))
    counted = rewrites.groupBy("ending", "becomes").agg(F.count(F.lit(1)).alias("pairs"))
    best = counted.groupBy("ending").agg(
        F.sum("pairs").alias("all"), F.min(F.struct((-F.col("pairs")).alias("less"), "becomes")).alias("best")
    ).select("ending", "all", (-F.col("best.less")).alias("pairs"), F.col("best.becomes").alias("becomes"))
    enough = (F.col("pairs") >= least_pairs) & (F.col("pairs") >= least_share * F.col("all"))
    return best.where(enough).select("ending", "becomes", "pairs")


def apply_rules(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """``(form, lemma)`` of those of the distinct ``forms(form)`` that a rule fits.

    Each form meets the rules by its endings, a few rows a form, and takes the longest.
    """
    most = F.least(F.lit(ENDING), F.length("form") - STEM)
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: n <= most)
    endings = forms.select("form").distinct().select("form", F.explode(sizes).alias("size"))
    met = endings.withColumn("ending", F.substr("form", F.length("form") - F.col("size") + 1, F.col("size"))).join(rules, "ending")
    best = met.groupBy("form").agg(F.max(F.struct("size", "becomes")).alias("rule"))
    stem = F.substr("form", F.lit(1), F.length("form") - F.col("rule.size"))
    return best.select("form", F.concat(stem, "rule.becomes").alias("lemma"))


def with_learned(lemma_table: DataFrame, words: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The lemma table, and the lemmas that rules give to the ``words(word)`` that it does not list."""
    listed = lemma_table.select("form", "lemma")
    new = words.select(F.col("word").alias("form")).distinct().join(listed.select("form").distinct(), "form", "left_anti")
    return listed.unionByName(apply_rules(new, learn_rules(lemma_table) if rules is None else rules))
