"""Lemmas of words that no table names, by endings learned from those it does.

A pair of token and lemma says what is cut from the token's end and what is put
there.  Every ending of the token, from what is cut up to ``LONGEST`` letters,
votes for that rewrite; a word takes the rewrite of its longest known ending.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import lookup_table, small_rows

LONGEST, LEAST = 6, 2
ENDINGS = "ending string, cut int, put string, votes bigint"


def learn_endings(lemmas: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``ending, cut, put, votes`` from ``lemmas(token, lemma)``: one rewrite an ending.

    Of several rewrites of an ending the one of most tokens counts, of ties the
    shortest cut, then the smallest ``put``.  Endings of fewer than ``least`` tokens are
    left out.  Tokens and lemmas are lower-cased; pairs with a null are no pairs.
    """
    pairs = lemmas.where("token is not null and lemma is not null").select(F.lower("token").alias("t"), F.lower("lemma").alias("l")).distinct()
    same = F.zip_with(F.split("t", ""), F.split("l", ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    kept = F.when(first > 0, first - 1).otherwise(F.least(F.length("t"), F.length("l"))).cast("int")
    rules = pairs.select("t", (F.length("t") - kept).alias("cut"), F.substring(F.col("l"), kept + 1, F.length("l")).alias("put"))
    rules = rules.where(F.col("cut") <= longest)
    sizes = F.sequence("cut", F.least(F.lit(longest), F.length("t")))
    votes = rules.select(F.explode(F.transform(sizes, lambda k: F.right(F.col("t"), k))).alias("ending"), "cut", "put")
    counts = votes.groupBy("ending", "cut", "put").agg(F.count("*").alias("votes"))
    best = counts.groupBy("ending").agg(F.min(F.struct((-F.col("votes")).alias("less"), "cut", "put")).alias("b"), F.sum("votes").alias("all"))
    found = best.where(F.col("all") >= least)
    return found.select("ending", F.col("b.cut").cast("int").alias("cut"), F.col("b.put").alias("put"), (-F.col("b.less")).alias("votes"))


def rewritten(low: Column, cut: Column, put: Column) -> Column:
    return F.concat(F.left(low, F.length(low) - cut), put)


def ending_lemma(token: Column, rules: dict[str, tuple[int, str]], longest: int = LONGEST) -> Column:
    """The lemma of each token by its longest known ending; null where none is known."""
    rules = dict(rules)

    def call(tokens: pa.Array) -> pa.Array:
        known: dict[str, str | None] = {}
        out = []
        for token in tokens.to_pylist():
            if token is not None and token not in known:
                found = None
                for k in range(min(longest, len(token)), -1, -1):
                    rule = rules.get(token[len(token) - k :])
                    if rule is not None and rule[0] <= len(token):
                        found = token[: len(token) - rule[0]] + rule[1]
                        break
                known[token] = found
            out.append(None if token is None else known[token])
        return pa.array(out, pa.string())

    return F.arrow_udf(call, "string")(F.lower(token))


def with_ending_lemmas(tokens: DataFrame, endings: DataFrame, column: str = "token", longest: int = LONGEST) -> DataFrame:
    """Adds ``lemma``: by the longest known ending, else the noun-suffix rule.

    Endings within the bounds of ``small_rows`` are looked up in the row; more of them
    by a join for each length, with the same result.
    """
    table = lookup_table(endings.select("ending", "cut", "put"))
    rows = small_rows(table)
    fallback = X.lemma(F.col(column))
    if rows is not None:
        found = ending_lemma(F.col(column), {r["ending"]: (r["cut"], r["put"]) for r in rows}, longest)
        return tokens.withColumn("lemma", F.coalesce(found, fallback))
    low, out, options = F.lower(F.col(column)), tokens, []
    for k in range(longest, -1, -1):
        rule = table.where(F.length("ending") == k).select(F.col("ending").alias(f"_e{k}"), F.struct("cut", "put").alias(f"_r{k}"))
        own = F.when(F.length(low) >= k, F.right(low, F.lit(k)) if k else F.lit(""))
        out = out.join(rule, own == F.col(f"_e{k}"), "left")
        options.append(F.when(F.col(f"_r{k}.cut") <= F.length(low), F.col(f"_r{k}")))
    out = out.withColumn("_rule", F.coalesce(*options))
    lemma = F.coalesce(rewritten(low, F.col("_rule.cut"), F.col("_rule.put")), fallback)
    return out.withColumn("lemma", lemma).select(*tokens.columns, "lemma")
