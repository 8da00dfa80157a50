"""Filter interaction audit (operator 13): what each filter removes, in every order, from one count of failure patterns.

Every row is reduced to the set of filters it fails, a mask of few bits, and rows are counted by part and mask, with
the rows that a removal costs (good, toxic). For a coalition of filters S the removal game v(S) is the number of rows
that fail at least one of them, so all orders follow from the 2^k values of v:

* a step of an order removes v(filters up to it) - v(filters before it);
* the potential (Hart and Mas-Colell, 1989), P({}) = 0, P(S) = (v(S) + sum of P(S without i)) / |S|, gives the Shapley
  value of filter i as P(all) - P(all without i). It is kept as |S|! P(S), a whole number, and k! times the Shapley value
  is the sum of what the filter removes over all k! orders.

Only DataFrame functions are used. Rows of one text are grouped by its digest and counted inside the tasks first, so a
text that fills a third of the table is one row for each task, part and label. Texts themselves are not shuffled.

Null text is empty, a null part is the empty string, null ids are larger than all others and not smaller than each
other, a label table may repeat ids (1 wins over 0) and lack them (neither good nor toxic). Repeated rows of one id are
all counted and are no copies of each other. An empty table gives no rows. Other columns are never touched.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"


def text_failures(text: Column) -> list[Column]:
    """What the four filters on a text remove: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 100, F.lit(100).cast("long") * kinds < F.lit(80).cast("long") * n, F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.char_length(text), F.regexp_like(text, F.lit(SYMBOLS))]


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the filters they fail; the last bit is that of copies of a smaller id's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    fails = text_failures(F.col("text"))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.md5("text").alias("digest"), mask.alias("mask")).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    rows = rows.join(marks, F.col("id") == F.col("of"), "left").select("*", F.coalesce("g", F.lit(0)).alias("good"), F.coalesce("t", F.lit(0)).alias("toxic"))
    place = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("n").alias("n"))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("all"), F.min(place).alias("first"))
    # The rows of one text are few here, one for each part and label, so the join back to its smallest id is small.
    least = groups.groupBy(F.col("digest").alias("d")).agg(F.min(F.struct("first.last", "first.id")).alias("least"))
    held = F.when(F.struct("first.last", "first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    placed = groups.join(least, F.col("digest") == F.col("d")).select("part", "mask", "good", "toxic", "all", held.alias("held"))
    both = F.array(F.struct(F.col("mask"), F.col("held").alias("n")), F.struct((F.col("mask") + (1 << len(fails))).alias("mask"), (F.col("all") - F.col("held")).alias("n")))
    split = placed.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def coalition_values(counts: DataFrame, k: int) -> DataFrame:
    """(part, total, v, good, toxic, potential): arrays over the 2^k coalitions; `potential` is |S|! P(S).

    A part has at most 2^k rows in `counts`, so the lists that are folded here are that short.
    """
    everything = F.sequence(F.lit(0), F.lit((1 << k) - 1))

    def removed(measure: str) -> Column:
        return F.transform(
            everything,
            lambda s: F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(s) != 0, x[measure]).otherwise(F.lit(0))),
        )

    grouped = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("seen"), F.sum("n").alias("total"))
    values = grouped.select("part", "total", *[removed(m).alias(name) for m, name in (("n", "v"), ("good", "good"), ("toxic", "toxic"))])

    def next_potential(known: Column, s: Column) -> Column:
        smaller = F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0).cast("long"),
            lambda a, i: a + F.when(s.bitwiseAND(bit(i)) != 0, F.get(known, s.bitwiseXOR(bit(i)))).otherwise(F.lit(0)),
        )
        return F.concat(known, F.array(F.factorial(F.bit_count(s) - 1) * F.get("v", s) + smaller))

    def bit(i: Column) -> Column:
        return F.get(F.array(*[F.lit(1 << j) for j in range(k)]), i)

    potential = F.aggregate(F.sequence(F.lit(1), F.lit((1 << k) - 1)), F.array(F.lit(0).cast("long")), next_potential)
    return values.withColumn("potential", potential)


def order_steps(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step; `counts` as `failure_counts` gives it, a bit for each letter."""
    k = len(letters)
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(letters[j] for j in order), "step": step, "own": 1 << i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,own:int,before:int,after:int>>")
    full = (1 << k) - 1

    def step_of(values: str) -> Column:
        return F.get(values, F.col("after")) - F.get(values, F.col("before"))

    rows = coalition_values(counts, k).select("*", F.inline(plan))
    alone = F.lit(full).bitwiseXOR(F.col("own"))
    return rows.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("v", F.col("after"))).alias("kept"),
        step_of("v").alias("removed"),
        (F.get("v", F.col("own")) - step_of("v")).alias("redundant"),
        (F.get("v", F.lit(full)) - F.get("v", alone)).alias("unique_fails"),
        step_of("good").alias("good_lost"),
        step_of("toxic").alias("toxic_lost"),
        # k! (P(all) - P(all without i)), with (k - 1)! P kept for the smaller coalition
        (F.get("potential", F.lit(full)) - F.lit(factorial(k) // factorial(k - 1)) * F.get("potential", alone)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """All orders of the five filters over `docs`, by part."""
    return order_steps(failure_counts(docs, labels, id_col, text_col, part_col))
