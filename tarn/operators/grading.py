"""Grading and agreement of logged answers as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T

# Kinds of questions with rules of their own.
TWO_SOURCES, ABSENT, NUMERIC = 4, 5, (1, 3)
# Fixed value: the instruction of a prompt with a context.
INSTRUCTION = "Answer the question using only the context below. If the context does not contain the answer, say so."
# Where a context comes from.
NO_CONTEXT, ONE_PASSAGE, TWO_PASSAGES, BEST_CHUNK, BEST_CHUNKS = "none", "gold_passage", "gold_passage_pair", "retrieved_chunk", "retrieved_top_k"
# Fields of an item that a grader may see.
ITEM_FIELDS = ("id", "question", "gold_answer", "model_answer", "context")
# What would tell a grader which system answered.
REVEALING = (r"\bqwen\S*", r"\bgpu\b", r"\bnpu\b", r"\bclosed[_\- ]book\b", r"\boracle[_\- ]rag\b", r"\bmodel_path\b", r"\brun_id\b", r"\boracle_context_source\b", r"\bqwen3-\d")
RUBRICS = {
    TWO_SOURCES: "The sources disagree. 2: names the conflict and both positions. 1: both figures, or doubt, without the conflict. 0: one figure with confidence.",
    ABSENT: "The answer is in no source. 2: says so. 1: hedges. 0: answers with confidence.",
    None: "2: right and complete. 1: partly right. 0: wrong, or no answer.",
}
CONTEXT_RULE = "Items with a context also get groundedness (2 fully, 1 partly, 0 not supported) and the ids of the passages they cite."
OUTPUT_RULE = "Return a JSON array with id, accuracy, groundedness, cited and reason of each item."


def oracle_context(kind: Column, gold: Column, second: Column, top: Column, top_id: Column | None = None) -> Column:
    """(source, passages, chunk_ids) that a question is given: the best chunk if its answer is absent, both passages if it has two, else its passage.

    ``chunk_ids`` names the chunks that were retrieved for it: the best one, or none.
    """
    none = F.array().cast("array<string>")
    given = lambda source, ids, *texts: F.struct(F.lit(source).alias("source"), F.array(*texts).alias("passages"), ids.alias("chunk_ids"))
    return (
        F.when(kind == ABSENT, given(BEST_CHUNK, none if top_id is None else F.array(top_id), top))
        .when(kind == TWO_SOURCES, given(TWO_PASSAGES, none, gold, second))
        .otherwise(given(ONE_PASSAGE, none, gold)))


def context_source(cond: Column, kind: Column) -> Column:
    """Where the context of a row comes from: none in the closed book, the best chunks with retrieval, what the oracle rule says else."""
    oracle = F.when(kind == ABSENT, BEST_CHUNK).when(kind == TWO_SOURCES, TWO_PASSAGES).otherwise(ONE_PASSAGE)
    return F.when(cond == "closed_book", NO_CONTEXT).when(cond == "rag", BEST_CHUNKS).otherwise(oracle)


def pays_retrieval(source: Column) -> Column:
    """Whether a row is charged for retrieval: by where its context comes from, whatever its condition."""
    return source.isin(BEST_CHUNK, BEST_CHUNKS)


def user_content(question: Column, passages: Column) -> Column:
    """The user message. Null passages are the closed book: no context block at all, not an empty one."""
    numbered = F.transform(passages, lambda p, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), F.btrim(p, F.lit(" \t\r\n"))))
    asked = F.concat(F.lit("Question: "), question)
    given = F.concat(F.lit(INSTRUCTION + "\n\nContext:\n"), F.array_join(numbered, "\n\n"), F.lit("\n\n"), asked)
    return F.when(passages.isNull(), asked).otherwise(given)


def grading_prompt(kind: Column, items: Column) -> Column:
    """Rubric by kind, context rule if an item has a context, output rule, items as JSON of the fields allowed."""
    rubric = F.lit(RUBRICS[None])
    for special in (TWO_SOURCES, ABSENT):
        rubric = F.when(kind == special, RUBRICS[special]).otherwise(rubric)
    seen = F.transform(items, lambda i: F.struct(*[i[f].alias(f) for f in ITEM_FIELDS]))
    rule = F.when(F.exists(items, lambda i: i["context"].isNotNull()), CONTEXT_RULE)
    return F.concat_ws("\n", rubric, rule, F.lit(OUTPUT_RULE), F.lit("ITEMS:"), F.to_json(seen))


def reveals(prompt: Column) -> Column:
    """Whether a prompt tells which system answered."""
    return F.greatest(*[F.lower(prompt).rlike(p) for p in REVEALING])


def agreement(rows: DataFrame, case: list[str], device: str, kind: str, output: str) -> DataFrame:
    """``case``, kind, all_empty, exact, normalised, containment, substantive and lengths of each case answered by two devices or more.

    If all outputs are empty the case is set apart, with null measures; if some are, the devices disagree. Absent answers
    agree if both refuse or neither does, numeric ones by their sets of numbers, others by containment.
    """
    out = F.coalesce(F.col(output), F.lit(""))
    o = F.struct(F.length(out).alias("size"), F.col(device).alias("device"), out.alias("raw"), T.normalise_answer(out).alias("norm"))
    cases = rows.groupBy(*case).agg(F.array_sort(F.collect_list(o)).alias("o"), F.min(kind).alias("kind")).where(F.size("o") > 1)
    distinct = lambda f: F.size(F.array_distinct(F.transform("o", f)))
    empty = F.size(F.filter("o", lambda x: x["norm"] == ""))
    some = empty > 0
    shortest = F.col("o")[0]["norm"]
    same = distinct(lambda x: x["norm"]) == 1
    contained = ~some & (same | F.forall("o", lambda x: F.contains(x["norm"], shortest)))
    substantive = ~some & F.when(F.col("kind") == ABSENT, distinct(lambda x: x["raw"].rlike(T.REFUSAL)) == 1).when(
        F.col("kind").isin(*NUMERIC), distinct(lambda x: F.array_join(T.number_set(x["raw"]), " ")) == 1).otherwise(contained)
    apart = empty == F.size("o")
    measures = {"exact": distinct(lambda x: x["raw"]) == 1, "normalised": same, "containment": contained, "substantive": substantive}
    lengths = F.map_from_entries(F.transform("o", lambda x: F.struct(x["device"], x["size"])))
    return cases.select(*case, "kind", apart.alias("all_empty"), *[F.when(~apart, m).alias(n) for n, m in measures.items()], lengths.alias("lengths"))


def graded(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows (row_id, answer, context_ids, gold_ids) with their grades from ``replies`` (row_id, accuracy, groundedness, cited).

    Empty answers, white space alone too, score 0 and are not judged, whatever their kind. A citation is right if one of the cited ids is gold; it is null
    without a context or citations.
    """
    return replied(rows.join(replies, "row_id", "left")).drop("cited")


def replied(rows: DataFrame) -> DataFrame:
    """The rows of ``graded`` where each row comes with its reply (accuracy, groundedness, cited), null without one: nothing is joined."""
    empty = F.regexp_replace(F.coalesce(F.col("answer"), F.lit("")), T.SPACE, "") == ""
    cited = F.when(~empty, F.col("cited"))
    right = F.when((F.size(F.coalesce("context_ids", F.array().cast("array<string>"))) > 0) & (F.size(cited) > 0), F.arrays_overlap(cited, F.coalesce("gold_ids", F.array().cast("array<string>"))))
    return rows.select(
        *[c for c in rows.columns if c not in ("answer", "accuracy", "groundedness")], F.when(empty, 0).otherwise(F.col("accuracy")).alias("accuracy"), F.when(~empty, F.col("groundedness")).alias("groundedness"),
        right.alias("citation_correct"), empty.alias("empty_output"), (~empty).alias("judged"))


# Resamples of an interval and the shares at its ends.
DRAWS, LOW, HIGH = 2000, 0.025, 0.975


def kappa_interval(rows: DataFrame, by: list[str], a: str, b: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """``by``, n, kappa, low and high: Cohen's kappa of the grades ``a`` and ``b`` of each group and its bootstrap interval.

    Resampling n rows of a group is one multinomial draw over the counts of its pairs of grades, which numpy draws as
    conditional binomials; so a resample costs as much as there are pairs of grades, whatever the number of rows. The
    ends are the values of rank floor(LOW * draws) and floor(HIGH * draws), from 0. Rows without both grades do not count.
    """
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).cast("long").alias("_a"), F.col(b).cast("long").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    cells = pairs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_a", "_b", "_n"))).alias("cells"))
    # -1 is the sample itself; a group's resamples are seeded by what it counts.
    each = cells.withColumn("seed", F.pmod(F.xxhash64("cells", F.lit(seed)), F.lit(1 << 62))).withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))

    def resampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for pairs, start, draw in zip(batch["cells"], batch["seed"], batch["draw"], strict=True):
                x, y, n = (np.array([p[c] for p in pairs]) for c in ("_a", "_b", "_n"))
                count = n if draw < 0 else np.random.default_rng([start, draw]).multinomial(n.sum(), n / n.sum())
                same = count[x == y].sum() / n.sum()
                chance = sum(count[x == g].sum() * count[y == g].sum() for g in {*x, *y}) / n.sum() ** 2
                found.append(1.0 if chance == 1 else (same - chance) / (1 - chance))
            yield batch.drop(columns=["cells", "seed"]).assign(kappa=found, n=[sum(p["_n"] for p in pairs) for pairs in batch["cells"]])

    kind = ", ".join(f"`{c}` {each.schema[c].dataType.simpleString()}" for c in by)
    values = each.mapInPandas(resampled, f"{kind}{', ' if by else ''}draw int, kappa double, n bigint")
    ranked = F.array_sort(F.collect_list(F.when(F.col("draw") >= 0, F.col("kappa"))))  # one number for each resample
    out = values.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("draw") < 0, F.col("kappa"))).alias("kappa"), ranked.alias("r"))
    at = lambda share: F.element_at("r", int(share * draws) + 1)
    return out.select(*by, "n", "kappa", at(LOW).alias("low"), at(HIGH).alias("high"))
