"""Quality rules as a learned decision list, in DataFrame functions only.

Sequential covering: one threshold condition at a time is added to a conjunction while it gains on the
growing part of the labelled rows, the conjunction is pruned on the other part, the rows it covers are
set aside, and the next rule is learned from the rest. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.lineage import staged
from tenura.llm.common import table

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
FEATURES = (
    "n_words",
    "mean_word_chars",
    "symbols_per_word",
    "marks_per_word",
    "capital_share",
    "digit_share",
    "dup_line_share",
    "repeat_share",
)
#: Cut points a feature; each rule has at most CONDITIONS of them, and a list at most RULES rules.
CUTS, CONDITIONS, RULES = 63, 4, 12
#: A rule must reach this precision, over this many rows it rejects rightly, on rows it was not grown on.
PRECISION, SUPPORT = 0.9, 5

Condition = tuple[str, str, float]


def with_statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, the counts of the base rules and the features of the learned ones, for whole texts.

    A missing or empty text has no words and every count 0. Repeated 5-word windows are found inside the
    row: windows are hashed to 64 bits and sorted, and only texts with an equal pair of neighbours
    go on to mark the words that repeated windows cover. All in O(n log n) of one text's words.
    With `carry`, the whole input row comes along as the struct `row`.
    """
    own = ["row"] if carry else []
    text = F.coalesce("text", F.lit(""))
    size = F.size("words")
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
        F.array_remove(F.split(text, f"{SPACE}+"), "").alias("words"),
        F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?|]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = split.select(
        "*",
        size.cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
    )
    windows = hashed.select(
        "*",
        F.when(
            size >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), size - WINDOW),
                lambda i: F.xxhash64(*[F.get("codes", i + k) for k in range(WINDOW)]),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    ordered = windows.select("*", F.sort_array("windows").alias("ordered"))
    found = ordered.select(
        "*", F.exists(F.transform("ordered", lambda x, i: x == F.get("ordered", i - 1)), lambda x: x).alias("repeats")
    )
    placed = found.select(
        "*",
        F.when(
            F.col("repeats"),
            F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("placed"),
    )
    starts = placed.select(
        "*",
        F.sort_array(
            F.transform(
                F.filter(
                    "placed",
                    lambda e, k: (e["h"] == F.get("placed", k - 1)["h"]) | (e["h"] == F.get("placed", k + 1)["h"]),
                ),
                lambda e: e["i"],
            )
        ).alias("starts"),
    )
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate(
        "starts",
        none,
        lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["total"] + p + WINDOW - F.greatest(p, a["end"])).alias("total")
        ),
        lambda a: a["total"],
    )
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    counted = starts.select(
        *own,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        "n_marks",
        "n_capitals",
        "n_digits",
    )
    return counted.select(
        *own,
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_marks") / words).alias("marks_per_word"),
        (F.col("n_capitals") / chars).alias("capital_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def holds(condition: Condition) -> Column:
    feature, sign, bound = condition
    return F.col(feature) > F.lit(bound) if sign == ">" else F.col(feature) <= F.lit(bound)


def all_hold(rule: list[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [holds(c) for c in rule], F.lit(True))


def kept_by(rules: list[list[Condition]]) -> Column:
    """The list as one ordered expression: the first rule that holds rejects, else the row is kept."""
    chain = F.when(F.lit(False), False)
    for rule in rules:
        chain = chain.when(all_hold(rule), False)
    return chain.otherwise(True)


def describe(rules: list[list[Condition]]) -> list[str]:
    return ["reject if " + " and ".join(f"{f} {s} {b:.6g}" for f, s, b in rule) for rule in rules] + ["else keep"]


def cut_points(labelled: DataFrame) -> dict[str, list[float]]:
    """Approximate quantiles of each feature: at most CUTS numbers a feature reach the driver."""
    share = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    found = labelled.agg(*[F.percentile_approx(F.col(f).cast("double"), share, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(found[f] or [])) for f in FEATURES}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[float, Condition | None, int, int]:
    """The condition of most information gain among all features and cuts, from one histogram job: at
    most len(FEATURES) * (CUTS + 1) counts reach the driver."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("bin")) for f in FEATURES])
    ).alias("cell")
    histogram = (
        rows.select("bad", cells)
        .groupBy("cell.f", "cell.bin")
        .agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    counts: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
    for r in histogram:
        counts[r["f"]][r["bin"]] = (r["p"], r["n"] - r["p"])
    first = counts[FEATURES[0]].values()
    p0, n0 = sum(p for p, _ in first), sum(n for _, n in first)
    best: tuple[float, Condition | None, int, int] = (0.0, None, p0, n0)
    if not p0 or not n0:
        return best
    for f in FEATURES:
        p = n = 0
        for k, cut in enumerate(cuts[f]):  # bin k holds the rows above cut k-1, up to cut k
            p, n = p + counts[f].get(k, (0, 0))[0], n + counts[f].get(k, (0, 0))[1]
            for sign, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                if (gain := _gain(a, b, p0, n0)) > best[0] + 1e-9:
                    best = (gain, (f, sign, float(cut)), a, b)
    return best


def learn(statistics: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """The decision list for rejecting rows labelled quality 0, from all labelled rows.

    Rows are split by a hash of doc_id, two thirds to grow rules and one third to prune and accept them.
    Contradicting labels of one doc_id count as the lower; missing ones are left out. With no label of
    either class the list is empty and keeps everything.
    """
    quality = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = statistics.join(quality.filter("quality in (0, 1)"), "doc_id").filter(~base_failed())
    cuts = cut_points(labelled)

    def bin_of(feature: str) -> Column:
        bounds = F.array(*[F.lit(float(c)) for c in cuts[feature]]).cast("array<double>")
        return F.size(F.filter(bounds, lambda c: c < F.col(feature))).cast("smallint")

    rows = staged(
        labelled.select(
            (1 - F.col("quality")).alias("bad"),
            (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"),
            *FEATURES,
            *[bin_of(f).alias(f"bin_{f}") for f in FEATURES],
        )
    )
    rules: list[list[Condition]] = []
    while len(rules) < RULES:
        left = rows.filter(kept_by(rules))
        grown: list[Condition] = []
        while len(grown) < CONDITIONS:
            gain, condition, _, wrong = _best_condition(left.filter(~F.col("prune") & all_hold(grown)), cuts)
            if condition is None or gain <= 0:
                break
            grown.append(condition)
            if not wrong:
                break
        if not grown:
            break
        # pruning: the shortest beginning of the conjunction that is best on the rows kept apart
        heads = [grown[: k + 1] for k in range(len(grown))]
        sums = []
        for k, head in enumerate(heads):
            sums.append(F.sum(F.when(all_hold(head), F.col("bad")).otherwise(0)).alias(f"p{k}"))
            sums.append(F.sum(F.when(all_hold(head), 1 - F.col("bad")).otherwise(0)).alias(f"n{k}"))
        seen = left.filter("prune").agg(*sums).first()
        scored = [((p - n) / (p + n) if p + n else -1.0, -k, p, n) for k in range(len(heads))
                  for p, n in [(seen[f"p{k}"] or 0, seen[f"n{k}"] or 0)]]
        _, k, p, n = max(scored)
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(heads[-k])
    return rules


def judged(statistics: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Adds base_failed and kept."""
    return statistics.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & kept_by(rules)
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, features, base_failed and kept of every document, by a list learned from `labels`.
    Repeated rows stay repeated; a row without doc_id is judged, but never learned from."""
    statistics = staged(with_statistics(docs))
    return judged(statistics, learn(statistics, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that base rules and learned list keep, with all columns. Rows are written once with
    their statistics, learned from by their narrow columns and filtered as they are read again: no
    shuffle, and no statistic is computed twice (a filter above the computation would be pushed into it)."""
    statistics = staged(with_statistics(docs, carry=True))
    return judged(statistics, learn(statistics, labels)).filter("kept").select("row.*")


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
