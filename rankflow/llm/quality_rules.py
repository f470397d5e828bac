"""Learned decision lists over text statistics.

``text_stats`` measures every whole text with built-in functions. ``learn_rules`` learns an
ordered list of rules by sequential covering: a rule is a conjunction of thresholds
that *grows* one condition at a time by information gain on two thirds of the labelled
rows and is *pruned* from its end on the other third; the rows that it covers are taken
away and the next rule is learned. ``decision`` turns the list into one ordered Spark CASE
expression, so scoring is a projection without a shuffle.

Learning needs only counts: labelled rows are put in bins between candidate thresholds and
counted by Spark, and the covering runs over these cells. Labelled documents are measured ahead of
the others; all documents are then measured and judged in one projection, and no table of all of them is kept.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import cut, set_up, words_of

#: Bits of a window's position in its packed integer; the rest are bits of its hash.
PLACE_BITS = 24
#: Letters of conditions on statistics; all are quotients, so that long and short texts compare.
FEATURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbol_share": "n_symbols / (word_chars + 1)",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / (word_chars + 1)",
    "mark_share": "n_marks / (word_chars + 1)",
}


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every text: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks``.

    Null and empty texts have 0 everywhere. Repeated rows are measured each. Positions of
    repeated 3-word windows are found by sorting one long integer for each window (40 bits of
    its hash, 24 bits of its position); windows whose 40 bits agree are then compared word by
    word, so counts are exact. Texts of 2**24 words and more compare all windows word by word.
    Other columns, whatever their names, are ignored. Keep the result with ``cut`` before filtering on it.
    """
    long, hashed = 1 << PLACE_BITS, f"{-(1 << PLACE_BITS)}L"
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        words_of(F.col(text_col)).alias("_w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    base = base.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""CASE WHEN size(_w) < 4 THEN cast(array() AS array<bigint>)
            WHEN size(_w) >= {long} THEN transform(sequence(0, size(_w) - 3), i -> cast(i AS bigint))
            ELSE sort_array(transform(sequence(0, size(_w) - 3), i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & {hashed}) | i)) END""").alias("_packed"),
    ).drop("_lines")
    # positions whose neighbour in the order has the same 40 bits
    base = base.select("*", F.expr(f"""CASE WHEN size(_w) >= {long} THEN _packed ELSE filter(_packed, (v, j) ->
        (j > 0 AND ((v ^ _packed[greatest(j - 1, 0)]) & {hashed}) = 0L) OR (j < size(_packed) - 1 AND ((v ^ _packed[least(j + 1, size(_packed) - 1)]) & {hashed}) = 0L)) END""").alias("_near")).drop("_packed")
    place = f"if(size(_w) >= {long}, cast(v AS int), cast(v & {long - 1}L AS int))"
    base = base.select("*", F.expr(f"array_sort(transform(_near, v -> named_struct('t', concat_ws(' ', _w[{place}], _w[{place} + 1], _w[{place} + 2]), 'i', {place})))").alias("_sorted")).drop("_near", "_w")
    base = base.select("*", F.expr("""array_sort(transform(filter(_sorted, (v, j) ->
        (j > 0 AND v.t = _sorted[greatest(j - 1, 0)].t) OR (j < size(_sorted) - 1 AND v.t = _sorted[least(j + 1, size(_sorted) - 1)].t)), v -> v.i))""").alias("_starts")).drop("_sorted")
    # each repeated window adds its words that the next one does not start with
    repeats = F.expr("aggregate(transform(_starts, (p, j) -> if(j + 1 < size(_starts), least(3, _starts[least(j + 1, size(_starts) - 1)] - p), 3)), 0L, (a, x) -> a + x)")
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "n_lines", "n_upper", "n_marks")


def base_failed() -> Column:
    """The fixed rule ahead of the learned ones."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold); rows that meet it are ``bad`` or good."""

    conditions: tuple[tuple[str, bool, float], ...]
    bad: bool = True

    def column(self) -> Column:
        met = F.lit(True)
        for name, above, threshold in self.conditions:
            value = F.coalesce(F.try_divide(*[F.expr(x).cast("double") for x in FEATURES[name].split(" / ", 1)]), F.lit(0.0))
            met = met & ((value > threshold) if above else (value <= threshold))
        return met


def decision(rules: list[Rule]) -> Column:
    """True where the first rule that holds says good, or where none holds."""
    kept: Column | None = None
    for rule in rules:
        kept = F.when(rule.column(), F.lit(not rule.bad)) if kept is None else kept.when(rule.column(), F.lit(not rule.bad))
    return F.lit(True) if kept is None else kept.otherwise(F.lit(True))


def labelled_stats(docs: DataFrame, labels: DataFrame, max_labelled: int = 100_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of labelled documents with their ``_label``, kept in the shared folder.

    At most ``max_labelled`` labels count, chosen by the hash of their id, and as many rows, if documents repeat an id
    by their statistics. Rows without an id or a label are left out.
    """
    wanted = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_label")).where("_id is not null and _label is not null")
    chosen = F.md5(F.col("_id").cast("string"))
    wanted = wanted.orderBy(chosen, "_label").limit(max_labelled)
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(wanted), "_id")  # max_labelled rows at most
    # an id goes through the statistics with its label
    stats = text_stats(some.select(F.struct("_id", "_label").alias("_known"), "_text"), "_known", "_text")
    stats = stats.select(F.col("doc_id._id").alias("_id"), F.col("doc_id._label").alias("_label"), *stats.columns[1:])
    return cut(stats.orderBy(chosen, *stats.columns).limit(max_labelled))


def labelled_cells(stats: DataFrame, bins: int = 16) -> tuple[dict[str, list[float]], dict]:
    """Candidate thresholds of each feature, and the rows of :func:`labelled_stats` counted by bins.

    There are at most as many cells as rows.
    """
    values = [F.coalesce(F.try_divide(*[F.expr(x).cast("double") for x in e.split(" / ", 1)]), F.lit(0.0)).alias(f) for f, e in FEATURES.items()]
    rows = stats.where(~base_failed()).select("_id", "_label", *values)
    shares = [i / bins for i in range(1, bins)] + [0.97, 0.98, 0.99]
    found = rows.agg(*[F.percentile_approx(f, shares, 1000).alias(f) for f in FEATURES]).first()
    thresholds = {f: sorted({float(x) for x in (found[f] or [])}) for f in FEATURES}
    binned = [sum(((F.col(f) > t).cast("int") for t in thresholds[f]), F.lit(0)).alias(f) for f in FEATURES]
    held = (F.conv(F.substring(F.md5(F.concat(F.lit("prune"), F.col("_id").cast("string"))), 1, 4), 16, 10).cast("int") % 3 == 0).alias("held")
    counted = rows.select(held, (F.col("_label") == 0).alias("bad"), *binned).groupBy("held", "bad", *FEATURES).count().collect()  # max_labelled rows at most
    cells: dict = {True: Counter(), False: Counter()}
    for r in counted:
        cells[r["held"]][(tuple(r[f] for f in FEATURES), r["bad"])] += r["count"]
    return thresholds, cells


def _covers(bins: tuple[int, ...], conditions: list[tuple[int, bool, int]]) -> bool:
    """Bin b holds values above the b first thresholds and at most the next."""
    return all((bins[f] > t) if above else (bins[f] <= t) for f, above, t in conditions)


def _counts(cells: Counter) -> tuple[int, int]:
    bad = sum(n for (_, is_bad), n in cells.items() if is_bad)
    return bad, sum(cells.values()) - bad


def learn_rules(stats: DataFrame, bins: int = 16, max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.95, least_rows: int = 5) -> list[Rule]:
    """Learn rules for bad rows (label 0) from :func:`labelled_stats`, most certain first.

    A rule stays only if at least ``least_rows`` of the pruning rows meet it and
    ``least_precision`` of these are bad: clean documents that no certain rule covers are
    kept. Without labels of both kinds the list is empty and everything is kept.
    """
    thresholds, cells = labelled_cells(stats, bins)
    names = list(FEATURES)
    grow, held, rules = cells[False], cells[True], []
    while len(rules) < max_rules:
        conditions: list[tuple[int, bool, int]] = []
        inside = grow
        bad, good = _counts(inside)
        while bad and good and len(conditions) < max_conditions:
            best = None
            for f in range(len(names)):
                per_bin: Counter = Counter()
                for (b, is_bad), n in inside.items():
                    per_bin[(b[f], is_bad)] += n
                low_bad = low_good = 0
                for t in range(len(thresholds[names[f]])):
                    low_bad, low_good = low_bad + per_bin[(t, True)], low_good + per_bin[(t, False)]
                    for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                        if p >= least_rows and p + n < bad + good:
                            gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                            if best is None or gain > best[0]:
                                best = (gain, (f, above, t))
            if best is None or best[0] <= 1e-9:
                break
            conditions.append(best[1])
            inside = Counter({k: n for k, n in inside.items() if _covers(k[0], conditions)})
            bad, good = _counts(inside)
        while conditions:  # prune from the end while the held-out worth does not fall

            def worth(some: list) -> float:
                p, n = _counts(Counter({k: c for k, c in held.items() if _covers(k[0], some)}))
                return (p - n) / (p + n) if p + n else -1.0

            if len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
                conditions = conditions[:-1]
            else:
                break
        p, n = _counts(Counter({k: c for k, c in held.items() if conditions and _covers(k[0], conditions)}))
        if p + n < least_rows or p < least_precision * (p + n):
            break
        rules.append(Rule(tuple((names[f], above, thresholds[names[f]][t]) for f, above, t in conditions)))
        grow = Counter({k: c for k, c in grow.items() if not _covers(k[0], conditions)})
        held = Counter({k: c for k, c in held.items() if not _covers(k[0], conditions)})
    return rules


def apply_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 100_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document.

    ``kept`` is false where the base rule fails, else the learned list's verdict. Repeated rows and rows without an id are
    measured and judged each; without labels the list is empty. Nulls, empty tables and other columns: see :func:`text_stats`,
    :func:`labelled_stats` and :func:`learn_rules`.
    """
    set_up(docs.sparkSession)
    rules = learn_rules(labelled_stats(docs, labels, max_labelled, label_col, id_col, text_col), **options)
    return text_stats(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision(rules))
