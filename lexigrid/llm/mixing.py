"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import WORD_CHARS, bounded_word_count, packed, saved

SEED = "mix-1"
#: The production target: shares of the sources' tokens. Sources that aren't named have DEFAULT_WEIGHT.
TARGET_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
DEFAULT_WEIGHT = 1.0
#: Of all tokens; a budget in tokens can be given instead.
BUDGET_FRACTION = 0.5
#: Rows that one window of running sums holds at most, as a mean; also what the last cut is searched among.
WINDOW_ROWS = 4096
#: Sources whose last chosen place is broadcast at most; above, all texts are shuffled.
BROADCAST_SOURCES = 1_000_000
NO_SOURCE = "\u0000"


def _shuffled(seed: str) -> Column:
    """A row's place in its source's queue: of all its columns that matter here, so that rows of one id or none are spread."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(seed + "|"), at("doc_id"), F.lit("|"), at("source"), F.lit("|"), F.md5(at("text"))))


def _queue(docs: DataFrame, tokens: Column, weights: dict[str, float] | None, default_weight: float, seed: str) -> DataFrame:
    """Every document's key, tokens and virtual finish time `vft`; its own shuffle order per source is that of _shuffled."""
    if min([default_weight, *(weights or {}).values()]) <= 0:
        raise ValueError("weights must be above 0")
    narrow = docs.select(F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("src"), F.col("doc_id").alias("id"), tokens.alias("n"), _shuffled(seed).alias("h"))
    narrow = saved(narrow, "mix-keys")
    rows = narrow.count()
    digits = min(6, max(1, math.ceil(math.log(max(1, rows / WINDOW_ROWS), 16))))
    # Rows alike are counted, so that however many they are they are one in a window.
    narrow = narrow.groupBy("src", "h", "id", "n").agg(F.count("*").alias("rows")).withColumn("part", F.substring("h", 1, digits))
    # Running sums in two steps, so that no window holds a whole source: sums of ranges of the order, then within each.
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_ = F.col("n") * F.col("rows")
    sums = narrow.groupBy("src", "part").agg(F.sum(all_).alias("n"))
    sums = sums.select("src", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "part").orderBy("h", "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.coalesce(*[F.when(F.col("src") == s, F.lit(float(w))) for s, w in sorted((weights or {}).items())], F.lit(float(default_weight)))
    placed = narrow.withColumn("cum", F.sum(all_).over(within) - all_).join(sums, ["src", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return placed.select("src", "id", "n", "h", ((F.col("cum") + F.col("base") + F.col("n") * F.col("copy")) / weight).alias("vft"))


#: A queue's order; `place` is the beginning of h as a number.
_ORDER = ["vft", "h", "src", "id", "n"]
_PLACE = "CAST(conv(substring(h, 1, 12), 16, 10) AS BIGINT)"


def _cut(queue: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of the queue, by _ORDER, whose tokens don't exceed the budget.

    Histograms narrow down where the cut lies, first by vft and then, among rows of one vft, by h, until few rows are left."""
    queue = queue.withColumn("place", F.expr(_PLACE))
    total, rows = queue.agg(F.sum("n"), F.count("*")).first()
    if not rows or total <= budget:
        return queue.drop("place")
    taken = 0  # tokens before the range in which the cut lies
    edge, before = queue, []
    for by in ("vft", "place"):
        low, high = edge.agg(F.min(by), F.max(by)).first()
        while rows > WINDOW_ROWS * 16 and high > low:
            bars = 1024
            bar = F.least(F.floor((F.col(by) - low) / ((high - low) / bars)), F.lit(bars - 1))
            hist = edge.where((F.col(by) >= low) & (F.col(by) <= high)).groupBy(bar.alias("bar")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min(by).alias("low"), F.max(by).alias("high"))
            for r in sorted(hist.collect(), key=lambda r: r["bar"]):  # at most `bars` rows
                if taken + r["n"] > budget:
                    break
                taken += r["n"]
            if (r["low"], r["high"]) == (low, high):
                break
            low, high, rows = r["low"], r["high"], r["rows"]
        before.append(edge.where(F.col(by) < low))
        edge = edge.where((F.col(by) >= low) & (F.col(by) <= high))
    run = Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = edge.withColumn("run", F.sum("n").over(run)).where(F.col("run") + taken <= budget).drop("run")
    return before[0].unionByName(before[1]).unionByName(last).drop("place")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    default_weight: float = DEFAULT_WEIGHT,
    budget_tokens: int | None = None,
    budget_fraction: float = BUDGET_FRACTION,
    seed: str = SEED,
    tokens: Column | None = None,
) -> DataFrame:
    """(doc_id, source, n_tokens, virtual_finish) of the chosen documents, range-sorted by virtual finish time.

    Each source's documents queue in an order shuffled by md5(seed|doc_id|source|md5(text)). A document's virtual finish time
    is the tokens of its source up to and with it, divided by the source's weight. All documents are sorted by it, and the
    sequence ends before the first one that would exceed the budget: budget_tokens, or budget_fraction of all tokens. So any
    prefix, and the result, holds the sources' tokens in proportion to the weights until a source runs dry. tokens counts a
    text's tokens: the pipeline gives the ids of op3's tokenizer; without it, as in op9 and its SQL, a token is a word of at
    most WORD_CHARS characters, longer runs of non-blank characters being cut.

    Nulls: a null source is a source of its own; a null text has 0 tokens; null doc_ids are queued like any other. Empty texts
    finish when their predecessor does and cost nothing. Ties in time go by the shuffle. Repeated rows are queued each for
    itself, one after the other. A text of any length counts whole. An empty table gives an empty result. Other columns
    aren't read.
    """
    queue = saved(_queue(docs, bounded_word_count(F.col("text")) if tokens is None else tokens, weights, default_weight, seed), "mix-queue")
    budget = budget_tokens if budget_tokens is not None else math.floor((queue.agg(F.sum("n")).first()[0] or 0) * budget_fraction)
    cut = _cut(queue, budget)
    return cut.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(
        F.col("id").alias("doc_id"), F.nullif(F.col("src"), F.lit(NO_SOURCE)).alias("source"), F.col("n").alias("n_tokens"), F.col("vft").alias("virtual_finish")
    )


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT, budget_tokens: int | None = None, budget_fraction: float = BUDGET_FRACTION, seed: str = SEED, tokens: Column | None = None) -> DataFrame:
    """The rows of docs that mix_sources chooses, all columns, in its order; of repeated rows as many as it chose.

    Nulls, empty and long texts, ties, repeated rows and empty tables are as in mix_sources; columns of any name pass through.
    """
    queue = saved(_queue(docs, bounded_word_count(F.col("text")) if tokens is None else tokens, weights, default_weight, seed), "mix-queue")
    budget = budget_tokens if budget_tokens is not None else math.floor((queue.agg(F.sum("n")).first()[0] or 0) * budget_fraction)
    key = ["h", "src"]
    chosen = saved(_cut(queue, budget).groupBy(*key).agg(F.min("vft").alias("vft"), F.count("*").alias("taken")), "mix-chosen")
    wide = packed(docs, h=_shuffled(seed), src=F.coalesce(F.col("source"), F.lit(NO_SOURCE)))
    # What is chosen of a source are the first of its queue, so texts behind the last of them needn't be shuffled.
    last = chosen.groupBy("src").agg(F.max("h").alias("last"))
    if last.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        wide = wide.join(F.broadcast(last), "src").where(F.col("h") <= F.col("last")).drop("last")
    both = wide.join(chosen, key)
    # Rows alike that were taken in part stand at the cut, at most one kind a source; the others need no numbering.
    alike = saved(queue.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").join(chosen.select(*key, "taken"), key).where("taken < rows").select(*key), "mix-edge")
    if not alike.isEmpty():
        # Numbered in two steps, as such a kind may hold a third of all rows.
        edge = saved(both.join(alike, key, "left_semi").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024))), "mix-alike")
        counts = edge.groupBy(*key, "salt").agg(F.count("*").alias("rows"))
        base = counts.select(*key, "salt", F.coalesce(F.sum("rows").over(Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        nth = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("taken"))
        edge = edge.withColumn("nth", nth).join(base, [*key, "salt"]).where(F.col("nth") + F.col("base") <= F.col("taken"))
        both = both.join(alike, key, "left_anti").select("row_", "vft", "h").unionByName(edge.select("row_", "vft", "h"))
    return both.repartitionByRange("vft", "h").sortWithinPartitions("vft", "h").select("row_.*")


def oracle_sql(budget_fraction: float = BUDGET_FRACTION, seed: str = SEED, weights: dict[str, float] | None = None, default_weight: float = DEFAULT_WEIGHT) -> str:
    """mix_sources in DuckDB's SQL, over the table documents."""
    weight = "CASE source " + " ".join(f"WHEN '{s}' THEN {float(w)}" for s, w in sorted((weights or {"": default_weight}).items())) + f" ELSE {float(default_weight)} END"
    return f"""
WITH k AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]{{1,{WORD_CHARS}}}')), 0) AS BIGINT) AS n,
                  md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id, n ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST({weight} AS DOUBLE) AS vft FROM k),
r AS (SELECT *, sum(n) OVER (ORDER BY vft, h, source NULLS FIRST, doc_id, n ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT doc_id, source, n AS n_tokens, vft AS virtual_finish FROM r WHERE run <= (SELECT floor(sum(n) * {budget_fraction}) FROM k)"""
