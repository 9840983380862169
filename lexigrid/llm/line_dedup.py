"""Cross-site boilerplate lines: HyperLogLog sketches of the sites per line, exact counts near the threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import packed, saved

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: Relative half-width of the estimates that are counted exactly; a sketch of 2**LG_K registers errs by about 1.6 %.
BAND = 0.25
LG_K = 12


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """Hashes `h` of the lines that stand on at least min_sites distinct sites (column source)."""
    lines = (
        docs.select(F.col("source").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
        .where(F.col("site").isNotNull())
        .select("site", _trimmed(F.col("line")).alias("line"))
        .where("line != ''")
        .select("site", F.xxhash64("line").alias("h"))
    )
    low, high = math.floor(min_sites * (1 - band)), math.ceil(min_sites * (1 + band))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("about"))
    spread = saved(spread.where(F.col("about") >= low), "line-spread")
    near = spread.where(F.col("about") <= high).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("sites"))
    return saved(
        spread.where(F.col("about") > high).select("h").unionByName(exact.where(F.col("sites") >= min_sites).select("h")),
        "boilerplate",
    )


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """docs without the lines that recur on min_sites or more sites; all rows and columns stay.

    A line counts by its text without blanks at its ends; blank lines are never boilerplate. The one exemption: a document
    that would lose all that isn't blank stays whole, as it is a copy of others, of which near-duplicate removal then keeps
    one; else no copy would. n_chars, if there, is set to the new length.

    Nulls: a null source is no site and adds to no count; its documents are still cleaned. A null text stays null, an
    empty one empty. Ties don't occur. Repeated rows count once per site and are all kept, cleaned alike. An empty table
    gives an empty table. Columns of any name pass through. Length of text isn't bounded.
    """
    bad = boilerplate(docs, min_sites, band, lg_k)
    # A text's lines to drop as bits, 64 a number, so that looking one up takes no time however many they are.
    found = (
        docs.select(F.xxhash64("text").alias("t"), F.length("text").alias("n"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .select("t", "n", "at", F.xxhash64(_trimmed(F.col("line"))).alias("h"))
        .join(bad, "h")
        .groupBy("t", "n", F.shiftright("at", 6).alias("block"))
        .agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits"))
        .groupBy("t", "n")
        .agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("bits"))
        .select("t", "n", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("bits"))), lambda b: F.coalesce(F.element_at("bits", b), F.lit(0).cast("bigint"))).alias("drop"))
    )
    rows = packed(docs, t=F.xxhash64("text"), n=F.length("text")).join(found, ["t", "n"], "left")
    gone = lambda i: F.coalesce(F.getbit(F.get("drop", F.shiftright(i, 6)), i.bitwiseAND(F.lit(63))), F.lit(0)) == 1
    kept = F.filter(F.split("row_.text", "\n"), lambda x, i: ~gone(i))
    blank = ~F.exists(kept, lambda x: _trimmed(x) != "")
    text = F.when(F.col("drop").isNull() | blank, F.col("row_.text")).otherwise(F.array_join(kept, "\n"))
    out = rows.select("row_", text.alias("text_"))
    fields = [F.col(f"row_.`{c}`").alias(c) for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c == "text":
            fields[i] = F.col("text_").alias(c)
        elif c == "n_chars":
            fields[i] = F.length("text_").cast(docs.schema[c].dataType).alias(c)
    return out.select(*fields)


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    """The same in DuckDB's SQL, over the table documents."""
    return f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS rowid_, * FROM documents),
lines AS (
  SELECT rowid_, source, pos, line, trim(line, chr(32) || chr(9) || chr(13)) AS t
  FROM (SELECT rowid_, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT rowid_, source, string_split(text, chr(10)) AS ls FROM numbered))),
bad AS (SELECT t FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= {min_sites}),
marked AS (SELECT l.*, b.t IS NOT NULL AS drop_ FROM lines l LEFT JOIN bad b ON l.t = b.t),
docs AS (
  SELECT rowid_, sum(CASE WHEN drop_ THEN 1 ELSE 0 END) AS n, sum(CASE WHEN drop_ THEN 0 ELSE length(t) END) AS rest,
         string_agg(CASE WHEN drop_ THEN NULL ELSE line END, chr(10) ORDER BY pos) AS cleaned
  FROM marked GROUP BY rowid_),
result AS (
  SELECT d.doc_id, CASE WHEN c.n IS NULL OR c.n = 0 OR c.rest = 0 THEN d.text ELSE c.cleaned END AS text, d.lang, d.source
  FROM numbered d LEFT JOIN docs c ON d.rowid_ = c.rowid_)
SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS n_chars FROM result"""


__all__ = ["boilerplate", "remove_boilerplate", "oracle_sql"]
