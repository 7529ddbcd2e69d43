"""Scalar text functions and extraction on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import extraction as X
from palimpsest.functions import text as S
from palimpsest.operators import windows as W
from palimpsest.plans.catalog import query
from palimpsest.session import load_table as t


@query(r"SELECT item_id, len(regexp_extract_all(text, '\s+|[0-9]+|[^\s0-9]+')) AS n_tokens, length(text) AS last_end FROM benchmark")
def token_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossless token streams: their number and where the last one ends."""
    tape = S.token_tape(F.col("text"))
    return t(spark, sf_dir, "benchmark").select("item_id", F.size(tape).cast("long").alias("n_tokens"), F.element_at(tape, -1)["end"].cast("long").alias("last_end"))


@query("""
SELECT p_partkey, ['', 'M', 'MM', 'MMM'][(floor(p_retailprice)::INT // 1000) % 10 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(floor(p_retailprice)::INT // 100) % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(floor(p_retailprice)::INT // 10) % 10 + 1]
  || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][floor(p_retailprice)::INT % 10 + 1] AS roman, floor(p_retailprice)::INT AS back FROM part WHERE p_retailprice BETWEEN 1 AND 3999""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers to Roman numerals and back."""
    p = t(spark, sf_dir, "part").filter("p_retailprice between 1 and 3999").withColumn("n", F.floor("p_retailprice").cast("int"))
    return p.withColumn("roman", S.arabic_to_roman(F.col("n"))).select("p_partkey", "roman", W.roman_value(F.col("roman")).alias("back"))


@query("""
SELECT o_orderkey, u.nth::BIGINT AS nth, CASE u.nth WHEN 0 THEN 'REPEAL' WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'INSERT' ELSE 'REPLACE' END END AS action, CASE u.nth WHEN 0 THEN 'section:' || (o_orderkey % 90 + 1) WHEN 1 THEN 'section:' || (o_orderkey % 7 + 1) || 'a' END AS target
FROM orders, unnest([0, 1, 2]) AS u(nth)""")
def amendment_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendment clauses, split into ops by their verbs; a clause without one stays, with neither action nor target."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("Section "), s(k % 90 + 1), F.lit(" is repealed; in section "), s(k % 7 + 1), F.when(k % 2 == 0, "a a sentence is added").otherwise("a a word is REPLACED"), F.lit("; nothing else"))
    return X.amendment_ops(t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query("""
SELECT o_orderkey, 'authority' AS actor, CASE WHEN o_orderkey % 3 = 0 THEN 'shall' ELSE 'may' END AS modal, 1::BIGINT AS n FROM orders WHERE o_orderkey % 5 <> 0""")
def actor_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actors and what they shall, must or may, within a sentence."""
    k = F.col("o_orderkey")
    text = F.concat(F.when(k % 5 == 0, "Someone").otherwise("The Authority"), F.lit(" in charge "), F.when(k % 3 == 0, "shall").otherwise("may"), F.lit(" decide. That is all."))
    return X.actor_duties(t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", ("authority", "board"))


@query("""SELECT o_orderkey, 'term ' || (o_orderkey % 9) AS term FROM orders""")
def term_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that texts define."""
    text = F.concat(F.lit('In this act "term '), (F.col("o_orderkey") % 9).cast("string"), F.lit('" means a thing.'))
    return X.definitions(t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages), b AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM a)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM b""")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of pages."""
    return t(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("plain"))
