"""Label algebra: numbers with letter suffixes, compared and continued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = r"^(\d+)\s*([a-z]*)$"


def parse(c: Column) -> Column:
    """'12 a' → (12, 'a'); null for anything else."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike(PATTERN), F.struct(F.regexp_extract(low, PATTERN, 1).cast("int").alias("number"), F.regexp_extract(low, PATTERN, 2).alias("suffix")))


def before(a: Column, b: Column) -> Column:
    """Whether label a comes before label b; null if either is no label."""
    return parse(a) < parse(b)


def successor(c: Column) -> Column:
    """The next label of its kind: 3 → 4, 3a → 3b, 3z → 3aa."""
    p = parse(c)
    last = F.right(p["suffix"], F.lit(1))
    head = F.left(p["suffix"], F.char_length(p["suffix"]) - 1)
    letter = F.when(last == "z", F.concat(F.when(head == "", "a").otherwise(head), F.lit("a"))).otherwise(F.concat(head, F.char(F.ascii(last) + 1)))
    return F.when(p["suffix"] == "", (p["number"] + 1).cast("string")).otherwise(F.concat(p["number"].cast("string"), letter))


def lemmas(words: DataFrame, forms: DataFrame, word: str = "word") -> DataFrame:
    """Words with the lemma of their form; a form of several lemmas gives the first by name, an unknown one itself."""
    one = forms.groupBy(F.lower("form").alias("form")).agg(F.min("lemma").alias("lemma"))
    return words.join(one, F.lower(F.col(word)) == F.col("form"), "left").withColumn("lemma", F.coalesce("lemma", F.lower(F.col(word)))).drop("form")
