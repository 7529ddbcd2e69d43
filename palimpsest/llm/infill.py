"""Fill-in-the-middle: part of the documents is rearranged so that a model learns to write a passage between two others.

A text is cut into units (white space with the word after it, or white space at the end). Hashes of a seed and the id
choose two cuts and the form: plain (the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), each part
behind its sentinel. A text that holds a sentinel stays plain, so the arrangement can always be undone: splitting at the
sentinels gives the three parts, as no part holds one and no sentinel overlaps with itself or another.

Everything is one projection over the scan: no shuffle, no Python. A row needs memory in proportion to its own text only.

Null and empty texts are plain and empty, with no units. A null id counts as the empty string in the hash. Rows of equal id
and text come out alike; ties of the two cuts leave the middle empty. Very long texts are whole. An empty table gives an
empty result. Other columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import own_columns

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class InfillRule:
    """How many of a hundred documents are rearranged, how many of those suffix first, and the sentinels."""

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    @property
    def any_sentinel(self) -> str:
        """A pattern of any of the three."""
        return "|".join("".join(c if c.isalnum() or c in "<>" else f"\\{c}" for c in s) for s in self.sentinels)


def fill_in_middle(docs: DataFrame, rule: InfillRule = InfillRule()) -> DataFrame:  # noqa: B008
    """(doc_id, text, n, form, prefix, middle, suffix, output): the parts are null where the form is plain."""
    digest = F.sha2(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    own = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    units = own.select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"), *(number(k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    n = F.size("units")
    one, two = (F.col(h) % (n + 1) for h in ("h1", "h2"))
    plain = (F.col("text") == "") | F.col("text").rlike(rule.any_sentinel) | (F.col("h3") % 100 >= rule.rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < rule.spm_rate, "spm").otherwise("psm")
    cut = units.select("doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(one, two).cast("int").alias("first"), F.greatest(one, two).cast("int").alias("last"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    parts = cut.select(
        "doc_id", "text", F.col("n").cast("long").alias("n"), "form",
        part(F.lit(1), F.col("first")).alias("prefix"),
        part(F.col("first") + 1, F.col("last") - F.col("first")).alias("middle"),
        part(F.col("last") + 1, F.col("n") - F.col("last")).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in rule.sentinels)
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm = F.concat(s, "suffix", p, "prefix", m, "middle")
    return parts.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))


def restored(output: Column, form: Column, rule: InfillRule = InfillRule()) -> Column:  # noqa: B008
    """The text that ``output`` was made of, from it and its form alone."""
    parts = F.split(output, rule.any_sentinel, -1)
    prefix, suffix = (F.when(form == "psm", F.get(parts, F.lit(a))).otherwise(F.get(parts, F.lit(b))) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


def infill_report(docs: DataFrame, rule: InfillRule = InfillRule()) -> DataFrame:  # noqa: B008
    """One row per document: its form, the length of its parts, and digests of the output and of what is restored from it."""
    done = fill_in_middle(docs, rule)
    chars = lambda part: F.char_length(part).cast("long").alias(f"{part}_chars")
    return done.select(
        "doc_id", "n", "form", chars("prefix"), chars("middle"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), rule).cast("binary"), 256).alias("restored_sha256"),
    )


def infill_sql(rule: InfillRule = InfillRule()) -> str:  # noqa: B008
    """The same rows by DuckDB over ``documents``; the text is restored by position, not by splitting."""
    p, s, m = rule.sentinels
    number = lambda k: f"CAST('0x' || substr(d, {8 * k - 7}, 8) AS BIGINT) AS h{k}"
    inside = " OR ".join(f"contains(t, '{x}')" for x in rule.sentinels)
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{rule.seed}:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
b AS (SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u, {", ".join(map(number, (1, 2, 3, 4)))} FROM a),
c AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
  CASE WHEN t = '' OR {inside} OR h3 % 100 >= {rule.rate} THEN 'plain' WHEN h4 % 100 < {rule.spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM c),
f AS (SELECT *, CASE form WHEN 'psm' THEN '{p}' || p || '{s}' || s || '{m}' || m WHEN 'spm' THEN '{s}' || s || '{p}' || p || '{m}' || m ELSE t END AS o FROM e),
g AS (SELECT *, strpos(o, '{p}') AS at_p, strpos(o, '{s}') AS at_s, strpos(o, '{m}') AS at_m FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN substr(o, at_p + {len(p)}, at_s - at_p - {len(p)}) || substr(o, at_m + {len(m)}) || substr(o, at_s + {len(s)}, at_m - at_s - {len(s)})
    ELSE substr(o, at_p + {len(p)}, at_m - at_p - {len(p)}) || substr(o, at_m + {len(m)}) || substr(o, at_s + {len(s)}, at_p - at_s - {len(s)}) END) AS restored_sha256 FROM g"""
