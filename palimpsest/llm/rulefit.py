"""Quality classifier: a sparse ensemble of rules over statistics of a text.

1. Each text becomes a dozen statistics, by column expressions over the whole text, in one pass; they are written.
2. Small trees are grown on the labelled statistics. Every path from a root is a rule: a conjunction of comparisons, those
   of the same statistic and direction merged into the narrowest. Equal rules are one.
3. Which rules hold makes a pattern of bits. Labelled documents are counted by pattern and label, and a logistic regression
   with lasso penalty over these weighted patterns gives most rules the weight 0.
4. The rules that are left are compiled into one column expression: the score is a projection of the statistics.

Trees learn from at most ``max_rows`` labelled documents, chosen by hash (the bound on what is fitted on a sample); weights
learn from all. The number of rules is bounded by the trees, so neither the driver nor a task sees more as the corpus grows.

Null and empty texts have all statistics 0 and are scored like any other. Rows are judged each by its own text: repeated
rows get equal scores. A document with several labels has that of the majority, a tie counts as 0; null labels and
labels of ids that no document has count for nothing. Rows with null id are never learned from and count as held out.
If there are no labels to learn from, all scores are 0.5; if they are all alike, all scores are that label. An empty table
gives an empty result. Very long texts are whole; ties at a threshold go to the lower side.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import own_columns, written

#: Rows up to which the labels are broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class RuleFit:
    """How many trees of what depth, the least part of the documents to a leaf, the lasso's penalty, and the bound on rows
    for the trees. One in ``folds`` documents, by checksum of its id, is held out."""

    trees: int = 24
    depth: int = 3
    min_leaf: float = 0.002
    penalty: float = 0.0005
    max_rows: int = 1_000_000
    folds: int = 5
    threshold: float = 0.3
    seed: int = 7


def text_statistics(text: Column) -> dict[str, Column]:
    """The statistics by name, of the columns that :func:`with_statistics` prepares."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.col("__words")
    n_words = F.greatest(F.size(words), F.lit(1))
    count = lambda kind: F.char_length(text) - F.char_length(F.regexp_replace(text, kind, ""))
    share = lambda condition: F.size(F.filter(words, condition)) / n_words
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    of_lines = F.greatest(F.size("__lines"), F.lit(1))
    return {
        "__lines": lines,
        "log_words": F.log1p(F.size(words)),
        "word_length": F.char_length(F.array_join(words, "")) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct("__lines")) / of_lines,
        "line_words": F.size(words) / of_lines,
        "upper": count(r"\p{Lu}+") / chars,
        "digits": count(r"\p{Nd}+") / chars,
        "symbols": count(r"[^\p{L}\p{N}\p{P}\p{Z}\s]+") / chars,
        "punctuation": count(r"\p{P}+") / chars,
        "bars": count(r"[|#*$%&<>_=+~^{}\[\]\\]+") / chars,
        "no_letter": share(lambda w: ~w.rlike(r"\p{L}")),
        "repeated_word": F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)) / n_words,
        "long_words": share(lambda w: F.char_length(w) > 20),
        "sentence_ends": share(lambda w: w.rlike(r"[.!?]$")),
    }


#: Statistics in the order of the rules' vectors.
NAMES = (
    "log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "upper", "digits", "symbols", "punctuation", "bars", "no_letter", "repeated_word", "long_words", "sentence_ends",
)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics as doubles)."""
    own = own_columns(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    split = own.withColumn("__words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    made = text_statistics(F.col("text"))
    lined = split.withColumn("__lines", made.pop("__lines"))
    return lined.select("doc_id", *(made[n].cast("double").alias(n) for n in NAMES))


@dataclass(frozen=True)
class Rule:
    """Comparisons (statistic, above, threshold): it is greater than the threshold if ``above``, and not if not."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(Column.__and__, (F.col(n) > t if above else F.col(n) <= t for n, above, t in self.terms))

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if above else '<='} {t:.6g}" for n, above, t in self.terms)


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights."""

    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        terms = [F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.weighted]
        return 1 / (1 + F.exp(-reduce(Column.__add__, terms, F.lit(self.intercept))))


def _narrowed(path: list[tuple[str, bool, float]]) -> Rule:
    """The conjunction of a path's comparisons."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, t in path:
        kept = best.get((name, above))
        best[name, above] = t if kept is None else max(kept, t) if above else min(kept, t)
    return Rule(tuple((n, a, t) for (n, a), t in sorted(best.items())))


def tree_rules(model) -> list[Rule]:
    """The rules of all nodes of all trees of a forest but the roots, each once, in order."""
    found: dict[Rule, None] = {}

    def walk(node, path: list[tuple[str, bool, float]]) -> None:
        if path:
            found.setdefault(_narrowed(path))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, t = NAMES[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*path, (name, False, t)])
            walk(node.rightChild(), [*path, (name, True, t)])

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), [])
    return list(found)


def labelled(statistics: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """The statistics of the documents that have a label, and it."""
    each = own_columns(labels, "doc_id", label).filter(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg((F.avg(label) > 0.5).cast("double").alias("label"))
    return statistics.join(F.broadcast(each) if labels.count() <= BROADCAST_ROWS else each, "doc_id")


def fit(train: DataFrame, how: RuleFit = RuleFit()) -> RuleEnsemble:  # noqa: B008
    """The ensemble that ``train`` (statistics and label) gives."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:  # nothing to tell apart
        return RuleEnsemble({0.0: float("-inf"), 1.0: float("inf")}.get(next(iter(sizes), None), 0.0), ())
    n = sum(sizes.values())
    row = F.xxhash64("doc_id", "label", *NAMES)
    sample = train.filter(F.pmod(row, F.lit(1 << 30)) < int((1 << 30) * how.max_rows / n)) if n > how.max_rows else train
    # rows in an order of their own, so that the trees do not depend on how files were cut into tasks
    dealt = sample.repartition(1 + min(n, how.max_rows) // 50_000, row).sortWithinPartitions(row)
    vectors = dealt.select(array_to_vector(F.array(*NAMES)).alias("features"), "label")
    forest = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, minInstancesPerNode=max(1, int(how.min_leaf * min(n, how.max_rows))), seed=how.seed, featureSubsetStrategy="onethird")
    rules = tree_rules(forest.fit(vectors))
    if not rules:
        return RuleEnsemble(0.0, ())
    bits = F.array(*(r.column().cast("double") for r in rules))
    patterns = written(train.select(bits.alias("bits"), "label").groupBy("bits", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")), "rule-patterns")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=how.penalty, maxIter=200, weightCol="weight")
    fitted = lasso.fit(patterns.select(array_to_vector("bits").alias("features"), "label", "weight"))
    # rounded, as sums over tasks differ in their last digits from run to run
    weights = [round(w, 6) for w in fitted.coefficients.toArray().tolist()]
    return RuleEnsemble(round(float(fitted.intercept), 6), tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def held_out(how: RuleFit) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % how.folds == 0, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", how: RuleFit = RuleFit()) -> DataFrame:  # noqa: B008
    """One row per document: (doc_id, held_out, score, predicted). Held-out documents are not learned from."""
    statistics = written(with_statistics(docs).withColumn("held_out", held_out(how)), "statistics")
    train = labelled(statistics.filter("not held_out").drop("held_out"), labels, label)
    score = fit(train, how).score()
    return statistics.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= how.threshold).cast("int"))
