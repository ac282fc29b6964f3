"""Screening text for injected instructions and forbidden intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X

def normalise_text(df: DataFrame, text: str = "text", out: str = "normalised") -> DataFrame:
    """NFKD, look-alikes to ASCII, lower case, trimmed."""
    return df.withColumn(out, X.normalise_text(F.col(text)))


def _normalised_terms(terms, normalise: bool = True) -> list[str]:
    terms = list(terms)
    return [X.normalise_literal(t) for t in terms] if normalise else terms


def screen_keywords(
    df: DataFrame, text: str = "text", terms=K.INJECTION_TERMS, normalise_terms: bool = True
) -> DataFrame:
    """Flag and matched terms of a list in the plan; ``screen_term_table`` takes lists from a table.

    Terms are normalised like the text. The normalised text is a column of its own, so Python sees it once, and only
    when it is not ASCII.
    """
    listed = _normalised_terms(terms, normalise_terms)
    tagged = df.withColumn("_norm", X.normalise_text(F.col(text)))
    return (
        tagged.withColumn("matched", X.contained_terms(F.col("_norm"), listed))
        .withColumn("flagged", F.size("matched") > 0)
        .drop("_norm")
    )


def screen_term_table(df: DataFrame, keys: list[str], terms: DataFrame, text: str = "text", max_words: int = 1) -> DataFrame:
    """Whole-word terms from a table of any size: word n-grams, then an equi-join.

    Grams are distinct per text before the join, so a frequent word costs one
    row per text; which side is broadcast is left to the measured sizes.
    """
    words = F.filter(F.split(X.normalise_text(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    split = df.select(*keys, words.alias("_w"))

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - n + 1))
        return F.transform(starts, lambda i: F.array_join(F.slice("_w", i, n), " "))

    grams = [F.col("_w")] + [grams_of(n) for n in range(2, max_words + 1)]
    rows = split.select(*keys, F.explode(F.array_distinct(F.concat(*grams))).alias("term"))
    return rows.join(terms.select("term").distinct(), "term", "left_semi")


def goal_rule_hit(goal: Column, reasoning: Column, value: Column) -> Column:
    """Terms that count only under one goal; texts are normalised already."""
    hit = F.lit(False)
    for name, terms in K.GOAL_REASONING_TERMS.items():
        hit = hit | ((goal == name) & X.contains_any(reasoning, terms))
    for name, terms in K.GOAL_VALUE_TERMS.items():
        hit = hit | ((goal == name) & X.contains_any(value, terms))
    return hit


def screen_goal_rules(actions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Actions hit by the extra terms of their task's goal."""
    joined = with_normalised(actions).join(anchors.select("task_id", "goal"), "task_id", "left")
    hit = goal_rule_hit(F.col("goal"), F.col("_reason"), F.col("_value"))
    return joined.withColumn("goal_rule_hit", F.coalesce(hit, F.lit(False))).drop("_reason", "_value")


def with_normalised(actions: DataFrame) -> DataFrame:
    """Normalised reasoning and value as ``_reason`` and ``_value``."""
    return actions.withColumn("_reason", X.normalise_text(F.col("reasoning"))).withColumn(
        "_value", X.normalise_text(F.col("value"))
    )


def class_terms(compat: bool = False, classes=K.FORBIDDEN_CLASSES) -> list[tuple[str, str]]:
    """(class, term) in test order: the class itself, then its synonyms."""
    pairs = []
    for cls in classes:
        term = X.normalise_literal(cls)
        pairs.append((cls, term))
        clusters = (term,) if compat else K.CLUSTERS_OF_CLASS.get(cls, ())
        for cluster in clusters:
            pairs.extend((cls, t) for t in K.SYNONYM_CLUSTERS.get(cluster, ()))
    return pairs


def forbidden_hit(reasoning: Column, value: Column, pairs, classes: Column | None = None) -> Column:
    """First forbidden class referred to, as ``struct(cls, term)`` or NULL."""
    chain = None
    for cls, term in pairs:
        cond = reasoning.contains(term) | value.contains(term)
        if classes is not None:
            cond = cond & F.array_contains(classes, cls)
        found = F.struct(F.lit(cls).alias("cls"), F.lit(term).alias("term"))
        chain = F.when(cond, found) if chain is None else chain.when(cond, found)
    return chain


def forbidden_any(reasoning: Column, value: Column, pairs) -> Column:
    """Whether any forbidden class or synonym is referred to."""
    terms = list(dict.fromkeys(t for _, t in pairs))
    return X.contains_any(reasoning, terms) | X.contains_any(value, terms)


def screen_forbidden_classes(
    actions: DataFrame, compat: bool = False, classes: str | None = None
) -> DataFrame:
    """First forbidden class or synonym in reasoning or value.

    ``classes`` names an array column when forbidden classes differ by row.
    """
    tagged = with_normalised(actions)
    hit = forbidden_hit(
        F.col("_reason"), F.col("_value"), class_terms(compat), F.col(classes) if classes else None
    )
    return (
        tagged.withColumn("_hit", hit)
        .withColumn("forbidden_class", F.col("_hit.cls"))
        .withColumn("forbidden_term", F.col("_hit.term"))
        .drop("_hit", "_reason", "_value")
    )


def scheme_hit(normalised: Column, compat: bool = False) -> Column:
    """Navigation target with a forbidden scheme or embedded data.

    The text arrives normalised (digits as letters), so the marks are
    normalised as well; ``compat`` leaves them, and ``base64`` then never fires.
    """
    marks = K.FORBIDDEN_NAV_MARKS if compat else [X.normalise_literal(m) for m in K.FORBIDDEN_NAV_MARKS]
    starts = F.lit(False)
    for scheme in K.FORBIDDEN_SCHEMES:
        starts = starts | normalised.startswith(scheme)
    return starts | X.contains_any(normalised, marks)


def screen_url_scheme(df: DataFrame, url: str = "url", compat: bool = False) -> DataFrame:
    tagged = df.withColumn("_norm", X.normalise_text(F.col(url)))
    return tagged.withColumn("forbidden_scheme", scheme_hit(F.col("_norm"), compat)).drop("_norm")


def screening_report(
    prompts: DataFrame, text: str = "prompt", terms=K.PROMPT_SCREEN_TERMS, by: str = "vector",
    normalise_terms: bool = True,
) -> DataFrame:
    """Recall, false positives and unsafe share, in total (NULL) and per ``by``."""
    seen = screen_keywords(prompts, text, terms, normalise_terms)
    attack, flagged = F.col("is_attack"), F.col("flagged")
    counts = seen.rollup(by).agg(
        F.count("*").alias("cases"),
        F.count_if(attack).alias("attacks"),
        F.count_if(attack & flagged).alias("attacks_flagged"),
        F.count_if(~attack & flagged).alias("benign_flagged"),
    )

    def pct(part, whole):
        return F.when(whole > 0, F.round(part / whole * 100, 2))

    benign = F.col("cases") - F.col("attacks")
    return (
        counts.withColumn("recall_pct", pct(F.col("attacks_flagged"), F.col("attacks")))
        .withColumn("false_positive_pct", pct(F.col("benign_flagged"), benign))
        .withColumn("unsafe_pct", pct(F.col("attacks") - F.col("attacks_flagged"), F.col("cases")))
    )
