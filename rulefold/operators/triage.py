"""Suggestions for unknown rule-kind codes: name similarity, body shape and keywords in the text."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulefold.fixed_values import KIND_KEYWORDS
from rulefold.operators.rules import known_rule_kinds, rule_kind

STRONG = 0.60
KEYWORD_CONFIDENCE = min(0.75, 0.85)  # as stated, and below the cap for text evidence


def similarity(code: Column, term: str) -> Column:
    """1 for equal names in lower case, less by the share of letters to edit; NULL for a NULL code."""
    low, term = F.lower(code), term.lower()
    return 1 - F.levenshtein(low, F.lit(term)) / F.greatest(F.length(low), F.lit(len(term)))


def similarities(code: Column, terms: list[str]) -> Column:
    return F.array(*[similarity(code, t) for t in terms])


def suggest_terms(codes: DataFrame, column: str, terms: list[str] | None = None, top: int = 3) -> DataFrame:
    """Best `top` terms per distinct unknown code: (code, term, score, strong, place); terms without a letter in place are left out."""
    terms = terms or known_rule_kinds()
    distinct = codes.select(F.col(column).alias("code")).where("code IS NOT NULL").distinct()
    pairs = F.array(*[F.struct((-similarity(F.col("code"), t)).alias("neg"), F.lit(t).alias("term")) for t in terms])
    # The vocabulary is short, so ranking happens inside the row instead of in a window.
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["neg"] < 0)), 1, top)
    return distinct_places(distinct.select("code", F.posexplode(best).alias("place", "p")))


def distinct_places(ranked: DataFrame) -> DataFrame:
    score = -F.col("p.neg")
    return ranked.select(
        "code", F.col("p.term").alias("term"), score.alias("score"), (score >= STRONG).alias("strong"),
        (F.col("place") + 1).alias("place"))


def body_shape(kind: str, keys: Column) -> Column:
    """Share of the fields named in a body, or known of a rule kind, that are both: 0 to 1."""
    own = F.array(*[F.lit(f.name) for f in fields(rule_kind(kind).body)])
    return F.size(F.array_intersect(keys, own)) / F.size(F.array_union(keys, own))


def _kind_of_lowered(low: Column) -> Column:
    out = F
    for kind, words in KIND_KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, F.lit(kind))
    return out.otherwise(F.lit(None).cast("string"))


def with_keyword_kind(rows: DataFrame, text: Column, out: str = "kind") -> DataFrame:
    """Add the rule kind pointed to by the first matching keyword row, over the whole text.

    The lower-cased text is projected once; inside the CASE it would be made anew for every keyword.
    """
    low = rows.withColumn("_low", F.lower(text))
    return low.withColumn(out, _kind_of_lowered(F.col("_low"))).drop("_low")


def suggest_kinds(entries: DataFrame, top: int = 3) -> DataFrame:
    """Ranked rule kinds for entries whose kind is unknown.

    entries(study_id, name, inputs, rule_kind, rule_body, rationale, ambiguity_notes). Signals are combined
    by the greatest; keywords count only when neither name nor shape is strong.
    """
    kinds = known_rule_kinds()
    unknown = entries.where(~F.coalesce(F.col("rule_kind").isin(kinds), F.lit(False)))
    codes = unknown.select("rule_kind").distinct().withColumn("_scores", similarities(F.col("rule_kind"), kinds))
    rows = unknown.join(codes, "rule_kind", "left")
    keys = F.coalesce(F.json_object_keys("rule_body"), F.array().cast("array<string>"))
    base = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.greatest(
            F.coalesce(F.get(F.col("_scores"), i), F.lit(0.0)), body_shape(k, keys)).alias("score"))
        for i, k in enumerate(kinds)
    ])
    text = F.concat_ws(" ", "rationale", "ambiguity_notes", "name")
    rows = with_keyword_kind(rows.withColumn("_base", base), text, "_word")
    weak = F.array_max(F.transform("_base", lambda s: s["score"])) < STRONG
    lifted = F.transform("_base", lambda s: F.when(
        weak & F.coalesce(s["kind"] == F.col("_word"), F.lit(False)),
        F.struct(s["kind"].alias("kind"), F.lit(KEYWORD_CONFIDENCE).alias("score"))).otherwise(s))
    ranked = F.slice(
        F.array_sort(F.transform(F.filter(lifted, lambda s: s["score"] > 0),
                                 lambda s: F.struct((-s["score"]).alias("neg"), s["kind"].alias("kind")))), 1, top)
    return rows.select("study_id", "name", "rule_kind", F.posexplode(ranked).alias("_pos", "_s")).select(
        "study_id", "name", "rule_kind", F.col("_s.kind").alias("suggestion"), (-F.col("_s.neg")).alias("confidence"),
        (F.col("_pos") + 1).alias("place"))


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per key; Spark limits each group inside the tasks before shuffling."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)
