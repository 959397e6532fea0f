"""Feature providers: what turns an input row into an entity.

An entity has an id, numeric properties, pattern flags, a feature set, a group key
and fragments.  Operators need nothing else, so another domain only needs another
provider.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import canonical_text, sha_hex
from tessera.operators.patterns import ngrams


class FeatureProvider(Protocol):
    """entities() gives entity_id, category, valid, props as columns, flags as columns, features, group_key and fragments."""

    def entities(self, rows: DataFrame) -> DataFrame: ...


class TextFeatures:
    """Texts: lengths, ratios and regular expressions, all as native expressions."""

    #: pattern name -> regular expression
    FLAGS = {"has_digit": "[0-9]", "has_exclaim": "!", "has_bar": r"\|", "has_question": r"\?", "has_license": "(?i)licen[cs]e"}
    PROPS = ("n_chars", "n_tokens", "mean_token", "upper_ratio", "digit_ratio")

    def __init__(self, entity_id: str = "doc_id", text: str = "text", category: str = "source", fragment_words: int = 2):
        self.entity_id, self.text, self.category, self.n = entity_id, text, category, fragment_words

    def entities(self, rows: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(self.text), F.lit(""))
        base = rows.select(F.col(self.entity_id).alias("entity_id"), F.col(self.category).alias("category"), text.alias("text"))
        base = base.withColumns({"canonical": canonical_text(F.col("text"))}).withColumns({"tokens": F.when(F.col("canonical") != "", F.split("canonical", " ")).otherwise(F.array().cast("array<string>"))})
        n = F.greatest(F.length("text"), F.lit(1))
        props = {
            "n_chars": F.length("text").cast("double"),
            "n_tokens": F.size("tokens").cast("double"),
            "mean_token": F.length(F.regexp_replace("canonical", " ", "")).cast("double") / F.greatest(F.size("tokens"), F.lit(1)),
            "upper_ratio": F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double") / n,
            "digit_ratio": F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double") / n,
        }
        flags = {name: F.col("text").rlike(pattern) for name, pattern in self.FLAGS.items()}
        rest = {"valid": F.col("canonical") != "", "features": F.array_distinct("tokens"), "group_key": sha_hex(F.col("canonical")), "fragments": F.array_distinct(ngrams(F.col("tokens"), self.n))}
        return base.withColumns(props | flags | rest).drop("text", "canonical", "tokens")


class NumericFeatures:
    """Tables of numeric columns; flags are thresholds, the feature set the names of the flags that hold."""

    def __init__(self, entity_id: str, category: str, props: list[str], flags: dict[str, str]):
        self.entity_id, self.category, self.props, self.flags = entity_id, category, props, flags

    def entities(self, rows: DataFrame) -> DataFrame:
        out = rows.select(F.col(self.entity_id).alias("entity_id"), F.col(self.category).alias("category"), *(F.col(p).cast("double").alias(p) for p in self.props), *(F.expr(f"coalesce({test}, false)").alias(name) for name, test in self.flags.items()))
        valid = F.lit(True)
        for p in self.props:
            valid = valid & F.col(p).isNotNull()
        names = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in self.flags)))
        return out.withColumns({"valid": valid, "features": names, "group_key": F.col("category").cast("string"), "fragments": names})


class MoleculeFeatures:
    """Molecules, by a chemistry toolkit.  None is installed here, so nothing of this adapter has been run."""

    def entities(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError("a chemistry toolkit is not installed; give a FeatureProvider of your own")
