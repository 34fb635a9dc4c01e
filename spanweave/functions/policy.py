"""From observations to categories: policy, severity and category names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# The observations a scorer answers with true or false.
OBSERVATIONS = ("female_topless", "buttocks_or_genitals", "underwear_only", "male_shirtless", "sex_act",
                "kissing", "kissing_sexual", "sexualised_framing")
# How serious a category is when a shot is labelled, and when findings are merged.
SEVERITY = {"sexual_activity": 3, "nudity": 2, "intense_kissing": 1, "suggestive": 0}
MERGE_SEVERITY = {"nudity": 5, "gore": 5, "sexual": 4, "sex": 4, "violence": 3, "suggestive": 2, "profanity": 1}
# Detector categories and their standard names.
CATEGORY_NAMES = {"NUDITY": "nudity", "PARTIAL_NUDITY": "nudity", "SEXUAL_ACTIVITY": "sexual_activity",
                  "AUDIO_MOAN": "sexual_activity", "KISSING": "intense_kissing", "COMPOSITE": "sexual_activity"}
VISUAL_CATEGORIES = ("nudity", "sexual_activity", "intense_kissing", "suggestive", "violence", "gore")
VISUAL_ENGINES = ("vlm", "pureframe")


@dataclass(frozen=True)
class Policy:
    """What to flag. Compiled into one CASE expression, so a change of policy is a change of view."""

    flag_male_shirtless: bool = False
    flag_underwear: bool = True
    flag_any_kissing: bool = False
    tentative: frozenset[str] = field(default_factory=lambda: frozenset({"suggestive"}))

    def classify(self, obs=F.col) -> Column:
        """Category of a sample, or null. ``obs`` maps an observation name to its column."""
        def seen(name: str) -> Column:
            return F.coalesce(obs(name), F.lit(False))

        rules = (F.when(seen("sex_act"), "sexual_activity")
                 .when(seen("female_topless") | seen("buttocks_or_genitals"), "nudity")
                 .when(seen("kissing_sexual"), "intense_kissing"))
        if self.flag_underwear:
            rules = rules.when(seen("underwear_only"), "suggestive")
        # A bare male chest is settled here, framed or not, before kissing is looked at.
        if self.flag_male_shirtless:
            rules = rules.when(seen("male_shirtless"), "suggestive")
        else:
            rules = rules.when(seen("male_shirtless") & ~seen("sexualised_framing"), F.lit(None))
        rules = rules.when(seen("sexualised_framing"), "suggestive")
        if self.flag_any_kissing:
            rules = rules.when(seen("kissing"), "intense_kissing")
        return rules

    def is_tentative(self, category: Column) -> Column:
        return category.isin(sorted(self.tentative))


def lookup(values: dict[str, object], key: Column, default) -> Column:
    """A small fixed mapping as a CASE over literals."""
    out = None
    for name, value in values.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(default)


def severity(category: Column) -> Column:
    return lookup(SEVERITY, category, 0)


def merge_severity(category: Column) -> Column:
    return lookup(MERGE_SEVERITY, category, 0)


def map_category(raw: Column) -> Column:
    """Standard name of a detector category; an unlisted one is lower-cased, none is ``unknown``."""
    named = F.when(raw.isNotNull() & (raw != ""), raw)
    return F.coalesce(lookup(CATEGORY_NAMES, F.upper(named), None), F.lower(named), F.lit("unknown"))


def is_visual(engine: Column, category: Column) -> Column:
    return engine.isin(*VISUAL_ENGINES) | category.isin(*VISUAL_CATEGORIES)


def sample_confidence(category: Column) -> Column:
    return F.when(category == "suggestive", 0.5).otherwise(1.0)
