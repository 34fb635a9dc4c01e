"""The word list: tiers, the in-row predicate and the table form."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The words each tier mutes. A word filter cannot avoid listing them.
STRONG = """
fuck fucker fucking fucked motherfucker motherfucking shit shitty bullshit horseshit shithead asshole assholes
bitch bitches bitching bastard bastards cunt cunts cock cocks dick dicks dickhead prick pricks pussy pussies
whore whores slut sluts ass asses goddamn goddamnit goddammit hell damn damnit dammit nigger niggers nigga
faggot faggots fag retard retarded jackass dumbass badass piss pissed pissing
""".split()
STRONG_PREFIXES = "fuck motherfuck bullshit goddam".split()
MILD = """
stupid idiot idiots idiotic dumb dummy moron morons moronic jerk jerks loser losers poop poopy fart farted
farting butt butts shutup freak freaks sucks hate
""".split()
BLASPHEMY = "god gods jesus christ jeez geez jesu".split()


@dataclass(frozen=True)
class Lexicon:
    """Which tiers are on. Strong words always are; extra words are the caller's own."""

    include_mild: bool = False
    include_blasphemy: bool = False
    extra: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def of(include_mild: bool = False, include_blasphemy: bool = False,
           extra: Iterable[str] = ()) -> "Lexicon":
        return Lexicon(include_mild, include_blasphemy, frozenset(w.lower() for w in extra))

    def rows(self) -> list[tuple[str, str, str]]:
        """(word, tier, match_kind), a word appearing once, under its first tier."""
        tiers = [("strong", STRONG)]
        if self.include_mild:
            tiers.append(("mild", MILD))
        if self.include_blasphemy:
            tiers.append(("blasphemy", BLASPHEMY))
        tiers.append(("extra", sorted(self.extra)))
        seen: dict[str, str] = {}
        for tier, words in tiers:
            for word in words:
                seen.setdefault(word, tier)
        return ([(w, t, "exact") for w, t in seen.items()]
                + [(p, "strong", "prefix") for p in STRONG_PREFIXES])

    def match_keys(self) -> list[str]:
        """First letters of every word that can be listed: a heard word with others matches none of them."""
        return sorted({word.removesuffix("'s")[:3] for word, _, _ in self.rows()})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "word STRING, tier STRING, match_kind STRING")

    def tier(self, norm: Column) -> Column:
        """The tier a normalised word falls in, null when it is not listed."""
        out = F.when(norm.isin(STRONG), "strong")
        for prefix in STRONG_PREFIXES:
            out = out.when(norm.startswith(prefix), "strong")
        if self.include_mild:
            out = out.when(norm.isin(MILD), "mild")
        if self.include_blasphemy:
            out = out.when(norm.isin(BLASPHEMY), "blasphemy")
        if self.extra:
            out = out.when((norm != "") & norm.isin(sorted(self.extra)), "extra")
        return out

    def flags(self, norm: Column) -> Column:
        """Whether ``tier`` is not null: one look-up of all listed words, then the prefixes."""
        listed = norm.isin([w for w, _, kind in self.rows() if kind == "exact" and w])
        for prefix in STRONG_PREFIXES:
            listed = listed | norm.startswith(prefix)
        return F.coalesce(listed, F.lit(False))
