"""Rule-based sentiment from a small lexicon (a declared substitute for a full one).

Rules and constants, and those valences that agree, are those of a published rule-based model (Hutto and Gilbert, "VADER", ICWSM 2014,
MIT licence): word valences, negation, boosters, capitals, exclamation marks, and x / sqrt(x * x + 15) to bring
the sum into [-1, 1]. All in column expressions: words are looked up once, and only those in the lexicon are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LEXICON_CUT, WEAK_NEGATIVE, WEAK_NEUTRAL, WEAK_POSITIVE

# Valences of words, boosters and negations.
VALENCE = {
    "amazing": 2.8, "awesome": 3.1, "best": 3.2, "better": 1.9, "brilliant": 2.8, "easy": 1.9, "enjoy": 2.2, "excellent": 2.7, "fast": 1.0, "fun": 2.3, "glad": 2.0, "good": 1.9, "great": 3.1,
    "happy": 2.7, "helpful": 1.8, "impressive": 2.3, "improve": 1.9, "like": 1.5, "love": 3.2, "nice": 1.8, "perfect": 2.7, "thanks": 1.9, "useful": 1.9, "win": 2.8, "wow": 2.8,
    "angry": -2.3, "annoying": -1.7, "awful": -2.0, "bad": -2.5, "broken": -2.1, "bug": -1.0, "crash": -1.7, "disappointing": -2.2, "error": -1.7, "fail": -2.5, "fear": -2.2, "hate": -2.7, "horrible": -2.5,
    "idiot": -2.3, "kill": -3.7, "loser": -2.4, "pathetic": -2.7, "problem": -1.7, "sad": -2.1, "scam": -2.7, "slow": -0.6, "stupid": -2.4, "terrible": -2.1, "trash": -1.5, "ugly": -2.3, "useless": -1.8, "worse": -2.1, "worst": -3.1, "worthless": -1.9, "wrong": -2.1,
}
BOOST = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "totally": 0.293, "absolutely": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293}
NEGATION = {"not", "no", "never", "without", "cannot", "cant", "can't", "dont", "don't", "isnt", "isn't", "wasnt", "wasn't", "wont", "won't", "nothing", "neither", "nor"}
#: Emphasis by capitals and by an exclamation mark (four count at most), reversal by a negation, scale of the sum; fading by distance.
CAPITALS, MARK, REVERSAL, SCALE = 0.733, 0.292, -0.74, 15
FADE = ((1, 1.0), (2, 0.95), (3, 0.9))


def _upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def with_compound(df: DataFrame, text: str, name: str = "compound") -> DataFrame:
    """df with the sentiment of a text column in [-1, 1]; 0 for null, empty or neutral text."""
    known = F.create_map(*(F.lit(x) for pair in VALENCE.items() for x in pair))
    boost = F.create_map(*(F.lit(x) for pair in BOOST.items() for x in pair))
    d = df.withColumn("_words", F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z']+)"), 1))
    d = d.withColumn("_low", F.transform("_words", F.lower))
    d = d.withColumn("_hits", F.filter(F.transform("_low", lambda w, i: F.when(w.isin(*VALENCE), F.struct(i.alias("i"), F.try_element_at(known, w).alias("v")))), lambda x: x.isNotNull()))
    d = d.withColumn("_loud", (F.size("_hits") > 0) & F.exists("_words", _upper) & ~F.forall("_words", _upper))

    def scored(hit: Column) -> Column:
        word = F.get("_words", hit["i"])
        start = hit["v"] + F.when(F.col("_loud") & _upper(word) & (F.length(word) > 1), F.signum(hit["v"]) * CAPITALS).otherwise(0.0)
        steps = F.array(*(F.struct(F.lit(k).alias("back"), F.lit(f).alias("fade")) for k, f in FADE))

        def step(score: Column, at: Column) -> Column:
            before = F.get("_low", hit["i"] - at["back"])
            turned = F.when(F.coalesce(before.isin(*sorted(NEGATION)), F.lit(False)), F.lit(REVERSAL)).otherwise(1.0)
            return (score + F.signum(score) * F.coalesce(F.try_element_at(boost, before), F.lit(0.0)) * at["fade"]) * turned

        return F.aggregate(steps, start, step)

    d = d.withColumn("_sum", F.aggregate(F.transform("_hits", scored), F.lit(0.0), lambda s, x: s + x))
    marks = F.least(F.length(text) - F.length(F.replace(F.col(text), F.lit("!"), F.lit(""))), F.lit(4))
    d = d.withColumn("_sum", F.when(F.col("_sum") != 0, F.col("_sum") + F.signum("_sum") * marks * MARK).otherwise(0.0))
    return d.withColumn(name, F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + SCALE)).drop("_words", "_low", "_hits", "_loud", "_sum")


def sign(score: Column, cut: float = LEXICON_CUT) -> Column:
    return F.when(score > cut, 1).when(score < -cut, -1).otherwise(0)


def sign_label(score: Column) -> Column:
    return F.when(score > LEXICON_CUT, "positive").when(score < -LEXICON_CUT, "negative").otherwise("neutral")


def weak_label(score: Column) -> Column:
    """A training label where the score is decided enough; null where the row is dropped."""
    return F.when(score > WEAK_POSITIVE, "positive").when(score < WEAK_NEGATIVE, "negative").when(F.abs(score) < WEAK_NEUTRAL, "neutral")
