"""Text functions as column expressions: cleaning, bots, tokens, keywords, overlap. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markup patterns and their replacements, in the order in which they apply.
MARKUP = [
    (r"```[\s\S]*?```", " "),
    (r"(?m)^>+\s?", " "),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"https?://\S+|www\.\S+", " "),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"~~([^~]+)~~", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^#{1,6}\s+", " "),
]
# Names of bots and of authors who are gone.
BOT = r"(?i)(?:bot$|automoderator|automod|\[deleted\]|\[removed\]|_bot$|-bot$)"
GONE = ("", "[deleted]", "[removed]")
# Words that say nothing about a topic, in its graph and in its label.
GRAPH_STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "my", "of", "on", "or", "that", "the", "this", "to", "with"]
LABEL_STOPWORDS = ["the", "and", "for", "that", "with", "this", "you", "are", "from", "have", "was", "but", "not", "can", "all", "just"]


def clean(text: Column) -> Column:
    """Plain lower-case text without markup; null gives the empty string."""
    text = reduce(lambda t, rule: F.regexp_replace(t, *rule), MARKUP, F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


# Endings of words and what stands for them, in the order in which they apply; a word takes the first that fits.
ENDINGS = [("(?<=[a-z]{2})ies$", "y"), ("(?<=ss)es$", ""), ("(?<=[a-z]{2}(?:x|z|ch|sh))es$", ""), ("(?<=[a-z]{2}[^aious])s$", ""), ("(?<=[a-z]{3}[^aeiou])ing$", ""), ("(?<=[a-z]{3}[^aeiou])ed$", "")]


def lemmas(cleaned: Column) -> Column:
    """Cleaned text with its words cut to a common form by their endings: a rule-based substitute for a dictionary, off by default."""

    def one(word: Column) -> Column:
        out = word
        for pattern, by in reversed(ENDINGS):
            out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, by)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(cleaned, " "), one), " ")


def raw_text(title: Column, content: Column) -> Column:
    """Title and content joined; blank, deleted and removed contents are left out."""
    body = F.trim(content)
    return F.concat_ws(" ", F.when(title != "", F.trim(title)), F.when(~body.isin(*GONE), body))


def token_count(cleaned: Column) -> Column:
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))


def is_bot(author: Column) -> Column:
    return author.isNull() | (author == "") | author.rlike(BOT)


def filter_reason(author: Column, tokens: Column, least: int = 10) -> Column:
    """bot before empty before too_short; null where the text is kept."""
    return F.when(is_bot(author), "bot").when(tokens == 0, "empty").when(tokens < least, "too_short")


def search_terms(text: Column) -> Column:
    """Distinct lower-case words of three letters or digits and more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays without repeats; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(shared / union)


def overlap_score(shared: Column, size: Column, other_size: Column, phrase: Column) -> Column:
    """Jaccard overlap from counts, at least 0.25 where the text holds the query as a phrase; null without any.

    The arguments are columns that are computed already: an expression would be evaluated once for each mention.
    """
    overlap = shared / F.greatest(size + other_size - shared, F.lit(1))
    return F.when(phrase, F.greatest(overlap, F.lit(0.25))).when(shared > 0, overlap)


def lexical_score(terms: Column, phrase: Column, other_terms: Column) -> Column:
    """overlap_score of the query's and a text's search_terms, both columns that are computed already."""
    return overlap_score(F.size(F.array_intersect(terms, other_terms)), F.size(terms), F.size(other_terms), phrase)


def parse_list(text: Column, separators: str = ",") -> Column:
    """A JSON list of strings, or else the parts between separators once brackets and quotes are gone."""
    parts = F.split(F.regexp_replace(text, r'[\[\]"]', " "), separators)
    found = F.coalesce(F.from_json(text, "array<string>"), parts)
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def keyword_words(text: Column) -> Column:
    """The words of a stored list of words, or of [word, score] pairs."""
    pairs = F.transform(F.from_json(text, "array<array<string>>"), lambda x: F.get(x, F.lit(0)))
    return F.when(F.ltrim(text).rlike(r"^\[\s*\["), pairs).otherwise(parse_list(text))


def keywords(text: Column) -> Column:
    """Lower-case distinct keywords of a stored list, without stop words, in order."""
    found = F.transform(parse_list(text, r"[\s,;|/]+"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.isin(*GRAPH_STOPWORDS)))


def cluster_label(words: Column) -> Column:
    """The first three telling keywords, or a fixed name if there is none."""
    useful = F.slice(F.filter(words, lambda w: ~F.lower(w).isin(*LABEL_STOPWORDS) & (F.length(w) > 2)), 1, 3)
    return F.when(F.size(useful) > 0, F.array_join(useful, " / ")).otherwise("Unlabeled cluster")


def preview(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def titled(name: Column) -> Column:
    """snake_case as a title."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def first_line(text: Column) -> Column:
    return F.get(_lines(text), F.lit(0))


def other_lines(text: Column) -> Column:
    lines = _lines(text)
    return F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def redacted(url: Column) -> Column:
    """A connection URL without its credentials."""
    return F.regexp_replace(url, r"//[^/@]*@", "//***@")


def canonical_hash(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted keys; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])))), 256)
