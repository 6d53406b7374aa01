"""Scalar text functions as columns: words, sentences, index terms and query terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words that queries leave out.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "on", "at",
    "by", "for", "with", "about", "as", "from", "or", "and", "but", "not",
    "who", "what", "which", "that", "this", "these", "those", "it", "its",
    "he", "she", "they", "we", "you", "i", "me", "him", "her", "us", "them",
    "how", "when", "where", "why", "all", "any", "no", "so", "than", "just",
    "also", "more", "most", "some", "such", "into", "if", "my", "your",
    "his", "our", "their",
)

_BLANK = r"(?U)[\s\x1c-\x1f]+"


def stripped(text: Column) -> Column:
    """text without white space at its ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences end after . ! ? or an ellipsis before white space; empty ones are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?…])[\s\x1c-\x1f]+")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def index_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def query_terms(query: Column) -> Column:
    """Index terms without function words; all of them where nothing else is left. A repeated term stays repeated."""
    found = index_terms(query)
    content = F.filter(found, lambda w: ~w.isin(*STOP_WORDS))
    return F.when(F.size(content) > 0, content).otherwise(found)
