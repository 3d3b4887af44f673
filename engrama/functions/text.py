"""Text predicates and formatting as column expressions.

Word boundaries are those of ASCII word characters, whatever stands in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of the three classifiers.
CONSTRAINT_WORDS = ("diabetic", "vegan", "vegetarian", "pescatarian", "celiac", "coeliac", "lactose", "gluten", "allergic", "allergy", "allergies", "intolerant", "intolerance", "terrified", "afraid", "scared", "phobia", "phobic", "kosher", "halal", "sober", "teetotal", "acrophobi")
CONSTRAINT_NO = ("sugar", "meat", "dairy", "nut", "nuts", "gluten", "shellfish", "alcohol")
CONSTRAINT_CANNOT = ("can't", "cant", "cannot", "never")
CONSTRAINT_ACTS = ("eat", "have", "drink", "stand", "do")
HISTORICAL = ("used to", "previous", "previously", "before", "back then", "in the past", "formerly", "history", "historical")
HISTORICAL_OLD = ("old", "older")
HISTORICAL_THINGS = ("job", "address", "phone", "car", "name", "number")
HISTORICAL_ASK = ("what did i use", "what did i used to")
CUES = ("actually", "now", "nowadays", "no longer", "anymore", "as of", "currently", "instead", "moved", "relocated", "switched", "became")
CUES_COLON = ("update:", "correction:")

BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: A boundary after a colon needs a word character.
AFTER_COLON = "(?=[A-Za-z0-9_])"


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


CONSTRAINT = BEFORE + _any(*CONSTRAINT_WORDS, f"no {_any(*CONSTRAINT_NO)}", f"{_any(*CONSTRAINT_CANNOT)} {_any(*CONSTRAINT_ACTS)}") + AFTER
HISTORY = BEFORE + _any(*HISTORICAL, f"{_any(*HISTORICAL_OLD)} {_any(*HISTORICAL_THINGS)}", *HISTORICAL_ASK) + AFTER
CUE = BEFORE + _any(_any(*CUES) + AFTER, _any(*CUES_COLON) + AFTER_COLON)



def bounded(pattern: str) -> str:
    """A pattern with \\b as a boundary of ASCII word characters."""
    return pattern.replace(r"\b", BOUNDARY)


#: All Unicode white space that a trim takes off.
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


#: What a text must hold somewhere, in lower case, for a pattern to match at all.
CONSTRAINT_STEMS = (*CONSTRAINT_WORDS, *(f"no {w}" for w in CONSTRAINT_NO), *(f"{w} " for w in CONSTRAINT_CANNOT))
HISTORY_STEMS = (*HISTORICAL, *(f"{w} " for w in HISTORICAL_OLD), *HISTORICAL_ASK)
CUE_STEMS = (*CUES, *CUES_COLON)


def _matches(text: Column, pattern: str, stems: tuple[str, ...]) -> Column:
    """Whether a text matches, whatever the case; most texts hold no stem and are not matched at all. A stem that holds another is left to that one."""
    least = [s for s in stems if not any(o != s and o in s for o in stems)]
    held = F.exists(F.array(F.lower(text)), lambda low: F.exists(F.array(*map(F.lit, least)), lambda s: F.contains(low, s)))
    return F.coalesce(held & text.rlike("(?i)" + pattern), F.lit(False))


def is_constraint(text: Column) -> Column:
    """Whether a memory states something that must not be overlooked."""
    return _matches(text, CONSTRAINT, CONSTRAINT_STEMS)


def is_historical(query: Column) -> Column:
    """Whether a query asks about what used to hold."""
    return _matches(query, HISTORY, HISTORY_STEMS)


def has_cue(text: Column) -> Column:
    """Whether a memory announces a change."""
    return _matches(text, CUE, CUE_STEMS)


def trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "^" + SPACES, ""), SPACES + "$", "")


def tokens(text: Column) -> Column:
    """Distinct lower-case ASCII word tokens in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9_]+"), lambda w: w != ""))


def keyword_score(query_tokens: Column, text: Column) -> Column:
    """Share of the tokens that occur anywhere in the lower-case text; 0 without tokens."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.size(F.filter(query_tokens, lambda w: F.contains(low, w)))
    return F.when(F.size(query_tokens) > 0, hits / F.size(query_tokens)).otherwise(F.lit(0.0))


def date_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def snippet(text: Column, n: int = 60) -> Column:
    """White space collapsed; what is longer than n ends in an ellipsis."""
    flat = trim(F.regexp_replace(text, SPACES, " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def content_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256, the key of cached embeddings."""
    return F.substring(F.sha2(text, 256), 1, 16)


def contains_all(terms: Column, text: Column) -> Column:
    """Every term occurs, whatever the case; true without terms."""
    return F.coalesce(F.forall(terms, lambda t: F.contains(F.lower(text), F.lower(t))), F.lit(True))


def contains_none(terms: Column, text: Column) -> Column:
    return F.coalesce(~F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t))), F.lit(True))


def listing_line(rank: Column, id_: Column, text: Column, superseded_on: Column) -> Column:
    """One line of a recall listing; a date marks facts that no longer hold."""
    note = F.when(superseded_on.isNull(), "").otherwise(F.concat(F.lit("  (no longer current — superseded "), date_label(superseded_on), F.lit(")")))
    return F.concat(rank.cast("string"), F.lit(". [id "), id_, F.lit("] "), text, note)
