"""Text analysis as columns: markup stripping, tokens, compounds and query-side rules."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F

# The token alphabet and the word lists the results depend on.
TOKEN = "(?iu)[0-9a-zåäöéèüæø]+"
HEADS = (
    "klänningar", "pikétröjor", "piketrojor", "skjortor", "jackor", "väskor", "tröjor", "kepsar", "mössor", "blusar", "kjolar", "kappor", "västar",
    "kängor", "sneakers", "klänning", "pikétröja", "piketroja", "skjorta", "jacka", "väska", "tröja", "byxor", "byxa", "keps", "mössa", "blus",
    "kjol", "kappa", "väst", "jeans",
)
SINGULARS = {
    "jackor": "jacka", "skjortor": "skjorta", "väskor": "väska", "klänningar": "klänning", "tröjor": "tröja", "pikétröjor": "pikétröja", "kepsar": "keps",
    "mössor": "mössa", "blusar": "blus", "kjolar": "kjol", "kappor": "kappa", "västar": "väst", "byxor": "byxa", "kängor": "känga",
}
MODIFIERS = ("herr", "dam", "barn")
ENGLISH_HEADS = {
    "jacket": "jacka", "jackets": "jacka", "dress": "klänning", "dresses": "klänning", "shirt": "skjorta", "shirts": "skjorta", "bag": "väska", "bags": "väska",
    "coat": "kappa", "coats": "kappa", "sweater": "tröja", "sweaters": "tröja", "cap": "keps", "caps": "keps", "beanie": "mössa", "beanies": "mössa",
    "skirt": "kjol", "skirts": "kjol", "vest": "väst", "vests": "väst", "pants": "byxa", "trousers": "byxa", "blouse": "blus", "blouses": "blus", "boots": "känga",
}
SHORTEST_PREFIX = 3


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def unescape(text: Column) -> Column:
    """References of HTML decoded, all 2,231 names and the numeric ones, over Arrow batches."""
    return F.pandas_udf(_unescaped, "string")(text)


def strip_tags(text: Column) -> Column:
    """Text without tags, references decoded afterwards; null is empty."""
    return unescape(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))


def tokens(text: Column, decode: bool = True) -> Column:
    """Lower-case tokens of a text, tags left out. ``decode`` False spares the decoding where a text can hold no reference."""
    plain = strip_tags(text) if decode else F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    return F.transform(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0)), F.lower)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def compound_head(token: Column) -> Column:
    """The first head in list order that ends ``token`` and leaves a prefix of three letters; null if none does."""
    fits = F.filter(F.array(*map(F.lit, HEADS)), lambda h: F.endswith(token, h) & (token != h) & (F.length(token) - F.length(h) >= SHORTEST_PREFIX))
    return F.get(fits, 0)


def compound_prefix(token: Column) -> Column:
    head = compound_head(token)
    return F.substring(token, F.lit(1), F.length(token) - F.length(head))


def compound_tokens(token: Column) -> Column:
    """``token``, its singular, its head and the head's singular, each once, in this order."""
    head = compound_head(token)
    return F.array_distinct(F.array_compact(F.array(token, _lookup(SINGULARS, token), head, _lookup(SINGULARS, head))))


def field_tokens(text: Column, compound: bool, decode: bool = True) -> Column:
    """Tokens as a document field is indexed: with ``compound``, each followed by what it is made of."""
    plain = tokens(text, decode)
    return F.flatten(F.transform(plain, compound_tokens)) if compound else plain


def query_expansion(token: Column) -> Column:
    """What a query token stands for without regard to the catalog: its parts, a kept modifier, its Swedish head."""
    prefix = compound_prefix(token)
    kept = F.when(prefix.isin(*MODIFIERS), prefix)
    return F.array_distinct(F.array_compact(F.concat(compound_tokens(token), F.array(kept, _lookup(ENGLISH_HEADS, token)))))


def edit_budget(token: Column) -> Column:
    """Edits allowed to a vendor token by its length."""
    return F.when(F.length(token) < 5, 0).when(F.length(token) < 8, 1).otherwise(2)


def fold_case(text: Column) -> Column:
    """Caseless form: lower case, sharp s as ss. Other full case foldings are rare in names and stay."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))
