"""Text normalization as column expressions (only Unicode decomposition needs a pandas UDF)."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no identity, by the method that strips them.
LEGAL = ("pvt", "ltd", "inc", "corp", "llc", "limited", "private", "incorporated")
LEGAL_ARTICLES = (*LEGAL, "the", "co")
LEGAL_EU = (*LEGAL_ARTICLES, "sa", "sarl", "gmbh")
LEGAL_WIDE = (*LEGAL_ARTICLES, "sa", "sarl", "sas", "eurl", "sci", "ste", "societe", "solutions", "services", "group", "enterprises", "enterprise")
LEGAL_CORE = ("ltd", "limited", "pvt", "private", "inc", "incorporated", "corp", "corporation", "llc", "co", "company")
NAME_STOPWORDS = (
    "ltd", "limited", "pvt", "private", "inc", "incorporated", "corp", "corporation", "llc", "l l c", "llp", "co", "company", "plc",
    "sa", "sas", "sarl", "eurl", "gmbh", "dr", "mr", "mrs", "ms", "smt", "shri", "sri", "m s", "the", "dba", "and",
)
KEY_STOPWORDS = (
    "pvt", "ltd", "inc", "corp", "llc", "limited", "private", "incorporated", "the", "co", "and", "of", "in", "at", "a", "an", "sa",
    "sarl", "gmbh", "enterprise", "enterprises", "company", "services", "group",
)
KEY_STOPWORDS_WIDE = (
    "pvt", "ltd", "inc", "corp", "llc", "limited", "private", "incorporated", "the", "co", "company", "and", "of", "in", "at", "a",
    "an", "services", "group", "enterprises", "sa", "sarl", "sas", "eurl", "sci", "ste", "societe", "france", "paris", "solutions",
    "industries", "de", "la", "le", "les", "du", "des", "en", "et",
)
# Address abbreviations.
ABBREVIATIONS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "ct": "court", "cir": "circle", "dr": "drive",
    "ln": "lane", "blvd": "boulevard", "hwy": "highway", "pkwy": "parkway", "pl": "place", "sq": "square", "ste": "suite",
    "fl": "floor", "flr": "floor", "apt": "apartment", "bldg": "building", "opp": "opposite", "nr": "near", "mg": "marg",
    "n": "north", "s": "south", "e": "east", "w": "west",
}
# Fixed value: a name that is a web address stands for its host.
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co\.in|fr|us|biz|info|io)\b.*$"


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition; null stays null."""
    return s.str.normalize("NFKD")


def text(c) -> Column:
    """The column, null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_words(c: Column, words, by: str = " ") -> Column:
    return F.regexp_replace(c, rf"\b(?:{'|'.join(words)})\b", by)


def plain(c: Column) -> Column:
    """What is not a-z, 0-9 or white space becomes a space."""
    return squeeze(F.regexp_replace(c, r"[^a-z0-9\s]", " "))


@dataclass(frozen=True)
class Cleaner:
    """Lower case, words stripped before punctuation, spaces collapsed; ``fold`` drops accents first."""

    words: tuple[str, ...]
    fold: bool = False

    def __call__(self, c) -> Column:
        c = text(c)
        if self.fold:
            c = F.regexp_replace(nfkd(c), r"\p{M}+", "")
        return plain(without_words(F.lower(c), self.words))


clean_legal = Cleaner(LEGAL)
clean_articles = Cleaner(LEGAL_ARTICLES)
clean_eu = Cleaner(LEGAL_EU)
clean_folded = Cleaner(LEGAL_WIDE, fold=True)


def basic(c) -> Column:
    """Decomposed, lower case, & spelled out; all else than a-z and 0-9, marks too, becomes a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkd(text(c))), "&", " and "), "[^a-z0-9]+", " "))


def name_v2(c) -> Column:
    host = F.regexp_extract(F.trim(F.lower(text(c))), DOMAIN, 1)
    name = F.when(host != "", F.regexp_replace(host, "-", " ")).otherwise(basic(c))
    return squeeze(without_words(name, NAME_STOPWORDS))


def address_v2(c) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    words = F.split(F.regexp_replace(basic(c), r"\b0+(\d)", "$1"), " ")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def clean_ascii(c) -> Column:
    """Lower case without web addresses; non-ASCII runs and punctuation but & become spaces."""
    c = F.regexp_replace(F.lower(text(c)), r"https?://\S+|www\.\S+", "")
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]+", " "), r"[^\w\s&]", " "))


def name_core(cleaned: Column) -> Column:
    return squeeze(without_words(cleaned, LEGAL_CORE, ""))


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def address_numbers(c: Column) -> Column:
    """Whole numbers with repeats, sorted as text, space-joined."""
    return F.array_join(F.array_sort(all_matches(c, r"\b\d+\b")), " ")


def number_text(c: Column) -> Column:
    """Distinct digit runs, sorted as text, space-joined."""
    return F.array_join(F.array_sort(F.array_distinct(all_matches(c, r"\d+"))), " ")


def number_set(c: Column) -> Column:
    return F.array_distinct(all_matches(c, r"\b\d+\b"))


def word_set(c: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(c), r"\b[a-z0-9]+\b"))


def first_token(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"\b[a-z0-9]+\b", 0)


def postal_first(c: Column) -> Column:
    """The first number of five or six digits, else empty."""
    return F.regexp_extract(c, r"\b(\d{5}|\d{6})\b", 1)


def postal_last(c: Column) -> Column:
    """The last number of five digits or more, else null."""
    return F.try_element_at(all_matches(c, r"\b\d{5,}\b"), F.lit(-1))


def leading_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^\D*(\d+)", 1)


def significant_tokens(cleaned: Column, stopwords=KEY_STOPWORDS) -> Column:
    stop = F.array(*(F.lit(w) for w in stopwords))
    return F.filter(F.split(cleaned, " "), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))


def composite(name: Column, addr: Column, name_weight: int = 1) -> Column:
    return F.trim(F.concat_ws(" ", *([name] * name_weight), addr))


def compact(name: Column) -> Column:
    return F.regexp_replace(name, " ", "")


def blocking_text(name: Column, addr: Column) -> Column:
    """Name, name without spaces, address."""
    return F.concat_ws(" ", name, compact(name), addr)


def core_text(name: Column, addr: Column) -> Column:
    """Core name and cleaned address, for dense blocking."""
    return F.concat(name_core(clean_ascii(name)), F.lit(" "), clean_ascii(addr))


def prompt(name: Column, addr: Column) -> Column:
    return F.format_string("name: %s | address: %s", name, addr)


def encode_id(c: Column) -> Column:
    """S<digit>-<number> as one long: the digit times 10^12 plus the number."""
    return F.substring(c, 2, 1).cast("long") * F.lit(10**12) + F.substring_index(c, "-", -1).cast("long")


def decode_id(c: Column) -> Column:
    return F.concat(F.lit("S"), F.floor(c / F.lit(10**12)).cast("long").cast("string"), F.lit("-"), (c % F.lit(10**12)).cast("string"))


def lossless_ids(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Rows whose id does not come back from its code, such as zero-padded ones."""
    return df.where(~decode_id(encode_id(F.col(id_col))).eqNullSafe(F.col(id_col)))
