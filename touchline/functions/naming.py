"""Names: market aliases, team-name normalisation, slugs, display labels."""
import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every letter of the Latin blocks that decomposes into a base letter and marks. Letters that carry no accent
# mark (dotless i, sharp s, crossed l and o) are not in it: each key below says what it does to them.
_MARKED = [(c, b) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
           if (b := unicodedata.normalize("NFD", c)[0]) != c and b.isascii()]
FOLD_FROM, FOLD_TO = "".join(c for c, _ in _MARKED), "".join(b for _, b in _MARKED)

# Words that carry no identity, per matching ladder.
FEED_STOPWORDS = ["fc", "cf", "afc", "sc", "ac", "as", "ss", "club", "de", "el", "la", "le", "the"]
ENTITY_STOPWORDS = [
    "fc", "cf", "afc", "cfc", "sc", "ac", "fk", "sk", "bk", "if", "ca", "cd", "sd", "ud", "us", "ss",
    "as", "sv", "vfb", "vfl", "fsv", "tsv", "tsg", "bsc", "nk", "hnk", "gnk", "pfc", "kv", "krc", "kaa",
    "rsc", "club", "cp", "de", "1", "2",
]
ENTITY_STOPWORDS_WIDE = ENTITY_STOPWORDS + [
    "svg", "royal", "sporting", "sport", "atletico", "athletic", "cs", "cr", "ec", "se", "rj", "sp",
]
# City names that clubs spell in two languages.
TOKEN_SYNONYMS = {
    "wien": "vienna", "munchen": "munich", "koln": "cologne", "praha": "prague",
    "warszawa": "warsaw", "lisboa": "lisbon", "bucuresti": "bucharest",
    "beograd": "belgrade", "moskva": "moscow", "sankt": "saint", "st": "saint",
}
# User-facing labels.
MARKET_LABELS = {
    "1X2": "Maç Sonucu", "double_chance": "Çifte Şans", "over_under": "Alt/Üst",
    "btts": "KG Var/Yok", "odd_even": "Tek/Çift", "correct_score": "Kesin Skor",
}
SELECTION_LABELS = {
    "1": "Ev sahibi", "X": "Berabere", "2": "Deplasman", "1X": "1 veya X", "12": "1 veya 2",
    "X2": "X veya 2", "yes": "Var", "no": "Yok", "odd": "Tek", "even": "Çift", "over": "Üst", "under": "Alt",
}


def lookup(col: Column, table: dict) -> Column:
    """Value of a small constant table, or null."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[col]


def lookup_or_self(col: Column, table: dict) -> Column:
    return F.coalesce(lookup(col, table), col)


def fold(name: Column) -> Column:
    return F.translate(name, FOLD_FROM, FOLD_TO)


def feed_name(name: Column) -> Column:
    """Plain lower-case name without club words: the key feeds are joined on."""
    s = F.lower(fold(name))
    s = F.regexp_replace(s, r"\b(" + "|".join(FEED_STOPWORDS) + r")\b", " ")
    s = F.regexp_replace(s, r"[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def entity_name(name: Column, wide: bool = False) -> Column:
    s = F.replace(F.lower(fold(name)), F.lit("ı"), F.lit("i"))
    if wide:
        s = F.replace(s, F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def entity_tokens(name: Column, stopwords: list, synonyms: bool = False) -> Column:
    toks = F.split(entity_name(name, wide=synonyms), " ")
    if synonyms:
        toks = F.transform(toks, lambda t: lookup_or_self(t, TOKEN_SYNONYMS))
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(toks, lambda t: (t != "") & ~F.array_contains(stop, t))


def entity_core(name: Column, stopwords: list = ENTITY_STOPWORDS, synonyms: bool = False) -> Column:
    return F.array_join(entity_tokens(name, stopwords, synonyms), " ")


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(name)), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))


def team_ref(league: Column, name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(
        F.concat_ws(":", F.lit("team"), league, slug(name))
    )


def competition_ref(league: Column) -> Column:
    return F.concat(F.lit("league:"), league)


def price_market(market: Column) -> Column:
    """One spelling for a market wherever it comes from (OU_2.5, BTTS, DC ... -> model names)."""
    m = F.regexp_replace(market, r"^OU_", "over_under_")
    return F.when(m == "BTTS", "btts").when(m == "DC", "double_chance").when(m == "CS", "correct_score").otherwise(m)


def base_market(market: Column, compat: bool = False) -> Column:
    """Market family used for diversity. ``compat`` cuts other names at their first underscore."""
    rest = F.substring_index(market, "_", 1) if compat else market
    return (
        F.when(market.startswith("over_under") | market.startswith("OU_"), "over_under")
        .when(market.startswith("asian_handicap"), "asian_handicap")
        .otherwise(rest)
    )


def calibration_bucket(market: Column) -> Column:
    return F.regexp_replace(market, r"^OU_", "over_under_")


def selection_label(market: Column, selection: Column) -> Column:
    text = lookup_or_self(selection, SELECTION_LABELS)
    line = F.regexp_extract(market, r"^over_under_(.+)$", 1)
    return F.when(line != "", F.concat_ws(" ", line, text)).otherwise(text)
