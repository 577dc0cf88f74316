"""Folding of names for search, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Latin letters with marks, and their plain spelling, letter by letter.
MARKED = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđð", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥħ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł",
    "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşšș", "t": "ţťŧț", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
#: Letters that become two.
DOUBLED = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}


def fold(x) -> Column:
    """Lower case without marks."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.regexp_replace(F.lower(x), "[̀-ͯ]", "")
    out = F.translate(out, "".join(MARKED.values()), "".join(k * len(v) for k, v in MARKED.items()))
    for letter, plain in DOUBLED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def compact(x) -> Column:
    """Letters and digits alone."""
    return F.regexp_replace(fold(x), r"[^\p{L}\p{N}]", "")


def joined_words(x) -> Column:
    """Words, one space between them."""
    return F.trim(F.regexp_replace(fold(x), r"[^\p{L}\p{N}]+", " "))


#: Names that say a class or nothing, not a model; and makers that are not models.
GENERIC = ("unknown", "other", "na", "none", "custom", "prototype", "monohull", "multihull", "sailboat", "sailingyacht", "yacht", "boat", "cruiser", "racer", "catamaran", "trimaran", "onedesign", "open40", "open60", "class40", "imoca", "imoca60", "tp52", "irc", "orc", "orr", "phrf")
GENERIC_STARTS = ("irc", "orc", "orr", "phrf", "division", "class", "mono", "multi")
MAKERS = ("beneteau", "jeanneau", "dufour", "hanse", "bavaria", "jboats", "nautor", "x", "x-yachts", "dehler", "elan", "farr", "hylas", "oyster", "sunseeker", "catalina", "melges", "jpk")
PLAIN_MODELS = ("laser", "optimist", "dragon", "star", "soling", "yngling", "contender", "flyingdutchman", "folkboat")


#: Ends of builders' names that say no more than their trade.
TRADE_WORDS = ("yachts", "yacht", "boats", "boat", "sa", "ltd")


def maker(x) -> Column:
    """A builder's name without its trade words."""
    out = compact(x)
    for suffix in TRADE_WORDS:
        out = F.regexp_replace(out, f"^(.{{3,}}){suffix}$", "$1")
    return F.regexp_replace(F.regexp_replace(out, "^j$", "jboats"), "^nautorswan$", "nautor")


def model_key(x) -> Column:
    """What two boats of one model share; null for names that say no model. Decimal points between digits stay."""
    key = F.regexp_replace(fold(x), r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{N}.]", "")
    key = F.regexp_replace(key, r"^beneteau(?=first|oceanis)|^jeanneau(?=sunfast|sunodyssey)|^nautor(?=swan)", "")
    generic = key.isin(*GENERIC) | key.rlike("^(" + "|".join(GENERIC_STARTS) + ")")
    good = (F.length(key) >= 3) & key.rlike(r"\p{L}") & ~generic & ~maker(key).isin(*MAKERS) & (key.rlike("[0-9]") | key.isin(*PLAIN_MODELS))
    return F.when(good, key)


def sail_display(number, country) -> Column:
    """A sail number behind its country once, whatever was written before it; empty where the number is missing or a stand-in."""
    number, country = (F.col(c) if isinstance(c, str) else c for c in (number, country))
    raw = F.regexp_replace(F.regexp_replace(number, "^[^/]*/", ""), r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.substring(raw, F.length(country) + 1, F.length(raw)), "^[ /-]+", "")
    own = (F.lower(F.substring(raw, F.lit(1), F.length(country))) == F.lower(country)) & (bare != "")
    shown = F.when((country != "") & own, bare).otherwise(raw)
    return F.when((raw == "") | F.startswith(raw, F.lit("_")), "").when(country == "", shown).otherwise(F.concat_ws(" ", country, shown))
