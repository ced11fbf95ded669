"""Text helpers for IRIs, labels and names: splitting, keys, titles, distances."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from quadrille.model import PREFIXES

_WORDS = r"[\p{L}\p{N}\p{M}]+"


def _any(c: Column, test) -> Column:
    return F.exists(c, test)


# -- IRIs -------------------------------------------------------------------

def local_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^#/]*)$", 1)


def humanise(name: Column) -> Column:
    """``has_PartOf`` -> ``has Part Of``."""
    return F.regexp_replace(F.regexp_replace(name, "_", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")


def namespace(iri: Column) -> Column:
    return F.regexp_extract(iri, r"^(.*[#/:])", 1)


def identifier_name(iri: Column) -> Column:
    return F.regexp_extract(iri, r"([^#/:]*)$", 1)


def compact_iri(iri: Column, own_namespace: str = "") -> Column:
    """Standard prefixes first, then the ontology's own namespace is dropped."""
    out = F.lit(None).cast("string")
    for prefix, base in PREFIXES.items():
        out = F.coalesce(out, F.when(iri.startswith(base),
                                     F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(base) + 1)))))
    if own_namespace:
        out = F.coalesce(out, F.when(iri.startswith(own_namespace) & (iri != own_namespace),
                                     F.substr(iri, F.lit(len(own_namespace) + 1))))
    return F.coalesce(out, iri)


def expand_iri(text: Column, own_namespace: str = "") -> Column:
    """Full IRI of what a user typed: ``<iri>``, ``prefix:name``, an absolute
    IRI, or a bare or ``:name`` in the own namespace."""
    t = F.trim(text)
    known = [F.when(F.substring_index(t, ":", 1) == prefix, F.concat(F.lit(base), t.substr(F.lit(len(prefix) + 2), F.length(t))))
             for prefix, base in PREFIXES.items()]
    bracketed = F.when(t.startswith("<") & t.endswith(">"), t.substr(F.lit(2), F.length(t) - 2))
    absolute = F.when(t.rlike(r"^[A-Za-z][-+.A-Za-z0-9]*:"), t)
    local = F.when(t != "", F.concat(F.lit(own_namespace), F.regexp_replace(t, "^:", "")))
    return F.when(t.isNotNull(), F.coalesce(bracketed, *[F.when(t.contains(":"), k) for k in known], absolute, local, F.lit("")))


def is_placeholder(iri: Column) -> Column:
    """Identifiers an editor makes up, such as ``NewClass2``."""
    # The placeholder stems.
    stems = "Class|Node|Entity|Individual|Instance|Property|ObjectProperty|DataProperty|AnnotationProperty"
    bare = F.regexp_replace(identifier_name(iri), r"[\s_-]", "")
    return ~iri.startswith("_:") & bare.rlike(f"(?i)^New(?:{stems})[0-9]*$")


# -- names ------------------------------------------------------------------

def _composed(form: str):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t.isascii() else unicodedata.normalize(form, t), na_action="ignore")
    return run


nfkc, nfc = _composed("NFKC"), _composed("NFC")


def normalize_name(text: Column) -> Column:
    """A standalone ``&`` reads as ``and``; ``R&D`` stays."""
    return F.regexp_replace(text, r"(?<=\s)&(?=\s)", "and")


def ampersand_synonym(name: Column) -> Column:
    """The spelling with ``&``, NULL when there is no standalone ``and``."""
    out = F.regexp_replace(name, r"(?i)(?<=\s)and(?=\s)", "&")
    return F.when(out != name, out)


def name_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(normalize_name(text)), F.lit(f"({_WORDS})"), 1)


def name_key(text: Column) -> Column:
    """Authoring identity of a name: its lowercase words."""
    t = nfkc(text)
    words = F.array_join(name_words(t), " ")
    return F.when(words != "", words).otherwise(F.lower(F.trim(t)))


def _camel_words(text: str) -> list[str]:
    """Words of a label; a capital starts one after a small letter or digit,
    and the last capital of a run does before a small letter."""
    text = unicodedata.normalize("NFKC", text)
    out, word = [], ""
    for i, c in enumerate(text):
        inside = c == "_" or unicodedata.category(c)[0] in "LNM"
        if inside and word and c.isupper():
            follows = text[i + 1:i + 2]
            if word[-1].islower() or unicodedata.category(word[-1])[0] == "N" or (word[-1].isupper() and follows.islower()):
                out, word = [*out, word], ""
        if inside:
            word += c
        elif word:
            out, word = [*out, word], ""
    return [*out, word] if word else out


@F.pandas_udf(StringType())
def _camel_case(labels: pd.Series) -> pd.Series:
    return labels.map(lambda t: "".join(w[0].upper() + w[1:].lower() for w in _camel_words(t)), na_action="ignore")


#: longest identifier made from a label
IDENTIFIER_LENGTH = 200


def identifier_from_label(label: Column, longest: int = IDENTIFIER_LENGTH) -> Column:
    """CamelCase identifier of at most ``longest`` characters, in NFKC;
    ``Entity`` stands in for, or before, what has no first letter."""
    name = _camel_case(normalize_name(label))
    return F.when(name.rlike(r"^\p{L}"), name).otherwise(F.concat(F.lit("Entity"), name)).substr(1, longest)


def title_case_query(text: Column) -> Column:
    """First letter of every word upper, the rest as typed."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


# The longest text that is taken for a name, and three patterns
# of what is not one (field query or CURIE; IRI in brackets or enclosed
# regular expression, caseless; operators of regular expressions).
NAME_LENGTH = 256
FIELD_QUERY = r"(?:^|\s)[\p{L}_][\p{L}\p{N}_-]*(?::[\p{L}_][\p{L}\p{N}_-]*)?:"
ENCLOSED = r"^<[^>]+>$|^\/.*\/[a-z]*$"
EXPRESSION = r"[\\^$*|]|\[[^\]]*\]|\(\?|\.\+|\{\d+(?:,\d*)?\}"


def can_name_entity(text: Column, longest: int = NAME_LENGTH) -> Column:
    """Free text, not an IRI, CURIE, field query or regular expression."""
    t = F.trim(text)
    return (F.length(t) > 0) & (F.length(t) <= longest) & ~t.rlike(FIELD_QUERY) & ~t.rlike("(?i)" + ENCLOSED) & ~t.rlike(EXPRESSION)


_TITLE_WORD = re.compile(r"[^\W_]+(?:[&'’][^\W_]+)*")


def title_phrase(text: Column, acronyms: dict[str, str] | None = None, function_words: tuple[str, ...] = ()) -> Column:
    """Title case that knows acronyms and keeps inner function words low.

    The caller supplies both word lists (``acronyms`` maps the upper-case
    spelling to its canonical one); mixed-case words are kept.
    """
    spelled, small = dict(acronyms or {}), {w.lower() for w in function_words}

    def title(phrase: str) -> str:
        phrase = " ".join(unicodedata.normalize("NFC", phrase).split())
        places = [m.span() for m in _TITLE_WORD.finditer(phrase)]
        out, at = [], 0
        for start, end in places:
            word = phrase[start:end]
            inner = places[0][0] < start and end < places[-1][1]
            uniform = word in (word.upper(), word.lower())
            new = spelled.get(word.upper()) or (word if not uniform else word.lower() if inner and word.lower() in small else word[0].upper() + word[1:].lower())
            out += [phrase[at:start], new]
            at = end
        return "".join([*out, phrase[at:]])

    @F.pandas_udf(StringType())
    def run(phrases: pd.Series) -> pd.Series:
        return phrases.map(title, na_action="ignore")

    return run(text)


# -- search text and distances ----------------------------------------------

@F.pandas_udf(StringType())
def _fold_marks(texts: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no native decomposition."""
    def fold(t):
        if t is None or t.isascii():
            return t
        return "".join(c for c in unicodedata.normalize("NFKD", t)
                       if not unicodedata.category(c).startswith("M"))
    return texts.map(fold, na_action="ignore")


def normalize_search(text: Column, ascii_only: bool = False) -> Column:
    """Search form: camel case split, no diacritics, lowercase words.

    ``ascii_only`` skips the Arrow round trip when the caller knows that the
    text carries no accents.
    """
    split = F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])", " ")
    folded = split if ascii_only else _fold_marks(split)
    return F.trim(F.regexp_replace(F.lower(folded), r"[^\p{L}\p{N}]+", " "))


def text_distance(a: Column, b: Column, threshold: int | None = None) -> Column:
    """Case-insensitive Levenshtein distance of the composed forms; -1 beyond ``threshold``."""
    a, b = nfc(a), nfc(b)
    if threshold is None:
        return F.levenshtein(F.lower(a), F.lower(b))
    return F.levenshtein(F.lower(a), F.lower(b), threshold)
