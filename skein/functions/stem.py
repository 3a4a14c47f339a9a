"""Lexemes of Spanish texts: words without accents, without function words, as stems.

The stems are those of the published Spanish suffix-stripping algorithm (regions RV, R1 and
R2, an attached pronoun, a standard or a verb suffix, a residual vowel) for words whose
accents were removed before, as a catalog's search does: endings that are written with
an accent only never match.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import normalize_text

# Function words.
STOP_WORDS = frozenset(
    "de la que el en y a los del se las por un para con no una su al lo como pero sus le ya o este si porque esta entre cuando muy sin sobre"
    " tambien me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mi antes algunos unos yo"
    " otro otras otra tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mis tu te ti tus ellas vosotros".split()
)
# Pronouns that verbs carry at their end, and the verb endings before them.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "iendo ando ar er ir".split()
# Standard suffixes, by what is done with them.
DELETED = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
).split()
AFTER_IC = "adora ador acion adoras adores aciones ante antes ancia ancias".split()
REPLACED = {"ucion": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
LONGER = {  # endings that may stand before, deleted too
    "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv"),
    "iva": ("at",), "ivo": ("at",), "ivas": ("at",), "ivos": ("at",),
}
# Verb endings: those with y, those that may follow gu, all others.
WITH_Y = "ya ye yan yen yeron yendo yo yas yes yais yamos".split()
AFTER_GU = "en es emos".split()
VERB = (
    "aremos eremos iremos aba ada ida ara iera ad ed id ase iese aste iste an aban aran ieran asen iesen aron ieron ado ido ando iendo"
    " ar er ir as abas adas idas aras ieras ases ieses abais arais ierais aseis ieseis asteis isteis ados idos amos imos"
).split()
RESIDUAL = "os a o".split()


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    n, is_vowel = len(word), [c in "aeiou" for c in word]

    def behind(start: int, vowel: bool) -> int:
        return next((i + 1 for i in range(start, n) if is_vowel[i] == vowel), n)

    def after_pair(start: int) -> int:
        first = behind(start, True)
        return behind(first, False) if first < n or n and is_vowel[-1] else n

    if n < 2:
        rv = n
    elif not is_vowel[1]:
        rv = behind(2, True)
    else:
        rv = behind(2, False) if is_vowel[0] else min(3, n)
    r1 = after_pair(0)
    return rv, r1, after_pair(r1)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    rv, r1, r2 = regions(word)

    def cut(w: str, endings, at: int) -> str:
        """w without the longest of the endings, if that begins at ``at`` or behind."""
        e = _longest(w, endings)
        return w[: len(w) - len(e)] if e and len(w) - len(e) >= at else w

    pronoun = _longest(word, PRONOUNS)
    if pronoun:
        base = word[: -len(pronoun)]
        verb = _longest(base, [*BEFORE_PRONOUN, "yendo"])
        if verb and len(base) - len(verb) >= rv and (verb != "yendo" or base.endswith("uyendo")):
            word = base
    out = _standard(word, r1, r2, cut)
    if out is None:
        e = _longest(word[rv:], WITH_Y)
        if e and word[: len(word) - len(e)].endswith("u"):
            out = word[: len(word) - len(e)]
        else:
            e = _longest(word[rv:], [*AFTER_GU, *VERB])
            out = word[: len(word) - len(e)]
            if e in AFTER_GU and out.endswith("gu"):
                out = out[:-1]
    if out.endswith("e") and len(out) - 1 >= rv and not _longest(out, RESIDUAL):
        out = out[:-1]
        return out[:-1] if out.endswith("gu") and len(out) - 1 >= rv else out
    return cut(out, RESIDUAL, rv)


def _standard(word: str, r1: int, r2: int, cut) -> str | None:
    """The word without its standard suffix; None where it has none in its region."""
    e = _longest(word, [*DELETED, *AFTER_IC, *REPLACED, *LONGER, "amente"])
    at = len(word) - len(e)
    if not e or at < (r1 if e == "amente" else r2):
        return None
    out = word[:at]
    if e in AFTER_IC:
        return cut(out, ("ic",), r2)
    if e in REPLACED:
        return out + REPLACED[e]
    if e in LONGER:
        return cut(out, LONGER[e], r2)
    if e == "amente":
        less = cut(out, ("iv", "os", "ic", "ad"), r2)
        return cut(less, ("at",), r2) if less != out and out.endswith("iv") else less
    return out


def placed_words(text: Column, stop: frozenset[str] = STOP_WORDS) -> Column:
    """array<struct<pos, word>> of a text: its words but the stop words, which keep their places,
    from 1; a null text has none."""
    words = F.regexp_extract_all(F.coalesce(normalize_text(text), F.lit("")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.transform(words, lambda w, k: F.struct((k + 1).alias("pos"), w.alias("word"))), lambda x: ~x["word"].isin(*sorted(stop)))


def stemmed(word: Column) -> Column:
    """The stem of each word. To be used on a row per word: then a batch of Arrow holds some
    ten thousand words, not the words of as many texts."""
    return F.pandas_udf(lambda words: words.map(stem, na_action="ignore"), "string")(word)
