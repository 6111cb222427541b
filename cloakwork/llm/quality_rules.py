"""Line-first cleaning with DataFrame expressions only.

Every line is judged on its own (punctuation, navigation, boilerplate); failing lines are removed, and a
document is rejected if too much of its text went with them. Everything is computed inside the row: no
shuffle, so hot sources and groups of copies cost no more than other rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANK, aside, whole_text

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MOST_MARKS = 5

#: Phrases of page furniture in the corpus's languages, matched without case at word boundaries.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "click here",
    "sign up now",
    "subscribe to our newsletter",
    "lorem ipsum",
    "powered by",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "javascript aktivieren",
    "hier klicken",
    "jetzt anmelden",
    "newsletter abonnieren",
    "zum inhalt springen",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions d'utilisation",
    "accepter les cookies",
    "activer javascript",
    "cliquez ici",
    "inscrivez-vous maintenant",
    "abonnez-vous à notre newsletter",
    "aller au contenu",
    "todos los derechos reservados",
    "política de privacidad",
    "términos de uso",
    "condiciones de uso",
    "aceptar cookies",
    "activar javascript",
    "haga clic aquí",
    "regístrese ahora",
    "suscríbase a nuestro boletín",
    "saltar al contenido",
)


def phrases(words: tuple[str, ...], at: int = 0) -> str:
    """A pattern for any of some phrases that tells them apart letter by letter, as a list of alternatives would be tried one by one."""
    branches = []
    for letter in sorted({w[at] for w in words if len(w) > at}):
        branches.append(re.escape(letter) + phrases(tuple(w for w in words if w[at : at + 1] == letter), at + 1))
    ends = any(len(w) == at for w in words)
    if not branches:
        return ""
    one = branches[0] if len(branches) == 1 and not ends else "(?:" + "|".join(branches) + ")"
    return one + "?" if ends else one


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\x0c\r"))


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and lines (array) to `df`.

    A null text has no words. Lines are split at newlines; only those with a word count.
    """
    words = F.split(F.col("_trim"), BLANK + "+")
    df = df.withColumn("_t", whole_text(text)).withColumn("_trim", _trimmed(F.col("_t")))
    df = df.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(words))
    df = df.withColumns(
        {
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.regexp_replace("_t", BLANK + "+", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long"),
            "lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_START)),
        }
    )
    many = F.size("_hash") - (WINDOW - 1)
    windows = F.transform(
        F.slice("_hash", 1, F.greatest(many, F.lit(0))), lambda _, i: F.xxhash64(F.slice(F.col("_hash"), i + 1, WINDOW))
    )
    df = df.withColumn("_win", windows)
    df = df.withColumn("_again", F.size("_win") > F.size(F.array_distinct("_win")))
    ordered = F.array_sort(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.col("_again"), ordered))

    def same(x: Column, j: Column) -> Column:
        near = lambda k: F.coalesce(F.get(F.col("_sorted"), k)["h"] == x["h"], F.lit(False))
        return near(j - 1) | near(j + 1)

    df = df.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", same), lambda x: x["i"])))
    covered = F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), j + 1) - p, F.lit(WINDOW))))
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
        }
    )
    return df.drop("_t", "_trim", "_words", "_hash", "_win", "_again", "_sorted", "_at")


WORD_START = r"[^\x20\x09-\x0D]"


#: A phrase begins and ends where no ASCII letter, digit or underscore goes on.
PHRASE_EDGE = r"(?<![0-9A-Za-z_])"
#: The same word four times in a row. {3,} would recurse for each further word and overflow the stack on a long line.
FILLER = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D])){3}"


def line_fails(line: Column, by_share: bool = False) -> Column:
    r"""True for a line that the punctuation, navigation or boilerplate rule removes.

    Punctuation: over MOST_MARKS symbols of #*$%&|<>~^={}\\ or doubled ! or ? for each 100 letters and digits, or neither at all.
    Navigation: three or more free-standing bars, guillemets, arrows or bullets, as in link rows.
    Boilerplate: a fixed phrase of page furniture, in a line of at most 30 words; or filler, the same word
    four times or more in a row. With `by_share`, bars must be one to ten words at least, and a fifth of the words
    lie in such fours: a long clean line is not removed for one stutter.
    """
    n = lambda c: F.char_length(c)
    marks = n(F.regexp_replace(line, r"[^#*$%&|<>~^={}\\]+", "")) + F.regexp_count(line, F.lit(r"[!?]{2,}"))
    letters = n(F.regexp_replace(line, r"[^\p{L}\p{N}]+", ""))
    bars = F.regexp_count(line, F.lit(r"\s[|»›>→•·]\s"))
    words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    phrase = line.rlike(rf"(?iu){PHRASE_EDGE}{phrases(BOILERPLATE)}(?![0-9A-Za-z_])")
    filler, links = line.rlike(FILLER), bars >= 3
    if by_share:
        filler &= F.regexp_count(line, F.lit(FILLER)) * (4 * 5) >= words
        links &= bars * 10 >= words
    return (letters == 0) | (marks * 100 > letters * MOST_MARKS) | links | (phrase & (words <= 30)) | filler


#: Columns of the steps between.
OWN = ("lines", "_t", "_trim", "_words", "_hash", "_win", "_again", "_sorted", "_at", "_judged")


def clean_lines(df: DataFrame, text: str = "text", most_lost: float = 0.3, least_words: int = 20, most_repeated: int = 30, by_share: bool = False) -> DataFrame:
    """Adds the counts, base_failed, clean_text (the text without the lines that fail), lost_chars, total_chars and kept to `df`.

    base_failed: fewer than `least_words` words, or over `most_repeated` percent of the words in repeated
    8-word windows. kept: not base_failed, and at most the share `most_lost` of the characters of lines
    with a word was removed. A null or empty text
    fails the base. Ties and repeated rows are judged alike; extra columns are carried along, but those named like a result are replaced.
    """
    df, back = aside(df, *(c for c in OWN if c != text))
    df = text_counts(df, text)
    judged = F.transform(F.split(whole_text(text), "\n"), lambda x: F.struct(x.alias("line"), x.rlike(WORD_START).alias("word"), (x.rlike(WORD_START) & line_fails(x, by_share)).alias("fails")))
    df = df.withColumn("_judged", judged)
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["line"]))
    passing = F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"])
    df = df.withColumns({"clean_text": F.array_join(passing, "\n"), "total_chars": size(F.filter("_judged", lambda x: x["word"])), "lost_chars": size(F.filter("_judged", lambda x: x["fails"]))})
    df = df.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    lost = F.col("lost_chars") > F.col("total_chars") * F.lit(most_lost)
    return df.withColumn("kept", ~F.col("base_failed") & ~lost).drop("_judged", "lines").withColumnsRenamed(back)


def kept_only(judged: DataFrame) -> DataFrame:
    """The rows of clean_lines() that are kept.

    The row number stops Spark from moving the filter below the counts, where their expressions would be
    written out many times over.
    """
    judged, back = aside(judged, "_row")
    return judged.withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0").drop("_row").withColumnsRenamed(back)
