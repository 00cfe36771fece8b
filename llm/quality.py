r"""Quality rules: a threshold table compiled into one Spark projection.

Each row of the table is a measure, a comparison and integers: a document fails
when ``scale * measure  op  bound * base`` (base 1 where none is named).  The
table is compiled to one boolean column over the measures; measures are Spark
expressions of length, symbol, stop-word and line counts.  There are no user
functions, no shuffle, and each array (words, window hashes) is built once, in a
projection of its own.

Words that are part of repeated three-word windows are counted by sorting
(window hash, position) pairs within the row: n log n, so a long document made
of one repeated word costs no more than any other of its length.

Rules that know only some languages (``LANGUAGES``: function words, and word
lengths, which mean little in text without spaces) do not reject a document whose
language column names another one; no or a null language is judged by them.

Defined results: a null or blank text has no words and fails; repeated rows are
judged alike; a null id stays null; an empty table gives no rows; there is no
upper length; :func:`keep_good` leaves all other columns as they are, whatever
their names.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAPS = r"[\x20\x09-\x0D]+"
#: The word-separating characters and the symbols that are counted.
GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for with on by at from it as are this "
    "der die das und den von zu mit für ist im nicht ein eine auf sich "
    "le la les de des et un une du que est pour qui dans sur en "
    "el los las y una por con del se al lo como para"
).split()

#: Languages of STOP_WORDS, by the first letters of a language tag.
LANGUAGES = ("en", "de", "fr", "es")

_OPS = {"<": operator.lt, ">": operator.gt}


class Rule(NamedTuple):
    """Fails when scale * measure  op  bound * base; if spoken, only in a known language."""

    name: str
    measure: str
    op: str
    bound: int
    scale: int = 1
    base: str | None = None
    spoken: bool = False

    def column(self) -> Column:
        right = F.lit(self.bound) if self.base is None else F.lit(self.bound) * F.col(self.base)
        fails = _OPS[self.op](F.lit(self.scale) * F.col(self.measure), right)
        return fails & F.col("known_lang") if self.spoken else fails


BASE_RULES = (
    Rule("too_few_words", "n_words", "<", 50),
    Rule("repeated_windows", "n_repeat_words", ">", 50, 100, "n_words"),
)
METHOD_RULES = (
    Rule("short_words", "word_chars", "<", 2, 1, "n_words"),
    Rule("long_words", "word_chars", ">", 25, 1, "n_words", spoken=True),
    Rule("symbols", "n_symbols", ">", 15, 100, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 2, 100, "n_words", spoken=True),
    Rule("repeated_lines", "n_dup_lines", ">", 50, 100, "n_lines"),
)


def compiled(rules: Sequence[Rule]) -> Column:
    """True where any rule fails."""
    return reduce(operator.or_, (r.column() for r in rules), F.lit(False))


def measures(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs (its columns in a struct named row) with every measure."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    known = F.lit(True)
    if lang_col in docs.columns:
        known = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{lang_col}`"), "^[A-Za-z]+", 0)).isin("", *LANGUAGES), F.lit(True))
    words = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        text.alias("text"),
        known.alias("known_lang"),
        F.array_remove(F.split(text, GAPS), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, GAP_CHARS, "")) > 0).alias("lines"),
    )
    n = F.size("w")
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    windows = words.select(
        "*",
        F.sort_array(
            F.transform(
                at,
                lambda i: F.struct(
                    F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)).alias("h"), i.alias("i")
                ),
            )
        ).alias("g"),
    )
    same = lambda x, k: F.get("g", k).getField("h") == x.h
    starts = windows.select(
        "row", "text", "known_lang", "w", "lines",
        F.sort_array(F.transform(F.filter("g", lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x.i)).alias("s"),
    )
    # a window covers three words, fewer where the next repeated window begins sooner
    covered = F.aggregate(
        F.transform("s", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("s", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return starts.select(
        "row",
        "known_lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", GAP_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )


def judged(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", base: Sequence[Rule] = BASE_RULES, method: Sequence[Rule] = METHOD_RULES
) -> DataFrame:
    """The measures with base_failed and kept."""
    return measures(docs, text_col, lang_col).select("*", compiled(base).alias("base_failed")).select("*", (~F.col("base_failed") & ~compiled(method)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that no rule rejects.

    The verdict is taken by a generator and not by a filter: a filter would be
    pushed below the projections and build every array anew for each element.
    """
    verdict = F.explode(F.when(F.col("kept"), F.array("row")))
    return judged(docs, text_col, lang_col).select("row", "kept").select(verdict.alias("row")).select("row.*")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id and all measures and verdicts of every row."""
    lang = [F.col(f"`{lang_col}`").alias("lang")] if lang_col in docs.columns else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *lang)
    return judged(rows).select("row.doc_id", "*").drop("row", "known_lang")
