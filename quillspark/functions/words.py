"""Word-level column functions: runs, gates and whole-word patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.chars import NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD
from quillspark.functions.columns import as_col

RUN = f"[{WORD}]+"


def runs(text: Column | str) -> Column:
    """Maximal runs of word characters, in order."""
    return F.regexp_extract_all(as_col(text), F.lit(f"({RUN})"), F.lit(1))


def lower_runs(text: Column | str) -> Column:
    """Distinct lower-cased runs; the empty string stands for "any text"."""
    return F.array_append(F.array_distinct(runs(F.lower(as_col(text)))), F.lit(""))


def first_run(word: Column | str) -> Column:
    """The run an entry can be looked up by; empty when it has none."""
    return F.regexp_extract(F.lower(as_col(word)), RUN, 0)


def is_single_run(word: Column | str) -> Column:
    return as_col(word).rlike(f"^{RUN}$")


def is_candidate_shape(word: Column | str) -> Column:
    """Letters only, at least two, and not a Roman numeral in capitals."""
    word = as_col(word)
    return word.rlike(r"^\p{L}{2,}$") & ~word.rlike("^[IVXLCDM]+$")


def spellings(word: Column | str) -> list[Column]:
    """The four ways a word is looked up: as is, lower, capitalised, upper."""
    word = as_col(word)
    return [word, F.lower(word), F.initcap(word), F.upper(word)]


def quote(word: Column | str) -> Column:
    r"""A word as a literal inside a pattern; an ``\E`` in it cannot end the quote."""
    return F.concat(
        F.lit("\\Q"), F.replace(as_col(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )


def whole_word_pattern(word: Column | str) -> Column:
    """Case-insensitive whole-word pattern.

    An edge that is itself no word character needs a word character next to it,
    as a word boundary does.
    """
    word = as_col(word)
    before = F.when(word.rlike(f"^[{WORD}]"), NOT_AFTER_WORD).otherwise(f"(?<=[{WORD}])")
    after = F.when(word.rlike(f"[{WORD}]$"), NOT_BEFORE_WORD).otherwise(f"(?=[{WORD}])")
    return F.concat(F.lit("(?iu)"), before, quote(word), after)


def contains_word(text: Column | str, word: Column | str) -> Column:
    return F.call_function("rlike", as_col(text), whole_word_pattern(word))


def override(text: Column | str, word: Column | str, ipa: Column | str) -> Column:
    """Rewrite every occurrence of one word as ``[word](/ipa/)``, keeping its casing."""
    literal_ipa = F.regexp_replace(as_col(ipa), r"([\\$])", r"\\$1")
    return F.call_function(
        "regexp_replace",
        as_col(text),
        whole_word_pattern(word),
        F.concat(F.lit("[$0](/"), literal_ipa, F.lit("/)")),
    )
