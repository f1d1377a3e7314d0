"""Sentence and clause boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.chars import ANY_SPACE, INLINE_SPACE
from quillspark.functions.columns import as_col, bind, strip

# The boundary rules.  The optional closing quote before the gap is
# swallowed; only ASCII capitals and digits open a new sentence.  Patterns start
# with the rare character, not with a look-behind, which would be tried at every
# position of the text; possessive quantifiers, as giving back could never help.
SENTENCE_GAP = rf"""([.!?])["']?+[{INLINE_SPACE}]++(?=["'(\[]?[A-Z0-9])"""
CLAUSE_GAP = rf"([,;:])[{ANY_SPACE}]+"
TERMINATED = r"[^.!?]*[.!?]"

# White space after and before a newline.  The latter is rare: a look back from
# each newline tells whether it occurs.  Its match can only start at the first
# character of a run, so a long run is scanned once.
_LINE_START = rf"\n[{ANY_SPACE}]+"
_HAS_LINE_END = rf"\n(?<=[{INLINE_SPACE}]\n)"
_LINE_END = rf"[{INLINE_SPACE}](?<![{INLINE_SPACE}]{{2}})[{INLINE_SPACE}]*+\n"


def sentence_lines(text: Column | str) -> Column:
    """The text with exactly one newline between stripped, non-empty sentences.

    Newlines always end a sentence, so none is left inside one and the newline
    is a separator that cannot clash with the text.
    """
    out = F.regexp_replace(as_col(text), SENTENCE_GAP, "$1\n")
    out = F.regexp_replace(out, _LINE_START, "\n")
    return strip(
        bind(
            out,
            lambda t: F.when(
                t.rlike(_HAS_LINE_END), F.regexp_replace(t, _LINE_END, "\n")
            ).otherwise(t),
        )
    )


def sentences(text: Column | str) -> Column:
    """Ordered sentences as an array."""
    return F.array_remove(F.split(sentence_lines(text), "\n", -1), "")


def clause_lines(sentence: Column | str) -> Column:
    """A sentence with a newline in place of the gap after ``, ; :``."""
    return F.regexp_replace(as_col(sentence), CLAUSE_GAP, "$1\n")


def clauses(sentence: Column | str) -> Column:
    return F.split(clause_lines(sentence), "\n", -1)


def longest_clause(text: Column | str) -> Column:
    """Length of the longest clause over all sentences, 0 when there is none."""
    lines = F.split(clause_lines(sentence_lines(text)), "\n", -1)
    return F.coalesce(F.array_max(F.transform(lines, lambda u: F.length(u))), F.lit(0))


def terminated_sentences(text: Column | str) -> Column:
    """Runs that end in ``. ! ?``; an unterminated tail is dropped."""
    return F.regexp_extract_all(as_col(text), F.lit(f"({TERMINATED})"), F.lit(1))
