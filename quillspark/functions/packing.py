"""Greedy packing of sentences into length-bounded chunks.

Packing is "take as many whole sentences as fit".  With sentences separated by
one newline, and joined in a chunk by one space, separator and joiner have the
same length, so a chunk is the longest run of at most ``budget`` characters that
ends at a newline: one greedy regular expression packs a whole chapter in a
single linear pass on the JVM, without a fold that copies its state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.chars import ANY_SPACE, STRIP_CHARS
from quillspark.functions.columns import as_col, bind
from quillspark.functions.segment import clause_lines, sentence_lines

# Between chunks; single newlines inside a chunk become spaces afterwards.
_CHUNK_END = "\n\n"


def _over(budget: int) -> str:
    """Pattern that finds a line longer than the budget, tried at line starts only."""
    return rf"(?dm)^[^\n]{{{budget + 1}}}"


def _pack(lines: Column, budget: int) -> Column:
    """Newline-separated units to chunks, each closed by a blank line.

    A unit longer than the budget stays alone and whole.
    """
    closed = F.regexp_replace(lines, rf"(?s)(.{{1,{budget}}}|[^\n]+)(?:\n|\z)", "$1" + _CHUNK_END)
    return F.regexp_replace(closed, r"\n(?<!\n\n)(?!\n)", " ")


def _pack_ragged_words(sentence: Column, budget: int) -> Column:
    """Word packing for sentences with other white space next to a blank.

    Joining strips such a word when it is appended but keeps it as it is when it
    opens a piece, so lengths depend on the history and a fold is needed.
    """
    def step(state: Column, word: Column) -> Column:
        joined = F.btrim(F.concat(state["open"], F.lit(" "), word), F.lit(STRIP_CHARS))
        full = (F.length(joined) > budget) & (state["open"] != "")
        return F.struct(
            F.when(full, F.concat(state["done"], state["open"], F.lit(_CHUNK_END)))
            .otherwise(state["done"]).alias("done"),
            F.when(full, word).otherwise(joined).alias("open"),
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))
    return F.aggregate(
        F.split(sentence, " ", -1), start, step,
        lambda s: F.concat(s["done"], s["open"], F.lit(_CHUNK_END)),
    )


def _hard_pack(sentence: Column, budget: int) -> Column:
    """Clauses if every clause fits, else words, for one sentence."""
    ragged = rf" [{ANY_SPACE}&&[^ ]]|[{ANY_SPACE}&&[^ ]] "
    return bind(
        clause_lines(sentence),
        lambda units: F.when(~units.rlike(_over(budget)), _pack(units, budget))
        .when(sentence.rlike(ragged), _pack_ragged_words(sentence, budget))
        .otherwise(_pack(F.regexp_replace(sentence, " +", "\n"), budget)),
    )


def _pieces(packed: Column) -> Column:
    return F.array_remove(F.split(packed, _CHUNK_END, -1), "")


def _check(budget: int) -> int:
    if budget < 1:
        raise ValueError("budget must be at least 1")
    return int(budget)


def hard_split(sentence: Column | str, budget: int = 500) -> Column:
    """Pieces of one over-long sentence: clauses, or words as a last resort."""
    return _pieces(_hard_pack(as_col(sentence), _check(budget)))


def chunks(text: Column | str, budget: int = 500) -> Column:
    """Ordered chunks of at most ``budget`` characters made of whole sentences.

    A sentence over the budget closes the running chunk and is cut into pieces
    of its own; only a single word can exceed the budget.
    """
    budget = _check(budget)

    def cut_long(lines: Column) -> Column:
        # Long sentences are fenced off by blank lines, the stretches between
        # the fences are packed separately.
        fenced = F.array_join(
            F.transform(
                F.split(lines, "\n", -1),
                lambda s: F.when(
                    F.length(s) > budget, F.concat(F.lit(_CHUNK_END), _hard_pack(s, budget))
                ).otherwise(s),
            ),
            "\n",
        )
        stretches = F.split(fenced, r"\n{2,}", -1)
        return F.array_join(F.transform(stretches, lambda s: _pack(s, budget)), "")

    packed = bind(
        sentence_lines(text),
        lambda lines: F.when(lines.rlike(_over(budget)), cut_long(lines)).otherwise(
            _pack(lines, budget)
        ),
    )
    return _pieces(packed)
