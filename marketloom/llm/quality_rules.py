"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule bounds ``100 * numerator / denominator`` of two counts of the text, in integers, so that
no rounding decides. A document is kept if no base rule and no row of the table rejects it.

Defined cases: a null or empty text has no words and fails the base rule; null ids pass through;
repeated rows are judged alike; extra columns stay out of the result of ``measure`` unless named in
``keep``. A rule whose denominator is 0 holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it with as was on are by this be an at from he which or have not but "
    "le la les de des et en un une du que qui dans pour par sur au aux il elle est pas "
    "der die das und den von zu mit sich auf für im dem nicht ein eine als ist "
    "el los las y se del con para su al lo como una por es"
).split()
#: A character of a word.
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Symbols without the bar, which also draws tables.
MARKS = SYMBOLS.replace("|", "")
MIN_WORDS = 50
MAX_REPEAT_PCT = 50


@dataclass(frozen=True)
class Rule:
    """100 * numerator >= at_least * denominator and 100 * numerator <= at_most * denominator."""

    name: str
    numerator: str
    denominator: str
    at_least: int | None = None
    at_most: int | None = None

    def holds(self) -> Column:
        num, den = F.col(self.numerator) * 100, F.col(self.denominator)
        ok = F.lit(True)
        if self.at_least is not None:
            ok = ok & (num >= den * self.at_least)
        if self.at_most is not None:
            ok = ok & (num <= den * self.at_most)
        return ok


#: Percentages. Repeated lines weigh by their characters, so a short line that stands twice in a text of
#: few lines does not reject it. A mean word length of 3.0 to 9.0 characters is 300 to 900.
RULES = (
    Rule("word_length", "word_chars", "n_words", 300, 900),
    Rule("symbol_ratio", "n_marks", "n_words", None, 10),
    Rule("exclamation_ratio", "n_exclamations", "n_words", None, 20),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 6, None),
    Rule("dup_line_ratio", "dup_line_chars", "line_chars", None, 30),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 30),
)
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_marks", "n_exclamations", "n_stop_words", "n_lines", "line_chars", "dup_line_chars", "n_bullet_lines", "n_ellipsis_lines",
)


def _occurrences(text: str, chars: str) -> str:
    return f"regexp_count({text}, '[{chars}]')"


def _beside(sorted_rows: str, field: str) -> str:
    """A lambda: whether a row of a sorted array has a neighbour with an equal field."""
    near = (f"coalesce(x.{field} = get({sorted_rows}, k {step} 1).{field}, false)" for step in "-+")
    return f"(x, k) -> {' or '.join(near)}"


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The counts of every text beside the columns ``keep``."""
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    held = [f"_keep{i}" for i in range(len(keep))]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    split = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        *held,
        "_text",
        F.filter(F.split("_text", SPACES), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("_lines"),
    )
    # Most texts repeat no window: distinct hashes prove it. Of the others only windows whose hash occurs
    # again are compared by their words, in order, so that equal ones stand side by side.
    hashed = split.withColumn(
        "_hashes",
        F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"),
    )
    ordered = hashed.withColumn(
        "_ordered",
        F.expr("if(size(array_distinct(_hashes)) = size(_hashes), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(_hashes, (h, i) -> struct(h as h, i as i))))"),
    )
    grams = ordered.withColumn(
        "_grams",
        F.expr(f"sort_array(transform(filter(_ordered, {_beside('_ordered', 'h')}), x -> struct(concat_ws(' ', _words[x.i], _words[x.i + 1], _words[x.i + 2]) as g, x.i as i)))"),
    )
    starts = grams.withColumn("_starts", F.expr(f"sort_array(transform(filter(_grams, {_beside('_grams', 'g')}), x -> x.i))"))
    return starts.select(
        *[F.col(h).alias(c) for h, c in zip(held, keep, strict=True)],
        F.expr("cast(size(_words) as bigint)").alias("n_words"),
        F.expr("cast(char_length(array_join(_words, '')) as bigint)").alias("word_chars"),
        F.expr(f"cast({_occurrences('_text', SYMBOLS)} as bigint)").alias("n_symbols"),
        F.expr("cast(size(_lines) - size(array_distinct(_lines)) as bigint)").alias("n_dup_lines"),
        # a window that starts at p covers words p to p + 2; last is the start before it
        F.expr(
            "aggregate(_starts, struct(0L as n, -3 as last), (a, p) -> struct(a.n + least(3, p - a.last) as n, p as last), a -> a.n)"
        ).alias("n_repeat_words"),
        F.expr(f"cast({_occurrences('_text', MARKS)} as bigint)").alias("n_marks"),
        F.expr(f"cast({_occurrences('_text', '!')} as bigint)").alias("n_exclamations"),
        F.expr(f"cast(size(filter(_words, w -> lower(trim(BOTH '.,;:!?' FROM w)) IN ({stop}))) as bigint)").alias("n_stop_words"),
        F.expr("cast(size(_lines) as bigint)").alias("n_lines"),
        F.expr("cast(char_length(array_join(_lines, '')) as bigint)").alias("line_chars"),
        F.expr("cast(char_length(array_join(_lines, '')) - char_length(array_join(array_distinct(_lines), '')) as bigint)").alias("dup_line_chars"),
        F.expr("cast(size(filter(_lines, x -> substr(ltrim(x), 1, 1) IN ('-', '*', '•'))) as bigint)").alias("n_bullet_lines"),
        F.expr("cast(size(filter(_lines, x -> rtrim(x) LIKE '%...')) as bigint)").alias("n_ellipsis_lines"),
    )


def judge(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, kept and failed_rules (names, comma-joined) in one projection."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    failed = F.concat_ws(",", *[F.when(~r.holds(), F.lit(r.name)) for r in rules])
    all_hold = F.lit(True)
    for r in rules:
        all_hold = all_hold & r.holds()
    return counts.withColumns({"base_failed": base, "kept": ~base & all_hold, "failed_rules": failed})


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns in one pass (no join back).

    The filter also names a row number, which is not deterministic: the optimizer would otherwise push
    ``kept`` below the projections and write out every nested count once per reference.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_d{i}" for i in range(len(names))])
    at = names.index("text")
    judged = judge(measure(plain, tuple(plain.columns), f"_d{at}"), rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter("kept and _row >= 0").select(*[F.col(f"_d{i}").alias(c) for i, c in enumerate(names)])
