"""Quality rules, lines first: bad lines go, then texts that lose too much.

Everything is computed within the row by built-in functions, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words, for regular expressions of Java and RE2 alike.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class LineRules:
    """When a line fails, and how much a text may lose.

    Punctuation: ``unpunctuated_words`` or more words and no punctuation at all. Navigation: at least
    ``least_separators`` words that are only a separator, and one for every ``words_per_separator`` words.
    Symbols: at least ``least_symbols`` symbol characters, and one for every ``words_per_symbol`` words.
    Shouting: ``shouting_words`` or more words, no lower-case letter. Boilerplate: at most ``boilerplate_words`` words and a
    phrase of ``boilerplate``. A text is rejected when the failing lines hold over ``lost_percent`` of its word characters.
    """

    unpunctuated_words: int = 40
    least_separators: int = 3
    words_per_separator: int = 8
    least_symbols: int = 6
    words_per_symbol: int = 2
    shouting_words: int = 8
    boilerplate_words: int = 20
    boilerplate: tuple[str, ...] = ("cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "sign in", "log in", "subscribe", "click here", "powered by", "skip to content", "read more")
    lost_percent: int = 50


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def _parts(docs: DataFrame, text_col: str) -> DataFrame:
    """Add _lines: (x, w), the lines with a word and their words; every text is split once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("x"), words_of(x).alias("w")))
    return docs.withColumn("_split", split).withColumn("_lines", F.filter("_split", lambda x: F.size(x["w"]) > 0)).drop("_split")


def _repeated(window: int) -> Column:
    """Words in a run of ``window`` words that is in _words more than once, from _runs, a hash of each run.

    Sorted runs with their places tell which are repeated; a place adds the words that the one before it left uncovered.
    """
    places = F.array_sort(F.transform("_runs", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    equal = F.zip_with(places, F.slice(places, 2, F.size("_runs")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["at"])).alias("n"), i.alias("at")),
    )
    return F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), covered["n"]).otherwise(F.lit(0))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and _lines for what follows.

    Runs of words are compared by 64-bit hashes: those of the words, shifted by their place and added bit by bit, in three steps of pairs.
    Most texts repeat none, which the count of distinct hashes tells; only the others sort their runs.
    """
    window = 8
    df = _parts(docs, text_col).withColumn("_words", F.flatten(F.transform("_lines", lambda x: x["w"])))
    runs = F.transform("_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_runs", runs)
    for step in (1, 2, 4):
        shifted = F.slice("_runs", step + 1, F.greatest(F.size("_runs") - step, F.lit(0)))
        kept = F.slice("_runs", 1, F.greatest(F.size("_runs") - step, F.lit(0)))
        df = df.withColumn("_runs", F.zip_with(kept, shifted, lambda a, b: F.shiftleft(a, step).bitwiseXOR(b)))  # noqa: B023
    joined = F.array_join("_words", "")
    return df.withColumns(
        {
            "n_words": _size(F.col("_words")),
            "word_chars": F.length(joined).cast("long"),
            "n_symbols": (F.length(joined) - F.length(F.regexp_replace(joined, r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": _size(F.col("_lines")) - _size(F.array_distinct(F.transform("_lines", lambda x: x["x"]))),
            "n_repeat_words": _repeated(window).cast("long"),
        }
    ).drop("_words", "_runs")


#: What stands alone between the entries of a navigation line, and the symbols of a line of them.
SEPARATORS = r"[|>»›·•/—-]"
SYMBOLS = r"[#*$%&<>^~=+@{}\\]"


def line_fails(line: Column, words: Column, low: Column, rules: LineRules) -> Column:
    """Whether a line with these words fails; ``low`` is the line in lower case, needed for short ones.

    All three are columns, so that nothing is made twice, and what is cheap comes first: an expression within a
    lambda is worked out wherever it stands, but not behind a condition that fails.
    """
    n = F.size(words)
    without = lambda marks: F.length(line) - F.length(F.regexp_replace(line, marks, ""))
    alone = F.size(F.filter(words, lambda w: w.rlike(f"^{SEPARATORS}+$")))
    phrase = F.lit(False)
    for p in rules.boilerplate:
        phrase = phrase | low.contains(p)
    return (
        ((n >= rules.unpunctuated_words) & ~line.rlike(r"\p{P}"))
        | ((n >= rules.shouting_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"))
        | ((n <= rules.boilerplate_words) & phrase)
        | (line.rlike(SEPARATORS) & (without(SEPARATORS) >= rules.least_separators) & (alone >= rules.least_separators) & (alone * rules.words_per_separator >= n))
        | (line.rlike(SYMBOLS) & (without(SYMBOLS) >= rules.least_symbols) & (without(SYMBOLS) * rules.words_per_symbol >= n))
    )


def judge(docs: DataFrame, *, text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """``docs`` with the measures, base_failed, lost_chars, cleaned (the text without failing lines) and kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated runs of 8. kept: neither base_failed nor
    more than ``lost_percent`` of the word characters in failing lines. Null counts as an empty text, and
    fails for want of words, as empty ones do. Texts of any length are judged whole, within their row. Lines are compared exactly;
    rows that repeat are judged alike. An empty table gives an empty result. Columns of ``docs`` named like a
    new one give way to it.
    """
    rules = rules or LineRules()
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "cleaned", "kept")
    own = [c for c in docs.columns if c not in new]
    df = measure(docs.select(*[f"`{c}`" for c in own]), text_col)
    short = F.transform("_lines", lambda x: F.struct(x["x"].alias("x"), x["w"].alias("w"), F.when(F.size(x["w"]) <= rules.boilerplate_words, F.lower(x["x"])).alias("low")))
    marked = F.transform("_lines", lambda x: F.struct(x.alias("l"), line_fails(x["x"], x["w"], x["low"], rules).alias("bad")))
    df = df.withColumn("_lines", short).withColumn("_marked", marked)
    lost = F.aggregate("_marked", F.lit(0), lambda n, x: n + F.when(x["bad"], F.length(F.array_join(x["l"]["w"], ""))).otherwise(0))
    good = F.transform(F.filter("_marked", lambda x: ~x["bad"]), lambda x: x["l"]["x"])
    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
            "lost_chars": lost.cast("long"),
            "cleaned": F.array_join(good, "\n"),
        }
    )
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.lost_percent)
    return df.withColumn("kept", kept).select(*[f"`{c}`" for c in own], *new)


def keep_good(docs: DataFrame, *, text_col: str = "text", rules: LineRules | None = None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns, whatever their names; texts stay whole.

    The counts that are observed on the way also hold the filter above them: pushed
    below, it would repeat the measures in its condition many times over.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    judged = judge(rows, text_col="_text", rules=rules).select("_row", "kept")
    counted = judged.observe("quality_rules", F.count("*").alias("judged"), F.count_if("kept").alias("kept"))
    return counted.where("kept").select("_row.*")
