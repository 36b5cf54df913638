"""Line-first cleaning and document rules, in Spark SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import documents

BLANK = r"[ \t-\r]+"
#: Phrases of page furniture.
BOILERPLATE = ["lorem ipsum", "javascript", "cookie policy", "use of cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "skip to content", "click here", "sign up now", "log in to", "read more"]
#: What may end a sentence.
TERMINAL = ".!?:;…\"')]»”。！？"


#: SQL: whether a line x fails.
FAILS = "(x.pipes >= 2 and 5 * x.pipes >= x.n) or (x.marks > 0 and 5 * x.marks >= x.n) or x.other or (x.n < 4 and not x.ended)"


def _any(text: str) -> str:
    """SQL: whether a text has one of the phrases of BOILERPLATE."""
    return " or ".join(f"contains({text}, '{x}')" for x in BOILERPLATE)


def _words(text: str) -> str:
    """SQL: the array of words of a text, empty without words."""
    trimmed = rf"trim(both ' \t\n\u000b\u000c\r' from {text})"
    return rf"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '{BLANK}'))"


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: int = 40) -> DataFrame:
    """Counts and verdicts of each row of docs.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, then n_lines (with a
    word), n_lines_failed, chars_lost and cleaned (the text without its failed lines; its other lines, repeats and
    blank ones too, stay in order). A line (of as many words as
    blanks, and one) fails by
    - navigation: two | at least, one for five words or more;
    - punctuation: runs of symbols, or of ! and ?, one for five words or more; no letter at all; or fewer than four
      words without punctuation at the end;
    - boilerplate: a phrase of page furniture.
    A document is kept unless base_failed (under ten words, or over a fifth of them in repeated 5-word windows) or
    more than most_lost percent of the characters of its lines are in failed lines. Null and empty texts have no words: all counts 0,
    base_failed, not kept, cleaned '', as where all lines with a word failed. Null and repeated ids stay, one row each; an empty table gives an empty table;
    other columns are ignored.
    """
    src = documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = src.select(
        "doc_id", "text", F.expr(_words("text")).alias("words"), F.split("text", "\n").alias("every"), F.expr(r"filter(split(text, '\n'), l -> l rlike '[^ \t-\r]')").alias("lines"), F.expr("cast(regexp_count(text, '[#*$%&|<>]') as long)").alias("n_symbols"),
        F.expr("text rlike '[#*$%&<>!?]{2}'").alias("marked"), F.expr(_any("lower(text)")).alias("furnished"),
    )
    counted = split.select(
        "doc_id", "text", "words", "lines", "n_symbols", F.expr("cast(size(words) as long)").alias("n_words"), F.expr("cast(length(array_join(words, '')) as long)").alias("word_chars"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("word_hashes"),
        F.expr(rf"""transform(every, l -> named_struct('line', l, 'blank', not l rlike '[^ \t-\r]', 'c', length(l), 'n', length(l) - length(replace(l, ' ', '')) + 1,
            'pipes', if(n_symbols > 0, length(l) - length(replace(l, '|', '')), 0),
            'marks', if(marked, greatest(regexp_count(l, '[#*$%&<>]{{2,}}'), regexp_count(l, '[!?]{{2,}}')), 0),
            'other', not l rlike '\\p{{L}}' or (furnished and ({_any("lower(l)")})),
            'ended', instr('{TERMINAL.replace("'", "\\'")}', right(rtrim(l), 1)) > 0))""").alias("of_every"),
    )
    counted = counted.withColumn("of_lines", F.expr("filter(of_every, x -> not x.blank)"))
    # windows whose hash, of the hashes of their words, comes twice are looked at as text, in sorted order
    hashed = counted.withColumn("hashes", F.expr("if(size(words) < 6, cast(array() as array<bigint>), transform(sequence(0, size(words) - 5), i -> xxhash64(get(word_hashes, i), get(word_hashes, i + 1), get(word_hashes, i + 2), get(word_hashes, i + 3), get(word_hashes, i + 4))))"))
    ordered = hashed.withColumn("ordered", F.expr("if(size(array_distinct(hashes)) = size(hashes), null, array_sort(transform(hashes, (h, i) -> struct(h as h, i as i))))"))
    twice = ordered.withColumn("twice", F.expr("filter(ordered, (x, k) -> (k > 0 and get(ordered, k - 1).h = x.h) or (get(ordered, k + 1).h <=> x.h))"))
    windows = twice.withColumn("windows", F.expr("array_sort(transform(twice, x -> named_struct('w', array_join(slice(words, x.i + 1, 5), ' '), 'i', x.i)))"))
    judged = windows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "of_lines",
        F.expr("if(windows is null, null, array_sort(transform(filter(windows, (x, k) -> (k > 0 and get(windows, k - 1).w = x.w) or (get(windows, k + 1).w <=> x.w)), x -> x.i)))").alias("repeated"),
        F.expr(f"filter(of_lines, x -> {FAILS})").alias("failed"), F.expr(f"filter(of_every, x -> x.blank or not ({FAILS}))").alias("left"),
    )
    done = judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        # each repeated window adds the words up to the next one, five at most
        F.expr("if(repeated is null or size(repeated) = 0, 0L, cast(5 + aggregate(sequence(1, size(repeated)), 0, (a, k) -> a + if(k < size(repeated), least(5, get(repeated, k) - get(repeated, k - 1)), 0)) as long))").alias("n_repeat_words"),
        F.expr("cast(size(of_lines) as long)").alias("n_lines"), F.expr("cast(size(failed) as long)").alias("n_lines_failed"),
        F.expr("aggregate(failed, 0L, (a, x) -> a + x.c)").alias("chars_lost"), F.expr("aggregate(of_lines, 0L, (a, x) -> a + x.c)").alias("chars"),
        F.expr(r"if(size(failed) = size(of_lines), '', array_join(transform(left, x -> x.line), '\n'))").alias("cleaned"),
    )
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & (100 * F.col("chars_lost") <= most_lost * F.col("chars"))).alias("kept"), "n_lines", "n_lines_failed", "chars_lost", "cleaned",
    )
