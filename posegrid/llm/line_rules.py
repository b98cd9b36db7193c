"""Line-first quality rules, in DataFrame expressions only.

Every line of a document is judged by itself: punctuation (symbols on its words, shouted marks, or a
fragment without an end mark), navigation (separators between its words, or a short menu entry) and
boilerplate (phrases of notices). Lines that fail are removed; a document is then rejected when the
words lost are more than ``LOST_PERCENT`` percent of its words. Documents with too few words or too
many repeated three-word windows are rejected before that.

One pass over the rows, no shuffle: counts are array expressions within a row, the repeated windows by
sorting the row's window hashes, so that no window of one text meets those of another.

Defined cases: null text has no words and fails; a line without words is neither judged nor kept count
of; repeated rows are judged alike, and a verdict follows a row's text alone, so there are no ties; a text of any length is judged
whole, in memory of some times its size (its window hashes are sorted in its row); no rows, no result rows; other columns pass through ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held, packed_rows, unpacked

#: Bounds of the document rules.
LEAST_WORDS = 50
REPEAT_PERCENT = 50
LOST_PERCENT = 30

# White space, and the characters counted as symbols.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[ \t-\r]+"
WORD_CHAR = r"[^ \t-\r]"
SYMBOLS = "#*$%&|<>"
MARKS = "[#*$%&<>]"

#: A line fails the punctuation rule when this many percent of its words carry symbols or "!!".
MARKED_PERCENT = 20
#: Or when it is this short and has no end mark.
FRAGMENT_WORDS = 3
END_MARK = r"[.!?…:;,)\]\"'”’»。！？]\s*$"
#: A line fails the navigation rule with this many separators, being this share of its words.
SEPARATORS, SEPARATOR_PERCENT = 3, 20
SEPARATOR_CHARS = "[|›»•·→]"
MENU_WORDS = 6
MENU = r"(?i)^\W*(home|menu|log ?in|sign (in|up)|next|previous|back to top|contact( us)?|about( us)?|site ?map|search|skip to content|read more|share)\b"
#: A line fails the boilerplate rule when it has one of these phrases and is no longer than this.
NOTICE_WORDS = 40
NOTICE = (
    r"(?i)(all rights reserved|terms of (use|service)|privacy policy|cookie(s)? (policy|notice|settings)|we use cookies"
    r"|enable javascript|javascript is (disabled|required)|subscribe to our|sign up for our|click here to|powered by"
    r"|copyright (\(c\)|©|[0-9]{4})|lorem ipsum)"
)
NOTICE_HINTS = ("rights", "terms", "privacy", "cookie", "javascript", "subscribe", "sign up", "click", "powered", "copyright", "lorem")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _without(text: Column, of: str) -> Column:
    """Text without some characters, each taken out by a plain search."""
    for char in of:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def line_fails(line: Column, may_notice: Column) -> Column:
    """Whether a line with a word fails one of the three rules. Words are counted by the spaces between them.

    ``may_notice``: whether the document has a word of a notice at all.
    """
    bare = F.trim(line)
    n = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
    marked = _count(line, MARKS) + (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit(""))))
    punctuation = (marked * 100 > n * MARKED_PERCENT) & (marked >= 3) | (n <= FRAGMENT_WORDS) & ~line.rlike(END_MARK)
    bars = _count(line, SEPARATOR_CHARS)
    navigation = (bars >= SEPARATORS) & (bars * 100 >= n * SEPARATOR_PERCENT) | (n <= MENU_WORDS) & line.rlike(MENU)
    boilerplate = may_notice & (n <= NOTICE_WORDS) & line.rlike(NOTICE)
    return punctuation | navigation | boilerplate


def _may_notice(text: Column) -> Column:
    """A cheap necessary condition of NOTICE: one of its words, in any case."""
    low = F.lower(text)
    found = F.lit(False)
    for hint in NOTICE_HINTS:
        found = found | F.contains(low, F.lit(hint))
    return found


def _window_hashes(words: Column) -> Column:
    """Hash of every three-word window. ``words`` must be a column, as it is looked into at every place."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>"))


def _equal_neighbours(at: Column, same) -> Column:
    """Elements of a sorted array that ``same`` ties to the one before or after."""
    tied = lambda x, j: F.coalesce(same(x, F.get(at, j + 1)), F.lit(False)) | F.coalesce((j > 0) & same(x, F.get(at, F.greatest(j - 1, F.lit(0)))), F.lit(False))
    return F.filter(at, tied)


def _with_repeats(rows: DataFrame) -> DataFrame:
    """Adds _again: places of the windows of ``_words`` that are found twice or more, in ascending order.

    Hashes are sorted with their places in their low bits, as plain longs. Should two different hashes
    of a text agree in the remaining bits, its full hashes are sorted beside their places instead.
    """
    rows = held(rows, _hashes=_window_hashes(F.col("_words")))
    hashes = F.col("_hashes")
    rows = rows.withColumn("_bits", F.ceil(F.log2(F.size("_hashes") + 1.0)).cast("int"))
    packed = F.expr("transform(_hashes, (h, i) -> shiftleft(shiftright(h, _bits), _bits) | i)")
    rows = held(rows, _packed=F.sort_array(packed))
    twins = F.expr(
        "filter(_packed, (x, j) -> coalesce(shiftright(x, _bits) = shiftright(get(_packed, j + 1), _bits), false)"
        " or coalesce(shiftright(x, _bits) = shiftright(get(_packed, j - 1), _bits), false))"
    )
    places = F.expr("transform(_twins, x -> cast(x & (shiftleft(1L, _bits) - 1) as int))")
    rows = held(held(rows, _twins=twins), _places=places)
    clash = F.expr(
        "exists(sequence(0, size(_places) - 1), j -> shiftright(get(_twins, j), _bits) = shiftright(get(_twins, j + 1), _bits)"
        " and get(_hashes, get(_places, j)) <> get(_hashes, get(_places, j + 1)))"
    )
    full = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_full", F.when((F.size("_places") > 0) & clash, full))
    slow = _equal_neighbours(F.col("_full"), lambda x, y: x["h"] == y["h"])
    again = F.when(F.col("_full").isNull(), F.col("_places")).otherwise(F.transform(slow, lambda x: x["i"]))
    return held(rows, _again=F.sort_array(again)).drop("_hashes", "_bits", "_packed", "_twins", "_places", "_full")


def with_quality(documents: DataFrame) -> DataFrame:
    """doc_id and text of ``documents`` with the base counts, the verdicts and the text that the line rules leave.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_failed,
    lost_words, kept, clean_text.
    """
    return _judged(documents.select("doc_id", "text"))


def _judged(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumn("_text", text)
    bare = F.btrim(F.col("_text"), F.lit(SPACE))
    rows = held(rows, _words=F.when(bare != "", F.split(bare, SPACES)).otherwise(F.array().cast("array<string>")))
    rows = _with_repeats(rows)
    rows = rows.withColumn("_lines", F.split("_text", "\n"))
    gap = lambda acc, x: F.struct(
        (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")
    )
    covered = F.aggregate("_again", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), gap)["n"]
    rows = held(rows, _wordy=F.filter("_lines", lambda x: x.rlike(WORD_CHAR)), _notice=_may_notice(F.col("_text")))
    rows = held(rows, _good=F.filter("_wordy", lambda x: ~line_fails(x, F.col("_notice"))))
    rows = rows.withColumn("_clean", F.array_join("_good", "\n"))
    n_words = F.size("_words").cast("long")
    counted = held(
        rows,
        n_words=n_words,
        word_chars=F.length(_without(F.col("_text"), SPACE)).cast("long"),
        n_symbols=_count(F.col("_text"), f"[{SYMBOLS}]").cast("long"),
        n_dup_lines=(F.size("_wordy") - F.size(F.array_distinct("_wordy"))).cast("long"),
        n_repeat_words=covered.cast("long"),
        n_lines_failed=(F.size("_wordy") - F.size("_good")).cast("long"),
        lost_words=F.when(F.size("_wordy") == F.size("_good"), F.lit(0).cast("long")).otherwise(n_words - _n_words(F.col("_clean")).cast("long")),
        clean_text=F.col("_clean"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_words") <= LOST_PERCENT * F.col("n_words")))
    return judged.drop("_text", "_words", "_sorted", "_lines", "_again", "_wordy", "_notice", "_good", "_clean")


def clean(documents: DataFrame) -> DataFrame:
    """Kept documents, without the lines that failed; the columns of ``documents``, whatever their names."""
    kept = _judged(packed_rows(documents, "text")).filter("kept")
    changed = {"text": F.col("clean_text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.length("clean_text").cast(documents.schema["n_chars"].dataType)
    return unpacked(kept, documents, **changed)
