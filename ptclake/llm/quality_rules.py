"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Statistics of a text come from built-in functions on its words ``[^\\x20\\x09-\\x0D]+`` and its lines; ratios are
compared as integers. Repeated five-word windows are found by sorting the windows' 64-bit hashes within the text and
looking at neighbours.

Edge cases: a null or empty text has no words and fails the base rule; repeated rows are judged each; a very long text
takes memory in proportion to its words, in one row; an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Very frequent words of English, French, German and Spanish prose.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "at", "by", "this", "from", "or", "an"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "qui", "au", "pour", "sur"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "ein", "eine", "als", "nicht", "für"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "con", "no", "una", "su", "es", "al", "lo"],
}


@dataclass(frozen=True)
class Rule:
    """Fails a text of at least ``min_words`` words whose ``over / under`` (two statistics) lies outside of [low, high] (in thousandths)."""

    name: str
    over: str
    under: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0


#: The method's verdict; the base rule stands apart.
RULES = (
    Rule("word length", "word_chars", "n_words", low=1_500, high=20_000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("exclamations", "n_marks", "n_words", high=300),
    Rule("stop words", "n_stop_words", "n_words", low=5, min_words=100),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=500),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column, n: Column, width: int) -> Column:
    """Words in windows of ``width`` words that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.struct(F.xxhash64(F.slice(words, i, width)).alias("h"), i.cast("int").alias("i")))
    return F.when(n >= width, F.sort_array(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def text_statistics(docs: DataFrame, width: int = 5, carry: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to one row per document with the counts that the rules compare, and the column ``carry`` if named."""
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, _SPACE, "")
    ids = ["doc_id", *([carry] if carry else [])]
    a = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *ids[1:], text.alias("text"))
    a = a.select(*ids, words_of(F.col("text")).alias("ws"), F.char_length(bare).cast("long").alias("word_chars"), *[(F.char_length("text") - F.char_length(F.translate("text", c, ""))).cast("long").alias(k) for k, c in (("n_symbols", SYMBOLS), ("n_marks", "!?"))], F.filter(F.split("text", "\n", -1), lambda s: F.translate(s, _SPACE, "") != "").alias("lines"))
    n = F.size("ws")
    b = a.select(*ids, "word_chars", "n_symbols", "n_marks", n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size(F.filter("ws", lambda w: F.rtrim(w, F.lit(".,")).isin(stop))).cast("long").alias("n_stop_words"), _repeat_words(F.col("ws"), n, width).alias("windows"))
    # places of windows that have an equal neighbour, in order
    at = F.col("windows")
    twice = F.filter(at, lambda x, k: (F.get(at, k - 1)["h"] == x["h"]) | (F.get(at, k + 1)["h"] == x["h"]))
    c = b.select(*[x for x in b.columns if x != "windows"], F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate("starts", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-width).alias("last")), lambda s, i: F.struct((s["sum"] + F.least(F.lit(width), i - s["last"])).alias("sum"), i.alias("last")), lambda s: s["sum"])
    counts = [x for x in c.columns if x not in ("starts", *ids)]
    out = c.select(*ids, F.struct(*counts, covered.alias("n_repeat_words")).alias("s"))
    # a filter on the counts would be pushed down and work them out again for each use; it doesn't pass a generator
    return out.select(*ids, F.explode(F.array("s")).alias("s")).select(*ids, "s.*")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no rule of the table fails."""
    ok = F.lit(True)
    for r in rules:
        value, of = F.col(r.over) * 1000, F.col(r.under)
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (value >= r.low * of)
        if r.high is not None:
            inside = inside & (value <= r.high * of)
        ok = ok & (inside | (F.col("n_words") < r.min_words))
    return ok


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """Per document: its statistics, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return text_statistics(docs).withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))
