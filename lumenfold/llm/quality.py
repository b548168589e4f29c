"""Operator 8: quality rules, line first. DataFrame functions only; no shuffle.

Every line with a word is judged on its own: it fails as
  navigation   menu separators between its words, or one of RUN or more short unpunctuated
               labels that follow each other,
  punctuation  symbol marks or doubled exclamation marks on much of its words, shouting (half or
               more of its words in capitals), or many words without one sentence mark,
  boilerplate  a licence, cookie or copyright phrase in a short line.
Failing lines are removed, lines without a word stay, a text in which no line fails stays as it is; a document that loses more than
`most_lost` of its word characters is rejected, as is one that fails the base rules.

Defined results: null and empty texts have no words and are rejected. Repeated rows are judged alike; a loss of just `most_lost` is kept. A
text is judged whole, in one task, in n log n of its words, with some 50 bytes of memory a word. An empty table gives an empty one. Columns
with clashing names are safe: the row is carried as one struct beside the work columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOL = r"[#*$%&|<>]"
#: Phrases of licence, cookie and copyright lines.
BOILERPLATE = r"(?i)(licensed under the|all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|copyright \(c\)|lorem ipsum|subscribe to our|sign up for our|javascript is disabled)"
BOILERPLATE_WORDS = 20
WORD = r"[^\x20\x09-\x0D]+"
MENU = r"[\x20\x09-\x0D][|»›·•][\x20\x09-\x0D]"
SENTENCE_MARK = r"[.!?…:;,]"
#: A label has a letter, so many words and characters at most, and no mark of any script; so many in sequence are a menu.
LABEL_WORDS, LABEL_CHARS, RUN = 4, 40, 4
LABEL = r"^[^.!?…:;,。！？、，；：]*\p{L}[^.!?…:;,。！？、，；：]*$"
#: A word in capitals (two of them, no small letter), and the fewest that are shouting.
CAPITALS = r"(?<![^\x20\x09-\x0D])[^\p{Ll}\p{Lu}\x20\x09-\x0D]*\p{Lu}[^\p{Ll}\p{Lu}\x20\x09-\x0D]*\p{Lu}[^\p{Ll}\x20\x09-\x0D]*(?![^\x20\x09-\x0D])"
SHOUTS = 3
#: Of a text with a 1 for each label and a - for each line without a word: the ones of runs of RUN or more, each at the start of a run or after the one before.
IN_RUN = r"(?:\G(?!\A)|(?=1(?:-*1){%d}))(-*)1" % (RUN - 1)
MOST_LOST = 0.5


def times(text: Column, pattern: str) -> Column:
    """How often a pattern is found, left to right without overlap."""
    return F.regexp_count(text, F.lit(pattern))


def squeezed(text: Column) -> Column:
    """The text without white space."""
    return F.array_join(F.split(text, c.SPACE), "")


def line_fails(line: Column) -> Column:
    """The rules of one line, as booleans of one expression."""
    n, shouts = times(line, WORD), times(line, CAPITALS)
    return (
        (times(line, MENU) * 4 >= n)
        | (times(line, SYMBOL) * 2 >= n)
        | (times(line, "!!") * 2 >= n)
        | ((n >= 10) & ~line.rlike(SENTENCE_MARK))
        | ((n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
        | ((shouts >= SHOUTS) & (shouts * 2 >= n))
    )


def is_label(line: Column) -> Column:
    return (F.length(line) <= LABEL_CHARS) & (times(line, WORD) <= LABEL_WORDS) & line.rlike(LABEL)


def good_lines(lines: Column) -> Column:
    """The lines that no rule fails, in order, with those that have no word."""
    labels = F.array_join(F.transform(lines, lambda x: F.when(is_label(x), "1").when(x.rlike(WORD), "0").otherwise("-")), "")
    marks = F.split(F.regexp_replace(labels, IN_RUN, "$1x"), "")
    return F.filter(F.zip_with(lines, marks, lambda x, m: F.when((m == "-") | ((m != "x") & ~line_fails(x)), x)), lambda x: x.isNotNull())


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more. Sorted, not paired: n log n."""
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(hashes)


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with VERDICT's columns (they replace columns of the same names):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, lost, kept."""
    t = F.col("_text")
    df = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns if x not in VERDICT]).alias("_row"), c.text_of(text).alias("_text"))
    df = df.withColumn("_words", c.words_of(t)).withColumn("_all", F.split(t, "\n")).withColumn("_lines", F.filter("_all", lambda x: x.rlike(WORD)))
    df = df.withColumn("_hashes", repeated_words(F.col("_words")))
    df = df.withColumn("_good", good_lines(F.col("_all")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_sorted", lambda x, j: (x["h"] == F.get(F.col("_sorted"), j - 1)["h"]) | (x["h"] == F.get(F.col("_sorted"), j + 1)["h"]))
    df = df.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total")),
    )["total"]
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": times(t, SYMBOL).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "clean_text": F.array_join("_good", "\n"),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    df = df.withColumn("lost", F.when(F.size("_good") < F.size("_all"), 1 - F.length(squeezed(F.col("clean_text"))) / F.col("word_chars")).otherwise(0.0))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MOST_LOST))
    # A generator between: a filter on a verdict must not be pushed down and repeat all of the above for every line and word.
    return df.select("_row.*", F.inline(F.array(F.struct(*VERDICT))))


#: What scored() adds.
VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "lost", "kept"]
COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(c.table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: rejected documents go; of the others the failing lines."""
    clean = scored(docs).filter("kept")
    return clean.withColumns({"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + k) n FROM r, range(5) t(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i FROM d),
f AS (SELECT rid, l, i, list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
a AS (SELECT rid, l, i, len(ws) n, len(list_filter(ws, lambda x: regexp_full_match(x, '[^\p{Ll}\p{Lu}]*\p{Lu}[^\p{Ll}\p{Lu}]*\p{Lu}[^\p{Ll}]*'))) caps,
        length(l) <= 40 AND len(ws) <= 4 AND regexp_full_match(l, '[^.!?…:;,。！？、，；：]*\p{L}[^.!?…:;,。！？、，；：]*') label FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) - row_number() OVER (PARTITION BY rid, label ORDER BY i) g FROM a),
m AS (SELECT *, label AND count(*) OVER (PARTITION BY rid, label, g) >= 4 menu FROM b),
q AS (SELECT rid, count(*) - count(DISTINCT l) dups,
        sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) FILTER (WHERE NOT (
          menu OR (caps >= 3 AND caps * 2 >= n)
          OR (len(string_split_regex(l, '[\x20\x09-\x0D][|»›·•][\x20\x09-\x0D]')) - 1) * 4 >= n
          OR length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) * 2 >= n
          OR (len(string_split(l, '!!')) - 1) * 2 >= n
          OR (n >= 10 AND NOT regexp_matches(l, '[.!?…:;,]'))
          OR (n <= 20 AND regexp_matches(l, '(?i)(licensed under the|all rights reserved|terms of (use|service)|privacy policy|cookie policy|use of cookies|copyright \(c\)|lorem ipsum|subscribe to our|sign up for our|javascript is disabled)')))) good
      FROM m GROUP BY rid),
s AS (SELECT d.doc_id, len(w.w) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(q.dups, 0) n_dup_lines,
        coalesce(p.n, 0) n_repeat_words, coalesce(q.good, 0) good
      FROM d JOIN w USING (rid) LEFT JOIN p USING (rid) LEFT JOIN q USING (rid))
SELECT doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols,
  n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND (CASE WHEN word_chars > 0 THEN 1 - good::DOUBLE / word_chars ELSE 0 END) <= 0.5 kept
FROM s
"""
