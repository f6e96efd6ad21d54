"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base signals come from each text alone.  The method then counts, per host, in how many distinct documents each
normalised line stands.  A line above ``line_limit`` is boilerplate: it is removed from every document of that host.
A document left with under ``min_left_share`` of its words, or under ``min_left_words``, is depleted and rejected.

So a group of more than ``line_limit`` copies is boilerplate as a whole and goes.  Where a later step is to choose one
document of each group, ``count_copies=False`` counts texts: exact copies are one document, and the text with the
smallest id keeps the line.

Null text counts as empty (and fails the base rule); a null host is a host of its own.  Rows with equal ids are one
document, those without an id one per text; repeated rows are judged alike, each on its own words.  An empty table gives
an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import settle

# Fixed values of the base rule.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
SPACE_CLASS = r"[\x20\x09-\x0D]"

LINE_LIMIT = 100
MIN_LEFT_SHARE = 0.3
MIN_LEFT_WORDS = 5
#: Keys of 8 bytes that are broadcast at most; more are joined by key.
BROADCAST_ROWS = 200_000
#: Frequent lines (a key and a digest each) that are looked up row by row at most; with more, texts are joined with their removed lines.
LOOKUP_LINES = 50_000

# Windows of eight word hashes; positions in windows found twice or more; the words that they cover.
# An array of one element binds a value to a name, so that it is computed once.
_WINDOWS = f"""if(size(hw) < {REPEAT_WINDOW}, cast(array() as array<bigint>),
  transform(sequence(0, size(hw) - {REPEAT_WINDOW}), i -> xxhash64({", ".join(f"hw[i + {k}]" for k in range(REPEAT_WINDOW))})))"""
_COVERED = f"""transform(array(array_sort(transform(win, (h, p) -> struct(h as h, p as p)))), s ->
  aggregate(
    array_sort(filter(transform(s, (x, k) -> if((k > 0 and s[k - 1].h = x.h) or (k < size(s) - 1 and s[k + 1].h = x.h), x.p, null)), p -> p is not null)),
    struct(0 as n, -{REPEAT_WINDOW} as last),
    (a, p) -> struct(a.n + least({REPEAT_WINDOW}, p - a.last) as n, p as last),
    a -> a.n))[0]"""
_WORD_SIGNALS = f"""transform(array(array_remove(split(__flat, ' '), '')), ws ->
  transform(array(transform(ws, x -> xxhash64(x))), hw ->
    transform(array({_WINDOWS}), win -> struct(
      cast(size(ws) as bigint) as n_words,
      cast(length(array_join(ws, '')) as bigint) as word_chars,
      cast(if(size(array_distinct(win)) = size(win), 0, {_COVERED}) as bigint) as n_repeat_words))[0])[0])[0]"""


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _flat(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(SPACE_CLASS + "+"), F.lit(" "))


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, each run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_flat(line)), F.lit("[0-9]"), F.lit("0")))


def line_key(host: Column, line: Column) -> Column:
    """One number for a host's normalised line (a null host differs from an empty one)."""
    return F.xxhash64(host, normalised_line(line))


def _texts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("__host"), text.alias("__text"), F.md5(text).alias("__md5"))


def _lines(texts: DataFrame, *also: str) -> DataFrame:
    """Every line with a word: __host, __l (the raw line), __line (its key) and the columns ``also``."""
    return (
        texts.select("__host", *also, F.explode(F.split("__text", "\n")).alias("__l"))
        .filter(_has_word(F.col("__l")))
        .withColumn("__line", line_key(F.col("__host"), F.col("__l")))
    )


def frequent_lines(texts: DataFrame, line_limit: int, count_copies: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (__line, __host, __md5, __words) of texts with lines that may be frequent, and the lines that are: __line, __kmd5 (the text that keeps it, or null).

    A first pass counts occurrences by key, summed in each task before the exchange; lines that don't occur more often
    than the limit can't stand in more documents.  The rest, settled and counted, is broadcast if it is small and joined by
    its key otherwise; only its lines go on to the exact count.
    """
    often = settle(_lines(texts).groupBy("__line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > line_limit).select("__line"))
    words = F.size(F.array_remove(F.split(_flat(F.col("__l")), " "), "")).cast("long")
    # the row's number keeps the words of repeated rows apart
    rows = settle(
        _lines(texts.withColumn("__row", F.monotonically_increasing_id()), "doc_id", "__md5", "__row")
        .join(_small(often), "__line")
        .withColumn("__words", words)
        .groupBy("__line", "__host", "__md5", "doc_id", "__row")
        .agg(F.sum("__words").alias("__words"))
    )
    by_text = rows.groupBy("__line", "__host", "__md5").agg(F.min("doc_id").alias("doc_id"), F.max("__words").alias("__words"))
    if count_copies:
        document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("__md5")))
        counted = rows.groupBy("__line").agg(F.count_distinct(document).alias("n"), F.lit(None).cast("string").alias("__kmd5"))
    else:
        keeper = F.min(F.struct("doc_id", "__md5"))["__md5"]
        counted = by_text.groupBy("__line").agg(F.count(F.lit(1)).alias("n"), keeper.alias("__kmd5"))
    return by_text, settle(counted.filter(F.col("n") > line_limit).select("__line", "__kmd5"))


def _small(lines: DataFrame) -> DataFrame:
    return F.broadcast(lines) if lines.count() <= BROADCAST_ROWS else lines


def removed_lines(by_text: DataFrame, frequent: DataFrame) -> DataFrame:
    """For each distinct text that loses lines: __vhost, __vmd5, keys of its removed lines, their words."""
    lost = by_text.join(_small(frequent), "__line").filter(~F.col("__md5").eqNullSafe(F.col("__kmd5")))
    return (
        lost.groupBy(F.col("__host").alias("__vhost"), F.col("__md5").alias("__vmd5"))
        .agg(F.collect_set("__line").alias("__removed"), F.sum("__words").alias("removed_words"))
    )


def _lookup(frequent: DataFrame, n: int) -> Column:
    """The n frequent lines as a constant, an array of n buckets by key, so that a row finds a line without a join."""
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for line, keeper in frequent.toLocalIterator():
        buckets[line % n].append({"line": line, "keeper": keeper})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<line: bigint, keeper: string>>>")


def _once(value: Column, name: str, docs: DataFrame) -> DataFrame:
    """``docs`` and the value, which filters after it don't compute anew."""
    return docs.select("*", F.explode(F.array(value)).alias(name))


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_limit: int = LINE_LIMIT,
    min_left_share: float = MIN_LEFT_SHARE,
    min_left_words: int = MIN_LEFT_WORDS,
    count_copies: bool = True,
) -> DataFrame:
    """Per row: id, base signals, base_failed, removed_words (boilerplate), kept."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), _has_word)
    signals = (
        _texts(docs, id_col, text_col, host_col)
        .select(
            "doc_id", "__host", "__md5",
            _flat(text).alias("__flat"),
            F.length(F.regexp_replace(text, F.lit(f"[^{SYMBOLS}]+"), F.lit(""))).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        )
        .select("doc_id", "__host", "__md5", "n_symbols", "n_dup_lines", F.expr(_WORD_SIGNALS).alias("__s"))
        .select("doc_id", "__host", "__md5", "__s.n_words", "__s.word_chars", "n_symbols", "n_dup_lines", "__s.n_repeat_words")
    )
    removed = removed_lines(*frequent_lines(_texts(docs, id_col, text_col, host_col), line_limit, count_copies)).drop("__removed")
    judged = signals.join(removed, F.col("__host").eqNullSafe(F.col("__vhost")) & (F.col("__md5") == F.col("__vmd5")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = F.coalesce((left < min_left_words) | (left < min_left_share * F.col("n_words")), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), (~failed & ~depleted).alias("kept"),
    )


def quality_filtered(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    chars_col: str = "n_chars",
    line_limit: int = LINE_LIMIT,
    min_left_share: float = MIN_LEFT_SHARE,
    min_left_words: int = MIN_LEFT_WORDS,
    count_copies: bool = True,
) -> DataFrame:
    """The rows that pass, all columns, with boilerplate lines cut from their texts (and ``chars_col`` set anew).

    Texts stay where they are: frequent lines are looked up in each row.  Only if there are more than ``LOOKUP_LINES`` of
    them, texts are joined with the lines that they lose.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    by_text, frequent = frequent_lines(_texts(docs, id_col, text_col, host_col), line_limit, count_copies)
    n = frequent.count()
    signals = _once(F.expr(_WORD_SIGNALS), "__s", docs.withColumns({"__md5": F.md5(text), "__flat": _flat(text)}))
    signals = signals.filter((F.col("__s.n_words") >= MIN_WORDS) & (100 * F.col("__s.n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("__s.n_words"))).drop("__flat")
    if 0 < n <= LOOKUP_LINES:
        known = _lookup(frequent, n)
        found = lambda t, k: F.exists(F.get(t, F.pmod(k, F.lit(n)).cast("int")), lambda e: (e["line"] == k) & ~e["keeper"].eqNullSafe(F.col("__md5")))
        gone = lambda t, x: F.transform(F.array(line_key(F.col(host_col), x)), lambda k: found(t, k))[0]
    else:
        removed = removed_lines(by_text, frequent)
        signals = signals.join(removed, F.col(host_col).eqNullSafe(F.col("__vhost")) & (F.col("__md5") == F.col("__vmd5")), "left")
        known = F.col("__removed")
        gone = lambda t, x: F.array_contains(t, line_key(F.col(host_col), x))
    words = lambda a, e: a + F.size(F.array_remove(F.split(_flat(e["l"]), " "), ""))
    marked = lambda t: F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("l"), (_has_word(x) & F.coalesce(gone(t, x), F.lit(False))).alias("cut")))
    cut = F.transform(
        F.transform(F.array(known), marked),
        lambda m: F.struct(
            F.exists(m, lambda e: e["cut"]).alias("lost"),
            F.aggregate(F.filter(m, lambda e: e["cut"]), F.lit(0), words).alias("words"),
            F.array_join(F.transform(F.filter(m, lambda e: ~e["cut"]), lambda e: e["l"]), "\n").alias("clean"),
        ),
    )[0]
    judged = _once(cut, "__c", signals)
    lost, clean = F.col("__c.lost"), F.col("__c.clean")
    left = F.col("__s.n_words") - F.col("__c.words")
    passed = judged.filter(~lost | ((left >= min_left_words) & (left >= min_left_share * F.col("__s.n_words"))))
    new = {text_col: F.when(lost, clean).otherwise(F.col(text_col))}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        new[chars_col] = F.when(lost, F.length(clean).cast(kind)).otherwise(F.col(chars_col))
    return passed.withColumns(new).select(*docs.columns)


def oracle(line_limit: int = LINE_LIMIT, min_left_share: float = MIN_LEFT_SHARE, min_left_words: int = MIN_LEFT_WORDS) -> str:
    """DuckDB SQL with the rows of ``quality`` over ``documents`` (copies counted)."""
    word = r"[^\x20\x09-\x0D]+"
    flat = r"regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
l AS (SELECT rid, doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT rid, doc_id, host, t, line, len(regexp_extract_all(line, '{word}')) AS n,
         trim(regexp_replace(lower({flat.format('line')}), '[0-9]', '0', 'g')) AS norm
       FROM l WHERE regexp_matches(line, '{word}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY rid),
wd AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
win AS (SELECT rid, i, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, REPEAT_WINDOW))}) AS w FROM wd
        WINDOW o AS (PARTITION BY rid ORDER BY i) QUALIFY lead(w, {REPEAT_WINDOW - 1}) OVER o IS NOT NULL),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, range({REPEAT_WINDOW}) AS g(k) GROUP BY rid),
freq AS (SELECT host, norm FROM lw GROUP BY host, norm HAVING count(DISTINCT {{'id': doc_id, 'text': CASE WHEN doc_id IS NULL THEN t END}}) > {line_limit}),
rem AS (SELECT rid, sum(n) AS removed_words FROM lw JOIN freq f ON lw.host IS NOT DISTINCT FROM f.host AND lw.norm = f.norm GROUP BY rid),
s AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(d.t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(d.t, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN rem USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, removed_words::BIGINT AS removed_words,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {min_left_words} OR n_words - removed_words < {min_left_share} * n_words)) AS kept
FROM f"""
