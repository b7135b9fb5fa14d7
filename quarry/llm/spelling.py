"""Groups of spelling variants by permuterm rotations.

A word, marked with a terminator, is rotated to begin at each of its characters. Two words that differ by one replaced character
have rotations that are alike but for the last character; where one word has a character more, the shorter one's rotation is the
longer one's without its last character. So each rotation stands under itself and, its last character skipped, under the prefix
that is left, and sorting brings together what belongs together: under each prefix the words that have it as a whole rotation (one
at most) and those that have it but for one character at that place. A pair of words that differ by one replacement meets under one
prefix. A pair that differs by one insertion meets once for each character of the run in which it lies; only the run's first counts.

Each sorted group is scanned for its number of members, its best word and the second best (the most frequent first, then code-point
order), so each word learns from each group how many neighbours it has there and the best of them, without pairs being made. A group
has a member for each character of the alphabet and one more at most, whatever the number of words.

A word's form is its best neighbour, if that is at least twice as frequent; forms lead to words of ever larger counts, so a chain of
them has log2 of the largest count steps at most. Roots come by doubling: each round takes every word twice as far.

Words are counted within each task first (a table of MOST_WORDS words at most, sent on when full) and then summed, so that a word
that every document holds is one row of each task.

Defined results: null text has no words; a null id counts as the empty text where ids choose what is spoilt; repeated rows count
again; an empty table gives an empty result; only the id and the text are read, whatever the other columns' names are. Null words
or counts given to `variants` take no part, and words that are given more than once are summed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, saved, whole

#: Words that a task counts before it sends them on.
MOST_WORDS = 200_000
#: The terminator: no word of letters holds it.
END = "\0"
LETTERS = "A-Za-zÀ-ÿ"


def spoilt(prefix: int, run: str, every: int) -> str:
    """The run, or, where the checksum is a multiple of `every`, the run without one character. prefix: crc32 of what precedes it."""
    h = zlib.crc32(run.encode(), prefix)
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 5, least_n: int = 3, spoil_every: int = 97) -> DataFrame:
    """Columns word, n: maximal runs of letters, A-Z lower-cased. Where spoil_every divides crc32 of `<id>:<run>`, that run loses the
    character at the checksum modulo its length. Words shorter than least_chars or rarer than least_n are left out."""
    runs = re.compile(f"[{LETTERS}]{{{least_chars},}}")  # shorter ones never become words
    given = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), whole(text_col).alias("text"))

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(as_bytes(batch.column("id")), as_bytes(batch.column("text"))):
                prefix = zlib.crc32(doc + b":")
                own = Counter(runs.findall(text.lower().decode()))  # bytes.lower changes A-Z alone
                for run, n in own.items():
                    word = spoilt(prefix, run, spoil_every)
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= MOST_WORDS:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _rotations(words: DataFrame) -> DataFrame:
    """Rows key, gap (whether the key skips a character), head (whether that is the first of its run), word, minus (the negative of n)."""
    size, word = F.char_length("word"), F.col("word")
    part = lambda begin, n: F.substr(word, begin, n)  # noqa: E731  places from 1
    entry = lambda key, gap, head: F.struct(key.alias("key"), F.lit(gap).alias("gap"), head.alias("head"))
    turned = lambda i: F.concat(part(i + 1, size), F.lit(END), part(F.lit(1), i))  # noqa: E731  begins after i characters
    skipped = lambda i: F.concat(part(i + 1, size), F.lit(END), part(F.lit(1), i - 1))  # noqa: E731  the same without character i
    first = lambda i: (i == 1) | (part(i, F.lit(1)) != part(i - 1, F.lit(1)))
    entries = F.concat(
        F.transform(F.sequence(F.lit(0), size), lambda i: entry(turned(i), False, F.lit(False))),
        F.transform(F.sequence(F.lit(1), size), lambda i: entry(skipped(i), True, first(i))),
    )
    return words.where(size > 0).select("word", (-F.col("n")).alias("minus"), F.explode(entries).alias("e")).select("e.*", "word", "minus")


def _neighbours(words: DataFrame) -> DataFrame:
    """Columns word, n_near, best (struct minus, word) of words that have neighbours."""
    group = Window.partitionBy("key").orderBy(F.col("gap").desc(), "minus", "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct("minus", "word")
    gap, head = F.col("gap"), F.col("head")
    of = lambda test, value: F.when(test, value)
    scanned = _rotations(words).select(
        "word", "gap", "head", own.alias("own"),
        F.count(of(gap, 1)).over(group).alias("n_gap"), F.count(of(head, 1)).over(group).alias("n_head"), F.count(of(~gap, 1)).over(group).alias("n_whole"),
        F.first(of(gap, own)).over(group).alias("best"), F.nth_value(of(gap, own), 2).over(group).alias("second"),
        F.min(of(head, own)).over(group).alias("best_head"), F.min(of(~gap, own)).over(group).alias("whole"),
    )
    other = F.when(F.col("best") == F.col("own"), F.col("second")).otherwise(F.col("best"))
    near = F.when(gap, F.col("n_gap") - 1 + of(head, F.col("n_whole")).otherwise(0)).otherwise(F.col("n_head"))
    best = F.when(gap, F.least(other, of(head, F.col("whole")))).otherwise(F.col("best_head"))
    return scanned.select("word", near.alias("near"), best.alias("best")).where("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, most_steps: int) -> DataFrame:
    """Columns word, root from columns word, form: each word's last form. most_steps: a bound on the steps of a chain."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(most_steps, 1)))):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = saved(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found


def variants(words: DataFrame, word_col: str = "word", n_col: str = "n", times: int = 2) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n of words with counts: near words differ by exactly one inserted, deleted or
    replaced code point; the form is the near word of the largest n (ties: the smallest), if that is at least `times` (2 or more) the
    word's."""
    if times < 2:
        raise ValueError("forms must grow")
    named = words.select(F.col(word_col).alias("word"), F.col(n_col).cast("long").alias("n")).where("word IS NOT NULL AND n > 0")
    named = saved(named.groupBy("word").agg(F.sum("n").alias("n")), "words")
    near: Column = F.col("best")
    near_words = named.join(_neighbours(named), "word", "left")
    is_form = -near["minus"] >= F.col("n") * times
    known = saved(near_words.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, near["word"]).alias("form"), F.when(is_form, -near["minus"]).alias("form_n"),
    ), "near-words")
    counts = known.where("form IS NOT NULL").agg(F.min("n"), F.max("form_n")).first()
    steps = math.ceil(math.log(counts[1] / counts[0], times)) + 1 if counts[0] else 0
    roots = _roots(known.where("form IS NOT NULL"), steps)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_bytes = "list_transform(generate_series(1, CAST(length(x) / 2 AS INT)), lambda i: CAST('0x' || substr(x, CAST(2 * i - 1 AS INT), 2) AS BIGINT))"
_step = "list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1)))"
#: The same in SQL: words that are alike without one character, and a walk along forms.
ORACLE = rf"""
WITH RECURSIVE r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], {_bytes}), lambda s, b: {_step}), 4294967295::BIGINT) AS h FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r)),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
f AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS best, max(n) AS most FROM p GROUP BY 1),
v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN best END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN f USING (word)),
u AS (SELECT word, word AS at, form AS next FROM v UNION ALL SELECT u.word, u.next, v.form FROM u JOIN v ON v.word = u.next)
SELECT v.word, v.form, u.at AS root, v.n, v.n_near, v.form_n FROM v JOIN u ON u.word = v.word AND u.next IS NULL
"""
