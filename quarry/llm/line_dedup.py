"""Removal of lines that many documents share, over levelled sorted runs of line hashes, in DataFrame functions.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys shorter than min_chars code points don't
count. Keys stand as 128-bit hashes. Batches of documents come in descending order of their ids. Each batch's keys are counted, keys that
a run already settles (found in min_docs documents, so that neither their fate nor the document that keeps them can change) go by
a merge anti-join with each run, and the rest are written as a new sorted run. Whenever a level holds two runs, they are merged
into one of the next level, and in the end all into one, which tells which keys lose their lines in all documents but the largest
id's.

A run is a table bucketed and sorted by the hash, with a bucket for each shuffle partition. Anti-joins and merges (full outer merge
joins of two runs) read buckets beside each other and write them back as they are: only a batch's own new keys are shuffled.

A key that most documents share is summed before each shuffle and is one row of a run. A document's long lines are rows (id, digest
of the text, place), joined with the keys as such; the places that go come back as the document's own list, and the stretches
between them stay. All of this takes a document's lines once, or sorts them.

There are `batches` batches whatever the size (four, which keeps the number of jobs small); their bounds come from a sixteenth of the
ids, chosen by hash, and change nothing in the result.

Defined results: null and empty texts are one empty line; every row is a document, so that a repeated row counts again and rows
with the same id keep a line together (in the SQL as well); ids are of any type that can be ordered; a null id is smaller than every other; an empty table gives an empty result; the input's
columns are carried inside one struct, so that clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_tables, saved, whole, working_path

BLANK, UPPER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def key_hash(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2"))


@dataclass
class LineRuns:
    """Sorted runs (h1, h2, n, keeper) in levels; n: documents that held the key, keeper: the largest id of them."""

    spark: SparkSession
    min_docs: int = 5
    levels: list[list[str]] = field(default_factory=list)

    def _write(self, rows: DataFrame, level: int) -> None:
        """rows: dealt by the hash to as many partitions as there are buckets."""
        path = working_path(self.spark, f"run{level}")
        name = f"run_{path[-32:]}"
        rows.write.bucketBy(self._parts(), "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(f"{name} {path}")

    def _parts(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, run: str) -> DataFrame:
        return self.spark.table(run.split(" ")[0])

    def _merged(self, one: str, other: str) -> DataFrame:
        a, b = (self._read(r).select("h1", "h2", *(F.col(c).alias(f"{c} {i}") for c in ("n", "keeper"))) for i, r in enumerate((one, other)))
        n = F.coalesce("n 0", F.lit(0)) + F.coalesce("n 1", F.lit(0))
        return a.hint("merge").join(b, ["h1", "h2"], "full_outer").select("h1", "h2", n.alias("n"), F.greatest("keeper 0", "keeper 1").alias("keeper"))

    def _delete(self, runs: list[str]) -> None:
        for r in runs:
            name, path = r.split(" ", 1)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_tables(self.spark, [path])

    def _compact(self, level: int, runs: list[str]) -> None:
        self._write(self._merged(*runs), level + 1)
        self._delete(runs)

    def add(self, keys: DataFrame) -> None:
        """keys: a batch's rows (id, h1, h2), one for each key of a document; ids not above those of earlier batches."""
        new = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).repartition(self._parts(), "h1", "h2")
        for run in (r for level in self.levels for r in level):
            known = self._read(run).where(F.col("n") >= self.min_docs).select("h1", "h2")
            new = new.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) > 1:
            runs, self.levels[level] = self.levels[level], []
            self._compact(level, runs)
            level += 1

    def settled(self) -> DataFrame:
        """Merges all runs into one, and gives the keys in at least min_docs documents, each with its keeper."""
        runs = [(level, r) for level, own in enumerate(self.levels) for r in own]
        self.levels = []
        while len(runs) > 1:
            (_, one), (level, other), *rest = runs
            self._compact(level, [one, other])
            runs = [(level + 1, self.levels.pop().pop()), *rest]
            self.levels = []
        self.levels = [[r for _, r in runs]]
        return self._read(runs[0][1]).where(F.col("n") >= self.min_docs)

    def clear(self) -> None:
        for level in self.levels:
            self._delete(level)
        self.levels = []


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows id, t1, t2, h1, h2, place, first of every line that counts; first: whether the key stands there for the first time in its
    document. A document's lines are sorted by their keys, so this takes no longer than sorting."""
    named = F.transform("lines", lambda x, i: F.struct(x.alias("line"), i.alias("place")))
    counts = F.filter(named, lambda x: F.char_length(F.btrim(x["line"], F.lit(BLANK))) >= min_chars)
    hashed = F.sort_array(F.transform(counts, lambda x: F.struct(key_hash(x["line"]).alias("k"), x["place"].alias("place"))))
    found = docs.select("id", "t1", "t2", hashed.alias("found")).where(F.size("found") > 0)
    before = F.concat(F.array(F.element_at("found", -1)), F.slice("found", F.lit(1), F.size("found") - 1))  # the first one has none
    with_first = F.zip_with("found", before, lambda x, y: F.struct(x["k"]["h1"].alias("h1"), x["k"]["h2"].alias("h2"), x["place"].alias("place"), (x["k"] != y["k"]).alias("changed")))
    flat = found.select("id", "t1", "t2", F.posexplode(with_first).alias("nth", "x"))
    return flat.select("id", "t1", "t2", "x.h1", "x.h2", "x.place", ((F.col("nth") == 0) | F.col("x.changed")).alias("first"))


def _cuts(docs: DataFrame, batches: int) -> list:
    """Ids that part the batches, the largest first: from ranges of a sixteenth of all ids, a row of each range."""
    spark = docs.sparkSession
    some = docs.select("id").where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(16)) == 0))
    ranges = some.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("least"))
    least = sorted(r.least for r in ranges.collect())
    return sorted({least[len(least) * i // batches] for i in range(1, batches)} - {*least[:1]}, reverse=True) if least else []


def without_repeated_lines(
    df: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4
) -> DataFrame:
    """Columns row (a struct of the columns `carry`), text (what is left), n_lines, n_dropped."""
    text = whole(text_col)
    docs = df.select(
        F.struct(*carry).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), F.split(text, "\n", -1).alias("lines")
    )
    keys = saved(_long_lines(docs, min_chars), "line-keys")
    runs, above, as_id = LineRuns(df.sparkSession, min_docs), None, docs.schema["id"].dataType
    try:
        for end in [*_cuts(docs, batches), None]:
            batch = keys.where("first")
            if above is not None:
                batch = batch.where((F.col("id") < F.lit(above).cast(as_id)) | F.col("id").isNull())
            if end is not None:
                batch = batch.where(F.col("id") >= F.lit(end).cast(as_id))
            runs.add(batch.select("id", "h1", "h2"))
            above = above if end is None else end
        repeated = saved(runs.settled(), "repeated")  # a side of its own, so that adaptive execution can split a hot key's rows
    finally:
        runs.clear()
    elsewhere = ~F.col("id").eqNullSafe(F.col("keeper"))
    # rows with the same id and text lose the same lines
    owner = [F.col("id").alias("of"), F.col("t1").alias("of1"), F.col("t2").alias("of2")]
    gone = keys.join(repeated, ["h1", "h2"]).where(elsewhere).groupBy(*owner).agg(F.sort_array(F.collect_set("place")).alias("gone"))
    is_own = (F.col("t1") == F.col("of1")) & (F.col("t2") == F.col("of2")) & F.col("id").eqNullSafe(F.col("of"))
    # what stands between two lines that go stays in one slice
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x + 1))
    kept = F.flatten(F.zip_with(begins, F.concat("gone", F.array(F.size("lines"))), lambda a, b: F.slice("lines", a + 1, b - a)))
    left = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n"))
    return docs.join(gone, is_own, "left").select(
        "row", left.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    )


#: The same in SQL; every row is a document of its own, as above.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
l AS (
  SELECT n, doc_id, line, place, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT n, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM d)),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT n) >= 5),
m AS (SELECT l.n, l.doc_id, line, place, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM keeper AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY n, doc_id
"""
