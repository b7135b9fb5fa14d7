"""Similarity joins of token sets and of contained strings, without comparing all with all.

Sets: tokens are ordered by how many entries hold them, the rarest first. A pair that reaches the least score has a certain number of
tokens in common, which follows from the two sizes; so its rarest common token stands among the first tokens of either side (the
whole size less that number, plus one). Only these prefixes are joined, by token and both sizes, and a pair comes up once, at its
rarest common token. A token that half the entries hold stands last in them and is joined for sizes alone at which it decides.

Strings: a part that a text holds is found by the rarest of its pieces of three characters (fewer, if it is shorter); the texts that
hold this piece are searched for the part.

Defined results: empty and null sets, texts and parts match nothing; entries may have several sets or parts (a row each), of which
the best counts; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The score of a pair by the number of common tokens, the size of the line's set and the size of the entry's.
Score = Callable[[Column, Column, Column], Column]


def coverage_score(both: Column, line: Column, entry: Column) -> Column:
    """Share of the entry's tokens that the line holds."""
    return both / entry


def weighted_score(both: Column, line: Column, entry: Column) -> Column:
    """0.7 * that share + 0.3 * Jaccard, three digits."""
    return F.round(0.7 * (both / entry) + 0.3 * (both / (line + entry - both)), 3)


def _by_rarity(sets: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct sets, as columns tokens (sorted by name) and rare (sorted by the number of entries that hold them)."""
    kinds = sets.select(F.array_sort(F.array_distinct(F.array_compact("tokens"))).alias("tokens")).where(F.size("tokens") > 0).distinct()
    counts = entries.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    one = kinds.select("tokens", F.explode("tokens").alias("token")).join(counts, "token", "left")
    of_set = one.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("all"))
    return of_set.select("tokens", F.transform("all", lambda x: x["token"]).alias("rare"), F.size("tokens").alias("size"))


def similar_sets(lines: DataFrame, entries: DataFrame, score: Score = coverage_score, least: float = 0.5) -> DataFrame:
    """All pairs of distinct sets (columns tokens of both inputs) that score `least` or more: line_tokens, entry_tokens (sorted),
    score. The score must not fall as more tokens are common."""
    one, other = _by_rarity(lines, entries), _by_rarity(entries, entries)
    sizes = one.agg(F.array_sort(F.collect_set("size")).alias("line_sizes"))  # a row of distinct sizes
    pairs = other.select("size").distinct().join(F.broadcast(sizes)).select(F.col("size").alias("entry_size"), F.explode("line_sizes").alias("line_size"))
    n_both = F.sequence(F.lit(1), F.least("entry_size", "line_size"))
    enough = F.filter(n_both, lambda n: score(n, F.col("line_size"), F.col("entry_size")) >= least)
    bounds = pairs.select("line_size", "entry_size", F.try_element_at(enough, F.lit(1)).alias("needed")).where("needed IS NOT NULL")

    def prefixes(side: DataFrame, size: str, name: str) -> DataFrame:
        first = F.slice("rare", F.lit(1), F.col("size") - F.col("needed") + 1)
        return side.join(bounds, F.col("size") == F.col(size)).select(F.col("tokens").alias(f"{name}_tokens"), F.col("rare").alias(f"{name}_rare"), "line_size", "entry_size", F.explode(first).alias("token"))

    met = prefixes(one, "line_size", "line").join(prefixes(other, "entry_size", "entry"), ["token", "line_size", "entry_size"])
    common = F.array_intersect("line_rare", "entry_rare")
    once = met.where(F.element_at(common, 1) == F.col("token"))
    scored = once.select("line_tokens", "entry_tokens", score(F.size(common), F.col("line_size"), F.col("entry_size")).alias("score"))
    return scored.where(F.col("score") >= least)


def _pieces(text: Column, size: Column) -> Column:
    """The distinct pieces of `size` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size)))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """All pairs of distinct texts (column text) and parts (column part) where the text holds the part: text, part."""
    texts = texts.select("text").where("text <> ''").distinct()
    parts = parts.select("part", F.least(F.length("part"), F.lit(3)).alias("size")).where("part <> ''").distinct()
    of_part = parts.select("part", F.explode(_pieces(F.col("part"), F.col("size"))).alias("piece"))
    wanted = of_part.select("piece").distinct()
    all_sizes = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: n <= F.length("text"))
    of_text = texts.select("text", F.explode(F.flatten(F.transform(all_sizes, lambda n: _pieces(F.col("text"), n)))).alias("piece")).join(wanted, "piece", "left_semi")
    counts = of_text.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = of_part.join(counts, "piece").groupBy("part").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"), F.count("*").alias("found"), F.any_value(F.length("part")).alias("size"))
    return of_text.join(rarest.select("part", "piece"), "piece").where(F.contains("text", F.col("part"))).select("text", "part")


def best_entries(lines: DataFrame, entries: DataFrame, score: Score = coverage_score, least: float = 0.5, of_part: float = 1.0) -> DataFrame:
    """Each line's entry of the highest score from `least` on, ties to the smaller entry: line, entry, score.

    lines: line, tokens, and text where parts are looked for; entries: entry, tokens, and optionally part: an entry whose part the
    line's text holds scores `of_part`. An entry may have several rows (other names, other parts)."""
    own = F.array_sort(F.array_distinct(F.array_compact("tokens")))
    with_part = "part" in entries.columns
    kinds = lines.select("line", own.alias("tokens"), *(["text"] if with_part else []))
    named = entries.select("entry", own.alias("entry_tokens")).distinct()
    top = lambda: [F.max_by("entry", F.struct("score", -F.col("entry"))).alias("entry"), F.max("score").alias("score")]
    # of the entries with one set the smallest; of a line's sets the best
    smallest = named.groupBy("entry_tokens").agg(F.min("entry").alias("entry"))
    found = similar_sets(lines, entries, score, least).join(smallest, "entry_tokens").groupBy(F.col("line_tokens").alias("tokens")).agg(*top())
    best = kinds.join(found, "tokens").select("line", "entry", "score")
    if with_part:
        owner = entries.where("part <> ''").groupBy("part").agg(F.min("entry").alias("entry"))
        held = containing(kinds, entries).join(owner, "part").groupBy("text").agg(F.min("entry").alias("entry"))
        best = best.unionAll(kinds.join(held, "text").select("line", "entry", F.lit(of_part).alias("score"))).groupBy("line").agg(*top())
    return best.select("line", "entry", "score")
