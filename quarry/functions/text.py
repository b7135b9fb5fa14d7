"""Text as Column expressions: normalisation, keys, repair, redaction, chunks and mentions. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def name_key(text: Column) -> Column:
    """Lower case, ё as е, everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def match_key(text: Column) -> Column:
    """Lower case, ё as е, everything but a-z, а-я and digits as single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[^a-zа-я0-9]+", " "))


def match_tokens(text: Column, least_chars: int = 1) -> Column:
    return F.array_distinct(F.filter(F.split(match_key(text), " "), lambda x: F.length(x) >= least_chars))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name_key(text), " "), lambda x: x != ""))


def overlap_score(a: Column, b: Column) -> Column:
    """0.7 * share of a's tokens found in b + 0.3 * Jaccard, three digits; 0 if either has none."""
    both = F.size(F.array_intersect(a, b))
    score = 0.7 * both / F.size(a) + 0.3 * both / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(score, 3))


#: Legal forms that don't belong to a company's name.
LEGAL_FORMS = ("ооо", "оао", "зао", "пао", "ао", "ип", "llc", "ltd", "inc", "gmbh")


def company_key(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), "[\"'«»„“”]", " ")
    bare = F.regexp_replace(bare, rf"(^|[\s,.])({'|'.join(LEGAL_FORMS)})(?=$|[\s,.])", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def phone_key(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("8"), F.concat(F.lit("7"), F.substring(digits, 2, 10))).otherwise(digits)


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, no slash at the path's end; no path is a slash."""
    bare = F.regexp_replace(url, "#.*$", "")
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?i)(utm_|yclid|gclid)[^=]*(=|$)")), "&")
    host = F.regexp_extract(base, r"^(([a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/]*)", 1)
    path = F.regexp_replace(F.substr(base, F.length(host) + 1), "/+$", "")
    return F.concat(F.lower(host), F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def russian_number(text: Column) -> Column:
    """1 200,50 and 1.200,50 and 1,200.50 as doubles, currency signs dropped; null for what is no number."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\s  '’]", ""), r"(?i)(руб\.?|rub|₽|\$|€|eur|usd)", "")
    comma_last = F.locate(",", F.reverse(bare)), F.locate(".", F.reverse(bare))
    both = (comma_last[0] > 0) & (comma_last[1] > 0)
    european = F.replace(F.regexp_replace(bare, r"\.", ""), F.lit(","), F.lit("."))
    english = F.regexp_replace(bare, ",", "")
    return (
        F.when(both & (comma_last[0] < comma_last[1]), european)
        .when(both, english)
        .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
        .try_cast("double")
    )


#: Strings that try to give orders to a model that reads the text, without regard to case.
INJECTIONS = (
    r"ignore\s+(previous|all|above)\s+instructions?", r"you\s+are\s+now\s+(?:a|an|the)?\s*\w+\s+without\s+restrictions?", r"<\s*system\s*>",
    r"\[INST\]|\[/?SYS\]|<<SYS>>", r"###\s*System\s*:", r"ASSISTANT\s*:\s*(?:OK|Sure|Of course)",
    r"disregard\s+(?:all\s+)?(?:previous|prior)\s+(?:instructions?|prompts?|context)", r"new\s+instructions?\s*:",
)


def redacted(text: Column, most: int = 32_768) -> Column:
    """A struct: the first `most` characters with injections as [redacted], and warnings (the patterns, in order, each searched in
    what the ones before it left)."""
    cut = F.substring(text, 1, most)
    states = [cut]
    for p in INJECTIONS:
        states.append(F.regexp_replace(states[-1], f"(?i){p}", "[redacted]"))
    found = [F.when(before.rlike(f"(?i){p}"), p) for before, p in zip(states, INJECTIONS)]
    warnings = F.filter(F.array(F.when(F.length(text) > most, "truncated"), *found), lambda x: x.isNotNull())
    return F.struct(states[-1].alias("text"), warnings.alias("warnings"))


#: Tags of spans that are not for readers, and a note that goes with the first.
FENCES = ("memory-context", "think", "thinking", "reasoning")
NOTE = r"(?i)\[System note:\s*The following is recalled memory context,[^\]]*\]\s*"


def without_fences(text: Column) -> Column:
    """Closed spans drop out with all they hold, then tags that stand alone, then the note."""
    spans = reduce(lambda c, t: F.regexp_replace(c, rf"(?is)<\s*{t}\s*>.*?</\s*{t}\s*>", ""), FENCES, text)
    return F.regexp_replace(F.regexp_replace(spans, rf"(?i)</?\s*({'|'.join(FENCES)})\s*>", ""), NOTE, "")


def without_tags(html: Column) -> Column:
    """Scripts, styles and tags dropped, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def chunks(df: DataFrame, text: str, size: int = 3000, overlap: int = 300) -> DataFrame:
    """A row for each chunk: chunk_index, chunk_start, chunk_text, token_count. Blank texts have none."""
    step = size - overlap
    length = F.length("bare")
    starts = F.when(length == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - overlap) / step).cast("int") - 1) * step, F.lit(step)))
    cut = df.withColumn("bare", F.trim(F.coalesce(F.col(text), F.lit("")))).select("*", F.posexplode(starts).alias("chunk_index", "chunk_start"))
    cut = cut.withColumn("chunk_text", F.substring("bare", F.col("chunk_start") + 1, F.lit(size)))
    return cut.withColumn("token_count", token_count(F.col("chunk_text"))).drop("bare")


def token_count(text: Column) -> Column:
    """Number of words, 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")))


#: Families of mentions: what kind, and its pattern with one group.
MENTIONS = {
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
    "ip": r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b",
    "licence": r"(Licensed under the [A-Z][A-Za-z ]+)",
    "date": r"\b(\d{2}\.\d{2}\.\d{4})\b",
    "thread": r"\b(M\d{1,3}x\d{1,3})\b",
    "standard": r"\b((?:ISO|DIN|GOST) ?\d{2,6})\b",
    "number": r"\b(\d{9,16})\b",
}


def mentions(df: DataFrame, text: str, families: dict[str, str] | None = None) -> DataFrame:
    """A row for each distinct mention of a row's text: mention_type, mention (trimmed, three characters or more)."""

    def of(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("mention_type"), F.trim(F.regexp_replace(m, r"\s+", " ")).alias("mention"))

    # a pattern that looks for a sign is run where the sign is
    where = lambda k, c: F.when(F.contains(text, F.lit("@")), c).otherwise(F.array().cast("array<string>")) if k == "email" else c
    found = [F.transform(where(k, F.regexp_extract_all(text, F.lit(p))), of(k)) for k, p in (families or MENTIONS).items()]
    return df.select("*", F.explode(F.array_distinct(F.concat(*found))).alias("m")).select("*", "m.mention_type", "m.mention").drop("m").where(F.length("mention") >= 3)


def trigrams(text: Column) -> Column:
    """The set of three-letter pieces of each word, two blanks before it and one behind."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams, 0 where there are none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def term_overlap(text: Column, terms: list[str]) -> Column:
    """Share of the terms that the text holds."""
    return sum((F.contains(F.lower(text), F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) / F.lit(float(max(1, len(terms))))
