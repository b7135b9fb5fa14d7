"""Readers: plain text with a gate, catalogue tables with a header found, JSON lists, messages, and ingest without duplicates."""

from __future__ import annotations

import csv
import io
from email import policy
from email.parser import BytesParser
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What catalogue columns may be called; the first name is the field.
HEADERS = {
    "name": ("name", "наименование", "название", "description"), "part_number": ("part_number", "артикул", "sku", "part number", "code"), "price": ("price", "цена", "cost"),
    "unit": ("unit", "ед", "ед.", "единица"), "quantity": ("quantity", "qty", "кол-во", "количество"), "supplier": ("supplier", "поставщик", "vendor"),
}
_known = {alias: field for field, aliases in HEADERS.items() for alias in aliases}


def looks_textual(text: Column) -> Column:
    """Fewer than one in twenty of the first 4000 characters are control or replacement characters."""
    head = F.substring(text, 1, 4000)
    return F.length(F.regexp_replace(head, r"[^\x{FFFD}\x00-\x08\x0E-\x1F]", "")) < 0.05 * F.length(head)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, content of each file that looks textual."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.where(looks_textual(F.col("content")))


def delimiter_of(line: str) -> str:
    """The most frequent of ; tab | and comma; comma if none occurs."""
    best = max(";\t|,", key=line.count)
    return best if line.count(best) else ","


def header_place(rows: list[list[str]]) -> int | None:
    """The row, of the first twenty, with most known names; two at least."""
    found = [sum(c.strip().lower() in _known for c in r) for r in rows[:20]]
    best = max(range(len(found)), key=lambda i: (found[i], -i), default=None)
    return best if best is not None and found[best] >= 2 else None


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A delimited catalogue whose delimiter and header row are found from its first lines (only these reach the driver). Fields by
    their known names, others by their own; rows above the header and blank rows drop out."""
    head = [r.value.removeprefix("﻿") for r in spark.read.text(path).limit(20).collect()]
    if not head:
        return spark.createDataFrame([], "name string")
    delimiter = delimiter_of(max(head, key=lambda x: max(x.count(d) for d in ";\t|,")))
    rows = [next(csv.reader(io.StringIO(x), delimiter=delimiter), []) for x in head]
    at = header_place(rows)
    if at is None:
        raise ValueError("no header row among the first lines")
    names, seen = [], set()
    for i, c in enumerate(rows[at]):
        name = _known.get(c.strip().lower(), c.strip().lower().replace(" ", "_")) or f"column_{i}"
        names.append(name if name not in seen else f"column_{i}")
        seen.add(names[-1])
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = spark.read.csv(path, schema=schema, sep=delimiter, mode="PERMISSIVE", multiLine=False)
    filled = F.filter(F.array(*(F.col(f"`{n}`") for n in names)), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    above = {tuple(r) for r in rows[: at + 1]}
    first = [F.coalesce(F.regexp_replace(F.col(f"`{names[0]}`"), "^﻿", ""), F.lit("")) != r[0] for r in above if r]
    keep = F.size(filled) > 0
    for c in first:
        keep = keep & c
    return parsed.where(keep)


def usable(df: DataFrame) -> DataFrame:
    """Rows with a name of three characters, or with a part number and a price."""
    named = F.length(F.trim("name")) >= 3
    if {"part_number", "price"} <= set(df.columns):
        named = F.coalesce(named, F.lit(False)) | (F.col("part_number").isNotNull() & F.col("price").isNotNull())
    return df.where(named)


def read_json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or an object whose items are one."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode("items").alias("item")).select("item.*") if df.columns == ["items"] else df


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Mail files: path, message_id, in_reply_to, subject, sender, body, attachments (name, digest, size)."""
    attachment = T.StructType([T.StructField("name", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("size", T.LongType())])
    names = ("message_id", "in_reply_to", "subject", "sender", "body")
    schema = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, T.StringType()) for n in names), T.StructField("attachments", T.ArrayType(attachment))])

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                mail = BytesParser(policy=policy.default).parsebytes(bytes(content))
                body = mail.get_body(("plain", "html"))
                files = [(p.get_filename() or "", p.get_payload(decode=True) or b"") for p in mail.iter_attachments()]
                head = [mail.get(h) for h in ("Message-ID", "In-Reply-To", "Subject", "From")]
                rows.append((path, *(None if h is None else str(h) for h in head), body.get_content() if body else "", [(n, sha256(c).hexdigest(), len(c)) for n, c in files]))
            yield pd.DataFrame(rows, columns=schema.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def new_files(incoming: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """incoming with its digest; is_duplicate where the stored digests, or an earlier row's path, hold the same content."""
    hashed = incoming.withColumn("digest", F.sha2(F.col(content), 256))
    first = hashed.groupBy("digest").agg(F.min("path").alias("first_path"))
    known = stored.select("digest").distinct().withColumn("known", F.lit(True))
    joined = hashed.join(first, "digest").join(known, "digest", "left")
    return joined.withColumn("is_duplicate", F.coalesce("known", F.lit(False)) | (F.col("path") != F.col("first_path"))).drop("known", "first_path")


def threads(messages: DataFrame) -> DataFrame:
    """thread of each message: the one it answers, or else its mailbox and its subject without Re: and Fwd:."""
    ids = messages.select(F.col("message_id").alias("answered"), F.col("subject").alias("of_subject"))
    joined = messages.join(ids, messages.in_reply_to == ids.answered, "left")
    bare = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*((re|fwd|fw)\s*:\s*)+", "")))
    return joined.withColumn("thread", F.concat_ws("|", "mailbox", bare(F.coalesce("of_subject", "subject")))).drop("answered", "of_subject")
