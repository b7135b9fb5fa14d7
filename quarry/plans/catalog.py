"""Logical sources: names for base DataFrames, their fields, and what each field is called.

A specification can name only these fields. A source is built from its tables lazily; derived columns that cost a join (lists and
counts of an invoice's lines) are added only if a query names them, since Catalyst can't drop an aggregating join by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    header: str
    kind: str = "text"  # text, number or date
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Source:
    title: str
    build: Callable[[Tables, frozenset[str]], DataFrame]
    fields: dict[str, Field]
    default: tuple[str, ...]
    key: str
    primary_text: str
    synonyms: tuple[str, ...] = ()
    #: Where a smart filter looks, if not in the primary text: another source, its text field and the key that leads back.
    smart_through: tuple[str, str, str] | None = None
    #: The field that leads to canonical items, whose names and other names a smart filter looks through too.
    canonical: str | None = None


@dataclass(frozen=True)
class Virtual:
    """A source that computes its rows for what a condition names: `required` is that condition's field. build: of the tables, the
    conditions' values by field and the most rows, rows with the fields and a column __place, which orders them."""

    title: str
    build: Callable[[Tables, dict[str, object], int], DataFrame]
    fields: dict[str, Field]
    default: tuple[str, ...]
    required: str
    rows: int | None = None  # where the specification names no limit
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tables:
    """Parquet tables of one folder."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def line_list(t: Tables) -> DataFrame:
    """Per order: its lines as one text, in line order, a line break between them, and their number."""
    lines = t("lineitem").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    text = F.concat(F.coalesce("p_name", F.lit("?")), F.lit(" x "), F.col("l_quantity").cast("decimal(18,2)").cast("string"))
    entries = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.alias("text"))))
    return lines.groupBy(F.col("l_orderkey").alias("list_key")).agg(
        F.array_join(F.transform(entries, lambda x: x["text"]), "\n").alias("items_list"), F.count("*").alias("items_count")
    )


def _invoices(t: Tables, needed: frozenset[str]) -> DataFrame:
    found = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if needed & {"items_list", "items_count"}:
        found = found.join(line_list(t), F.col("o_orderkey") == F.col("list_key"), "left")
    extra = {"items_list": F.col("items_list"), "items_count": F.coalesce("items_count", F.lit(0))} if needed & {"items_list", "items_count"} else {}
    return _select(
        found, invoice_id=F.col("o_orderkey"), invoice_number=F.col("o_orderkey").cast("string"), invoice_date=F.col("o_orderdate"), supplier_name=F.col("c_name"), segment=F.col("c_mktsegment"),
        total_amount=F.col("o_totalprice"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"), **extra,
    )


def _items(t: Tables, needed: frozenset[str]) -> DataFrame:
    found = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = found.join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    canonical = {}
    if "canonical_id" in needed:
        found = found.join(canonical_items(t).select("canonical_id", "name"), F.split_part("p_name", F.lit(" "), F.lit(2)) == F.col("name"), "left")
        canonical = {"canonical_id": F.col("canonical_id")}
    return _select(
        found, **canonical, invoice_id=F.col("l_orderkey"), line_number=F.col("l_linenumber"), description=F.col("p_name"), sku=F.col("p_partkey").cast("string"), quantity=F.col("l_quantity"), amount=F.col("l_extendedprice"),
        unit_price=F.try_divide("l_extendedprice", "l_quantity"), tax_rate=F.col("l_tax"), invoice_number=F.col("l_orderkey").cast("string"), invoice_date=F.col("o_orderdate"), supplier_name=F.col("s_name"),
    )


def canonical_items(t: Tables) -> DataFrame:
    """canonical_id, name, aliases: one item for each kind of part, with the type of its first part as another name."""
    kind = F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")
    found = t("part").groupBy(kind).agg(F.min("p_partkey").alias("canonical_id"), F.array(F.min_by("p_type", "p_partkey")).alias("aliases"))
    return found.select("canonical_id", "name", "aliases")


def _anomalies(t: Tables, needed: frozenset[str]) -> DataFrame:
    found = t("events").where("event_type = 'error'")
    severity = F.when(F.col("value") >= 100, "critical").when(F.col("value") >= 50, "warning").otherwise("info")
    solved = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return _select(
        found, anomaly_id=F.col("event_id"), title=F.concat(F.lit("error of user "), F.col("user_id").cast("string")), anomaly_type=F.col("event_type"), severity=severity,
        status=F.when(solved, "resolved").otherwise("open"), created_at=F.col("ts"), resolved_by=F.when(solved, F.concat(F.lit("user "), F.col("user_id").cast("string"))),
        resolved_at=F.when(solved, F.col("ts") + F.expr("INTERVAL 1 DAY")), description=F.col("props"),
    )


def _vector_search(t: Tables, wanted: dict[str, object], most: int) -> DataFrame:
    """The rows nearest to the one that the query names; a condition on the type is part of the scan."""
    from quarry.operators.retrieval import cosine

    own = t("embeddings").where(F.col("vec_id") == int(wanted["query"])).select(F.col("embedding").alias("own")).limit(1)
    rows = t("embeddings").where(F.col("vec_id") != int(wanted["query"]))
    if "doc_type" in wanted:
        rows = rows.where(F.col("label").cast("string") == str(wanted["doc_type"]))
    scored = rows.join(F.broadcast(own)).select("vec_id", "label", cosine(F.col("embedding"), F.col("own")).alias("exact"))  # one row beside the scan
    best = scored.orderBy(F.desc_nulls_last("exact"), "vec_id").limit(most)
    return best.select(
        F.coalesce(F.round("exact", 3), F.lit(0.0)).alias("score"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("file_name"), F.col("label").cast("string").alias("doc_type"),
        F.col("vec_id").cast("string").alias("doc_id"), F.lit(str(wanted["query"])).alias("query"), F.struct(-F.coalesce("exact", F.lit(0.0)), "vec_id").alias("__place"),
    )


def knowledge(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, title, kind, confidence) and edges (source, target, edge_type, confidence, reason) of parties and places."""
    ids = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nodes = [("supplier", "s_suppkey", "s_name", F.col("s_acctbal") / 10_000), ("nation", "n_nationkey", "n_name", F.lit(1.0)), ("region", "r_regionkey", "r_name", F.lit(2.0))]
    every = [t(table).select(ids(table, key).alias("node"), F.col(name).alias("title"), F.lit(table).alias("kind"), c.alias("confidence")) for table, key, name, c in nodes]
    edges = [("supplier", "s_suppkey", "nation", "s_nationkey", "located_in", F.col("s_acctbal") / 10_000), ("nation", "n_nationkey", "region", "n_regionkey", "part_of", F.lit(1.0))]
    links = [
        t(a).select(ids(a, x).alias("source"), ids(b, y).alias("target"), F.lit(kind).alias("edge_type"), c.cast("double").alias("confidence"), F.lit(f"{a} table").alias("reason"))
        for a, x, b, y, kind, c in edges
    ]
    return every[0].unionAll(every[1]).unionAll(every[2]), links[0].unionAll(links[1])


def _graph_query(t: Tables, wanted: dict[str, object], most: int) -> DataFrame:
    """The edges of the surest node whose title or name holds the text."""
    nodes, edges = knowledge(t)
    text = f"%{wanted['start_node']}%"
    center = nodes.where(F.col("title").ilike(text) | F.col("node").ilike(text)).orderBy(F.desc("confidence"), "node").limit(1).select(F.col("node").alias("center"), F.col("title").alias("start_node"))
    own = F.broadcast(center)  # one row at most
    near = edges.join(own, F.col("source") == F.col("center")).unionAll(edges.join(own, (F.col("target") == F.col("center")) & (F.col("source") != F.col("center"))))
    named = near.join(nodes.select(F.col("node").alias("source"), F.col("title").alias("source_title")), "source", "left")
    named = named.join(nodes.select(F.col("node").alias("target"), F.col("title").alias("target_title"), F.col("kind").alias("target_type")), "target", "left")
    return named.select(
        "start_node", F.coalesce("source_title", F.lit("")).alias("source_title"), "edge_type", F.coalesce("target_title", F.lit("")).alias("target_title"), F.coalesce("target_type", F.lit("")).alias("target_type"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"), F.struct("source", "target", "edge_type").alias("__place"),
    )


def _suppliers(t: Tables, needed: frozenset[str]) -> DataFrame:
    found = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return _select(found, supplier_id=F.col("s_suppkey"), name=F.col("s_name"), address=F.col("n_name"), region=F.col("r_name"), balance=F.col("s_acctbal"))


def _warehouse(t: Tables, needed: frozenset[str]) -> DataFrame:
    found = t("part").withColumn("min_qty", F.lit(10))
    below = F.when(F.col("min_qty").isNotNull() & (F.col("p_size") < F.col("min_qty")), "yes").otherwise("no")
    return _select(found, item_id=F.col("p_partkey"), name=F.col("p_name"), sku=F.col("p_brand"), current_qty=F.col("p_size"), min_qty=F.col("min_qty"), location=F.col("p_type"), below_min=below)


def _documents(t: Tables, needed: frozenset[str]) -> DataFrame:
    pages = F.ceil(F.col("n_chars") / 3000).cast("long")
    return _select(t("documents"), document_id=F.col("doc_id"), file_name=F.col("doc_id").cast("string"), doc_type=F.col("lang"), source_channel=F.col("source"), page_count=pages)


def _payments(t: Tables, needed: frozenset[str]) -> DataFrame:
    found = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    due = F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "P", "partial").otherwise("scheduled")
    return _select(found, payment_id=F.col("o_orderkey"), invoice_number=F.col("o_orderkey").cast("string"), due_date=due, amount=F.col("o_totalprice"), status=status, supplier_name=F.col("c_name"))


def _emails(t: Tables, needed: frozenset[str]) -> DataFrame:
    inbound = F.when(F.col("role") == "user", "inbound").otherwise("outbound")
    return _select(t("conversations"), mailbox=F.col("conv_id"), turn=F.col("turn"), subject=F.col("text"), from_address=F.col("role"), direction=inbound)


def _drawings(t: Tables, needed: frozenset[str]) -> DataFrame:
    return _select(t("events"), drawing_id=F.col("event_id"), title=F.col("event_type"), material=F.get_json_object("props", "$.k"), created_at=F.col("ts"), weight=F.col("value"))


def _tools(t: Tables, needed: frozenset[str]) -> DataFrame:
    """Active entries (with a price) with their supplier: the first part of lines, or the brand where there is none."""
    first = t("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_supplier"))
    found = t("part").where("p_retailprice is not null").join(first, F.col("p_partkey") == F.col("l_partkey"), "left").join(t("supplier"), F.col("first_supplier") == F.col("s_suppkey"), "left")
    return _select(
        found, entry_id=F.col("p_partkey"), name=F.col("p_name"), part_number=F.col("p_partkey").cast("string"), tool_type=F.col("p_type"),
        diameter_mm=F.col("p_size"), price_value=F.col("p_retailprice"), supplier_name=F.coalesce("s_name", "p_brand"),
    )


def _select(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(k) for k, c in columns.items()))


def _fields(text: str = "", number: str = "", date: str = "") -> dict[str, Field]:
    kinds = (("text", text), ("number", number), ("date", date))
    return {k: Field(k.replace("_", " ").capitalize(), kind, (k.replace("_", " "),)) for kind, names in kinds for k in names.split()}


SOURCES: dict[str, Source] = {
    "invoices": Source(
        "Invoices", _invoices, _fields("invoice_number supplier_name segment status priority items_list", "invoice_id total_amount items_count", "invoice_date"),
        ("supplier_name", "invoice_number", "invoice_date", "total_amount"), "invoice_id", "supplier_name", ("invoice", "bill"), ("invoice_items", "description", "invoice_id"),
    ),
    "invoice_items": Source(
        "Invoice lines", _items, _fields("description sku invoice_number supplier_name", "canonical_id invoice_id line_number quantity amount unit_price tax_rate", "invoice_date"),
        ("description", "quantity", "unit_price", "amount", "supplier_name", "invoice_number"), "invoice_id", "description", ("items", "lines", "goods"), canonical="canonical_id",
    ),
    "anomalies": Source("Anomalies", _anomalies, _fields("title anomaly_type severity status resolved_by description", "anomaly_id", "created_at resolved_at"), ("title", "anomaly_type", "severity", "status", "created_at"), "anomaly_id", "title", ("anomaly", "problems")),
    "suppliers": Source("Suppliers", _suppliers, _fields("name address region", "supplier_id balance"), ("name", "address"), "supplier_id", "name", ("supplier", "vendor")),
    "warehouse": Source("Stock", _warehouse, _fields("name sku location below_min", "item_id current_qty min_qty"), ("name", "sku", "current_qty", "location"), "item_id", "name", ("stock", "inventory")),
    "documents": Source("Documents", _documents, _fields("file_name doc_type source_channel", "document_id page_count"), ("file_name", "doc_type", "source_channel"), "document_id", "file_name", ("document", "file")),
    "payments": Source("Payments", _payments, _fields("invoice_number status supplier_name", "payment_id amount", "due_date"), ("due_date", "amount", "status", "invoice_number"), "payment_id", "supplier_name", ("payment", "due")),
    "emails": Source("Messages", _emails, _fields("subject from_address direction", "mailbox turn"), ("subject", "from_address", "mailbox"), "mailbox", "subject", ("email", "message")),
    "drawings": Source("Drawings", _drawings, _fields("title material", "drawing_id weight", "created_at"), ("title", "material"), "drawing_id", "title", ("drawing",)),
    "tool_catalog": Source("Tools", _tools, _fields("name part_number tool_type supplier_name", "entry_id diameter_mm price_value"), ("name", "part_number", "price_value"), "entry_id", "name", ("tool", "catalog")),
}


VIRTUAL: dict[str, Virtual] = {
    "vector_search": Virtual("Likeness", _vector_search, _fields("file_name doc_type doc_id query", "score"), ("score", "file_name", "doc_type"), "query", 50, ("semantic search",)),
    "graph_query": Virtual("Relations", _graph_query, _fields("start_node source_title edge_type target_title target_type reason", "confidence"), ("source_title", "edge_type", "target_title", "confidence"), "start_node", None, ("relations",)),
}


def names_of(fields: Iterable[str]) -> frozenset[str]:
    return frozenset(fields)
