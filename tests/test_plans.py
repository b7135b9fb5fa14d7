import pytest

from quarry.plans.catalog import Tables
from quarry.plans.guard import checked, guarded
from quarry.plans.spec import Condition, Shown, TableSpec, compiled, edited, problems, repaired, smart_tokens, total, unlimited


def test_smart_tokens():
    assert smart_tokens("Фрезы для диаметр 5, все!") == ["фрез", "5"]
    assert smart_tokens("a to 12,5 Bolts") == ["12", "5", "bolt"]


def test_standalone_number(spark):
    from pyspark.sql import functions as F

    from quarry.plans.spec import standalone_number

    df = spark.createDataFrame([("mill 5 mm",), ("mill 50 mm",), ("mill 0.5 mm",), ("5",)], "t string")
    assert [r.t for r in df.where(standalone_number(F.col("t"), "5")).collect()] == ["mill 5 mm", "5"]


def test_problems_and_repair():
    spec = TableSpec("invoices", (Shown("nothing"),), (Condition("total_amount", "like", 1),), (("x", False),))
    assert problems(spec) == ["unknown column nothing", "unknown sort field x", "unknown operator like"]
    fixed, notes = repaired(TableSpec("Invoice", (Shown("Total amount"), Shown("junk"))))
    assert fixed.source == "invoices" and [c.field for c in fixed.columns] == ["total_amount"] and len(notes) == 2
    with pytest.raises(ValueError):
        compiled(spec, None)


def test_edits():
    spec = TableSpec("invoices", (Shown("invoice_number"), Shown("total_amount")))
    out = edited(spec, [{"op": "add_column", "field": "status", "before": "total_amount"}, {"op": "add_column", "field": "status"}, {"op": "set_sort", "field": "total_amount", "desc": True},
                        {"op": "set_group_by", "field": "segment"}, {"op": "set_aggregate", "field": "total_amount", "agg": "avg"}, {"op": "add_filter", "field": "status", "value": "O"}, {"op": "set_limit", "limit": 3}])
    assert [c.field for c in out.columns] == ["segment", "invoice_number", "status", "total_amount"]
    assert out.sort == (("total_amount", True),) and out.group_by == ("segment",) and out.limit == 3 and out.columns[3].agg == "avg"
    assert edited(out, [{"op": "remove_filter", "field": "status"}]).filters == ()
    with pytest.raises(ValueError):
        edited(spec, [{"op": "fly"}])


def test_edits_of_places_groups_and_filters():
    fields = lambda s: [c.field for c in s.columns]
    spec = TableSpec("invoices", (Shown("invoice_number"), Shown("status"), Shown("total_amount")), (Condition("status", "eq", "O"),), group_by=("status",))
    assert fields(edited(spec, [{"op": "move_column", "field": "invoice_number", "after": "status"}])) == ["status", "invoice_number", "total_amount"]
    assert fields(edited(spec, [{"op": "move_column", "field": "total_amount", "before": "status"}])) == ["invoice_number", "total_amount", "status"]
    assert fields(edited(spec, [{"op": "add_column", "field": "segment", "after": "invoice_number"}])) == ["invoice_number", "segment", "status", "total_amount"]
    assert edited(spec, [{"op": "set_group_by", "field": "segment"}]).group_by == ("segment", "status")
    assert edited(spec, [{"op": "set_group_by", "field": "status"}]).group_by == ("status",) and edited(spec, [{"op": "clear_filters"}]).filters == ()
    for bad in ({"op": "add_column", "field": "none"}, {"op": "move_column", "field": "segment"}, {"op": "remove_column", "field": "segment"}, {"op": "set_sort", "field": "none"}, {"op": "what"}):
        with pytest.raises(ValueError):
            edited(spec, [bad])


def test_limits_and_total(spark, data):
    t = Tables(spark, data)
    spec = TableSpec("invoice_items", limit=0)
    assert compiled(spec, t).count() == 5000 and total(spec, t) == 6000
    assert "orders" not in unlimited(TableSpec("warehouse"), t)._jdf.queryExecution().toString()


def test_pushdown(spark, data):
    plan = compiled(TableSpec("invoices", (Shown("invoice_number"),), (Condition("total_amount", "gte", 1e5),)), Tables(spark, data))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in plan and "o_orderpriority" not in plan.split("== Physical Plan ==")[1]


def test_guard(spark, data):
    assert checked("SELECT id FROM invoices LIMIT 10;") == "SELECT id FROM invoices LIMIT 10"
    for bad in ("UPDATE t SET x=1", "DELETE FROM t", "SELECT 1; DROP TABLE t", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT * FROM parquet.`/etc`", "", "SELECT 1 -- x", "INSERT INTO t VALUES (1)"):
        assert checked(bad) is None
    assert checked("SELECT 'drop' AS x") is not None
    orders = Tables(spark, data)("orders")
    assert guarded(spark, "SELECT * FROM orders", {"orders": orders}).count() == 200
    with pytest.raises(ValueError):
        guarded(spark, "DROP TABLE orders", {})


def test_virtual_sources(spark, data):
    t = Tables(spark, data)
    assert problems(TableSpec("graph_query")) == ["graph_query needs a filter on start_node"]
    with pytest.raises(ValueError):
        compiled(TableSpec("vector_search", sort=(("score", False),)), t)
    near = TableSpec("vector_search", filters=(Condition("query", "contains", "3"),))
    assert compiled(near, t).count() == min(50, t("embeddings").count() - 1) and compiled(near, t).columns == ["score", "file_name", "doc_type"]
    scores = [r.score for r in compiled(near, t).collect()]
    assert scores == sorted(scores, reverse=True)
    upward = [r.score for r in compiled(TableSpec("vector_search", filters=near.filters, sort=(("score", False),), limit=7), t).collect()]
    assert upward == scores[:7][::-1]  # the seven best, then sorted
    assert compiled(TableSpec("graph_query", filters=(Condition("start_node", "eq", "no such node"),)), t).count() == 0
    assert repaired(TableSpec("Semantic search", filters=near.filters))[0].source == "vector_search"
    assert [c.field for c in edited(near, [{"op": "add_column", "field": "doc_id"}]).columns] == ["doc_id"]


def test_smart_filters_through_items(spark, data):
    t = Tables(spark, data)
    from quarry.plans.catalog import canonical_items

    item = canonical_items(t).orderBy("canonical_id").first()
    lines = TableSpec("invoice_items", (Shown("description"),), (Condition("description", "smart", item.aliases[0]),))
    found = {r.description.split(" ")[1] for r in compiled(lines, t).collect()}
    same = {r.name for r in canonical_items(t).collect() if item.aliases[0] in r.aliases}
    assert found and found <= same
    numbers = TableSpec("invoice_items", (Shown("description"),), (Condition("description", "smart", f"{item.aliases[0]} 7"),))
    assert compiled(numbers, t).count() == 0  # an item does not stand for a number
    keyed = compiled(lines, t, hidden_key=True)
    assert keyed.columns == ["description", "__pk"]
