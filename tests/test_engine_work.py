"""What the engine does once, and in parts that memory holds."""

from edilake.operators.events import journal_rows
from edilake.plans import queries, synth
from edilake.sources import x12

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_made_once(spark):
    assert plan(queries.docs(spark, SF, "837")).count("LX*") == 1
    assert plan(queries.provider_taxonomy(spark, SF)).count("LX*") == 1


def test_taxonomy_reads_its_fields_only(spark):
    got = plan(queries.provider_taxonomy(spark, SF))
    assert "map_filter" not in got and "subscriber_e" not in got
    # Numbering of the lines, segments, context, earlier provider, waiting taxonomy, held segments.
    assert got.count("Window [") <= 6


def test_large_inputs_are_dealt_into_more_parts(spark, monkeypatch):
    assert synth._parts(spark, SF, "lineitem") == 4
    monkeypatch.setattr(synth, "PART_BYTES", 10_000)
    many = synth._parts(spark, SF, "lineitem")
    assert many > 4
    got = plan(queries.docs(spark, SF, "837"))
    assert got.count(f", {many}), REPARTITION_BY_NUM") == 2 and got.count("Exchange hashpartitioning") == 2


def test_stages_are_of_methods_that_compile(spark):
    journal_rows(x12.segments(queries.docs(spark, SF, "837")))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_line_items_are_shuffled_as_numbers(spark, tmp_path):
    """One array of whole numbers and one of flags; nulls stay, and prices that round alike keep their order."""
    from datetime import datetime

    day = datetime(2026, 1, 2)
    rows = [(1, 1, 7, 8, 2.0, 10.004, 0.05, None, "N", "F", day), (1, 1, 7, 8, 3.0, 10.001, 0.05, 0.01, None, "O", day), (1, 1, 7, 8, None, 10.004, 0.05, 0.02, "R", "F", datetime(2026, 1, 1))]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = synth.lines(spark, str(tmp_path))
    assert " AS parts" not in plan(df) and "array(l_returnflag" not in plan(df)
    got = [(r.rn, r.charge, r.t, r.units, r.day, r.submitted, r.remitted) for r in df.orderBy("rn").collect()]
    assert got == [(1, 1000, 1, 3, "20260102", None, False), (2, 1000, 2, None, "20260101", False, True), (3, 1000, None, 2, "20260102", True, True)]
