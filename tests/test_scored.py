import os

import pytest
from partloom.operators import catalogue, cost, lines
from partloom.plans.queries import QUERIES
from partloom.sources.views import PRICE_STEPS, TABLES, VIEWS, frames, needed
from pyspark.sql import functions as F


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_lines_and_offers_equal_the_views(spark, sf):
    """Thin lines with their wordings are the lines of the view; priced offers are those of the views, steps and all."""
    v = frames(spark, sf)
    assert _rows(v["v_bom_line"]) == _rows(spark.sql(_nested("v_bom_line", sf)))
    priced = v["v_priced_offer"]
    same = ["part_id", "supp_id", "currency", "stock", "moq", "spq", "factory_lead_days", "authorized"]
    assert _rows(priced.select(same)) == _rows(v["v_offer"].select(same))
    steps = F.inline(F.array(*[F.struct(F.lit(q).alias("break_qty"), F.lit(p).alias("percent")) for q, p in PRICE_STEPS]))
    steps = priced.select("part_id", "supp_id", "base_micro", steps).select("part_id", "supp_id", "break_qty", F.floor((F.col("base_micro") * F.col("percent") + 50) / 100).alias("unit_micro"))
    assert _rows(steps) == _rows(v["v_price_break"])


def _nested(name, sf):
    """The view's own text over the files."""
    ctes = ", ".join(f"{t} as (select * from parquet.`{sf}/{t}.parquet`)" for t in TABLES) + "".join(f", {x} as ({VIEWS[x]})" for x in needed({name}) if x != name)
    return f"with {ctes} {VIEWS[name]}"


def test_lines_without_a_part_are_not_counted(spark, sf, tmp_path):
    """Lines of a part that is not in the catalogue are no lines, so those after them move up."""
    for t in os.listdir(sf):
        os.symlink(f"{sf}/{t}", tmp_path / t) if t != "part.parquet" else spark.read.parquet(f"{sf}/{t}").where("p_partkey % 9 <> 4").write.parquet(str(tmp_path / t))
    assert _rows(frames(spark, str(tmp_path))["v_bom_line"]) == _rows(spark.sql(_nested("v_bom_line", tmp_path)))


def test_counts_equal_the_rules(spark, sf):
    """Errors and warnings by distinct texts and by the ends of ranges are those that all rules find, line by line."""
    v = frames(spark, sf)
    odd = v["v_odd_line"].where("bom_id < 40").withColumn("ref_text", F.expr("case source_row%7 when 0 then 'R1-R6' when 1 then 'R6-R2, C1' when 2 then 'r1-r3' when 3 then 'AB0001-AB0003' when 4 then 'R1-C5' when 5 then 'SOL1-SOL2' else ref_text end"))
    given = lines.keyed(odd.withColumn("alt_mpns", F.array("alt_text")))
    found = lines.line_issues(given).groupBy("bom_id", "source_row").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    want = given.select("bom_id", "source_row").join(found, ["bom_id", "source_row"], "left").fillna(0)
    got = lines.with_issue_counts(given).select("bom_id", "source_row", F.col("errors").cast("long"), F.col("warnings").cast("long"))
    assert _rows(got) == _rows(want)


def test_best_of_equals_best_option(spark, sf):
    v = frames(spark, sf)
    wanted = v["v_part"].select("part_id", F.explode(F.array(*[F.lit(q).cast("long") for q in (0, 1, 99, 700, 5000, 400000)])).alias("required"))
    want = cost.best_option(cost.options(wanted.where("required > 0"), cost.usable_offers(v["v_offer"]), catalogue.ladders(v["v_price_break"])))
    best = cost.best_of(PRICE_STEPS)(F.col("required"), F.col("offers"))
    got = wanted.join(cost.gathered_offers(v["v_priced_offer"]), "part_id", "left").withColumn("b", best).where("b is not null")
    fields = ["supp_id", "order_qty", "unit_micro", "extended_micro", "covers", "overbuy", "low", "high", "options"]
    assert _rows(got.select("part_id", "required", *[f"b.{f}" for f in fields])) == _rows(want.select("part_id", "required", *fields))


@pytest.mark.parametrize("name, most", [("line_risk", 9), ("analysis_summary", 8), ("line_cost", 9), ("line_match", 12)])
def test_rows_shuffled_for_a_line(spark, sf, name, most):
    """Lines cross the network a few times, and neither their options nor their tiers do: rows written to shuffles, in times of the lines."""
    sc, jvm = spark.sparkContext, spark._jvm
    stages = lambda: list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), None)))
    before = max((s.stageId() for s in stages()), default=-1)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > before) <= most * 6000
