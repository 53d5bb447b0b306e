"""Work that must not grow with fixed costs or copies."""

from pyspark.sql import functions as F

from tarmetric.operators import cells as C
from tarmetric.plans.registry import World


def test_bounded_cells_are_not_counted(spark):
    """Rows of a cell known to fit one call are neither counted nor joined with counts."""
    rows = spark.range(40).select(F.lit("g").alias("graph"), (F.col("id") % 4).alias("cell"), "id")
    cells = spark.range(4).select(F.lit("g").alias("graph"), F.col("id").alias("cell"))

    def run(key, own, cell):
        return own.assign(n=len(cell))[["cell", "id", "n"]]

    schema = "cell long, id long, n long"
    bounded = C._by_cell(rows, rows, cells, ["id"], run, schema, 4, most=40)
    counted = C._by_cell(rows, rows, cells, ["id"], run, schema, 4)
    plan = bounded._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(bounded.collect()) == sorted(counted.collect()) and bounded.count() == 40
    assert "Join" in C._by_cell(rows, rows, cells, ["id"], run, schema, 4, most=C.ROWS_PER_CHUNK + 1)._jdf.queryExecution().optimizedPlan().toString()


def test_segments_are_worked_out_in_many_tasks(spark):
    w = World(spark, "/root/testdata/sf0.001")
    assert len(w.segments.inputFiles()) > 1
    assert w.segments.count() == w["road_segment"].count()
