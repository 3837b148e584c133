"""A hot key holding a third of all rows: results stay whole and exact."""

from pyspark.sql import functions as F

from shopmetrics.operators import cohort, funnel, quality, revenue

STAGES = ("home", "category", "product", "cart", "purchase")


def _skewed_events(spark, n=60_000):
    # user 0 owns every third row; the rest spread over 5,000 users
    ids = spark.range(n)
    return ids.select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000 + 1).alias("user_id"),
        F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.col("id") % 7 % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 11).alias("session_id"),
        F.when(F.col("id") % 2 == 0, "Email").otherwise("Search").alias("traffic_source"),
        F.make_timestamp_ntz(F.lit(2024), (F.col("id") % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        .alias("created_at"),
        (F.col("id") % 997 / 10.0).alias("total_sale_price"),
    )


def test_funnel_under_skew_equals_count_distinct(spark):
    ev = _skewed_events(spark)
    ours = {r["traffic_source"]: tuple(r[f"users_{s}"] for s in STAGES)
            for r in funnel.funnel_by(ev, "traffic_source", stages=STAGES).collect()}
    brute = ev.groupBy("traffic_source").agg(
        *[F.count_distinct(F.when(F.col("event_type") == s, F.col("user_id"))).alias(s) for s in STAGES])
    assert ours == {r[0]: tuple(r[1:]) for r in brute.collect()}


def test_cohort_under_skew_equals_self_join(spark):
    od = _skewed_events(spark).withColumn("status", F.lit("Complete")).withColumnRenamed("event_id", "order_id")
    ours = {(r["cohort_month"], r["month_number"]): (r["cohort_size"], r["retained_users"])
            for r in cohort.cohort_retention(od).collect()}
    # brute force: first month per user, joined back to every order, distinct users per cell
    m = od.select("user_id", F.trunc(F.to_date("created_at"), "month").alias("m"))
    first = m.groupBy("user_id").agg(F.min("m").alias("c"))
    cells = (m.join(first, "user_id")
             .select("user_id", "c", (F.months_between("m", "c")).cast("int").alias("n"))
             .groupBy("c", "n").agg(F.count_distinct("user_id").alias("k")))
    sizes = first.groupBy("c").agg(F.count("*").alias("size"))
    brute = {(r["c"], r["n"]): (r["size"], r["k"]) for r in cells.join(sizes, "c").where("n BETWEEN 0 AND 11").collect()}
    assert {(k[0].date(), k[1]): v for k, v in ours.items()} == brute
    assert sum(v[1] for k, v in ours.items() if k[1] == 0) == 5001


def test_rollup_and_duplicates_keep_every_row(spark):
    od = _skewed_events(spark).withColumnRenamed("event_id", "order_id")
    roll = revenue.order_rollup(od.withColumn("order_id", F.col("user_id")), "order_id", "total_sale_price")
    assert roll.agg(F.sum("num_of_item")).first()[0] == 60_000
    hot = roll.where("order_id = 0").first()
    assert hot["num_of_item"] == 20_000
    dup = quality.duplicate_keys(od, ("session_id", "event_type"), limit=20).collect()
    assert len(dup) == 20 and dup[0]["occurrences"] >= dup[-1]["occurrences"]
