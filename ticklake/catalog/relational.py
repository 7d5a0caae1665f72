"""Coverage of the Spark primitives that the engine uses, over the star schema; these are not operators of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..queries import register
from ..sources.views import table


@register("rel_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n, avg(l_discount) AS discount FROM lineitem GROUP BY ALL", "quantity discount")
def pricing_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("discount"))


@register("rel_join_revenue", "SELECT n_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_revenue(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"))


@register("rel_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@register("rel_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


_DAY = lambda kind: f"SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = '{kind}'"


@register("rel_set_operations", f"({_DAY('click')} INTERSECT {_DAY('purchase')}) EXCEPT {_DAY('error')}")
def set_operations(spark, sf_dir):
    """Users and days with a click and a purchase, but no error."""
    of = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"))
    return of("click").intersect(of("purchase")).subtract(of("error"))


@register("rel_union", "SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def union(spark, sf_dir):
    one = lambda t, c: table(spark, sf_dir, t).groupBy(F.col(c).alias("nation")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("kind"), "nation", "n")
    return one("customer", "c_nationkey").unionByName(one("supplier", "s_nationkey"))


@register("rel_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 8")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(8).select("event_id", "value")


@register("rel_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@register("rel_as_of", "SELECT a.event_id, b.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.event_id > b.event_id")
def as_of(spark, sf_dir):
    """Backward as-of join by sorting both sides together."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("before_id", last).where("event_type = 'purchase'").select("event_id", "before_id")


@register("rel_json_strings", "SELECT upper(trim(event_type)) AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS digit, count(*) AS n FROM events GROUP BY ALL")
def json_strings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.upper(F.trim("event_type")).alias("kind"), (F.from_json("props", "k long")["k"] % 10).alias("digit"))
    return rows.groupBy("kind", "digit").agg(F.count(F.lit(1)).alias("n"))


# CRC-32 by its definition: each byte enters the low bits, then eight steps of the reflected polynomial 0xEDB88320
_BITS = "flatten(list_transform(range(strlen(props)), lambda i: list_concat([CAST(ord(substr(props, CAST(i + 1 AS INTEGER), 1)) AS BIGINT)], [0, 0, 0, 0, 0, 0, 0])))"
_CRC = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {_BITS}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


@register("crc32_payload", f"SELECT event_id, CAST({_CRC} AS BIGINT) AS crc FROM events")
def crc32_payload(spark, sf_dir):
    """Check sums of payloads, as the depth format stores them."""
    return table(spark, sf_dir, "events").select("event_id", F.crc32(F.col("props").cast("binary")).alias("crc"))


@register("fixed_point", "SELECT event_id, CAST(round(CAST(printf('%.2f', value) AS DECIMAL(28, 8)) * CAST(100000000 AS DECIMAL(10, 0))) AS BIGINT) AS units FROM events")
def fixed_point(spark, sf_dir):
    from ..functions.parsing import fixed_decimal

    return table(spark, sf_dir, "events").select("event_id", fixed_decimal(F.format_string("%.2f", F.col("value"))).alias("units"))
