"""Orders, predictions, reports and models as files; a publish step whose manifest comes last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import fixed_decimal

ORDERS = "order_id string, decision_timestamp_ns long, side string, order_type string, quantity string, limit_price string, time_to_live_ns string"
MODEL_VERSION, REPORT_VERSION = 3, 4


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """Order requests from CSV with a header, in the simulator's columns; an error if a required column is missing."""
    seen = spark.read.option("header", "true").csv(path)
    missing = {"order_id", "decision_timestamp_ns", "side", "order_type", "quantity"} - set(seen.columns)
    if missing:
        raise ValueError(f"order file lacks {sorted(missing)}")
    text = lambda c: F.col(c) if c in seen.columns else F.lit(None).cast("string")
    blank = lambda c: F.when(F.trim(text(c)) != "", F.trim(text(c)))
    return seen.select(F.lit("order").alias("kind"), "order_id", F.col("decision_timestamp_ns").cast("long").alias("decision_ns"), F.lower(F.trim("side")).alias("side"), fixed_decimal(F.trim("quantity")).alias("qty"), F.when(F.lower(F.trim("order_type")) == "limit", fixed_decimal(blank("limit_price"))).alias("limit_price"), blank("time_to_live_ns").cast("long").alias("ttl_ns"))


def write_predictions(rows: DataFrame, prediction: str, threshold: float, path: str) -> None:
    """Forecasts with their signal and selection as CSV."""
    from ..functions.quotes import signal

    kind = signal(F.col(prediction), F.lit(threshold))
    out = rows.select("session_id", "event_ix", "ts_ns", F.col(prediction).alias("prediction_bps"), F.col("target").alias("target_bps"), kind.alias("signal"), "best_bid", "best_ask", "future_best_bid", "future_best_ask", "bid_qty", "ask_qty", *[c for c in ("selected_trade", "side", "net_bps") if c in rows.columns])
    out.write.option("header", "true").csv(path)


def selected_orders(predictions: DataFrame, qty: int) -> DataFrame:
    """Market orders for the selected trades of a prediction file."""
    rows = predictions.where("selected_trade = 1 AND side <> 0")
    return rows.select("session_id", F.lit("order").alias("kind"), F.concat_ws("-", "session_id", "event_ix").alias("order_id"), F.col("ts_ns").alias("decision_ns"), F.when(F.col("side") > 0, "buy").otherwise("sell").alias("side"), F.lit(qty).cast("long").alias("qty"), F.lit(None).cast("long").alias("limit_price"), F.lit(None).cast("long").alias("ttl_ns"))


def classify_reports(spark: SparkSession, path: str) -> DataFrame:
    """path and state (current, stale, invalid) of JSON reports by their schema version."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("j"))
    version = F.try_variant_get("j", "$.schema_version", "int")
    return rows.select("path", F.when(F.col("j").isNull() | version.isNull(), "invalid").when(version == REPORT_VERSION, "current").otherwise("stale").alias("state"))


def schema_hash(columns: list[tuple[str, str]]) -> str:
    """SHA-256 of an ordered feature definition."""
    import hashlib

    return hashlib.sha256(json.dumps(columns, separators=(",", ":")).encode()).hexdigest()


def model_row(spark: SparkSession, model: dict, definition: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(MODEL_VERSION, schema_hash(definition), json.dumps(model))], "version int, feature_hash string, model string")


def load_model(rows: DataFrame, definition: list[tuple[str, str]]) -> dict:
    """The model, if its version and feature definition are the ones asked for."""
    row = rows.first()
    if row is None or row.version != MODEL_VERSION or row.feature_hash != schema_hash(definition):
        raise ValueError("the model was made for other features or by another version")
    return json.loads(row.model)


def publish(tables: dict[str, DataFrame], report: dict, path: str) -> None:
    """Writes all tables into a staging folder, moves it into place, and writes the report last; an error leaves nothing behind.

    Readers take a folder without a report for incomplete. An existing report is never overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    staging = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".staging")
    fs = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(to):
        raise FileExistsError(path)
    try:
        for name, t in tables.items():
            t.write.parquet(f"{staging.toString()}/{name}")
        if not fs.rename(staging, to):
            raise OSError(f"cannot publish to {path}")
        spark.createDataFrame([(json.dumps(report | {"schema_version": REPORT_VERSION}),)], "value string").coalesce(1).write.text(f"{path}/report")
    except Exception:
        fs.delete(staging, True)
        fs.delete(to, True)
        raise
