"""Declared schemas of the tables, and a guard that names what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY, SHARE = "decimal(14,2)", "decimal(5,2)"
TABLES = {
    "lots": f"lot_id bigint, title string, asset string, nature string, zone string, sphere string, status string, uf string, city string, district string, address string, auctioneer_id bigint, appraisal {MONEY}, first_min {MONEY}, second_min {MONEY}, commission {SHARE}, occupied boolean, liens array<string>, case_number string, lot_number string, registry string, plate string, brand string, model string, model_year int, collected_at timestamp_ntz, last_seen timestamp_ntz",
    "sessions": f"lot_id bigint, ordinal int, at timestamp_ntz, share {SHARE}, session_status string",
    "events": "lot_id bigint, kind string, at timestamp_ntz, event_status string, estimated boolean, reminders array<int>",
    "event_history": "lot_id bigint, kind string, old_at timestamp_ntz, new_at timestamp_ntz, old_status string, new_status string",
    "findings": "lot_id bigint, name string, confidence double, evidence string, method string, value string",
    "publications": "publication_id bigint, source string, external_id string, lot_id bigint, text string, published_on date, detected boolean, score decimal(4,3)",
    "analyses": f"lot_id bigint, source string, reference {MONEY}, compared {MONEY}, discount decimal(12,2), confidence decimal(5,3)",
    "scores": "lot_id bigint, score decimal(5,1), band string, discount decimal(12,2)",
    "auctioneers": "auctioneer_id bigint, name string, register string, licence string, uf string, status string, districts array<string>, credentials map<string,boolean>",
    "alerts": f"alert_id bigint, active boolean, ufs array<string>, assets array<string>, least_price {MONEY}, most_price {MONEY}, least_score double",
    "alerts_sent": "alert_id bigint, lot_id bigint",
    "runs": "run_id bigint, source string, started_at timestamp_ntz, run_status string, items bigint, warnings bigint",
    "vehicle_table": f"ref_id string, brand string, model string, year int, fuel string, value {MONEY}, month string, demo boolean",
    "price_index": f"uf string, city string, district string, value_m2 {MONEY}, month string, note string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def validate(df: DataFrame, name: str) -> DataFrame:
    """df itself if it has every column of the table; otherwise an error that lists those it lacks."""
    missing = [f.name for f in schema(name) if f.name not in df.columns]
    if missing:
        raise ValueError(f"table {name} lacks {', '.join(missing)}")
    return df
