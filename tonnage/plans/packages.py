"""Export packages: which frames of a build leave it, under which name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tonnage.plans import contracts, features
from tonnage.plans.build import StoredBuild

# fixed values: names of the exported tables, and the frame of the build behind each
BI_TABLES = {
    "dim_date": "dates", "dim_product": "products", "dim_line": "lines_dim", "dim_shift": "shifts_dim", "dim_asset": "ev_assets",
    "fact_line_shift": "shift_mart", "fact_order": "order_mart", "fact_quality": "quality_mart", "fact_energy": "energy_mart",
    "fact_downtime": "downtime", "fact_maintenance": "maintenance", "fact_losses": "pareto", "fact_asset_condition": "condition_mart",
}
DIAGNOSTIC_TABLES = {
    "daily_trend": "trend", "mix_adjustment": "mix", "spc_tbh": "tbh_chart", "spc_quality": "quality_chart",
    "process_interactions": "cells", "segment_associations": "segment_links", "loss_pareto": "pareto",
}


def package(build: StoredBuild, tables: dict[str, str]) -> dict[str, DataFrame]:
    return {name: getattr(build, frame) for name, frame in tables.items()}


def contract_frames(build: StoredBuild) -> dict[str, tuple[DataFrame, DataFrame, str, tuple[str, ...], tuple[str, ...]]]:
    """Snapshot, labels, key, features and targets of the snapshots that have labels under their key."""
    windows = build.asset_snapshot.withColumnRenamed("criticality", "asset_criticality")
    return {
        "pre_order": (build.pre_order, features.order_labels(build.order_rows), "order_id", contracts.PRE_ORDER_FEATURES, contracts.PRE_ORDER_TARGETS),
        "asset_window": (windows, build.window_labels, "window_id", contracts.ASSET_WINDOW_FEATURES, contracts.ASSET_WINDOW_TARGETS),
    }


def feature_package(build: StoredBuild) -> dict[str, DataFrame]:
    """X, index and y of each snapshot, in contract order, over the samples that have labels."""
    out = {}
    for name, (snapshot, labels, key, chosen, targets) in contract_frames(build).items():
        covered = snapshot.join(labels.select(key), key, "left_semi")
        known = labels.join(snapshot.select(key), key, "left_semi")
        x, index, y = features.select_xy(covered, known, key, chosen, targets)
        out |= {f"{name}_X": x, f"{name}_index": index, f"{name}_y": y}
    return out
