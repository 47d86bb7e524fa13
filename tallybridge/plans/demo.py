"""A small pair of snapshots and a configuration to try the tools on."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from tallybridge.plans import bundle

ROWS = {
    "reference": [(1, "500.00", "north", "shop"), (2, "250.00", "south", "web"), (3, "125.50", "north", "web"), (4, "80.00", None, "shop")],
    "current": [(1, "450.00", "north", "shop"), (2, "250.00", "west", "web"), (3, "125.50", "north", "web"), (5, "60.25", "west", "shop")],
}
CONFIG = """mode: snapshots
reference: reference.parquet
current: current.parquet
key: [order_id]
metric: {name: net_sales, aggregate: sum, column: net_amount, null_policy: error}
dimensions: [region, channel]
"""


def demo(out: str | Path, overwrite: bool = False) -> Path:
    """Write the demonstration inputs; returns the configuration's path."""
    target = bundle.prepare(out, overwrite)

    def fill(stage: Path) -> None:
        kinds = pa.schema([("order_id", pa.int32()), ("net_amount", pa.decimal128(18, 2)), ("region", pa.string()), ("channel", pa.string())])
        for side, rows in ROWS.items():
            ids, amounts, regions, channels = zip(*rows, strict=True)
            pq.write_table(pa.table([list(ids), [Decimal(a) for a in amounts], list(regions), list(channels)], schema=kinds), stage / f"{side}.parquet")
        (stage / "comparison.yaml").write_text(CONFIG, encoding="utf-8")

    bundle.publish(target, overwrite, fill)
    return target / "comparison.yaml"
