"""What a run needs to know: where tables and files are, what they are called, which run it is."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

LAYERS = ("bronze", "silver", "gold", "ops")


@dataclass(frozen=True)
class RunContext:
    schema: str
    landing: str
    catalog: str = "spark_catalog"
    table_format: str = "parquet"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    started_at: datetime = field(default_factory=lambda: datetime.now(UTC))

    @property
    def database(self) -> str:
        return f"`{self.catalog}`.`{self.schema}`"

    def table(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"no layer {layer!r}; there are {', '.join(LAYERS)}")
        return f"{self.database}.`{layer}_{name}`"

    def feed_path(self, feed: str) -> str:
        return f"{self.landing.rstrip('/')}/{feed}"
