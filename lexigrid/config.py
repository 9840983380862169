"""Settings of an engine."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """shards: directories that a table's rows are spread over by term, pruned by a query's terms. page_rows: rows of a
    file that compaction aims at. codec: Parquet's. now: seconds used for documents without a timestamp, None for the clock."""

    shards: int = 16
    page_rows: int = 5_000_000
    codec: str = "zstd"
    read_only: bool = False
    now: int | None = None

    @classmethod
    def from_json(cls, text: str) -> EngineConfig:
        """Unknown members are ignored; one of the wrong type counts as missing."""
        raw = json.loads(text)
        own = {}
        for f in fields(cls):
            v = raw.get(f.name)
            want = {"shards": int, "page_rows": int, "codec": str, "read_only": bool, "now": int}[f.name]
            if isinstance(v, want) and (want is bool or not isinstance(v, bool)):
                own[f.name] = v
        return cls(**own)
