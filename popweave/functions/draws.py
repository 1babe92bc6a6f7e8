"""Deterministic draws: a value depends on (seed, channel, id), never on partitioning."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

SEED = "popweave"
_HEX = 13                      # 52 bits: exact in a double


def draw_int(channel: str, *ids, seed: str = SEED) -> Column:
    """52-bit integer from md5(seed|channel|id...)."""
    parts = [F.lit(seed), F.lit(channel)] + [F.col(i).cast("string") if isinstance(i, str) else i.cast("string")
                                             for i in ids]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX), 16, 10).cast("bigint")


def draw(channel: str, *ids, seed: str = SEED) -> Column:
    """Uniform number in [0, 1)."""
    return draw_int(channel, *ids, seed=seed) / F.lit(float(16 ** _HEX))


def draw_sql(channel: str, *ids: str, seed: str = SEED) -> str:
    """The same draw for the SQL side of a check."""
    parts = ", ".join(f"CAST({i} AS VARCHAR)" for i in ids)
    return (f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{channel}', {parts})), 1, {_HEX}) AS BIGINT)"
            f" / {float(16 ** _HEX)!r})")
