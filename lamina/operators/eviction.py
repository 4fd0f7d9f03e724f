"""Which cached objects to drop: least score first, until enough bytes are free."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.ordered import running_total

DECAY, FLOOR, MIN_FRACTION = 0.00000802, 10 * 1024 * 1024, 0.05


def score(idle_seconds: Column, size: Column, decay: float = DECAY, floor: int = FLOOR) -> Column:
    """Worth of keeping an object: what fetching it again costs, fading with the time that it was idle."""
    return F.exp(-F.lit(decay) * idle_seconds) * F.greatest(size, F.lit(floor))


def eviction_order(objects: DataFrame, decay: float = DECAY, floor: int = FLOOR) -> DataFrame:
    """(id, size, idle, orphan) with score and the bytes freed up to each: orphans first, then by score, then by id.

    The order is cut into ranges, so no task sorts all objects.
    """
    scored = objects.withColumn("score", score(F.col("idle"), F.col("size"), decay, floor))
    return running_total(scored, [F.desc("orphan"), F.asc("score"), F.asc("id")], "size", "freed")


def evict(objects: list[tuple[str, int, float, bool]], required: int, capacity: int, decay: float = DECAY, floor: int = FLOOR, fraction: float = MIN_FRACTION) -> list[str]:
    """Ids to drop of (id, size, idle seconds, orphan) so that ``required`` bytes, or a share of the cache, are free."""
    goal = max(required, int(fraction * capacity))
    if sum(o[1] for o in objects) < required:
        raise ValueError(f"{required} bytes can't be freed")
    ranked = sorted(objects, key=lambda o: (not o[3], math.exp(-decay * o[2]) * max(o[1], floor), o[0]))
    out, freed = [], 0
    for o in ranked:
        if freed >= goal and not o[3]:
            break
        out.append(o[0])
        freed += o[1]
    return out
