"""Heading and speed of a stream of fixes, from neighbours on both sides.

Each track keeps the fixes that are not given out yet and the last one that was. A fix
whose time the watermark has passed has all that can come before it, so it is given out as
soon as the fix after it is such, too; the last of a track waits until the watermark is
further on than the gap, beyond which no neighbour counts. Fixes later than the watermark are
dropped. What a track holds is bounded by the delay of the watermark and the gap, not by
its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tackline.operators.tracks import from_neighbours

_FIX = ["t", "fix_idx", "lat", "lon", "cog", "sog"]
_TYPES = {"t": "long", "fix_idx": "long", "lat": "double", "lon": "double", "cog": "double", "sog": "double"}
_NEIGHBOURS = [f"{side}_{c}" for side in ("p", "n") for c in ("t", "lat", "lon")]
#: Fixes by column, in order; the first has been given out if ``given``.
_STATE = ", ".join(f"{c} array<{_TYPES[c]}>" for c in _FIX) + ", given boolean"
_OUT = "track_id long, " + ", ".join(f"{c} {_TYPES[c]}" for c in _FIX) + ", " + ", ".join(f"{c} {_TYPES[c[2:]]}" for c in _NEIGHBOURS)


def derive_stream(fixes: DataFrame, max_gap_s: int = 10_800, delay: str = "1 hour") -> DataFrame:
    """A stream of fixes (track_id, t, fix_idx, lat, lon, cog, sog), one a time of a track, with heading and speed as :func:`tackline.operators.tracks.derive` gives them. Append mode."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, given = [], False
        if state.exists:
            *columns, given = state.get
            held = list(zip(*columns, strict=True))
        first, rest = (held[:1], held[1:]) if given else ([], held)
        for part in parts:
            rest += [tuple(None if pd.isna(x) else x for x in r) for r in part[_FIX].itertuples(index=False)]
        rest.sort(key=lambda r: (r[0], r[1]))
        passed = state.getCurrentWatermarkMs() / 1000
        ready = sum(r[0] <= passed for r in rest)
        # the last that is ready waits for its neighbour, unless that cannot count any more
        if ready and not (ready == len(rest) and rest[-1][0] + max_gap_s < passed):
            ready -= 1
        line, rows = first + rest, []
        for k in range(len(first), len(first) + ready):
            before, after = (line[n] if 0 <= n < len(line) else (None,) * len(_FIX) for n in (k - 1, k + 1))
            rows.append((int(key[0]), *line[k], before[0], before[2], before[3], after[0], after[2], after[3]))
        kept = line[len(first) + ready - 1 :] if ready else line
        given = bool(ready) or given
        if given and len(kept) == 1 and kept[0][0] + max_gap_s < passed:
            state.remove()
        else:
            state.update((*map(list, zip(*kept, strict=True)), given))
            state.setTimeoutTimestamp(int(max(passed + 1, kept[-1][0] + max_gap_s + 1) * 1000))
        names = ["track_id", *_FIX, *_NEIGHBOURS]
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({c: "Int64" for c in names if c in ("track_id", "t", "fix_idx", "p_t", "n_t")} | {c: "Float64" for c in names if c.endswith(("lat", "lon", "cog", "sog"))})

    timed = fixes.select("track_id", *[F.col(c).cast(_TYPES[c]).alias(c) for c in _FIX], F.timestamp_seconds("t").alias("at")).withWatermark("at", delay)
    got = timed.groupBy("track_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    side = lambda p: F.when(F.col(f"{p}_t").isNotNull(), F.struct(F.col(f"{p}_t").alias("t"), F.col(f"{p}_lat").alias("lat"), F.col(f"{p}_lon").alias("lon")))
    return from_neighbours(got.select("track_id", *_FIX, side("p").alias("_before"), side("n").alias("_after")), max_gap_s)
