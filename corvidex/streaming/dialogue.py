"""Dialogue windows as a stream: what a session's turn window leaves behind is emitted for compression as messages arrive.

State of a session: its messages that aren't emitted yet, where its last user
turns stand, and counts. That is bounded by the messages of ``turns`` + ``every``
user turns. The rows equal ``dialogue.compression_slices`` over the messages so
far, however these were split into batches; messages of a session arrive in the
order of ``seq``, and one at or before the last that was seen is passed over, so
a batch that is repeated adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "seen long, users long, slices long, base long, bounds array<long>, seqs array<long>, roles array<string>, contents array<string>"
_COLUMNS = ["session_id", "slice", "idx", "seq", "role", "content"]


def compression_slices(messages: DataFrame, turns: int, every: int) -> DataFrame:
    """(session_id, slice, idx, seq, role, content) of a stream of messages (session_id, seq, role, content), emitted once each."""
    kind = dict(messages.dtypes)["session_id"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            seen, users, slices, base, bounds, seqs, roles, contents = state.get
            bounds, seqs, roles, contents = list(bounds), list(seqs), list(roles), list(contents)
        else:
            seen, users, slices, base, bounds, seqs, roles, contents = None, 0, 0, 0, [], [], [], []
        out = []
        for row in pd.concat(batches).sort_values("seq").itertuples():
            if seen is not None and row.seq <= seen:
                continue
            seen = int(row.seq)
            seqs.append(seen)
            roles.append(row.role)
            contents.append(row.content)
            if row.role != "user":
                continue
            users += 1
            bounds = [*bounds, base + len(seqs) - 1][-turns:]
            if users % every or users < turns:
                continue
            # The window begins at the first of the last ``turns`` user turns; what stands before it is due.
            n = bounds[0] - base
            out += [(key[0], slices, base + i, seqs[i], roles[i], contents[i]) for i in range(n)]
            base, slices, seqs, roles, contents = base + n, slices + 1, seqs[n:], roles[n:], contents[n:]
        state.update((seen, users, slices, base, bounds, seqs, roles, contents))
        yield pd.DataFrame(out, columns=_COLUMNS)

    schema = f"session_id {kind}, slice long, idx long, seq long, role string, content string"
    rows = messages.selectExpr("session_id", "cast(seq AS long) AS seq", "role", "content")
    return rows.groupBy("session_id").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
