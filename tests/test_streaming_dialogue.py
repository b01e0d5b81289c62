"""Streamed slices equal the batch plan, however the messages are split."""

import os
import random

import pytest

from corvidex.operators import dialogue as batch
from corvidex.sources import corpus
from corvidex.streaming import dialogue

SCHEMA = "session_id long, seq long, role string, content string"


def loop(rows, turns, every):
    """The same by following each session message by message."""
    out, by = [], {}
    for sid, seq, role, content in sorted(rows):
        by.setdefault(sid, []).append((seq, role, content))
    for sid, held in by.items():
        cursor = number = users = 0
        for i, (_, role, _) in enumerate(held):
            users += role == "user"
            if role == "user" and users % every == 0 and users >= turns:
                start = [k for k in range(i + 1) if held[k][1] == "user"][-turns]
                out += [(sid, number, k, *held[k]) for k in range(cursor, start)]
                cursor, number = start, number + 1
    return sorted(out)


@pytest.mark.parametrize("turns, every", [(1, 1), (1, 2), (2, 2), (3, 2), (2, 5)])
def test_batch_plan_equals_the_loop(spark, turns, every):
    rows = [(r.session_id, r.seq, r.role, r.content) for r in corpus.messages(spark, "/root/testdata/sf0.01").collect()]
    rows += [(-1, k, "user" if k % 3 == 0 else "assistant", f"m{k}") for k in range(60)]
    got = batch.compression_slices(spark.createDataFrame(rows, SCHEMA), turns, every).collect()
    assert sorted(map(tuple, got)) == loop(rows, turns, every)


def test_stream_equals_the_batch_plan(spark, tmp_path):
    r = random.Random(6)
    rows = [(s, k, r.choice(["user", "assistant", "user", "system"]), f"{s}.{k}") for s in range(12) for k in range(r.randrange(1, 25))]
    (tmp_path / "in").mkdir()
    left = {s: [x for x in rows if x[0] == s] for s in range(12)}
    for n in range(5):
        part = []
        for held in left.values():
            k = len(held) if n == 4 else r.randrange(len(held) + 1)
            part += held[:k]
            del held[:k]
        again = part + ([x for x in rows if x[0] == 3 and x not in left[3]] if n == 3 else [])  # some once more
        r.shuffle(again)
        path = tmp_path / "in" / f"{n}.json"
        path.write_text("".join(f'{{"session_id":{a},"seq":{b},"role":"{c}","content":"{d}"}}\n' for a, b, c, d in again))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = []
    run = dialogue.compression_slices(stream, 2, 3).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    run.foreachBatch(lambda df, n: found.extend(map(tuple, df.collect()))).start().awaitTermination(200)
    assert sorted(found) == loop(rows, 2, 3) and len(found) > 20
