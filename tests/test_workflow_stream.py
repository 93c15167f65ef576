"""Workflows over a stream against the batch fold; timers fire without another event."""

import datetime as dt
import random
import time


from provenia.operators import workspace
from provenia.streaming.workflow import advance, final_workflows

TTL = 600_000
BEGIN = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches):
    schema = "workflow_id long, event_id long, choice string, ts timestamp"
    for part in batches:
        spark.createDataFrame([(w, k, c, BEGIN + dt.timedelta(seconds=s)) for w, k, c, s in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in order of their times
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return {r.workflow_id: r.stage for r in final_workflows(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint", TTL).collect()}


def test_timers_fire_without_another_event(spark, tmp_path):
    batches = [[(1, 0, "proceed", 0), (2, 1, "proceed", 0), (3, 2, "abort", 5), (4, 3, "refine", 5)], [(2, 4, "proceed", 500)], [(9, 5, "proceed", 700)]]
    assert run(spark, tmp_path, batches) == {1: "expired", 2: "draft", 3: "aborted", 4: "expired", 9: "outline"}


def test_stream_equals_the_batch_fold(spark, tmp_path):
    rng = random.Random(6)
    at, rows = 0, []
    for k in range(300):
        at += rng.choice([0, 1, 30, 90])
        rows.append((rng.randint(1, 12), k, rng.choice(["proceed", "proceed", "refine", "abort", "strange"]) if rng.random() < 0.95 else "abort", at))
    got = run(spark, tmp_path, [rows[:90], rows[90:200], rows[200:]])
    choices = spark.createDataFrame([(w, k, c, s * 1000) for w, k, c, s in rows], "workflow_id long, event_id long, choice string, ms long")
    want = {r.workflow_id: r.stage for r in workspace.workflow_states(choices, TTL).collect()}
    saved = {}
    for w, _, choice, s in rows:
        saved[w] = advance(saved.get(w, (0, s * 1000, "open")), s * 1000, choice, TTL)
    over = {w for w, (_, reached, end) in saved.items() if end == "open" and reached + TTL < at * 1000}
    assert got == {w: "expired" if w in over else stage for w, stage in want.items()}
    assert "aborted" in got.values()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
