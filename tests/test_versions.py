"""Tables change hands whole: a stage that fails on the way changes nothing."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from retailcast.operators import features, state
from retailcast.plans.stages import Job, handed_over
from retailcast.sources.versions import Published

KEY = ["store_id", "department"]
START = dt.date(2020, 1, 4)


def job_of(spark, base):
    return Job(spark, f"{base}/raw", f"{base}/processed", f"{base}/outputs", START, START)


def test_a_stage_that_dies_leaves_the_old_results(spark, tmp_path):
    job = job_of(spark, tmp_path)

    def stage(value, fail=False):
        def run(job):
            job.write("first", spark.range(value, value + 1))
            assert job.read("first").count() == 1  # within the stage the new table is read
            if fail:
                raise RuntimeError("lost")
            job.write("second", spark.range(value + 10, value + 11))

        return handed_over(run)

    ids = lambda: [int(job.read(n).first()["id"]) for n in ("first", "second")]
    stage(1)(job)
    assert ids() == [1, 11]
    with pytest.raises(RuntimeError, match="lost"):
        stage(2, fail=True)(job)
    assert ids() == [1, 11]
    stage(3)(job)
    assert ids() == [3, 13]


def test_tables_of_other_stages_stay(spark, tmp_path):
    job = job_of(spark, tmp_path)
    handed_over(lambda j: j.write("a", spark.range(1)))(job)
    handed_over(lambda j: j.write("b", spark.range(2)))(job)
    assert (job.read("a").count(), job.read("b").count()) == (1, 2)


def test_the_second_of_two_writers_is_refused(spark, tmp_path):
    published = Published(spark, str(tmp_path))
    base = published.number()
    published.hand_over({"x": "one"}, base)
    with pytest.raises(RuntimeError, match="changed"):
        published.hand_over({"x": "two"}, base)
    assert published.current() == {"x": "one"}


def test_half_written_manifests_are_not_read(spark, tmp_path):
    published = Published(spark, str(tmp_path))
    published.hand_over({"x": "one"})
    Path(tmp_path, "_manifests", ".draft").write_text("{broken")
    assert published.current() == {"x": "one"}


def panel(spark, weeks, correct=None):
    rows = []
    for store in (1, 2):
        for department in (1, 2):
            for w in weeks:
                value = float((store * 31 + department * 17 + w * w) % 101)
                if correct and (store, w) == correct[0]:
                    value = correct[1]
                rows.append((store, department, START + dt.timedelta(weeks=w), value, "A", 10.0 * store, "EUROPE"))
    return spark.createDataFrame(rows, "store_id long, department int, date date, weekly_sales double, store_type string, store_size double, region string")


def coming(df):
    return sorted(tuple(r) for r in features.next_week_rows(df).collect())


def test_three_weeks_in_turn_equal_one_recomputation(spark, tmp_path):
    folder = str(tmp_path)
    state.take_week(spark, folder, panel(spark, range(20)))
    for w in (20, 21, 22):
        held = state.take_week(spark, folder, panel(spark, [w]))
        assert coming(held) == coming(panel(spark, range(w + 1)))
        assert held.groupBy(*KEY).count().agg(F.max("count")).first()[0] == state.REACH


def test_late_corrections_count_while_they_are_looked_at(spark, tmp_path):
    folder, whole = str(tmp_path), range(23)
    state.take_week(spark, folder, panel(spark, whole))
    fixed = ((1, 18), 999.0)
    late = panel(spark, [18], fixed).where("store_id = 1")
    assert coming(state.take_week(spark, folder, late)) == coming(panel(spark, whole, fixed))
    # Too old for any feature: the forecast rows stay as they were.
    before = coming(state.stored_state(spark, folder))
    assert coming(state.take_week(spark, folder, panel(spark, [3], ((1, 3), 5.0)).where("store_id = 1"))) == before


def test_a_run_that_dies_leaves_the_old_state(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    state.take_week(spark, folder, panel(spark, range(12)))
    before = coming(state.stored_state(spark, folder))
    monkeypatch.setattr(Published, "hand_over", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        state.take_week(spark, folder, panel(spark, [12]))
    assert coming(state.stored_state(spark, folder)) == before
