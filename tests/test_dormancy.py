"""Dormancy by timers: nothing but event time passing changes an issue that isn't in a batch."""

from datetime import datetime, timedelta, timezone

from weftline.streaming import dormancy

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_an_issue_turns_dormant_alone_and_wakes_up(spark, tmp_path):
    session = dormancy.with_timers(spark)

    def later(rows):
        session.createDataFrame([(i, START + timedelta(days=d)) for i, d in rows], "issue_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        dormancy.run_changes(session.readStream.schema("issue_id long, ts timestamp").parquet(str(tmp_path / "in")), str(tmp_path), 60 * dormancy.DAY)
        return {r["issue_id"]: (r["state"], r["changes"]) for r in dormancy.states(spark, str(tmp_path)).collect()}

    assert later([(1, 0), (2, 1), (2, 5)]) == {1: ("active", 1), 2: ("active", 1)}
    assert later([(2, 59)]) == {1: ("active", 1), 2: ("active", 1)}
    assert later([(2, 70)]) == {1: ("dormant", 2), 2: ("active", 1)}  # by the timer: issue 1 is in no batch
    assert later([(1, 71), (3, 80)]) == {1: ("active", 3), 2: ("active", 1), 3: ("active", 1)}
    assert later([(3, 200)]) == {1: ("dormant", 4), 2: ("dormant", 2), 3: ("active", 1)}
    assert later([(3, 201)])[3] == ("active", 1)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != dormancy.PROVIDER
