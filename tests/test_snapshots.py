import datetime as dt

from marlinspike.operators.snapshots import listing_changes

AT = dt.datetime(2025, 1, 1)
SNAP = "snapshot_no int, source_id string, external_id string, content_hash string, status string, first_seen_at timestamp, loaded_at timestamp, sign string"


def _run(spark, rows, log):
    s = spark.createDataFrame([(n, src, e, h, st, f, l, "x") for n, src, e, h, st, f, l in rows], SNAP)
    g = spark.createDataFrame(log, "snapshot_no int, source_id string, is_complete boolean")
    return sorted(((r.snapshot_no, r.source_id, r.external_id, r.change_kind, tuple(r.changed_fields or ())) for r in listing_changes(s, g).collect()), key=str)


def test_kinds_and_skipped_deliveries(spark):
    late = AT + dt.timedelta(days=1)
    rows = [
        (1, "s", "gone", "a", "active", None, AT),
        (1, "s", "same", "AB", "active", None, AT),
        (1, "s", "moved", "a", "active", AT, AT),
        (2, "s", "ignored", "a", "active", None, AT),
        (3, "s", "same", "ab", "active", None, AT),
        (3, "s", "same", "ab", "active", None, AT),
        (3, "s", "moved", "a", "active", AT, AT),
        (3, "s", "moved", "a", "rejected", None, late),
        (3, "s", "new", None, None, None, None),
        (3, "s", None, "a", "active", None, AT),
        (1, None, "x", "a", "active", None, AT),
    ]
    log = [(1, "s", True), (2, "s", False), (3, "s", True), (3, "s", True), (1, "t", True), (4, "u", None)]
    assert _run(spark, rows, log) == sorted(
        [(3, "s", "gone", "removed", ()), (3, "s", "moved", "changed", ("first_seen_at", "status")), (3, "s", "new", "added", ()), (3, "s", None, "added", ())], key=str
    )


def test_a_complete_but_empty_delivery_removes_all(spark):
    rows = [(1, "s", "a", "h", "active", None, AT), (3, "s", "a", "h", "active", None, AT)]
    log = [(1, "s", True), (2, "s", True), (3, "s", True)]
    assert _run(spark, rows, log) == [(2, "s", "a", "removed", ()), (3, "s", "a", "added", ())]


def test_empty_tables(spark):
    assert _run(spark, [], []) == []
    assert _run(spark, [(1, "s", "a", "h", "x", None, AT)], []) == []
