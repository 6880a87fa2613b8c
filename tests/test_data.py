"""Instants, zones, increments and bounded ordering."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tsugumi.functions.instants import with_instant
from tsugumi.functions.json import json_array
from tsugumi.functions.text import fold_term, is_blank
from tsugumi.operators import incremental, times
from tsugumi.plans import bounds
from tsugumi.plans.commits import Commits
from tsugumi.plans.segments import segmented


def us(*a, zone="UTC"):
    t = datetime(*a, tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


CASES = [
    ("2024-08-06T12:30:15Z", None, us(2024, 8, 6, 12, 30, 15)), ("2024-08-06t12:30:15z", None, us(2024, 8, 6, 12, 30, 15)),
    ("2024-08-06T12:30:15.123456789Z", None, us(2024, 8, 6, 12, 30, 15, 123456)), ("2024-08-06T12:30:15,5Z", None, us(2024, 8, 6, 12, 30, 15, 500000)),
    ("2024-08-06 12:30:15 +0900", None, us(2024, 8, 6, 3, 30, 15)), ("2024-08-06T12:30:15+09", None, us(2024, 8, 6, 3, 30, 15)),
    ("2024-08-06T12:30:15−04:00", None, us(2024, 8, 6, 16, 30, 15)), ("2024-08-06T12:30:15+02:00[Europe/Berlin]", "Asia/Tokyo", us(2024, 8, 6, 10, 30, 15)),
    ("2024-08-06T12:30[Asia/Tokyo]", None, us(2024, 8, 6, 3, 30)), ("2024-08-06 12:30:15 JST", "UTC", us(2024, 8, 6, 3, 30, 15)), ("2024-08-06 12:30:15 XYZ", None, None),
    ("2024-08-06", "Asia/Tokyo", us(2024, 8, 5, 15)), ("\t2024-08-06\n", "Asia/Tokyo", us(2024, 8, 5, 15)), ("2024/8/6 9:05", "Europe/Berlin", us(2024, 8, 6, 7, 5)),
    ("2024/08/06(火) 09:05", "Asia/Tokyo", us(2024, 8, 6, 0, 5)), ("20240806T123015Z", None, us(2024, 8, 6, 12, 30, 15)), ("06.08.2024 09:05", "Europe/Berlin", us(2024, 8, 6, 7, 5)),
    ("2024年8月6日", "Asia/Tokyo", us(2024, 8, 5, 15)), ("２０２４年８月６日", "Asia/Tokyo", us(2024, 8, 5, 15)), ("2024年8月6日 午後0時5分", "UTC", us(2024, 8, 6, 12, 5)),
    ("2024年8月6日 午前12時05分", "UTC", us(2024, 8, 6, 0, 5)), ("令和6年8月6日", "UTC", us(2024, 8, 6)), ("令和元年5月1日", "UTC", us(2019, 5, 1)), ("R6.8.6", "UTC", us(2024, 8, 6)),
    ("Tue, 06 Aug 2024 12:30:15 +0530", None, us(2024, 8, 6, 7, 0, 15)), ("6 August 2024 12:30:15 UTC", None, us(2024, 8, 6, 12, 30, 15)), ("Aug 6, 2024 3:05 PM", "UTC", us(2024, 8, 6, 15, 5)),
    ("Aug 6, 2024 12:05 AM", "UTC", us(2024, 8, 6, 0, 5)), ("2024-W32-2", "UTC", us(2024, 8, 6)), ("2021-W53-1", "UTC", None), ("1722947415", None, us(2024, 8, 6, 12, 30, 15)),
    ("1722947415123", None, us(2024, 8, 6, 12, 30, 15, 123000)), ("1722947415123456", None, us(2024, 8, 6, 12, 30, 15, 123456)), ("1722947415.5", None, us(2024, 8, 6, 12, 30, 15, 500000)),
    ("2024-03-31 02:30", "Europe/Berlin", None), ("2024-10-27 02:30", "Europe/Berlin", None), ("2024-10-27 03:00", "Europe/Berlin", us(2024, 10, 27, 2)), ("2024-03-31 03:00", "Europe/Berlin", us(2024, 3, 31, 1)),
    ("2018-11-04", "America/Sao_Paulo", us(2018, 11, 4, 3)), ("2024-08-06 12:30", "Mars/Base", None), ("2024-08-06 12:30", " ", us(2024, 8, 6, 12, 30)),
    ("2024-02-30", None, None), ("0000-00-00", None, None), ("2024-08-06T25:00:00Z", None, None), ("12:30", None, None), ("未定", None, None), ("", None, None), (None, None, None), ("9" * 5000, None, None),
]


def test_forms(spark):
    rows = [(i, v, z) for i, (v, z, _) in enumerate(CASES)]
    got = {r.i: r.utc_us for r in with_instant(spark.createDataFrame(rows, "i int, v string, z string"), "v", "z").collect()}
    assert [(CASES[i][:2], got[i]) for i in got] == [(CASES[i][:2], CASES[i][2]) for i in got]


def test_two_instants_side_by_side(spark):
    df = spark.createDataFrame([("2024-08-06 12:00", "Asia/Tokyo", "Europe/Berlin", 1, "x")], "v string, p string, q string, _t int, _z string")
    r = with_instant(with_instant(df, "v", "p", "_a"), "v", "q", "_b").first()
    assert (r._a, r._b, r._t, r._z) == (us(2024, 8, 6, 3), us(2024, 8, 6, 10), 1, "x")


def test_session_zone_does_not_matter(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        test_forms(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_all_wall_times_of_a_year_of_changes(spark):
    """Against the zone rules of Python, around both changes."""
    rows = []
    for zone in ("Europe/London", "America/New_York", "Australia/Adelaide", "Asia/Kolkata"):
        for start in ((2024, 3, 9), (2024, 3, 30), (2024, 4, 6), (2024, 10, 5), (2024, 10, 26), (2024, 11, 2)):
            rows += [(str(datetime(*start) + timedelta(minutes=15 * k)), zone) for k in range(200)]
    got = with_instant(spark.createDataFrame(rows, "v string, z string"), "v", "z").collect()
    for r in got:
        t = datetime.fromisoformat(r.v)
        hits = {t.replace(tzinfo=ZoneInfo(r.z), fold=f).astimezone(timezone.utc) for f in (0, 1)}
        hits = {h for h in hits if h.astimezone(ZoneInfo(r.z)).replace(tzinfo=None) == t}
        want = (hits.pop() - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) if len(hits) == 1 else None
        assert r.utc_us == want, r


def test_more_candidate_zones_than_a_thousand(spark):
    rows = spark.createDataFrame([("g", us(2024, 1, 5, h) + 9 * 3_600_000_000, us(2024, 1, 5, h) - 60_000_000, us(2024, 1, 5, h) + 60_000_000) for h in range(5)], "g string, local long, lo long, hi long")
    candidates = spark.createDataFrame([(f"Unknown/{i}",) for i in range(1001)] + [("Asia/Tokyo",), ("UTC",), ("UTC",), (None,)], "zone string")
    got = times.fit_zones(rows, ["g"], "local", "lo", "hi", candidates).orderBy("rank").collect()
    assert [(r.zone, r.violations) for r in got] == [("Asia/Tokyo", 0), ("UTC", 5)]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    assert bounds.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        bounds.shared_folder(Session)
    Session.sparkContext.master = "local[3]"
    assert bounds.shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "/shared/x"}
    assert bounds.shared_folder(Session) == "/shared/x"


def test_a_number_is_published_once(spark, tmp_path):
    commits = Commits(spark, str(tmp_path / "log"))
    assert commits.names() == []
    commits.publish(1, {"a": 1})
    with pytest.raises(RuntimeError, match="exists"):
        commits.publish(1, {"a": 2})
    assert commits.read(commits.names()[0]) == {"a": 1} and not any((tmp_path / "log-drafts").glob("[0-9a-f]*"))


def test_normalised_keeps_only_keys(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", None, "x", 5), (1, "2024-01-01", None, "x", 5), (2, None, "UTC", "y", 6)], "k int, v string, z string, utc_us string, _t int")
    assert [tuple(r) for r in times.normalised(rows, "v", "z", ["k"]).collect()] == [(1, us(2024, 1, 1))] * 2
    assert times.normalised(rows.limit(0), "v", "z", ["k"]).count() == 0


def test_zone_fit_finds_the_history(spark):
    local = [(g, us(2024, m, 5, 12) + off) for g, z in (("a", "Asia/Tokyo"), ("b", "Europe/Berlin")) for m in range(1, 13) for off in [int(datetime(2024, m, 5, 12, tzinfo=ZoneInfo(z)).utcoffset().total_seconds()) * 10**6]]
    rows = spark.createDataFrame([(g, x, us(2024, m % 12 + 1, 5, 12) - 10**6, us(2024, m % 12 + 1, 5, 12) + 10**6) for m, (g, x) in enumerate(local)], "g string, l long, lo long, hi long")
    zones = spark.createDataFrame([("UTC",), ("Asia/Tokyo",), ("Europe/Berlin",), ("Europe/London",), (None,), ("No/Zone",)], "zone string")
    best = {r.g: (r.zone, r.violations) for r in times.fit_zones(rows, ["g"], "l", "lo", "hi", zones).filter("rank = 1").collect()}
    assert best == {"a": ("Asia/Tokyo", 0), "b": ("Europe/Berlin", 0)}
    fitted = times.fit_zones(rows, ["g"], "l", "lo", "hi", zones)
    values = spark.createDataFrame([("a", "2024-01-01 09:00", None)], "g string, v string, z string")
    assert times.normalised(values, "v", "z", ["g"], fitted, ["g"]).first().utc_us == us(2024, 1, 1)


def test_zone_bounds_reach_over_local_times(spark):
    from tsugumi.data_queries import zone_bounds

    m = [("s", 1, 1, "2024-08-06T00:00:00Z"), ("s", 2, 2, "2024-08-06 09:10:00"), ("s", 3, 3, "2024-08-06 09:20:00"), ("s", 4, 5, "2024-08-06 09:30:00"), ("s", 5, 4, "2024-08-06T01:00:00Z"), ("t", 1, 6, "2024-08-06 09:00"), ("old", None, 7, "2024-08-06T03:00:00Z"), ("old", None, 8, "2024-08-06 11:00:00")]
    messages = spark.createDataFrame([(*r, "Asia/Tokyo") for r in m], "session_id string, line_no int, msg_id long, value string, zone string")
    documents = spark.createDataFrame([("2024-08-06 09:00:00", "Asia/Tokyo", datetime(2024, 8, 6, 0, 30)), ("2024-08-06T00:00:00Z", "Asia/Tokyo", datetime(2024, 8, 6, 0, 30)), (None, None, None)], "value string, zone string, indexed_at timestamp")
    rows = zone_bounds(messages, documents)
    got = sorted(((r.rec_kind, r.local_us, r.lower, r.upper) for r in rows.filter("local_us is not null").collect()), key=str)
    lo, hi = us(2024, 8, 6), us(2024, 8, 6, 1)
    inside = [("message", us(2024, 8, 6, 9, k), lo, hi) for k in (10, 20, 30)]
    assert got == sorted([*inside, ("message", us(2024, 8, 6, 9), None, None), ("message", us(2024, 8, 6, 11), None, None), ("document", us(2024, 8, 6, 9), None, us(2024, 8, 6, 0, 30))], key=str)
    zones = spark.createDataFrame([("UTC",), ("Asia/Tokyo",)], "zone string")
    fit = {(r.rec_kind, r.zone): (r.records, r.bounded, r.violations, r["rank"]) for r in times.fit_zones(rows, ["rec_kind", "stated_tz"], "local_us", "lower", "upper", zones).collect()}
    assert fit == {("message", "Asia/Tokyo"): (5, 3, 0, 1), ("message", "UTC"): (5, 3, 3, 2), ("document", "Asia/Tokyo"): (1, 1, 0, 1), ("document", "UTC"): (1, 1, 1, 2)}


def test_segments_carry_over_nulls(spark):
    rows = [(i % 3, i, i * 7 if i % 11 == 0 else None) for i in range(200)]
    got = segmented(spark.createDataFrame(rows, "g int, o int, v int"), ["g"], ["o"], carried=["v"], partitions=13).collect()
    for r in got:
        same = [v for g, o, v in rows if g == r.g and o < r.o and v is not None], [v for g, o, v in rows if g == r.g and o > r.o and v is not None]
        assert (r.last_v, r.coming_v) == (same[0][-1] if same[0] else None, same[1][0] if same[1] else None)
    assert len(got) == 200


SCAN = "scan_id long, file_path string, file_hash string, scanned_at timestamp, documents string"


def scans(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCAN)


T = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(9)]
DOCS = [("a", "AA "), ("b", "bb"), ("c", None), ("d", "dd")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "file_path string, file_hash string")


def test_changed_files(spark):
    rows = [(1, "a", " aa", T[1]), (2, "b", "xx", T[1]), (3, "b", "bb", T[3]), (4, "b", "yy", T[2]), (5, "c", "cc", T[1]), (6, "new", "n", T[1]), (7, "d", None, T[5]), (8, "gone", None, T[1]), (9, None, "z", T[1]), (10, "d", "d2", None), (10, "d", "d2", None)]
    got = sorted(r.file_path for r in incremental.changed_files(scans(spark, rows), docs(spark), 0, 99).collect())
    assert got == ["c", "d", "new"]  # the late row 4 hides nothing
    assert incremental.changed_files(scans(spark, rows).limit(0), docs(spark), 0, 9).count() == 0
    assert incremental.upper_limit(scans(spark, rows).limit(0)) == 0


def test_increments_neither_skip_nor_repeat(spark, tmp_path):
    first = [(1, "a", "a2", T[1]), (2, "b", "bb", T[1])]
    second = [*first, (3, "new", "n", T[2]), (4, "a", "old", T[0])]
    folder = str(tmp_path / "progress")
    one = incremental.run_increment(scans(spark, first), docs(spark), folder)
    assert one["watermark"] == 2 and [r.file_path for r in spark.read.parquet(one["data"]).collect()] == ["a"]
    assert incremental.run_increment(scans(spark, first), docs(spark), folder) == one  # nothing new: no commit

    class Broken:
        def __getattr__(self, name):
            raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.run_increment(scans(spark, second), Broken(), folder)
    assert incremental.Progress(spark, folder).last() == one  # a failed run leaves no trace
    two = incremental.run_increment(scans(spark, second), docs(spark), folder)
    assert sorted(r.file_path for r in spark.read.parquet(two["data"]).collect()) == ["a", "new"] and two["watermark"] == 4
    with pytest.raises(RuntimeError):
        incremental.Progress(spark, folder).commit(2, 9, "x")
    kept = spark.createDataFrame([], "chunk_id long, content string, content_hash string")
    assert incremental.unprocessed(scans(spark, second), docs(spark), kept, folder).count() == 0
    assert [tuple(r) for r in incremental.unprocessed(scans(spark, [*second, (5, "d", "d2", T[3])]), docs(spark), kept, folder).collect()] == [("file", "d")]
    assert incremental.unprocessed(scans(spark, second).limit(0), docs(spark), kept, str(tmp_path / "none")).count() == 0


def test_increments_put_out_chunks_once_for_each_state(spark, tmp_path):
    chunks = lambda *rows: spark.createDataFrame(rows, "chunk_id long, content string, content_hash string")
    folder = str(tmp_path / "progress")
    keys = lambda c: sorted((r.rec_kind, r.rec_key) for r in spark.read.parquet(c["data"]).collect())
    seen = scans(spark, [(1, "a", "a2", T[1])])
    one = incremental.run_increment(seen, docs(spark), folder, chunks((1, "x", "old"), (2, "y", None)))
    assert keys(one) == [("chunk", "1"), ("chunk", "2"), ("file", "a")]
    assert incremental.run_increment(seen, docs(spark), folder, chunks((1, "x", "old"), (2, "y", None))) == one

    def lose():
        raise InterruptedError

    after = chunks((1, "x", "old"), (2, "z", None), (3, None, None))
    with pytest.raises(InterruptedError):
        incremental.run_increment(seen, docs(spark), folder, after, lose)
    two = incremental.run_increment(seen, docs(spark), folder, after)
    assert keys(two) == [("chunk", "2"), ("chunk", "3")] and two["watermark"] == 1
    assert keys(incremental.run_increment(seen, docs(spark), folder, chunks((2, "y", None)))) == [("chunk", "2")]


def test_stale_chunks(spark):
    import hashlib

    h = hashlib.sha256("あ".encode()).hexdigest()
    rows = [(1, "あ", h), (2, "あ", f" {h.upper()} "), (3, "あ", None), (4, "い", h), (5, None, h), (6, None, None), (7, "", hashlib.sha256(b"").hexdigest())]
    df = spark.createDataFrame(rows, "chunk_id long, content string, content_hash string")
    assert sorted(r.chunk_id for r in incremental.stale_chunks(df).collect()) == [3, 4, 5, 6]


def test_segments_match_windows(spark):
    import random

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"g{rng.randrange(9)}", rng.choice([None, rng.randrange(40)]), i, rng.randrange(9), "clash") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, id long, w long, _rows string")
    got = segmented(df, ["g"], ["o", "id"], following=["id", "w"], sums=["w"], preceding=["id"], partitions=13)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    want = set()
    for g, rs in groups.items():
        for k, r in enumerate(rs):
            after, ahead = rs[k + 1] if k + 1 < len(rs) else None, rs[k - 1] if k else None
            want.add((g, r[2], k + 1, after and after[2], after and after[3], ahead and ahead[2], sum(x[3] for x in rs[:k])))
    assert {(r.g, r.id, r.pos, r.next_id, r.next_w, r.previous_id, r.before_w) for r in got.collect()} == want
    assert segmented(df.limit(0), ["g"], ["id"]).count() == 0


def test_text_helpers(spark):
    rows = [("  ｱﾞｶﾞﾊﾟ ",), ("ＡＢｃ",), ("　",), ("",), (None,), ("a　b",), ("ガ",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string").select(fold_term(F.col("t")), is_blank(F.col("t"))).collect()]
    assert got[1:6] == [("abc", False), (None, True), (None, True), (None, True), ("a b", False)]
    assert got[0][0] == "ア゙ガパ" and got[6][0] == "ガ"


def test_json_array(spark):
    rows = ['[{"a":1}]', '[1] x', "[1],[2]", "[1]]", "[1]}", '["a"', "{}", "x", None, "", '[{"a":"\n"}]']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(json_array(F.col("t")).isNotNull()).collect()]
    assert got == [True] + [False] * 10
