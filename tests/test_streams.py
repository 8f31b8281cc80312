"""The history from a stream, each batch once, and the index for substring search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_accounts import EDGES, as_sources, random_inputs, rows_of, simulate

from plumbline.operators import text_index
from plumbline.operators.search import TextSource, text_search
from plumbline.plans import lifecycle
from plumbline.sources.storage import shared_folder
from plumbline.streaming import account_history as stream


def _arrivals(spark, seed, folder):
    """Events in files by arrival: most on their day, some two days later. The inputs, and per
    file its rows as (day, row)."""
    inputs = random_inputs(seed, accounts=12, days=24)
    created, closed, reopened, txns = inputs
    rows = [("created", a, u, k, ts, None) for a, u, k, ts in created]
    rows += [("closed", a, None, None, ts, None) for a, ts in closed]
    rows += [("reopened", a, None, None, ts, None) for a, ts in reopened]
    rows += [("activity", a, None, None, dt.datetime.combine(d, dt.time()), n) for a, d, n in txns]
    first = min(r[4] for r in rows).date() + dt.timedelta(days=21)
    files = {}
    for n, r in enumerate(rows):
        late = 2 if r[4].date() >= first and n % 3 == 0 else 0
        files.setdefault(max(r[4].date(), first) + dt.timedelta(days=late), []).append(r)
    parts = [files[d] for d in sorted(files)]
    for part in parts:
        spark.createDataFrame(part, stream.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return inputs, parts


def _late_by_hand(parts, wait):
    closed, seen, late = None, None, 0
    for part in parts:
        days = [r[4].date() for r in part]
        late += sum(closed is not None and d <= closed for d in days)
        on_time = [d for d in days if closed is None or d > closed]
        seen = max([*on_time, *([seen] if seen else [])])
        closed = max(seen - dt.timedelta(days=wait + 1), closed or dt.date.min)
    return late, closed


def _start(spark, folder, path, checkpoint, wait=0):
    rows = spark.readStream.schema(stream.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    stream.keep_history(rows, path, checkpoint, wait, EDGES).awaitTermination()


@pytest.mark.parametrize("step", ["_record", "build_day"])
def test_a_killed_stream_goes_on_to_the_history_of_a_rebuild(spark, monkeypatch, step):
    folder = shared_folder(spark, "arrivals")
    inputs, parts = _arrivals(spark, 7, f"{folder}/in")
    path, checkpoint = f"{folder}/store", f"{folder}/checkpoint"
    own, calls = getattr(stream, step), []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            if step == "build_day":
                own(*args)  # the day was replaced, and nothing after it was done
            raise RuntimeError("killed")
        return own(*args)

    monkeypatch.setattr(stream, step, dies)
    with pytest.raises(Exception, match="killed"):
        _start(spark, f"{folder}/in", path, checkpoint)
    monkeypatch.setattr(stream, step, own)
    before = stream.last_record(spark, path).batch
    assert before < len(parts) - 1
    _start(spark, f"{folder}/in", path, checkpoint)
    late, closed = _late_by_hand(parts, 0)
    last = stream.last_record(spark, path)
    assert (last.batch, last.closed_through) == (len(parts) - 1, closed)
    assert late and stream.late_rows(spark, path).count() == late
    assert stream._stored(spark, path).count() == sum(map(len, parts))

    stream.repair_late(spark, path, EDGES)
    got = stream.history(spark, path).select(*lifecycle.DATELIST_COLUMNS)
    assert rows_of(got) == simulate(_until(inputs, closed), closed)
    assert stream.repair_late(spark, path, EDGES) == []
    end = max(r[4].date() for p in parts for r in p)
    stream.close_through(spark, path, end, EDGES)
    assert rows_of(stream.history(spark, path).select(*lifecycle.DATELIST_COLUMNS)) == simulate(inputs, end)


def _until(inputs, day):
    def known(row, at):
        return (row[at].date() if isinstance(row[at], dt.datetime) else row[at]) <= day

    return [[r for r in rows if known(r, at)] for rows, at in zip(inputs, (3, 1, 1, 1))]


def test_batches_without_accounts_times_or_rows(spark):
    path = shared_folder(spark, "store")
    at = dt.datetime(2024, 5, 1, 8)

    def take(number, rows, query="q"):
        stream.take_batch(spark.createDataFrame(rows, stream.EVENTS), number, path, 0, EDGES, query)
        return stream.last_record(spark, path)

    assert take(0, []).closed_through is None and stream.history(spark, path) is None
    days = [at + dt.timedelta(days=n) for n in range(6)]
    assert take(1, [("activity", 1, None, None, days[1], None)]).closed_through is None  # nobody was created
    made = [("created", 1, 5, "pot", days[0], None), ("created", None, None, None, None, None)]
    done = take(2, [*made, ("activity", 1, None, None, days[3], 4)])
    assert (done.closed_through, done.rows, done.late_rows) == (days[2].date(), 3, 1)
    assert take(2, made * 9).rows == 3  # done before
    assert take(3, [("activity", 1, None, None, days[1], 2)]).late_rows == 1
    with pytest.raises(stream.ForeignStream):
        take(0, made, "another")
    assert stream.late_rows(spark, path).where("day IS NULL").count() == 1
    before = {r.snapshot_date: r.txn_count for r in stream.history(spark, path).collect()}
    stream.repair_late(spark, path, EDGES)
    after = {r.snapshot_date: r.txn_count for r in stream.history(spark, path).collect()}
    assert list(before.values()) != list(after.values())
    assert [after[d.date()] for d in days[:3]] == [0, 3, 0]
    # Three days at once, two of them without events.
    assert take(4, [("activity", 1, None, None, days[5], 1)]).closed_through == days[4].date()
    now = {r.snapshot_date: (r.txn_count, r.l7) for r in stream.history(spark, path).collect()}
    assert [now[d.date()] for d in days[:5]] == [(0, 0), (3, 1), (0, 1), (4, 2), (0, 2)]


# ---- substring search


@pytest.fixture(scope="module")
def indexed(spark):
    path = shared_folder(spark, "text files+50%")
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé ß", k=5)) for _ in range(300)]
    rows = [
        (n, None if n % 17 == 0 else " ".join(rng.choices(words[n // 50 * 25 : n // 50 * 25 + 40], k=12)), "Odd\U0001f600Name" if n == 321 else "")
        for n in range(600)
    ]
    long = "xy" * text_index.PIECE
    rows[450] = (450, long[: text_index.PIECE - 1] + "QuZ" + long, None)
    data = spark.createDataFrame(rows, "id long, body string, title string")
    for part in range(12):
        own = data.where(F.floor(F.col("id") / 50) == part)
        own.coalesce(1).write.mode("append").parquet(f"{path}/t")
        if part == 5:
            assert text_index.index_text(spark, f"{path}/t", ["body", "title"], f"{path}/i") == 6
    assert text_index.index_text(spark, f"{path}/t", ["body", "title"], f"{path}/i") == 6
    assert text_index.index_text(spark, f"{path}/t", ["body"], f"{path}/i") == 0
    return path, rows


def _search(spark, path, query, fields=("body", "title")):
    rows = text_index.narrowed(spark, f"{path}/t", fields, f"{path}/i", query)
    names = text_search([TextSource("t", rows, "id", tuple(fields))], query).select("name").collect()
    return sorted(int(r.name) for r in names), len(rows.inputFiles())


def test_search_by_index_equals_the_scan(spark, indexed):
    path, rows = indexed
    rng = random.Random(9)
    some = [r[1][a : a + rng.randrange(1, 9)] for r in rng.sample([r for r in rows if r[1]], 12) for a in [rng.randrange(40)]]
    files = []
    for query in [*some, "", "  ", "quz", "ODD\U0001f600n", "\U0001f600na", "nowhere", "xyx"]:
        needle = query.lower().strip()
        want = sorted(r[0] for r in rows if any(t and needle in t.lower() for t in r[1:]))
        got, read = _search(spark, path, query)
        assert got == want, query
        files.append((len(needle), read))
    assert all(read == 12 for size, read in files if size < 3)
    assert _search(spark, path, "quz") == ([450], 1) and _search(spark, path, "nowhere") == ([], 0)
    assert max(read for size, read in files if size > 5) < 12


def test_files_that_the_index_does_not_know_are_read(spark, indexed):
    path, rows = indexed
    extra = spark.createDataFrame([(9_000, "only quz here", "")], "id long, body string, title string")
    extra.coalesce(1).write.mode("append").parquet(f"{path}/t")
    assert _search(spark, path, "quz") == ([450, 9_000], 2)
    assert _search(spark, path, "quz", ("body",)) == ([450, 9_000], 2)
    empty = shared_folder(spark, "unindexed")
    extra.coalesce(1).write.parquet(f"{empty}/t")
    assert _search(spark, empty, "quz") == ([9_000], 1)


def test_only_postings_of_the_needle_are_read(spark, indexed, plan):
    path, _ = indexed
    found = text_index.candidate_files(spark, f"{path}/t", ["body"], f"{path}/i", "quz")
    shown = plan(found)
    assert "EqualTo(gram,quz)" in shown and "PartitionFilters: [isnotnull(bucket" in shown
