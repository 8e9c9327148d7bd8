"""Committed changes of stored checks and users, and titles as a stream with state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import search as S
from factloom.sources import history_store as H
from factloom.streaming import dedup

CHECKS = "user_id long, check_id long, statement string, created_at timestamp"


def checks(spark, rows):
    return spark.createDataFrame([(u, c, f"claim {c}", datetime.datetime(2024, 1, 1)) for u, c in rows], CHECKS)


def stored(store):
    return sorted((r.userId, r.checkId) for r in store.read().collect())


def test_one_bucket_is_rewritten_and_failures_leave_old_rows(spark, tmp_path):
    first = [(u, 10 * u + i) for u in range(40) for i in range(3)]
    store = H.checks_store(spark, f"file://{tmp_path}/checks", checks(spark, first))
    assert stored(store) == [] and H.add_checks(store, checks(spark, [*first, (None, 5)]))
    assert stored(store) == first
    before = store.manifest()["files"]
    assert H.delete_stored_check(store, 7, 999) == 0 and H.delete_stored_check(store, 8, 70) == 0 and store.version() == 1
    assert H.delete_stored_check(store, 7, 70) == 1 and stored(store) == [x for x in first if x != (7, 70)]
    after = store.manifest()["files"]
    assert [b for b in before if before[b] != after.get(b)] == [str(store.bucket_of(7))]
    assert sorted(r.checkId for r in store.read_key(7).collect()) == [71, 72]
    assert len(store.read_key(7).inputFiles()) <= 2 and stored(H.checks_store(spark, f"file://{tmp_path}/checks")) == stored(store)
    assert sorted((r.userId, r.checkId) for r in store.read(1).collect()) == first  # an older version

    def breaks(rows):
        return rows.withColumn("statement", F.when(F.rand() >= 0, F.raise_error(F.lit("broken"))).otherwise("x"))

    with pytest.raises(Exception, match="broken"):
        store.rewrite(breaks, [store.bucket_of(7)])
    assert not H.add_checks(store, checks(spark, first).withColumn("statement", F.raise_error(F.lit("broken"))))
    assert store.version() == 2 and stored(store) == [x for x in first if x != (7, 70)]
    assert store.vacuum(older_than_s=-10) >= 1 and stored(store) == [x for x in first if x != (7, 70)] and store.versions() == [2]


def test_a_change_that_another_overtook_fails(spark, tmp_path):
    store = H.checks_store(spark, f"file://{tmp_path}/checks", checks(spark, [(1, 1)]))
    other = H.checks_store(spark, f"file://{tmp_path}/checks")
    store.append(H.documents(checks(spark, [(1, 1), (1, 2), (2, 3)])))

    def late(rows):
        other.append(H.documents(checks(spark, [(3, 4)])))
        return rows.limit(0)

    with pytest.raises(H.Conflict):
        store.rewrite(late, [store.bucket_of(1)])
    assert stored(store) == [(1, 1), (1, 2), (2, 3), (3, 4)]


def test_users_are_added_once(spark, tmp_path):
    users = H.Store(spark, f"file://{tmp_path}/users", "google_id", "google_id string, name string")
    new = spark.createDataFrame([("a", "Ann"), ("a", "Abe"), ("b", None), (None, "none")], "google_id string, name string")
    assert sorted((r.google_id, r.name) for r in H.find_or_add_user(users, new).collect()) == [("a", "Abe"), ("b", None)]
    again = spark.createDataFrame([("a", "Zoe"), ("c", "Cat")], "google_id string, name string")
    assert users.insert_new(again) == 1 and users.insert_new(again) == 0 and users.version() == 2
    assert sorted((r.google_id, r.name) for r in users.read().collect()) == [("a", "Abe"), ("b", None), ("c", "Cat")]


# ---- streams ---------------------------------------------------------------

RESULTS = "claim_id long, job_order int, ord int, url string, title string, published timestamp"
DAY = datetime.datetime(2024, 1, 1)


def streamed(spark, folder, batches, build, schema=RESULTS, mode="append"):
    """What a stream over ``batches``, a file each, has put out."""
    spark.conf.set(*dedup.STATE_STORE)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = build(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").format("parquet").start(f"{folder}/out")
        query.awaitTermination(120)
        assert query.exception() is None, (i, query.exception())
    return spark.read.parquet(f"{folder}/out").collect()


def test_titles_streamed_in_batches_are_those_of_the_table(spark, tmp_path):
    """Shuffled batches, each started anew on one checkpoint, keep what the fold over the whole table keeps."""
    r = random.Random(2)
    words = "bank rates rise fall vote court rules city must ban oil price not approves rejects deal talks plan".split()
    bases = [r.sample(words, r.randint(4, 10)) for _ in range(6)]
    batches = []
    for b in range(3):
        rows = []
        for i in range(40):
            title = list(r.choice(bases))
            title[r.randrange(len(title))] = r.choice([*words, f"x{i}"])
            rows.append((r.randrange(4), b, i, f"u{r.randrange(150)}", " ".join(title), DAY + datetime.timedelta(hours=b)))
        r.shuffle(rows)
        batches.append(rows)
    got = streamed(spark, str(tmp_path), batches, dedup.distinct_titles)
    want = S.deduplicate(spark.createDataFrame([x for b in batches for x in b], RESULTS)).collect()
    assert sorted((x.claim_id, x.job_order, x.ord) for x in got) == sorted((x.claim_id, x.job_order, x.ord) for x in want) and 20 < len(want) < 110


def test_state_of_titles_expires(spark, tmp_path):
    title = "central bank raises rates by half a point today"
    at = lambda days, claim=1, url="u": (claim, days, 0, f"{url}{days}", title, DAY + datetime.timedelta(days=days))
    batches = [[at(0)], [at(1)], [at(60, 2)], [at(61, 3)], [at(62, 1, "late")]]
    got = streamed(spark, str(tmp_path), batches, lambda s: dedup.distinct_titles(s, late="1 day", idle_days=10))
    assert sorted(x.url for x in got) == ["late62", "u0", "u60", "u61"]


def test_first_by_url_and_stance_counts(spark, tmp_path):
    row = lambda c, u, h: (c, 0, 0, u, "t", DAY + datetime.timedelta(hours=h))
    got = streamed(spark, str(tmp_path / "a"), [[row(1, "x", 0), row(1, "x", 1), row(2, "x", 1), row(1, "", 0), row(1, None, 0)], [row(1, "x", 2), row(1, "y", 2)]], dedup.first_by_url)
    assert sorted((x.claim_id, x.url) for x in got) == [(1, "x"), (1, "y"), (2, "x")]
    evidence = "claim_id long, stance string, published timestamp"
    day = lambda d, s: (1, s, DAY + datetime.timedelta(days=d))
    got = streamed(spark, str(tmp_path / "b"), [[day(0, "supports"), day(0, "contradicts"), day(0, "unclear")], [day(100, "supports")], [day(101, "supports")]], lambda s: dedup.stance_counts(s, late="2 days"), evidence)
    assert [(x.supporting, x.contradicting, x.rows) for x in got] == [(1, 1, 3)]
