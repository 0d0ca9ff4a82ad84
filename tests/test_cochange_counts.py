"""Counts that are kept up to date equal a full mine of the window after every step."""

import random

from lodestar.operators import cochange, cochange_counts

SCHEMA = "repo string, seq long, authored_at string, paths array<string>"


def mined(spark, rows, window, max_files):
    """A full mine of the newest `window` commits of each repository."""
    by = {}
    for r in rows:
        by.setdefault(r[0], {})[r[1]] = r
    kept = [r for c in by.values() for r in sorted((r for r in c.values() if set(r[3])), key=lambda r: -r[1])[:window]]
    df = spark.createDataFrame(kept, SCHEMA).selectExpr("repo", "-seq as ord", "authored_at", "paths")
    return {tuple(r) for r in cochange.co_change(df, max_files=max_files, max_pairs=None).select("repo", "left_path", "right_path", "shared", "left_commits", "right_commits", "jaccard", "last_together").collect()}


def test_every_step_equals_a_full_mine(spark):
    rng = random.Random(2)
    commit = lambda repo, seq: (repo, seq, f"2024-01-{seq:03d}", [f"f{rng.randrange(7)}" for _ in range(rng.choice([0, 1, 2, 4, 30]))])
    state, seen, at = cochange_counts.empty(spark), [], {"one": 0, "two": 0}
    for step in range(5):
        new = []
        for repo in ("one", "two")[: 1 + step % 2]:
            new += [commit(repo, at[repo] + k + 1) for k in range(rng.choice([1, 6, 20]))]
            at[repo] += 20
        again = seen[-2:]  # commits that come twice change nothing
        state = cochange_counts.update(state, spark.createDataFrame(new + again, SCHEMA), window=12, max_files=5)
        seen += new
        assert {tuple(r) for r in cochange_counts.co_change(state).collect()} == mined(spark, seen, 12, 5)
        assert state.commits.groupBy("repo").count().where("count > 12").isEmpty()


def test_older_commits_and_nothing_new_change_nothing(spark):
    rows = [(None, 10 + k, "d", ["a", "b"]) for k in range(3)]
    frame = lambda r: spark.createDataFrame([x[1:] for x in r], "seq long, authored_at string, paths array<string>")
    state = cochange_counts.update(cochange_counts.empty(spark), frame(rows), window=3)
    after = cochange_counts.update(cochange_counts.update(state, frame([(None, 1, "old", ["a", "b"])]), window=3), frame([]), window=3)
    for x in (state, after):
        assert [tuple(r) for r in cochange_counts.co_change(x).collect()] == [("", "a", "b", 3, 3, 3, 1.0, "d")]


def test_of_very_many_new_commits_a_window_is_placed(spark, monkeypatch):
    sizes = []

    class Counted(cochange_counts.Written):
        def __call__(self, df):
            out = super().__call__(df)
            sizes.append(out.count())
            return out

    monkeypatch.setattr(cochange_counts, "Written", Counted)
    rows = [("r", k, "d", ["a", "b"]) for k in range(200)]
    state = cochange_counts.update(cochange_counts.empty(spark), spark.createDataFrame(rows, SCHEMA), window=3)
    assert sizes[0] == 3
    assert [tuple(r) for r in cochange_counts.co_change(state).collect()] == [("r", "a", "b", 3, 3, 3, 1.0, "d")]
