"""Renames followed by rounds of joins against one fold in the order of the log."""

import random

from lodestar.sources import history


def fold(log):
    """(ord, paths) by reading the log newest first, with one table of names."""
    today, out = {}, []
    for ord_, entries in enumerate(log):
        paths = set()
        for path, was in entries:
            seen = set()
            while path in today and today[path] not in seen:
                seen.add(path)
                path = today[path]
            if was is not None:
                today[was] = path
            paths.add(path)
        out.append((ord_, tuple(sorted(paths))))
    return out


def text(log):
    lines = lambda entries: "".join(f"R100\t{was}\t{path}\n" if was else f"M\t{path}\n" for path, was in entries)
    return "".join(f"\x00s{k}\x1f2024\x1fann\x1fsubject\n{lines(entries)}" for k, entries in enumerate(log))


def test_random_logs_equal_the_fold(spark):
    rng = random.Random(4)
    logs = {}
    for r in range(40):
        names = "abcde"[: rng.randint(2, 5)]
        entry = lambda: (rng.choice(names), rng.choice(names) if rng.random() < 0.5 else None)  # noqa: E731, B023
        logs[f"r{r}"] = [[entry() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 12))]
    logs["chain"] = [[(f"n{k}", f"n{k + 1}")] for k in range(6)] + [[("n6", None), ("n2", None)]]
    found = {}
    for r in history.commits(spark.createDataFrame([(k, text(v)) for k, v in logs.items()], "repo string, log string")).collect():
        found.setdefault(r.repo, []).append((r.ord, tuple(r.paths)))
    assert {k: sorted(v) for k, v in found.items()} == {k: fold(v) for k, v in logs.items()}


def test_logs_without_files_and_no_logs(spark):
    df = lambda rows: spark.createDataFrame(rows, "repo string, log string")
    assert [(r.ord, r.paths) for r in history.commits(df([("a", "\x00s\x1f2024\x1fann\x1fempty")])).collect()] == [(0, [])]
    assert history.commits(df([("a", ""), ("b", None)])).count() == 0 and history.commits(df([])).count() == 0
