import random

from pyspark.sql import functions as F

from voxlake.operators.dedupe import new_documents
from voxlake.operators.ranking import keep_first, top_n_per_group


def sequential(rows, stored):
    """Row-by-row insert-or-ignore with an in-batch set of dedupe keys."""
    keys = {d for _, _, _, d in stored if d}
    pairs = {(s, e) for _, s, e, _ in stored if e}
    seen, out = set(), []
    for i, s, e, d in rows:
        if d and d in seen:
            continue
        seen.add(d)
        if (d and d in keys) or (e and (s, e) in pairs):
            continue
        if e:
            pairs.add((s, e))
        out.append(i)
    return out


def test_matches_row_by_row_insert(spark):
    rng = random.Random(5)
    def rows(n, start):
        out = []
        for i in range(start, start + n):
            # A third of all rows are copies of one text.
            d = "hot" if rng.random() < 0.33 else rng.choice([None, f"d{rng.randint(0, 30)}"])
            out.append((i, rng.randint(1, 2), rng.choice([None, f"e{rng.randint(0, 40)}"]), d))
        return out
    schema = "id long, source_id long, external_id string, dedupe_key string"
    for _ in range(3):
        stored, incoming = rows(30, 0), rows(300, 1000)
        got = new_documents(
            spark.createDataFrame(incoming, schema), spark.createDataFrame(stored, schema), [F.asc("id")], row_id="id")
        assert sorted(r.id for r in got.collect()) == sequential(incoming, stored)


def test_first_wins_and_null_keys_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "id long, k string")
    assert {r.id for r in keep_first(df, ["k"], [F.asc("id")], row_id="id").collect()} == {1, 2, 4, 5}
    assert {r.id for r in keep_first(df, ["k"], [F.desc("id")], row_id="id").collect()} == {2, 3, 4, 5}


def test_top_n_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.5 else f"g{i % 7}", rng.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(6)
    got = top_n_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 9, rank="n").collect()
    want = {}
    for i, g, v in sorted(rows, key=lambda r: (-r[2], r[0])):
        want.setdefault(g, []).append(i)
    assert {(r.g, r.n): r.id for r in got} == {(g, n): i for g, ids in want.items() for n, i in enumerate(ids[:9], 1)}


def test_limits_sit_before_the_shuffles(spark):
    df = spark.createDataFrame([(1, "a", 2)], "id long, g string, v int")
    plan = top_n_per_group(df, ["g"], [F.desc("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4
    plan = keep_first(df, ["g"], [F.asc("id")], row_id="id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
