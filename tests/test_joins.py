import random

from pyspark.sql import functions as F

from tesselar.operators import joins


def test_best_match_is_the_first_that_fits(spark):
    """Against a loop over all symbols, with names that many share, hints that fit several, none or all, and nulls."""
    rng = random.Random(5)
    symbols = [("new" if i % 3 else "old", f"src/{rng.choice('abc')}.{rng.choice(['rs', 'py'])}::{rng.choice(['A', 'BA', 'C'])}::{'new' if i % 3 else 'old'}", f"id{i:02}") for i in range(40)]
    symbols += [("lone", "x.rs::lone", "id98"), ("lone", None, "id97")]
    hints = ["A::new", "C::new", "a::A::new", "new", "", None, "src::b::BA::old", "nowhere::old", "y::lone", "x::lone"]
    left = [(i, name, h) for i, (name, h) in enumerate((n, h) for n in ("new", "old", "lone", "missing", None) for h in hints)]
    got = joins.best_match(spark.createDataFrame(left, "k int, leaf string, hint string"), "leaf", F.col("hint"), spark.createDataFrame(symbols, "name string, qualified_name string, id string"), F.col("qualified_name"), F.col("id"))
    assert got.columns == ["k", "leaf", "hint", "n", "qualified_name", "id"]

    want = {}
    for k, name, hint in left:
        own = sorted(((q is not None, q or "", i) for n, q, i in symbols if n == name))
        if not own:
            continue
        path = None if hint is None else hint.replace("::", "/")
        forms = lambda q: (q.replace("::", "/"), q.replace("::", "/").replace(".rs/", "/").replace(".py/", "/"))
        fit = [s for s in own if path is not None and s[0] and any(f.endswith(path) for f in forms(s[1]))]
        want[k] = ((fit or own)[0][2], len(own))
    assert {r["k"]: (r["id"], r["n"]) for r in got.collect()} == want


def test_first_of_name(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "k int, name string")
    symbols = spark.createDataFrame([("a", "Z", "2"), ("a", "Y", "3"), ("a", "Y", "1"), (None, "X", "9")], "name string, label string, id string")
    got = joins.first_of_name(left, "name", symbols, F.col("label"), F.col("id")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", "Y", "1"), (4, "a", "Y", "1")]


def test_times_are_rounded_as_in_sql(spark, tmp_path):
    """Half a second before an hour or a week's end belongs to the next second."""
    import duckdb
    from support import same_rows

    from tesselar.catalog import ORACLES, QUERIES

    made = [("purchase", t) for t in ("2024-01-08 00:00:00.5", "2024-01-08 00:00:00.6", "2024-01-08 00:00:01.4", "2024-01-03 00:00:00.7")]
    made += [("click", t) for t in ("2024-01-01 00:59:59.4", "2024-01-01 00:59:59.6", "2024-01-01 02:59:59.7")] + [("view", t) for t in ("2024-01-01 01:10:00.2", "2024-01-01 05:59:59.8")]
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', 1, '{kind}')" for i, (kind, t) in enumerate(made))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type)")
    con.execute("CREATE TABLE orders AS SELECT 1::BIGINT AS o_orderkey, TIMESTAMP '2024-01-01' - to_seconds(852076800) AS o_orderdate")
    for t in ("events", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for name in ("range_overlap_join", "nearest_key_join"):
        ours, theirs = same_rows(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
        assert ours == theirs and ours


def test_by_name_is_dealt_out(spark):
    """A name that many share: every pair once, over many partitions, however small the sides are; nulls meet nothing."""
    left = spark.createDataFrame([(i, "hot" if i < 60 else None if i == 60 else f"n{i}") for i in range(80)], "a int, name string")
    right = spark.createDataFrame([(i, "hot" if i < 50 else None if i == 50 else f"n{i}") for i in range(80)], "b int, name string")
    got = joins.by_name(left, "name", right)
    want = sorted([(a, b) for a in range(60) for b in range(50)] + [(i, i) for i in range(61, 80)])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and got.columns[0] == "name"
    assert len({r[0] for r in got.select(F.spark_partition_id()).distinct().collect()}) > 1
