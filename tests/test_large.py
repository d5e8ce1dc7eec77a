"""Work that has to stay whole and cheap as tables grow."""

from fractions import Fraction

from pyspark.sql import functions as F

from larderflow.operators import latest, planning, relational, scalars, weeks  # noqa: F401  (scalars and planning register their queries)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_term_pairs_are_made_once_and_not_shuffled(spark):
    s = spark.createDataFrame([(3, 1), (3, 1), (4, 2), (4, 3), (6, None)], "s_suppkey long, s_nationkey long")
    p = spark.createDataFrame([(1, "red red", 1, "red"), (1, "red", 26, "promo"), (2, "widget", 2, "x"), (2, "widget", 3, "x"), (3, "red", None, "x")], "p_partkey long, p_name string, p_size long, p_type string")
    pairs = relational.term_members(s, p)
    assert sorted(tuple(r) for r in pairs.collect()) == [(3, 1), (3, 3), (4, 2), (6, 1), (6, 3)]
    assert plan_of(pairs).lstrip().startswith("Union")  # no aggregate over pairs


def test_term_pairs_take_few_bytes_and_are_those_of_the_sql(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(19)
    word = lambda: rng.choice(["red", "Widget", "economy", "bolt"])
    suppliers = [(k, k % 25) for k in range(1_500)] + [(rng.choice([None, *range(-9, 30)]), rng.choice([None, *range(25)])) for _ in range(90)]
    parts = [(k, f"{word()} {word()}", word(), k % 50) for k in range(6_000)] + [(rng.choice([None, *range(-9, 30)]), f"{word()} {word()}", rng.choice([None, word()]), rng.choice([None, *range(50)])) for _ in range(90)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    relational.c19_term_membership(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for name in ("supplier", "part"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    con.execute(f"create table want as {relational.ORACLES['c19_term_membership']}; create table got as select s_suppkey, p_partkey from '{tmp_path}/out/*.parquet'")
    assert con.execute("select count(*) from (select * from want except all select * from got)").fetchall() == con.execute("select count(*) from (select * from got except all select * from want)").fetchall() == [(0,)]
    assert sum(f.stat().st_size for f in tmp_path.glob("out/*.parquet")) < 0.4 * con.execute("select count(*) from got").fetchone()[0]


def test_blocks_hold_each_key_once(spark):
    df = spark.range(5_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") % 2).alias("g"))
    blocks = relational.in_blocks(df, ["g"], "k", 32).collect()
    assert max(len(b.k) for b in blocks) == 32 and len({(b.g, b.deal, b.block) for b in blocks}) == len(blocks) < 180
    assert sorted((b.g, -1 if r.k is None else r.k) for b in blocks for r in b.k) == sorted((k % 2, k or -1) for k in range(5_000))


def test_readers_order_is_over_all_rows_and_whole_words(spark, tmp_path):
    rows = [(1, 0, "BUILDINGS"), (2, 1, "BUILDERS"), (3, 0, "BUILDERS"), (4, 1, "AUTO"), (5, 0, "AUTO"), (6, 1, "BUILDINGS")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: r.place for r in weeks.f07_locale_order(spark, str(tmp_path)).collect()}
    assert got == {4: 1, 5: 2, 2: 3, 3: 4, 6: 5, 1: 6}


def test_places_over_all_ranges(spark):
    df = spark.range(5_000).select(((F.col("id") * 7919) % 5_000).alias("k"))
    assert latest.placed(df.repartition(7), [F.col("k")]).filter("place <> k + 1").count() == 0


def test_sums_of_short_and_long_numbers(spark):
    from larderflow.plans import demand, rules

    amounts = spark.createDataFrame([("p", "a", "1/3"), ("p", "b", "1e-7"), ("p", "c", "12345678901234567890"), ("p", "d", None), ("s", "a", "3"), ("s", "b", "1.5")], "plate string, ingredient string, q string")
    facts = spark.createDataFrame([(i, "100", "30", None if i == "b" else "2", "0.5", "-4") for i in "abcd"], "ingredient string, basis_qty string, calories string, protein_g string, carbs_g string, fat_g string")
    got = {(r.plate, r.nutrient): (r.value, r.known, r.missing) for r in rules.plate_nutrition(amounts, facts).collect()}
    q = Fraction(1, 3) + Fraction("1e-7") + 12345678901234567890
    assert got["p", "calories"] == (None, str(q * 30 / 100), ["d"]) and got["p", "protein_g"] == (None, str((q - Fraction("1e-7")) * 2 / 100), ["b", "d"])
    assert got["s", "calories"] == ("27/20", "27/20", []) and got["s", "fat_g"] == ("-9/50", "-9/50", []) and got["s", "protein_g"] == (None, "3/50", ["b"])
    lines = spark.createDataFrame([("e", "m", "x", "1e-7", "each", True), ("e", "m", "x", "1/3", "each", False), ("e", "m", "y", "0e5", "each", True), ("e", "m", "z", "12345678901234567890123456789012345678901", "each", True)], "event string, component string, ingredient string, quantity string, unit string, exact boolean")
    served = spark.createDataFrame([("e", "m", "3/2")], "event string, component string, portions string")
    for reduced in (True, False):
        out = demand.meal_lines(demand.event_demand(lines, served, reduced=reduced).withColumn("c", F.lit(1)), ["c"])
        assert sorted((r.ingredient, Fraction(r.meal), r.exact, r.any_exact) for r in out.collect()) == [("x", Fraction("1.5e-7") + Fraction(1, 2), False, True), ("z", Fraction(12345678901234567890123456789012345678901 * 3, 2), True, True)]


def test_sums_of_groups_do_not_go_group_by_group_through_python(spark):
    plan = weeks.k02_plate_nutrition(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowAggregatePython" not in plan and "AggregateInPandas" not in plan and "ArrowEvalPython" in plan


def test_amounts_are_read_once_and_divisors_found_in_few_steps(spark):
    from larderflow.functions import amounts

    plan = relational.QUERIES["h08_leading_amount"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "sequence(1, 90" not in plan
    df = spark.createDataFrame([(12, 18), (7, 7), (1, 999), (832040, 514229), (514229, 832040), (10**17, 2**40)], "a long, b long")
    assert [r.g for r in df.select(amounts.gcd(F.col("a"), F.col("b")).alias("g")).collect()] == [6, 7, 1, 1, 1, 2**17]
    texts = spark.createDataFrame([("9999 1/3", 7), ("10000", 3), ("0.000001", 8), ("2/7", 1)], "t string, k int")
    assert [tuple(r.s) for r in texts.select(amounts.per_serving(F.col("t"), F.col("k")).alias("s")).collect()] == [("1428.47619047619", False), ("3333.333333333333", False), ("0.000000125", True), ("0.285714285714", False)]


def test_simplest_fractions_of_short_and_long_decimals(spark):
    from larderflow.plans import histories

    texts = ["0.3333", "12.142857142857", "99999999999999.3333", "70000000000000.3333", "-0.3333", "0.333", "1.0417", "49.979166666667"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.f for r in df.select(histories.simplest_fraction(F.col("t")).alias("f")).collect()] == ["1/3", "85/7", "299999999999998/3", "210000000000001/3", None, None, "25/24", "2399/48"]
    plan = str(df.select(histories.simplest_fraction(F.col("t")).alias("f"))._jdf.queryExecution().optimizedPlan())
    assert " div " in plan  # whole numbers are tried as longs


def test_streamed_commands_read_their_state_once_a_household(spark, tmp_path, monkeypatch):
    from larderflow.streaming import commands
    from larderflow.streaming.logs import drained, feed

    rows = [(h, 10 * i + h, str(i % 6), str(i % 2), "xy"[i % 4 == 3], "ab"[i % 3 == 0], i % 3) for h in (1, 2) for i in range(24)]
    df = spark.createDataFrame(rows, "household long, seq long, operation string, actor string, request string, entity string, expected int")
    for low, high in ((0, 80), (80, 300)):
        df.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    got = drained(commands.decided_stream(feed(spark, f"{tmp_path}/log", df.schema, files_per_trigger=1)), "decided", stateful=True)
    key = lambda t: sorted(map(str, t))
    assert key(tuple(r) for r in got.select("household", "seq", "entity", "outcome", "code", "revision").collect()) == key(tuple(r) for r in commands.decided(df).collect())
    assert "getValue" not in commands.Reducer.handleInputRows.__code__.co_names


def queue_by_hand(rows, cooks, rests, max_new, novelty):
    """rows: (recipe, title, score, is_new, friendly)."""
    ranked = sorted(rows, key=lambda r: (-r[2] - novelty * r[3], r[1], r[0]))
    easy = [r for r in ranked if r[4]][:rests]
    out, news = [], 0
    for r in easy + [r for r in ranked if r not in easy]:
        news += r[3]
        if not r[3] or max_new is None or news <= max_new:
            out.append(r[0])
    return out[:cooks]


def test_queues_with_two_values_of_novelty_in_one_pass(spark):
    import random

    from larderflow.plans import proposal

    rng = random.Random(5)
    wanted = [(h, cooks, rng.randint(0, 7 - cooks), rng.choice([None, 0, 1, 2])) for h in range(150) for cooks in [rng.randint(0, 7)]]
    recipes = {h: [(r, rng.choice("abc"), rng.choice([0, 5, 20, 30]), rng.random() < 0.6, rng.random() < 0.5) for r in range(rng.choice([0, 3, 12, 60]))] for h, *_ in wanted}
    df = spark.createDataFrame([(h, *r) for h, rows in recipes.items() for r in rows], "household long, recipe long, title string, score long, is_new boolean, friendly boolean")
    got = proposal.queues(df, spark.createDataFrame(wanted, "household long, cooks int, rests int, max_new int"), {"was": -30, "now": 0}).collect()
    assert {(r.household, name): [x.recipe for x in r[name]] for r in got for name in ("was", "now")} == {(h, name): queue_by_hand(recipes[h], *w, novelty) for h, *w in wanted for name, novelty in (("was", -30), ("now", 0))}


def test_changes_are_those_between_two_proposals(spark):
    from larderflow.plans import proposal

    assert proposal.week_shapes(spark).select("shape").distinct().count() == proposal.week_shapes(spark).count() == 4_246
    h = spark.range(80).select(F.col("id").alias("household"), (F.col("id") % 6).cast("int").alias("sessions"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("max_new"))
    recipes = h.select("household", F.explode(F.sequence(F.lit(0).cast("long"), F.col("household") % 13)).alias("recipe")).select("household", "recipe", F.concat(F.lit("t"), F.col("recipe")).alias("title"), (F.col("recipe") * 37 % 11 * 5).alias("score"), (F.col("recipe") % 2 == 0).alias("is_new"), ((F.col("recipe") + F.col("household")) % 3 > 0).alias("friendly"))
    kept = spark.range(90).select((F.col("id") % 45).alias("household"), (F.floor(F.col("id") / 45) * 3 + F.col("id") % 3).cast("int").alias("night"), F.when(F.col("id") % 4 > 0, "cook").otherwise("out").alias("kind"), F.when(F.col("id") % 4 > 0, 100 + F.col("id")).alias("recipe"))
    weeks_of = [proposal.proposals(h, recipes.withColumn("score", F.col("score") + F.when(F.col("is_new"), n).otherwise(0)), kept).collect() for n in (-30, 0)]
    text = lambda r: {"cook": f"t{r.recipe}", "leftover": f"leftovers of t{r.recipe}"}.get(r.kind, r.kind)
    was, now = ({(r.household, r.night): text(r) for r in rows if not r.kept} for rows in weeks_of)
    wanted = sorted((*k, was[k], now[k]) for k in now if was[k] != now[k])
    assert wanted and sorted(map(tuple, proposal.changes(h, recipes, kept.drop("recipe"), -30, 0).collect())) == wanted


def test_changed_weeks_read_lines_once_and_tell_unknown_answers(spark, tmp_path):
    import duckdb

    assert plan_of(relational.QUERIES["k06_proposal_changes"](spark, "/root/testdata/sf0.001")).count("Relation [l_orderkey") == 1
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part"):
        con.execute(f"create table {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    con.execute("update lineitem set l_returnflag = null where l_partkey % 5 = 0; update lineitem set l_quantity = null where l_partkey % 7 = 0; update lineitem set l_discount = null, l_shipdate = null where l_orderkey % 3 = 0; delete from lineitem where l_orderkey % 10 = 1")
    for name in ("customer", "orders", "lineitem", "part"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    for name in ("k06_proposal_changes", "k05_week_proposals"):
        got = sorted(map(repr, map(tuple, relational.QUERIES[name](spark, str(tmp_path)).collect())))
        assert got and got == sorted(map(repr, con.execute(relational.ORACLES[name]).fetchall()))
