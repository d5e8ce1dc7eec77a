"""Small decisions about recipes, prices, staples and lists, each as a rule over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larderflow.functions.amounts import let
from larderflow.functions.readers import heading_name, is_heading, list_unit
from larderflow.functions.units import SCALE, base_unit, normalize_unit, parts
from larderflow.operators.latest import latest_by


def best_price(regular: Column, promo: Column) -> Column:
    """struct(minor, promotion): the promotion if it is a price and lower than the regular one or alone, else the regular one if it is a price, else null."""
    lower = (promo > 0) & F.coalesce(promo < regular, F.lit(True))
    chosen = F.coalesce(lower, F.lit(False))
    minor = F.when(chosen, promo).when(regular > 0, regular)
    return F.when(minor.isNotNull(), F.struct(minor.alias("minor"), chosen.alias("promotion")))


def photo(member_image: Column, member: Column, source_image: Column, site: Column, label: Column) -> Column:
    """struct(image, kind, label): a member's photo before the source's; null without either."""
    said = lambda c: F.nullif(c, F.lit(""))
    own = F.struct(member_image.alias("image"), F.lit("member").alias("kind"), F.coalesce(F.concat(F.lit("Photo by "), said(member)), F.lit("Our photo")).alias("label"))
    theirs = F.struct(source_image.alias("image"), F.lit("source").alias("kind"), F.coalesce(said(site), said(label), F.lit("Source photo")).alias("label"))
    return F.when(member_image.isNotNull(), own).when(source_image.isNotNull(), theirs)


def week_sentence(nights: DataFrame, orders: DataFrame) -> DataFrame:
    """household and sentence: what a week still needs, in words. nights: household, night, day, state (as coverage() has it), violated; orders: household, ready,
    ordered. A household without a row in orders has neither."""

    def days(condition: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("night", "day")))), lambda x: x["day"])  # seven at most

    def part(column: str, one: str, many: str, rest: str) -> Column:
        return F.when(F.size(column) > 0, F.concat(F.array_join(column, ", "), F.when(F.size(column) > 1, many).otherwise(one), F.lit(rest)))

    rows = nights.groupBy("household").agg(days(F.col("state") == "uncovered").alias("uncovered"), days(F.col("state") == "unresolved").alias("unresolved"), days(F.col("violated")).alias("violated"), ((F.countDistinct("night") == 7) & F.bool_and(F.col("state").isin("covered", "out"))).alias("chosen"))
    rows = rows.join(orders, "household", "left")
    groceries = F.when(F.coalesce("ready", F.lit(False)), "Groceries are ready to send.").when(F.coalesce("ordered", F.lit(False)), "Order confirmed; check what is still not sent.").otherwise("Grocery review remains.")
    sentence = F.concat_ws(" ", F.when(F.col("chosen"), "Every dinner is covered."), part("uncovered", " has", " have", " no dinner yet."), part("unresolved", " is", " are", " unresolved."), part("violated", "", "", " conflicts with an exclusion."), groceries)
    return rows.select("household", sentence.alias("sentence"))


def service_list(items: DataFrame) -> DataFrame:
    """items (state, quantity, unit, packages, note) with line (quantity and unit of a delivery service's list, or null) and left_out (why it is not sent): what is at
    home is neither."""
    bought = F.col("state").isin("already_ordered", "sent_to_cart")
    unit = list_unit(normalize_unit(F.col("unit")))
    by_amount = F.col("quantity").isNotNull()
    home = F.col("state") == "have_enough"
    left_out = F.when(home, None).when(bought, F.coalesce("note", F.lit("already bought another way"))).when(by_amount & unit.isNull(), F.concat(F.lit("amount in "), normalize_unit(F.col("unit")), F.lit(" isn't a unit of the service"))).when(~by_amount & ~F.coalesce(F.col("packages") > 0, F.lit(False)), "amount unknown")
    line = F.when(~home & left_out.isNull(), F.when(by_amount, F.concat_ws(" ", F.col("quantity"), unit)).otherwise(F.concat_ws(" ", F.col("packages").cast("string"), F.when(F.col("packages") == 1, "package").otherwise("packages"))))
    return items.withColumns({"line": line, "left_out": left_out})


#: Packages of a staple at most.
MOST_PACKAGES = 50


def usual_packages(quantity: Column, unit: Column, package_qty: Column, package_unit: Column) -> Column:
    """struct(packages, problem) of a usual amount (decimal text) of a staple: whole packages, or as many as hold a measured amount, from 1 to MOST_PACKAGES. Whole
    parts of 10^-11 of the base unit are compared, so that nothing is rounded; problem: quantity, unit, product, size, conversion or too_many."""
    factor = lambda u: F.coalesce(parts(u), F.lit(SCALE)).cast("decimal(15,0)")
    q, size = quantity.try_cast("decimal(12,4)"), package_qty.try_cast("decimal(12,4)")
    given = F.struct(
        F.coalesce(quantity.rlike(r"^\s*\d+(\.\d+)?\s*$") & (q > 0), F.lit(False)).alias("number"), q.alias("q"), (F.trim(unit) == "package").alias("packages"), F.coalesce(F.trim(unit) != "", F.lit(False)).alias("named"), (q * factor(unit)).cast("decimal(32,4)").alias("asked"),
        (size * factor(package_unit)).cast("decimal(32,4)").alias("one"), (base_unit(unit) == base_unit(package_unit)).alias("alike"), (package_qty.isNull() & package_unit.isNull()).alias("none"), (package_qty.isNull() | package_unit.isNull()).alias("unsized"),
    )

    def counted(g: Column) -> Column:
        whole = F.when(g["q"] == F.floor(g["q"]), g["q"].cast("bigint"))
        return F.when(g["packages"], whole).otherwise((F.floor((g["asked"] - g["asked"] % g["one"]) / g["one"]) + F.when(g["asked"] % g["one"] > 0, 1).otherwise(0)).cast("bigint"))

    def told(g: Column, n: Column) -> Column:
        problem = (
            F.when(~g["number"], "quantity").when(~g["named"], "unit").when(~g["packages"] & g["none"], "product").when(~g["packages"] & g["unsized"], "size").when(~g["packages"] & ~F.coalesce(g["alike"], F.lit(False)), "conversion")
            .when(~F.coalesce(n.between(1, MOST_PACKAGES), F.lit(False)), "too_many")
        )
        return let(problem, lambda p: F.struct(F.when(p.isNull(), n).alias("packages"), p.alias("problem")))

    return let(given, lambda g: let(counted(g), lambda n: told(g, n)))


def stale(expected: DataFrame, now: DataFrame) -> DataFrame:
    """op and stale of reviewed edits: expected (op, what, id, revision) is what an edit rested on when it was reviewed; one row that has another revision now, or is
    gone, makes the edit stale."""
    seen = expected.join(now.withColumnRenamed("revision", "_now"), ["what", "id"], "left")
    return seen.groupBy("op").agg(F.bool_or(~F.col("revision").eqNullSafe(F.col("_now"))).alias("stale"))


def components(lines: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Lines (keys, position, text, has_amount) that are no headings, with the component that they stand under: the last heading above, `Main` before any. A name that
    comes again within keys is numbered ("Sauce", "Sauce 2"), whatever its case; a heading without lines vanishes. Numbers go by headings, kept or not."""
    heads = lines.withColumn("_h", is_heading(F.col("text"), F.col("has_amount")))
    named = heads.filter("_h").withColumn("name", heading_name(F.col("text")))
    # "Main" is taken from the start
    place = F.row_number().over(Window.partitionBy(*keys, F.lower("name")).orderBy(position)) + F.when(F.lower("name") == "main", 1).otherwise(0)
    numbered = named.withColumn("n", place).select(*keys, position, F.when(F.col("n") > 1, F.concat_ws(" ", "name", F.col("n").cast("string"))).otherwise(F.col("name")).alias("_name"))
    above = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = heads.join(numbered, [*keys, position], "left").withColumn("component", F.coalesce(F.last("_name", ignorenulls=True).over(above), F.lit("Main")))
    return out.filter("not _h").drop("_h", "_name")


def bookmarks(links: DataFrame, drafts: DataFrame, saves: DataFrame) -> DataFrame:
    """links (id) with their open draft (draft, revision; null without one), and how often, by whom first and when last they were saved. A draft that is not open
    doesn't hide the link: drafts are filtered before they are joined."""
    open_ones = latest_by(drafts.filter("status = 'open'"), ["id"], F.desc("revision"), F.asc("draft")).select("id", "draft", "revision")
    told = saves.groupBy("id").agg(F.count(F.lit(1)).alias("n_saves"), F.min_by("member", F.struct("at", "member")).alias("first_by"), F.max("at").alias("last_at"))
    return links.join(open_ones, "id", "left").join(told, "id", "left").withColumn("n_saves", F.coalesce("n_saves", F.lit(0)))
