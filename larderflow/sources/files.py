"""Sources and sinks of household data: shopping lists, exports and restores, retail product bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.functions.readers import dollars_to_cents, sale_basis


def neutral(value: Column) -> Column:
    """A cell that a spreadsheet won't run: text that begins like a formula gets a leading apostrophe."""
    shown = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(shown.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), shown)).otherwise(shown)


def csv_line(*columns: Column) -> Column:
    """One CSV row, every cell quoted."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(neutral(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def write_list_csv(lines: DataFrame, path: str, columns: list[str]) -> None:
    """Shopping lists as CSV with CRLF, one folder per list: lines has list_id beside the columns."""
    quoted = [F.regexp_replace(neutral(F.col(c)), "[\\r\\n]+", " ").alias(c) for c in columns]
    lines.select("list_id", *quoted).write.partitionBy("list_id").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def list_text(lines: DataFrame) -> DataFrame:
    """list_id and the list as text, in its groups: lines has list_id, group (to_buy, check, have), position, text."""
    titles = {"to_buy": "To buy", "check": "Check first", "have": "Already have"}
    grouped = lines.groupBy("list_id", "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: F.concat(F.lit("- "), x.text)), "\n").alias("body"))
    order = F.array_position(F.array(*[F.lit(g) for g in titles]), F.col("group"))
    title = F.try_element_at(F.create_map(*[F.lit(x) for pair in titles.items() for x in pair]), F.col("group"))
    blocks = grouped.select("list_id", F.struct(order.alias("o"), F.concat(title, F.lit("\n"), F.col("body")).alias("t")).alias("b"))
    return blocks.groupBy("list_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x.t), "\n\n").alias("text"))


def export_tables(tables: dict[str, DataFrame], path: str, omit: dict[str, list[str]] | None = None) -> None:
    """Each table as JSON lines in the order of its rows' text, without the named columns."""
    for name, df in tables.items():
        df = df.drop(*(omit or {}).get(name, []))
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).orderBy("value").write.text(f"{path}/{name}")


def restore_tables(spark: SparkSession, schemas: dict[str, str], path: str) -> dict[str, DataFrame]:
    """What export_tables wrote, by explicit schemas; rows that don't fit raise."""
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in schemas.items()}


ITEM = "struct<itemId: string, size: string, soldBy: string, price: struct<regular: string, promo: string>>"
PRODUCT = f"struct<productId: string, upc: string, brand: string, description: string, items: array<{ITEM}>>"


def products(bodies: DataFrame) -> DataFrame:
    """One row per item of retail product bodies (location, body): a price only where a location is given, the promotion only if it is lower. `data` is a list of
    products or one; a product without an id is left out, one without items has a row of its own. Prices are read as they are written."""
    listed = F.from_json("body", f"struct<data: array<{PRODUCT}>>")["data"]
    single = F.from_json("body", f"struct<data: {PRODUCT}>")["data"]
    rows = bodies.withColumn("p", F.explode(F.coalesce(F.when(F.size(listed) >= 0, listed), F.array(single)))).filter("trim(p.productId) <> ''").withColumn("i", F.explode_outer("p.items"))
    regular, promo = dollars_to_cents(F.col("i.price.regular")), dollars_to_cents(F.col("i.price.promo"))
    has = F.col("location").isNotNull()
    better = F.coalesce(has & (promo < regular), F.lit(False))
    return rows.select(
        F.col("p.productId").alias("product_ref"), F.col("p.upc").alias("upc"), F.col("p.brand").alias("brand"), F.col("p.description").alias("name"), F.col("i.size").alias("size"), sale_basis(F.col("i.soldBy")).alias("sale_basis"),
        F.when(better, promo).when(has, regular).alias("price_minor"), better.alias("on_promotion"),
    )
