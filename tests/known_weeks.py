"""Small weeks whose results are known, row by row."""

from pyspark.sql import functions as F

from larderflow.plans import coverage, demand, projection, rules
from larderflow.sources import files
from tests.goldens import SQL_TYPES, literal

QUERIES, ORACLES = {}, {}


def known(outputs: str, rows: list[tuple]):
    """Registers a query over a small week, with the rows that it must have as its SQL."""
    kinds = dict(f.rsplit(" ", 1) for f in outputs.split(", "))

    def register(f):
        def run(spark, d):
            return f(spark, d).select(*[F.col(k).cast(v).alias(k) for k, v in kinds.items()])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
        ORACLES[f.__name__] = f"SELECT {', '.join(f'CAST({k} AS {SQL_TYPES[v]}) AS {k}' for k, v in kinds.items())} FROM (VALUES {values}) t({', '.join(kinds)})"
        return f

    return register


@known("ingredient string, meal string, unit string, conflict string, exact boolean, any_exact boolean", [("onion", "2", "each", None, True, True), ("milk", "473176473/400000", "ml", None, False, True), ("pesto", None, None, "g,ml", True, True)])
def d04_meal_sums(spark, d):
    """Demand over all events of a cycle, exact, one row for each ingredient; units that cannot be added are a conflict."""
    lines = spark.createDataFrame(
        [("e", "main", "onion", "2/3", "each", True), ("e", "main", "milk", "1", "cup", True), ("f", "main", "milk", "2/3", "cups", False), ("f", "side", "pesto", "1", "tbsp", True), ("e", "main", "pesto", "5", "g", True)],
        "event string, component string, ingredient string, quantity string, unit string, exact boolean",
    )
    plates = spark.createDataFrame([("e", {"main": "1.5"}), ("e", {"main": "1", "side": "1"}), ("e", {"main": "0.5"}), ("f", {"main": "3", "side": "2"})], "event string, component_portions map<string,string>")
    out = demand.meal_lines(demand.event_demand(lines, demand.portions(plates)).withColumn("cycle", F.lit("c")), ["cycle"])
    return out.withColumn("conflict", F.array_join("conflict", ","))


@known("recipe string, eaters string, status string, reasons string", [("a", "g1", "violated", "Peanut matches excluded nuts"), ("b", "g1", "ok", ""), ("c", "g1", "unknown", "Mystery"), ("a", "g2", "ok", ""), ("b", "g2", "ok", ""), ("c", "g2", "ok", "")])
def k04_constraints(spark, d):
    """Which recipes the eaters of a plan can have: ok, violated or unknown, and why."""
    ri = spark.createDataFrame([("h", "a", "peanut"), ("h", "b", "milk"), ("h", "c", "mystery")], "household string, recipe string, ingredient string")
    ing = spark.createDataFrame([("peanut", "Peanut", ["Nuts"], True), ("milk", "Milk", [], True), ("mystery", "Mystery", [], False)], "ingredient string, name string, tags array<string>, allergens_known boolean")
    ex = spark.createDataFrame([("h", "nuts", "m1"), ("other", "milk", None)], "household string, term string, member string")
    eaters = spark.createDataFrame([("h", "g1", "m1"), ("h", "g1", "m2"), ("h", "g2", "m2")], "household string, group string, member string")
    return rules.check_recipes(ri, ing, ex, eaters).withColumnRenamed("group", "eaters").withColumn("reasons", F.array_join("reasons", ","))


@known("nutrient string, value string, known string, missing string", [("calories", "3689/10", "3689/10", ""), ("protein_g", None, "527/10", "oil"), ("carbs_g", "0", "0", ""), ("fat_g", "403/25", "403/25", "")])
def k02_plate_nutrition(spark, d):
    """A plate's nutrients: unknown if any part is, with what is known beside it."""
    amounts = spark.createDataFrame([("p", "chicken", "170"), ("p", "oil", "10")], "plate string, ingredient string, q string")
    facts = spark.createDataFrame([("chicken", "100", "165", "31", "0", "3.6"), ("oil", "100", "884", None, "0", "100")], "ingredient string, basis_qty string, calories string, protein_g string, carbs_g string, fat_g string")
    return rules.plate_nutrition(amounts, facts).withColumn("missing", F.array_join("missing", ","))


@known("night string, state string", [("1", "covered"), ("2", "covered"), ("3", "unresolved"), ("4", "out"), ("5", "uncovered"), ("6", "unresolved"), ("7", "unresolved")])
def d23_week_coverage(spark, d):
    """Which nights of a week have their dinner."""
    a = spark.createDataFrame([("w", "1", "cook", "e"), ("w", "2", "leftover", "e"), ("w", "3", "leftover", "e"), ("w", "4", "out", None), ("w", "5", "open", None), ("w", "6", "cook", "x"), ("w", "7", "leftover", "g")], "week string, night string, kind string, event string")
    e = spark.createDataFrame([("e", "scheduled", "1"), ("x", "retired", "6"), ("g", "scheduled", "7")], "event string, status string, cook_night string")
    p = spark.createDataFrame([("e", n) for n in "1122233"] + [("g", "7")], "event string, night string")
    o = spark.createDataFrame([("e", 4, "2", 1), ("e", 9, "2", 0)], "event string, portions_remaining int, observed_night string, observed_at int")
    return coverage.coverage(a, e, p, o)


@known("ref string, size string, basis string, cents long, promo boolean", [("1", "2 lb", "unit", 350, True), ("1", "2 lb", "unit", None, False), ("1", None, "weight", None, False), ("1", None, "weight", None, False), ("2", None, "unknown", None, False), ("2", None, "unknown", None, False)])
def j07_products(spark, d):
    """Items of retail product bodies, a row each; a price only with a location, a promotion only below the regular price."""
    body = '{"data":[{"productId":"1","description":"Rice","items":[{"size":"2 lb","soldBy":"UNIT","price":{"regular":4.99,"promo":3.5}},{"soldBy":"weight","price":{"regular":4.999}}]},{"productId":"2","items":[]}]}'
    out = files.products(spark.createDataFrame([("here", body), (None, body), ("here", "no json")], "location string, body string"))
    return out.select(F.col("product_ref").alias("ref"), "size", F.col("sale_basis").alias("basis"), F.col("price_minor").alias("cents"), F.col("on_promotion").alias("promo"))


@known(
    "ingredient string, to_send long, status string, issues string",
    [("chicken", 2, "needs_review", ""), ("rice", 1, "needs_review", ""), ("broccoli", 2, "needs_review", ""), ("pesto", None, "needs_review", "units can't be combined; no product chosen"), ("oil", 1, "needs_review", ""), ("salmon", None, "needs_review", "package size unknown"), ("yogurt", 3, "needs_review", "")],
)
def k01_projection(spark, d):
    """From a week's demand, products and requests to packages."""
    frame = lambda rows, schema: spark.createDataFrame([("c", *r) for r in rows], "cycle string, ingredient string, " + schema)
    meals = frame(
        [("chicken", "1219.029494375", "g", None, False, False), ("rice", "675", "g", None, False, False), ("broccoli", "700", "g", None, True, True), ("pesto", None, None, ["g", "ml"], True, True), ("oil", "30", "ml", None, True, True), ("salmon", "500", "g", None, True, True)],
        "meal string, unit string, conflict array<string>, exact boolean, any_exact boolean",
    )
    products = frame([("chicken", "p1", "24", "oz", 749), ("rice", "p2", "2", "lb", 400), ("broccoli", "p3", "1", "lb", 249), ("oil", "p4", "500", "ml", None), ("salmon", "p5", None, None, 900), ("yogurt", "p6", "32", "oz", 500)], "product string, package_qty string, package_unit string, price_minor long")
    requests = frame([("yogurt", "usual", None), ("yogurt", "usual", 2), ("yogurt", "extra", None)], "kind string, packages int")
    available = frame([], "state string, quantity string, avail_unit string, reviewed_exact string, reviewed_demand string, reviewed_unit string")
    past = projection.history(
        frame([], "line string, packages int, package_qty string, package_unit string"), spark.createDataFrame([], "line string, receipt string, corrects string, state string, packages int, suitable boolean, sub_qty string, sub_unit string"),
        frame([], "batch string, status string, reconciled boolean, packages int, package_qty string, package_unit string"), products,
    )
    out = projection.project(meals, products, available, requests, past, frame([], "packages long"))
    return out.withColumn("issues", F.array_join("issues", "; "))


FOODS = [
    '{"fdcId":1,"description":"Chicken, raw","dataType":"Foundation","foodNutrients":[{"nutrient":{"number":"958","unitName":"KCAL"},"amount":120.50},{"nutrient":{"number":"203","unitName":"G"},"amount":22},{"nutrient":{"number":"204","unitName":"mg"},"amount":3}],"foodPortions":[{"id":7,"amount":1,"gramWeight":140,"measureUnit":{"name":"cup"},"modifier":"diced"},{"id":8,"gramWeight":0,"measureUnit":{"name":"cup"}}]}',
    '{"fdcId":2,"description":"Juice","dataType":"Branded","servingSize":240,"servingSizeUnit":"ml","foodNutrients":[{"nutrientNumber":"208","unitName":"KCAL","value":45}]}',
    '{"fdcId":3,"description":"Bar, roasted","dataType":"Branded","servingSize":"40","servingSizeUnit":"GRM","foodNutrients":[{"number":"208","unitName":"kcal","amount":null},{"number":"957","unitName":"kcal","amount":400},{"number":"205","unitName":"g","amount":"5e1"}]}',
    '{"fdcId":4,"description":" ","dataType":"Branded"}', '{"fdcId":5,"description":"x","dataType":"Experimental"}', "[]", "no json", '{"description":"x"}',
]


def _foods(spark):
    from larderflow.sources.foods import foods

    return foods(spark.createDataFrame(list(enumerate(FOODS)), "n int, body string"))


@known(
    "n int, reason string, form string, portions int",
    [(0, None, "raw", 1), (1, None, None, 0), (2, None, "cooked", 1), (3, "description missing", None, 0), (4, "unsupported or missing data type", None, 0), (5, "the food is not a JSON object", None, 0), (6, "the food is not a JSON object", None, 0), (7, "fdcId missing or not an integer", None, 0)],
)
def a25_foods(spark, d):
    """Bodies of a nutrition service, each normalised or refused with a reason."""
    return _foods(spark).withColumn("portions", F.when(F.col("reason").isNull(), F.size("portions")).otherwise(0))


@known(
    "food_id long, nutrient string, amount string, unit string, number string, status string",
    [
        (1, "energy", "120.5", "kcal", "958", "ok"), (1, "protein", "22", "g", "203", "ok"), (1, "fat", None, "mg", "204", "bad_unit"), (1, "carbs", None, None, None, "missing"),
        (2, "energy", None, "kcal", "208", "missing"), (2, "protein", None, None, None, "missing"), (2, "fat", None, None, None, "missing"), (2, "carbs", None, None, None, "missing"),
        (3, "energy", "400", "kcal", "957", "ok"), (3, "protein", None, None, None, "missing"), (3, "fat", None, None, None, "missing"), (3, "carbs", "50", "g", "205", "ok"),
    ],
)
def j05_nutrients(spark, d):
    """A food's nutrients for 100 g: the first number with an amount, in its unit, or why there is none."""
    from larderflow.sources.foods import nutrients

    return nutrients(_foods(spark))


@known(
    "food_id long, nutrient string, problem string, basis_qty string, basis_unit string, amount string",
    [(1, "energy", None, "1", "cup diced", "168.7"), (1, "protein", None, "1", "cup diced", "30.8"), (2, "energy", "basis_unknown", "100", "g", None), (2, "protein", "basis_unknown", "100", "g", None), (3, "energy", None, "1", "serving", "160"), (3, "protein", None, "1", "serving", None)],
)
def j06_effective_facts(spark, d):
    """A food's nutrients for the portion that was chosen; unknown stays unknown."""
    from larderflow.sources.foods import effective_facts, nutrients

    chosen = spark.createDataFrame([(1, "p7"), (3, "serving")], "food_id long, portion string")
    return effective_facts(nutrients(_foods(spark)).filter("nutrient in ('energy', 'protein')"), chosen)


@known("food_id long, nutrient string, problem string", [(1, "energy", "portion_unknown")])
def j06_unknown_portion(spark, d):
    """A portion that the food doesn't have is an error, not 100 g."""
    from larderflow.sources.foods import effective_facts, nutrients

    return effective_facts(nutrients(_foods(spark)).filter("food_id = 1 and nutrient = 'energy'"), spark.createDataFrame([(1, "p8")], "food_id long, portion string"))


@known(
    "line string, quantity string, unit string, name string, note string, status string",
    [
        ("2 cups flour, sifted", "2", "cup", "flour", "sifted", "parsed"), ("1 ½ lb. chicken breast", "1 1/2", "lb", "chicken breast", None, "parsed"), ("3 cloves garlic, minced", "3", "each", "garlic (clove)", "minced", "parsed"),
        ("1 (15 oz) can black beans", "15", "oz", "black beans", None, "parsed"), ("2-3 carrots", None, "each", "carrots", None, "requires_review"), ("1 quart stock", "4", "cup", "stock", None, "parsed"),
        ("a pinch of saffron", None, None, "saffron", None, "requires_review"), ("salt to taste", None, None, "salt", "to taste", "omitted"), ("parsley for garnish", None, None, "parsley", "for garnish", "requires_review"),
        ("1 cup milk or cream", "1", "cup", "", None, "requires_review"), ("2 large eggs", "2", "each", "eggs", "large", "parsed"), ("1 lb 4 oz beef", None, None, "beef", None, "requires_review"), ("1/0 cup sugar", None, None, "sugar", None, "requires_review"),
        ("8 fl oz cream", "8", "fl_oz", "cream", None, "parsed"), ("two onions (red), diced", "2", "each", "onions", "red; diced", "parsed"), ("1.5 T oil", "1.5", "tbsp", "oil", None, "parsed"), ("1 tsp kosher salt", "1", "tsp", "kosher salt", None, "omitted"), ("", None, None, "", None, "requires_review"),
    ],
)
def j04_ingredient_lines(spark, d):
    """Ingredient lines taken apart: amount, unit, name, note, and whether a person has to look."""
    from larderflow.functions.ingredient_lines import read_lines

    lines = ["2 cups flour, sifted", "1 ½ lb. chicken breast", "3 cloves garlic, minced", "1 (15 oz) can black beans", "2-3 carrots", "1 quart stock", "a pinch of saffron", "salt to taste", "parsley for garnish", "1 cup milk or cream", "2 large eggs", "1 lb 4 oz beef", "1/0 cup sugar", "8 fl oz cream", "two onions (red), diced", "1.5 T oil", "1 tsp kosher salt", ""]
    return read_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
