"""From demand to what is left to buy: home supply, package counts, order and transfer history, status and cost, for all cycles at once.

Every table has the columns of KEYS; quantities are exact text (functions.exact). Unknown is never zero: a missing package size, price or conversion makes
what depends on it null, with an entry in `issues`. One deviation, on purpose: a line whose recipe units can't be combined has an unknown package
count, not a count of 0."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.functions.exact import BESIDE, at_least, by_fractions, conversion, known, less, lesser, not_below_zero, packages, packs, pair, parse, rounded, short, shown, sum_parts, sum_text, times, to_decimal

KEYS = ["cycle", "ingredient"]
#: Transfer states that count as on their way.
COUNTED = ("authorized", "dispatch_started", "acknowledged", "uncertain")
SHOWN_PLACES = 3


def requested(requests: DataFrame) -> DataFrame:
    """usual: the largest of the usual requests; extra: the sum of the others; a request without a number is one package."""
    n = F.coalesce("packages", F.lit(1))
    usual = F.coalesce(F.max(F.when(F.col("kind") == "usual", n)), F.lit(0))
    return requests.groupBy(*KEYS).agg(usual.alias("usual"), F.coalesce(F.sum(F.when(F.col("kind") == "extra", n)), F.lit(0)).alias("extra"))


def at_home(lines: DataFrame, availability: DataFrame) -> DataFrame:
    """Adds home (null: nothing known), net, and home_issue to lines (meal, unit).

    availability has one row per key: state (enough, some, need), quantity and avail_unit, reviewed_exact, reviewed_demand, reviewed_unit. "Enough" covers
    the need if the exact amount that was reviewed is at least the need now; older rows, with only the shown decimal, are held against the need as it
    would be shown. An amount that can't be converted subtracts nothing."""
    rows = lines.join(availability, KEYS, "left")
    exact, old, some, meal = F.col("reviewed_exact"), F.when(F.col("reviewed_exact").isNull(), F.col("reviewed_demand")), F.col("quantity"), F.col("meal")
    rows = rows.withColumns({"_by": conversion(F.col("reviewed_unit"), F.col("unit")), "_some_by": conversion(F.col("avail_unit"), F.col("unit"))})
    rows = rows.withColumns({"_meal": short(meal), "_own_exact": short(exact), "_own_old": short(old), "_own_some": short(some)})
    rows = rows.withColumns({"_exact": times(F.col("_own_exact"), F.col("_by")), "_old": times(F.col("_own_old"), F.col("_by")), "_some": times(F.col("_own_some"), F.col("_some_by")), "_rounded": pair(rounded(F.col("_meal"), SHOWN_PLACES), 10**SHOWN_PLACES)})
    seen, by = meal.isNotNull() & F.col("state").isNotNull(), F.col("_by").isNotNull()
    enough, part = seen & (F.col("state") == "enough"), seen & (F.col("state") == "some")
    has_exact, has_old, has_some = exact.isNotNull() & by, old.isNotNull() & by, some.isNotNull() & F.col("_some_by").isNotNull()
    # in longs; what they cannot hold is done again by _at_home()
    rows = rows.withColumn("_covers", F.when(has_exact, at_least(F.col("_exact"), F.col("_meal"))).when(has_old, at_least(F.col("_old"), F.col("_rounded"))).otherwise(False))
    rows = rows.withColumn("_home", F.when(enough, F.when(F.col("_covers"), F.col("_meal")).when(has_exact, F.col("_exact")).when(has_old, F.col("_old")).otherwise(pair(0))).when(part & has_some, lesser(F.col("_some"), F.col("_meal"))))
    rows = rows.withColumn("_net", not_below_zero(less(F.col("_meal"), F.coalesce("_home", pair(0)))))
    unread = lambda text, number: text.isNotNull() & F.col(number).isNull()
    long = (unread(meal, "_meal") | unread(exact, "_own_exact") | unread(old, "_own_old") | unread(some, "_own_some") | (meal.isNotNull() & ~known(F.col("_net"))) | (enough & F.col("_covers").isNull()) | ((enough | (part & has_some)) & ~known(F.col("_home"))))
    rows = rows.withColumn("_long", F.coalesce(long, F.lit(False)))
    factor = lambda c: F.concat_ws("/", F.col(f"{c}.n").cast("string"), F.col(f"{c}.d").cast("string"))
    ratio = lambda c: F.when(F.col(c).isNotNull(), factor(c))
    rows = rows.withColumn("_hand", by_fractions(_at_home, "covers boolean, home string, net string", F.col("_long"), meal, F.col("state"), exact, old, ratio("_by"), some, ratio("_some_by")))
    rows = rows.withColumn("_covers", F.coalesce(F.when(F.col("_long"), F.col("_hand.covers")).otherwise(F.col("_covers")), F.lit(False)))
    told = lambda name: F.when(F.col("_long"), F.col(f"_hand.{name}")).otherwise(shown(F.col(f"_{name}")))
    same = F.col("_by.n") == F.col("_by.d")  # an amount that needn't be converted stays as it is written
    home = F.when(enough, F.when(F.col("_covers"), meal).when(has_exact & same, exact).when(has_old & same, old).otherwise(told("home"))).when(part & has_some, told("home"))
    issue = F.when(enough & ~F.col("_covers"), "need grew").when(part & some.isNull(), "amount at home unknown").when(part & ~has_some, "amount at home not comparable")
    return rows.select(*lines.columns, home.alias("home"), told("net").alias("net"), issue.alias("home_issue"))


def _amount(text: str | None, ratio: str | None) -> Fraction | None:
    return None if text is None or ratio is None else parse(text) * Fraction(ratio)


def _at_home(meal: str | None, state: str | None, exact: str | None, old: str | None, by: str | None, some: str | None, some_by: str | None) -> tuple[bool, str | None, str | None]:
    """covers, home and net of at_home() for one row, with numbers of any length."""
    need, reviewed, before, amount = (None if meal is None else parse(meal)), _amount(exact, by), _amount(old, by), _amount(some, some_by)
    if need is None:
        return False, None, None
    covers = reviewed >= need if reviewed is not None else before is not None and before >= Fraction(to_decimal(need, SHOWN_PLACES))
    home = None
    if state == "enough":
        home = need if covers else next((x for x in (reviewed, before) if x is not None), Fraction(0))
    elif state == "some" and amount is not None:
        home = min(amount, need)
    return covers, None if home is None else str(home), str(max(need - (home or 0), Fraction(0)))


def current_receipts(receipts: DataFrame) -> DataFrame:
    """Receipts that no other one corrects."""
    return receipts.join(receipts.filter("corrects is not null").select(F.col("corrects").alias("receipt")).distinct(), "receipt", "left_anti")


def _in_product_unit(rows: DataFrame, packages: Column, qty: Column, unit: Column) -> DataFrame:
    """Adds q and product (see exact.sum_parts): packages on their record's own basis, in the product's unit; on today's package where that is unknown or not
    comparable."""
    rows = rows.withColumns({"_n": packages, "_by": conversion(unit, F.col("product_unit"))})
    own = qty.isNotNull() & F.col("_by").isNotNull()
    rows = rows.withColumns({"_size": F.when(own, qty).otherwise(F.col("product_qty")), "_by": F.when(own, F.col("_by")).otherwise(pair(1))})
    rows = rows.withColumn("q", times(times(pair(F.col("_n")), short(F.col("_size"))), F.col("_by")))
    inverse = F.concat_ws("/", F.col("_by.d").cast("string"), F.col("_by.n").cast("string"))
    product = F.when(F.col("_n").isNotNull() & F.col("_size").isNotNull() & ~known(F.col("q")), F.concat_ws(BESIDE, F.col("_n").cast("string"), "_size", inverse))
    return rows.withColumn("product", product).drop("_n", "_by", "_size")


def history(order_lines: DataFrame, receipts: DataFrame, transfers: DataFrame, products: DataFrame) -> DataFrame:
    """Per key: ordered, received, missing, sent, uncertain (packages), covered and on_way (exact, in the product's unit) and what is unclear.

    order_lines: KEYS, line, packages, package_qty, package_unit; receipts: line, receipt, corrects, state (received, missing, substituted), packages,
    suitable (null: not confirmed), sub_qty, sub_unit; transfers: KEYS, batch, status, reconciled, packages, package_qty, package_unit."""
    size = products.select(*KEYS, F.col("package_qty").alias("product_qty"), F.col("package_unit").alias("product_unit"))
    state = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0))
    r = current_receipts(receipts).withColumnRenamed("packages", "n")
    unsuitable = F.coalesce(F.sum(F.when((F.col("state") == "substituted") & ~F.col("suitable"), F.col("n"))), F.lit(0))
    open_ = F.count_if((F.col("state") == "substituted") & F.col("suitable").isNull())
    by_line = r.groupBy("line").agg(state("received").alias("rec"), state("missing").alias("mis"), state("substituted").alias("sub"), unsuitable.alias("bad"), open_.alias("open"))
    lines = order_lines.join(by_line, "line", "left").na.fill(0, ["rec", "mis", "sub", "bad", "open"]).join(size, KEYS, "left")
    lines = _in_product_unit(lines, F.col("packages") - F.col("mis") - F.col("sub"), F.col("package_qty"), F.col("package_unit")).withColumn("no_basis", F.col("product_qty").isNotNull() & F.col("package_qty").isNull())
    counts = lines.groupBy(*KEYS).agg(F.sum("packages").alias("ordered"), F.sum("rec").alias("received"), F.sum(F.col("mis") + F.col("bad")).alias("missing"), F.sum("open").alias("unconfirmed"), F.bool_or("no_basis").alias("basis_unknown"), sum_parts(F.col("q"), F.col("product")).alias("line_covered"))
    subs = r.filter("state = 'substituted' and suitable").join(order_lines.select("line", *KEYS), "line").join(size, KEYS, "left")
    subs = subs.withColumns({"_own": short(F.col("sub_qty")), "_by": conversion(F.col("sub_unit"), F.col("product_unit"))}).withColumn("q", times(F.col("_own"), F.col("_by")))
    clear = F.col("sub_qty").isNotNull() & F.col("_by").isNotNull()
    product = F.when(clear & ~known(F.col("q")), F.concat_ws(BESIDE, "sub_qty", F.lit("1"), F.concat_ws("/", F.col("_by.d").cast("string"), F.col("_by.n").cast("string"))))
    replaced = subs.groupBy(*KEYS).agg(sum_parts(F.col("q"), product).alias("sub_covered"), F.sum(F.when(clear, F.col("n")).otherwise(0)).alias("sub_received"), F.count_if(~clear).alias("sub_unclear"))
    t = _in_product_unit(transfers.filter(F.col("status").isin(*COUNTED) & ~F.col("reconciled")).join(size, KEYS, "left"), F.col("packages"), F.col("package_qty"), F.col("package_unit"))
    moved = t.groupBy(*KEYS).agg(F.coalesce(F.sum(F.when(F.col("status") != "uncertain", F.col("packages"))), F.lit(0)).alias("sent"), F.coalesce(F.sum(F.when(F.col("status") == "uncertain", F.col("packages"))), F.lit(0)).alias("uncertain"), sum_parts(F.col("q"), F.col("product")).alias("way"))
    out = counts.join(replaced, KEYS, "left").join(moved, KEYS, "full")
    whole = ["ordered", "received", "missing", "unconfirmed", "sub_received", "sub_unclear", "sent", "uncertain"]
    out = out.na.fill(0, whole).na.fill(False, ["basis_unknown"])
    return out.select(*KEYS, "ordered", (F.col("received") + F.col("sub_received")).alias("received"), "missing", "sent", "uncertain", sum_text(F.col("line_covered"), F.col("sub_covered")).alias("covered"), sum_text(F.col("way")).alias("on_way"), "unconfirmed", "sub_unclear", "basis_unknown")


def _needed() -> Column:
    return F.when(F.col("for_meal").isNotNull(), F.greatest("for_meal", "usual") + F.col("extra"))


def _planned(meal: str | None, net: str | None, size: str | None, by: str | None, covered: str, on_way: str, usual: int, extra: int, price: str | None, conflict: bool) -> tuple[int | None, int | None, int | None]:
    """for_meal, packages to send and usage of project() for one row, with numbers of any length."""
    package = _amount(size, by)
    left = None if net is None else parse(net)
    for_meal = None if conflict else 0 if meal is None else None if left is None or package is None else packages(left, package)
    send = usage = None
    if for_meal is not None and size is not None:
        send = packages(max((max(for_meal, int(usual)) + int(extra)) * parse(size) - parse(covered) - parse(on_way), Fraction(0)), parse(size))
    if meal is not None and package is not None and price is not None:
        usage = int(to_decimal(parse(meal) / package * parse(price), 0))
    return for_meal, send, usage


def project(meals: DataFrame, products: DataFrame, availability: DataFrame, requests: DataFrame, past: DataFrame, approvals: DataFrame, active_order: bool = False) -> DataFrame:
    """One row per key of any input: what to send, its state, costs and issues.

    meals: plans.demand.meal_lines; products: KEYS, product, package_qty, package_unit, price_minor; past: history(); approvals: KEYS, packages (what was
    approved for the same line)."""
    asked = requested(requests)
    keys = meals.select(*KEYS).unionByName(asked.select(*KEYS)).unionByName(past.select(*KEYS)).distinct()
    lines = keys.join(at_home(meals, availability), KEYS, "left").join(products, KEYS, "left").join(asked, KEYS, "left").join(past, KEYS, "left").join(approvals.select(*KEYS, F.col("packages").alias("approved")), KEYS, "left")
    lines = lines.na.fill(0, ["usual", "extra", "ordered", "received", "missing", "sent", "uncertain", "unconfirmed", "sub_unclear"]).na.fill("0", ["covered", "on_way"]).na.fill(False, ["basis_unknown"])
    numbers = {"_meal": "meal", "_net": "net", "_size": "package_qty", "_covered": "covered", "_on_way": "on_way"}
    lines = lines.withColumns({"_by": conversion(F.col("package_unit"), F.col("unit")), **{k: short(F.col(v)) for k, v in numbers.items()}})
    comparable = F.col("package_qty").isNotNull() & F.col("_by").isNotNull()
    conflict, meal, nothing = F.col("conflict").isNotNull(), F.col("meal"), F.lit(None).cast("bigint")
    # in longs; what they cannot hold is done again by _planned()
    lines = lines.withColumn("_package", times(F.col("_size"), F.col("_by")))
    for_meal = F.when(conflict, nothing).when(meal.isNull(), F.lit(0).cast("bigint")).when(comparable, packs(F.col("_net"), F.col("_package")))
    lines = lines.withColumn("for_meal", for_meal).withColumn("needed", _needed())
    lines = lines.withColumn("_rest", not_below_zero(less(less(times(pair(F.col("needed")), F.col("_size")), F.col("_covered")), F.col("_on_way"))))
    lines = lines.withColumn("_send", packs(F.col("_rest"), F.col("_size")))
    share = times(pair(F.try_multiply(F.col("_meal.n"), F.col("_package.d")), F.try_multiply(F.col("_meal.d"), F.nullif(F.greatest("_package.n", F.lit(0).cast("long")), F.lit(0).cast("long")))), pair(F.col("price_minor")))
    lines = lines.withColumn("_share", share)
    lines = lines.withColumn("_usage", F.when(known(F.col("_share")), rounded(F.col("_share"), 0)))
    counted = ~conflict & (meal.isNull() | (F.col("net").isNotNull() & comparable))
    long = F.lit(False)
    for number, text in numbers.items():
        long = long | (F.col(text).isNotNull() & F.col(number).isNull())
    long = long | (counted & F.col("for_meal").isNull()) | (counted & F.col("package_qty").isNotNull() & F.col("_send").isNull()) | (meal.isNotNull() & comparable & F.col("price_minor").isNotNull() & F.col("_usage").isNull())
    lines = lines.withColumn("_long", F.coalesce(long, F.lit(False)))
    ratio = F.when(F.col("_by").isNotNull(), F.concat_ws("/", F.col("_by.n").cast("string"), F.col("_by.d").cast("string")))
    lines = lines.withColumn("_hand", by_fractions(_planned, "for_meal long, send long, usage long", F.col("_long"), meal, F.col("net"), F.col("package_qty"), ratio, F.col("covered"), F.col("on_way"), F.col("usual"), F.col("extra"), F.col("price_minor").cast("string"), conflict))
    told = lambda name, own: F.when(F.col("_long"), F.col(f"_hand.{name}")).otherwise(F.col(own))
    lines = lines.withColumns({"for_meal": told("for_meal", "for_meal"), "_send": told("send", "_send"), "_usage": told("usage", "_usage")}).withColumn("needed", _needed())
    by_count = F.greatest(F.col("needed") - (F.col("ordered") - F.col("missing")) - F.col("sent") - F.col("uncertain"), F.lit(0))
    lines = lines.withColumn("to_send", F.when(F.col("needed").isNull(), None).when(F.col("package_qty").isNotNull(), F.col("_send")).otherwise(by_count))
    issues = F.array_compact(
        F.array(
            F.when(F.col("conflict").isNotNull(), "units can't be combined"),
            F.when(F.col("product").isNull(), "no product chosen"),
            F.col("home_issue"),
            F.when(F.col("meal").isNotNull() & F.col("product").isNotNull() & F.col("package_qty").isNull(), "package size unknown"),
            F.when(F.col("meal").isNotNull() & F.col("package_qty").isNotNull() & ~comparable, "package not comparable"),
            F.when(F.col("unconfirmed") > 0, "substitute not confirmed"),
            F.when(F.col("sub_unclear") > 0, "substitute not comparable"),
            F.when(F.col("uncertain") > 0, "transfer uncertain"),
            F.when(F.col("basis_unknown"), "earlier package size unknown"),
        )
    )
    lines = lines.withColumn("issues", issues)
    sent, none = F.coalesce(F.col("to_send") > 0, F.lit(False)), F.coalesce(F.col("to_send") == 0, F.lit(False))
    approved = F.coalesce(F.col("approved") == F.col("to_send"), F.lit(False)) & (F.size("issues") == 0)
    status = (
        F.when((F.col("missing") > 0) & sent, "missing")
        .when(none & (F.col("uncertain") > 0), "uncertain")
        .when(none & (F.col("sent") > 0), "in_cart_transfer")
        .when(none & (F.col("received") > 0) & (F.col("received") >= F.col("ordered") - F.col("missing")) & (F.col("ordered") > 0), "received")
        .when(none & (F.col("ordered") - F.col("missing") > 0), "ordered")
        .when(none, "nothing_needed")
        .when(F.lit(active_order) & sent & approved, "approved")
        .when(F.lit(active_order), "not_sent_yet")
        .when(approved, "approved")
        .otherwise("needs_review")
    )
    # usage rounds once, at the end
    usage = F.when(conflict, nothing).when(meal.isNull(), F.lit(0).cast("bigint")).otherwise(F.col("_usage"))
    cost = lambda n: F.when(F.col(n) == 0, F.lit(0).cast("bigint")).otherwise(F.col(n) * F.col("price_minor"))
    lines = lines.withColumns({"status": status, "usage_minor": usage, "pickup_minor": cost("needed"), "outstanding_minor": cost("to_send")})
    return lines.select(*KEYS, "meal", "unit", "conflict", "home", "net", "product", "for_meal", "usual", "extra", "needed", "ordered", "received", "missing", "sent", "uncertain", "to_send", "status", "issues", "usage_minor", "pickup_minor", "outstanding_minor", "price_minor")


def costs(lines: DataFrame) -> DataFrame:
    """Per cycle and scope (usage, pickup, outstanding): the known sum, how many are unknown, whether all are known."""

    def scope(name: str, value: str, counts: Column) -> DataFrame:
        v = F.when(counts, F.col(value))
        return lines.groupBy("cycle").agg(F.coalesce(F.sum(v), F.lit(0)).alias("known"), F.count_if(counts & F.col(value).isNull()).alias("unknown")).withColumns({"scope": F.lit(name), "complete": F.col("unknown") == 0})

    return (
        scope("usage", "usage_minor", F.col("meal").isNotNull() | F.col("conflict").isNotNull())
        .unionByName(scope("pickup", "pickup_minor", ~F.col("needed").eqNullSafe(F.lit(0))))
        .unionByName(scope("outstanding", "outstanding_minor", ~F.col("to_send").eqNullSafe(F.lit(0))))
    )


def budget(cost: DataFrame, limits: DataFrame) -> DataFrame:
    """status of limits (cycle, scope, limit_minor): unset, over as soon as the known part is, else unknown while a part is, else within."""
    rows = limits.join(cost, ["cycle", "scope"], "left")
    status = F.when(F.col("limit_minor").isNull() | F.col("scope").isNull(), "unset").when(F.coalesce("known", F.lit(0)) > F.col("limit_minor"), "over").when(~F.coalesce("complete", F.lit(True)), "unknown").otherwise("within")
    return rows.select("cycle", "scope", "limit_minor", F.coalesce("known", F.lit(0)).alias("known"), status.alias("status"))
