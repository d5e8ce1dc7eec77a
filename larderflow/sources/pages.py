"""Recipes of web pages: JSON-LD blocks walked as variants, fields read as column expressions; microdata where a page has no block; Open Graph fields.

pages: page_id, html. Blocks that are too long, too deep or no JSON are named and skipped. Only what microdata needs, matching the ends of elements, is Python."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larderflow.functions import readers
from larderflow.functions.markup import decoded, lines, plain
from larderflow.functions.text import cleaned_link
from larderflow.sources.shared import written

#: Characters of a block, its nesting, blocks and recipes of a page, steps, ingredients and images of a recipe: what a page has beyond them is named in `problems`.
BLOCK_CHARS, DEPTH, BLOCKS, RECIPES, STEPS, INGREDIENTS, IMAGES = 512 * 1024, 64, 20, 20, 60, 100, 5
RECIPE = ("Recipe", "schema:Recipe", "http://schema.org/Recipe", "https://schema.org/Recipe")


# variants


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ..; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def field(v: Column, name: str) -> Column:
    return F.when(kind(v) == "OBJECT", F.variant_get(v, f'$["{name}"]', "variant"))


def items(v: Column) -> Column:
    """An array's items; anything else as the one item of an array."""
    return F.when(kind(v) == "ARRAY", v.try_cast("array<variant>")).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<variant>"))


def said(v: Column) -> Column:
    """A string or number as text."""
    return F.when(kind(v).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), v.try_cast("string"))


def types(v: Column) -> Column:
    return F.filter(F.transform(items(field(v, "@type")), lambda x: F.when(kind(x) == "STRING", x.try_cast("string"))), lambda x: x.isNotNull())


def local_types(v: Column) -> Column:
    return F.transform(types(v), lambda t: F.regexp_replace(t, r"^(schema:|https?://schema\.org/)", ""))


def has_type(v: Column, *names: str) -> Column:
    return F.arrays_overlap(local_types(v), F.array(*(F.lit(n) for n in names)))


# blocks and nodes


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block (from 1), text and problem of the JSON-LD blocks of each page. A script ends at the next </script, whatever stands in it."""
    parts = F.transform(F.split("html", r"(?i)</script"), lambda s: F.regexp_extract(s, r"(?is)<script(?=[\s>/])((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*+)$", 1))
    head = F.regexp_extract("part", r"(?s)^((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", 1)
    name = r"(?i)(?:^|\s)type\s*+=\s*+"
    given = F.coalesce(*(F.nullif(F.regexp_extract("head", name + form, 1), F.lit("")) for form in (r'"([^"]*+)"', r"'([^']*+)'", r"([^\s\"'>]++)")))
    scripts = pages.select("page_id", F.posexplode(parts).alias("at", "part")).filter("part <> ''").withColumn("head", head)
    ours = scripts.filter(F.lower(F.trim(F.split_part(given, F.lit(";"), F.lit(1)))) == "application/ld+json")
    listed = ours.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", F.expr("substring(part, length(head) + 2)").alias("body")))).alias("all"))
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim("all.body"), r"^<!--|-->$", "")), r"^<!\[CDATA\[|\]\]>$", ""))
    rows = listed.select("page_id", F.posexplode("all").alias("block", "all")).select("page_id", (F.col("block") + 1).alias("block"), text.alias("text")).filter("text <> ''")
    # nesting: the deepest of the brackets outside strings
    brackets = F.regexp_replace(F.regexp_replace("text", r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    deep = F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")), lambda s: s["most"])
    problem = F.when(F.col("block") > BLOCKS, "too many blocks").when(F.length("text") > BLOCK_CHARS, "too long").when(deep > DEPTH, "nested too deep").when(F.try_parse_json("text").isNull(), "not JSON")
    return rows.withColumn("problem", problem)


def nodes(found: DataFrame) -> DataFrame:
    """page_id, block, path and node (JSON text) of what blocks() without a problem hold: the top, the items of its lists, what stands under @graph and
    mainEntity. A round goes one step down from what the last one found, so there are as many as the deepest block has levels; path orders nodes as they stand."""
    v = F.parse_json("node")
    front = written(found.filter("problem is null").select("page_id", "block", F.array().cast("array<int>").alias("path"), F.to_json(F.parse_json("text")).alias("node")), "nodes")
    seen = [front]
    for _ in range(DEPTH + 1):
        down = F.when(F.startswith("node", F.lit("[")), v.try_cast("array<variant>")).otherwise(F.array(field(v, "@graph"), field(v, "mainEntity")))
        some = front.filter("node like '[%' or node like '{%'").select("page_id", "block", "path", F.posexplode(down).alias("i", "child")).filter("child is not null")
        front = written(some.select("page_id", "block", F.concat("path", F.array(F.col("i"))).alias("path"), F.to_json("child").alias("node")), "nodes")
        if not front.limit(1).count():
            break
        seen.append(front)
    return reduce(DataFrame.unionByName, seen).filter("node like '{%'")


def resolved(values: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """values (page_id, block and a variant) with references, objects of nothing but @-keys, replaced by the first node of the block that has their @id."""
    v = F.col(column)
    bare = (kind(v) == "OBJECT") & ~F.exists(F.map_keys(v.try_cast("map<string,variant>")), lambda k: ~F.startswith(k, F.lit("@")))
    out = values.withColumn("_ref", F.when(bare, said(field(v, "@id")))).join(known.select("page_id", "block", F.col("id").alias("_ref"), F.col("node").alias("_node")), ["page_id", "block", "_ref"], "left")
    return out.withColumns({column: F.coalesce(F.parse_json("_node"), v), "was_reference": F.col("_node").isNotNull()}).drop("_ref", "_node")


# fields


SERVING = r"(?i)^(?:(?:serves|servings?|yields?|makes)\s*:?\s*)?(\d{1,3})(?:\s*(?:servings?|people|persons?|portions?))?$"


def servings(v: Column) -> Column:
    """The one number of servings from 1 to 100 that all entries with a digit name."""
    entries = F.filter(F.transform(items(v), lambda x: plain(said(x))), lambda e: e.isNotNull() & e.rlike(r"\d"))
    counts = F.array_distinct(F.transform(entries, lambda e: F.regexp_extract(e, SERVING, 1)))
    n = F.try_element_at(counts, F.lit(1)).try_cast("int")
    return F.when((F.size(counts) == 1) & n.between(1, 100), n)


def ingredients(v: Column) -> Column:
    """Texts of a list of texts, numbers or named objects, or the lines of one text."""
    many = F.transform(items(v), lambda x: F.coalesce(said(x), said(field(x, "name"))))
    raw = F.when(kind(v) == "STRING", lines(v.try_cast("string"))).otherwise(many)
    return F.slice(F.filter(F.transform(raw, lambda t: plain(t)), lambda t: t.isNotNull()), 1, INGREDIENTS)


def first_text(v: Column, cap: int = 80) -> Column:
    parts = F.flatten(F.transform(items(v), lambda x: F.when(kind(x) == "STRING", F.split(x.try_cast("string"), ",")).otherwise(F.array().cast("array<string>"))))
    return F.try_element_at(F.filter(F.transform(parts, lambda t: plain(t, cap)), lambda t: t.isNotNull()), F.lit(1))


def steps(recipes: DataFrame) -> DataFrame:
    """page_id, block, path and steps: an array of (section, text) in their order. Sections and lists hold more of the same, three levels deep at most."""
    keys = ["page_id", "block", "path"]
    now = recipes.select(*keys, F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("section"), field(F.col("v"), "recipeInstructions").alias("x"))
    out = []
    for level in range(4):
        # written: both what is said on this level and what the next one holds are made of it
        flat = written(now.filter("x is not null").select(*keys, "at", "section", F.posexplode(items(F.col("x"))).alias("i", "x")).select(*keys, F.concat("at", F.array("i")).alias("at"), "section", F.to_json("x").alias("x")), "steps").withColumn("x", F.parse_json("x"))
        if level and not flat.limit(1).count():
            break
        x, name = F.col("x"), plain(said(field(F.col("x"), "name")), 200)
        inner, text = field(x, "itemListElement"), plain(said(field(x, "text")), 1_000)
        section, listed = has_type(x, "HowToSection"), has_type(x, "ItemList")
        holds = (kind(x) == "ARRAY") | section | listed | (text.isNull() & inner.isNotNull())
        written_out = F.when(kind(x) == "STRING", F.transform(lines(x.try_cast("string")), lambda t: plain(t, 1_000))).otherwise(F.array(F.coalesce(text, plain(said(field(x, "name")), 1_000))))
        out.append(flat.filter(~F.coalesce(holds, F.lit(False))).select(*keys, "at", "section", F.posexplode(written_out).alias("j", "text")).filter("text is not null"))
        under = F.when(section | (~listed & ~has_type(x, "HowToStep", "HowToDirection", "HowToTip")), F.coalesce(name, F.col("section"))).otherwise(F.col("section"))
        now = flat.filter(holds).select(*keys, "at", under.alias("section"), F.when(kind(x) == "ARRAY", x).otherwise(inner).alias("x"))
    rows = reduce(DataFrame.unionByName, out)
    ordered = F.array_sort(F.collect_list(F.struct("at", "j", "section", "text")))
    return rows.groupBy(*keys).agg(F.slice(F.transform(ordered, lambda s: F.struct(s["section"].alias("section"), s["text"].alias("text"))), 1, STEPS).alias("steps"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def links(urls: pd.Series) -> pd.Series:
    """Those that are links to public sites, cleaned, each once."""
    return urls.map(lambda some: list(dict.fromkeys(x[2] for x in map(cleaned_link, [] if some is None else some) if x[0])))


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, block (0: microdata), place (order in the block), name, ingredients, servings, prep, cook and total (minutes), author, category, cuisine,
    site_name, steps, images, has_nutrition of every recipe of every page; images and site name of the page stand in where a recipe has none."""
    found = written(blocks(pages), "blocks")
    held = written(nodes(found), "held")
    v = F.parse_json("node")
    marked = held.select("page_id", "block", "path", "node", F.arrays_overlap(types(v), F.array(*(F.lit(t) for t in RECIPE))).alias("recipe"), has_type(v, "WebSite").alias("site"), has_type(v, "Organization").alias("org"), said(field(v, "@id")).alias("id"), plain(said(field(v, "name")), 200).alias("own_name"))
    data = F.exists(F.map_keys(F.parse_json("node").try_cast("map<string,variant>")), lambda k: ~F.startswith(k, F.lit("@")))
    known = marked.filter("id is not null").filter(data).groupBy("page_id", "block", "id").agg(F.min_by("node", "path").alias("node"))
    sites = marked.filter("(site or org) and own_name is not null").groupBy("page_id", "block").agg(F.min_by("own_name", F.struct(~F.col("site"), F.col("path"))).alias("of_block"))
    recipes = marked.filter("recipe").select("page_id", "block", "path", "node")
    with_blocks = recipes.select("page_id").distinct()
    spare = pages.filter(F.lower("html").contains("schema.org/recipe")).join(with_blocks, "page_id", "left_anti")
    made = spare.select("page_id", F.lit(0).alias("block"), F.array().cast("array<int>").alias("path"), microdata("html").alias("node")).filter("node is not null")
    recipes = written(recipes.unionByName(made), "recipes").withColumn("v", F.parse_json("node"))
    keys, r = ["page_id", "block", "path"], F.col("v")

    def of(name: str) -> DataFrame:
        return resolved(recipes.select(*keys, F.posexplode(items(field(r, name))).alias("i", "x")), known, "x")

    x = F.col("x")
    writers = of("author").filter(~F.col("was_reference") | has_type(x, "Person", "Organization")).withColumn("t", plain(F.when(kind(x) == "OBJECT", said(field(x, "name"))).otherwise(said(x)), 200)).filter("t is not null")
    authors = writers.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), ", ").alias("author"))
    makers = of("publisher").withColumn("t", plain(said(field(x, "name")), 200)).filter("t is not null").groupBy(*keys).agg(F.min_by("t", "i").alias("publisher"))
    pictures = of("image").withColumn("url", F.when(kind(x) == "OBJECT", F.coalesce(said(field(x, "url")), said(field(x, "contentUrl")))).otherwise(said(x))).withColumn("width", F.regexp_extract(F.coalesce(said(field(field(x, "width"), "value")), said(field(x, "width"))), r"(?i)^\s*(\d{1,6})\s*(?:px)?\s*$", 1).try_cast("int"))
    by_width = F.array_sort(F.collect_list(F.struct("i", "url", "width")))
    pictures = pictures.filter("url is not null").groupBy(*keys).agg(by_width.alias("p")).withColumn("p", F.when(F.forall("p", lambda s: s["width"].isNotNull()), F.array_sort(F.transform("p", lambda s: F.struct((-s["width"]).alias("w"), s["i"].alias("i"), s["url"].alias("url"))))).otherwise(F.transform("p", lambda s: F.struct(F.lit(0).alias("w"), s["i"].alias("i"), s["url"].alias("url")))))
    pictures = pictures.select(*keys, F.slice(links(F.transform("p", lambda s: s["url"])), 1, IMAGES).alias("pictures"))
    fields = recipes.select(
        *keys, plain(said(field(r, "name"))).alias("name"), ingredients(F.coalesce(field(r, "recipeIngredient"), field(r, "ingredients"))).alias("ingredients"), servings(F.coalesce(field(r, "recipeYield"), field(r, "yield"))).alias("servings"),
        *(readers.duration_minutes(said(field(r, f"{t}Time"))).alias(t) for t in ("prep", "cook", "total")), first_text(field(r, "recipeCategory")).alias("category"), first_text(field(r, "recipeCuisine")).alias("cuisine"), field(r, "nutrition").isNotNull().alias("has_nutrition"),
    )
    meta = page_meta(pages)
    out = fields.join(authors, keys, "left").join(makers, keys, "left").join(steps(recipes), keys, "left").join(pictures, keys, "left").join(sites, ["page_id", "block"], "left").join(meta, "page_id", "left")
    order = F.row_number().over(Window.partitionBy("page_id", "block").orderBy("path"))
    none = F.array().cast("array<string>")
    return out.select(
        "page_id", "block", order.alias("place"), "name", "ingredients", "servings", "prep", "cook", "total", "author", "category", "cuisine", F.coalesce("publisher", "of_block", "site_name").alias("site_name"),
        F.coalesce("steps", F.array().cast("array<struct<section:string,text:string>>")).alias("steps"), F.when(F.size(F.coalesce("pictures", none)) > 0, F.col("pictures")).when(F.col("image").isNotNull(), F.array("image")).otherwise(none).alias("images"), "has_nutrition",
    ).filter(F.col("place") <= RECIPES)


# the page itself


def page_meta(pages: DataFrame) -> DataFrame:
    """page_id, title, site_name, image of each page: the first og:title, og:site_name, og:image (else twitter:image) outside comments and scripts."""
    bare = F.regexp_replace("html", r"(?is)<!--(?:.*?-->|.*$)|<script(?=[\s>/]).*?(?:</script|$)", " ")
    tags = F.regexp_extract_all(bare, F.lit(r"(?i)<meta(?=[\s/>])((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"), F.lit(1))

    def attribute(tag: Column, name: str) -> Column:
        forms = [F.nullif(F.regexp_extract(tag, rf"(?i)(?:^|[\s\"'/]){name}\s*+=\s*+" + form, 1), F.lit("")) for form in (r'"([^"]*+)"', r"'([^']*+)'", r"([^\s\"'>]++)")]
        return F.coalesce(*forms)

    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.trim(attribute(t, "property"))).alias("p"), F.lower(F.trim(attribute(t, "name"))).alias("n"), attribute(t, "content").alias("c")))

    def first(key: str) -> Column:
        return F.try_element_at(F.filter("pairs", lambda x: (x["p"].eqNullSafe(F.lit(key)) | x["n"].eqNullSafe(F.lit(key))) & x["c"].isNotNull()), F.lit(1))["c"]

    rows = pages.select("page_id", pairs.alias("pairs")).select("page_id", plain(first("og:title")).alias("title"), plain(first("og:site_name"), 200).alias("site_name"), F.trim(decoded(first("og:image"))).alias("a"), F.trim(decoded(first("twitter:image"))).alias("b"))
    given = F.filter(F.array("a", "b"), lambda u: u.isNotNull())
    return rows.select("page_id", "title", "site_name", F.when(F.size(given) > 0, F.try_element_at(links(given), F.lit(1))).alias("image"))


TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Properties that are read, and the names that they have in a JSON-LD recipe.
PROPERTIES = {p.lower(): p for p in ("name", "description", "author", "recipeCategory", "recipeCuisine", "prepTime", "cookTime", "totalTime", "nutrition", "recipeIngredient", "recipeYield", "recipeInstructions", "image")} | {"ingredients": "recipeIngredient"}
LISTS = ("recipeIngredient", "recipeYield", "recipeInstructions", "image")


def element_ends(tags: list[re.Match]) -> list[int]:
    """For each opening tag the index of the tag that closes it, by names alone, or -1: one pass with a stack for each name."""
    ends, open_ = [-1] * len(tags), {}
    for i, t in enumerate(tags):
        name = (t[2] or "").lower()
        if t[1]:
            if open_.get(name):
                ends[open_[name].pop()] = i
        elif name and name not in VOID:
            open_.setdefault(name, []).append(i)
    return ends


def recipe_of_microdata(html: str) -> str | None:
    """The first element whose itemtype is a recipe, as JSON: its itemprop elements in their order, without items nested in it (an author's name is read)."""
    tags = list(TOKEN.finditer(html))
    ends = element_ends(tags)
    read = lambda t: {k.lower(): next((x for x in v if x), "") for k, *v in ATTRIBUTE.findall(t[3] or "")}
    start = next((i for i, t in enumerate(tags) if not t[1] and "itemtype" in (t[3] or "").lower() and re.search(r"schema\.org/recipe(\s|$)", read(t).get("itemtype", "").lower())), None)
    if start is None:
        return None
    found: dict[str, list[str]] = {}
    i, stop = start + 1, ends[start] if ends[start] > 0 else len(tags)
    while i < stop:
        t, here = tags[i], i
        i += 1
        if t[1] or not t[2] or "item" not in (t[3] or "").lower():
            continue
        a = read(t)
        names = [PROPERTIES[p] for p in a.get("itemprop", "").lower().split() if p in PROPERTIES]
        end = ends[here]
        inner = html[t.end() : tags[end].start()] if end > 0 else None
        if end > 0 and (names or "itemscope" in a):
            i = end
        for p in names:
            value = a.get("content") or inner
            if p == "image":
                value = a.get("src") or a.get("content") or a.get("href")
            elif p.endswith("Time"):
                value = a.get("content") or a.get("datetime") or inner
            elif p == "author" and "itemscope" in a and inner:
                value = next((html[u.end() : tags[ends[k]].start()] for k, u in enumerate(tags[here + 1 : end], here + 1) if not u[1] and ends[k] > 0 and read(u).get("itemprop", "").lower() == "name"), inner)
            elif p == "name" and "itemscope" in a:
                continue
            if value:
                found.setdefault(p, []).extend(re.split(r"(?i)</li>|(?=<li[\s>])", value) if p == "recipeIngredient" else [value])
    return json.dumps({"@type": "Recipe"} | {p: v if p in LISTS else v[0] for p, v in found.items()})


@F.pandas_udf(T.StringType())
def microdata(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else recipe_of_microdata(h))
