"""Readers of recipe pages as queries: `pages`, each with a recipe made of the `part` of its number put into its html, in eight forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.operators.relational import query, table
from larderflow.sources import pages

#: What is put in, by page_id % 8; NAME, KEY and SIZE stand for the part's.
FORMS = (
    '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Recipe","name":"<b>NAME</b> &amp; rice","recipeIngredient":["SIZE cups flour","&frac12; tsp  salt <i>fine</i>",{"name":"named"}],"recipeYield":"SIZE servings","prepTime":"PT1HSIZEM",'
    '"author":[{"@type":"Person","name":"Ada"},"Bo"],"recipeInstructions":[{"@type":"HowToSection","name":"Base","itemListElement":[{"@type":"HowToStep","text":"Mix it"},{"@type":"HowToStep","name":"Bake it"}]},"Serve<br>Eat"],"image":[{"url":"https://www.pics.com/small.jpg","width":10},{"url":"https://www.pics.com/large.jpg","width":"20px"}]}</script>',
    '<script>var x = "<p>";</script><SCRIPT data-a=">" TYPE=\'Application/LD+JSON; charset=utf-8\'>[{"@type":"WebSite","name":"Pantry"},{"@type":["Thing","Recipe"],"name":"NAME","recipeIngredient":"SIZE g rice<br>water","recipeYield":["4","4 servings"],'
    '"image":"https://www.pics.com/a.jpg?utm_source=x&b=1#top","cookTime":"PT90S"}]</SCRIPT>',
    '<script type=application/ld+json>{"@graph":[{"@type":"Organization","@id":"#org","name":"Org KEY"},{"@type":"Recipe","name":"NAME","author":{"@id":"#me"},"publisher":{"@id":"#org"},"ingredients":["SIZE eggs"],"recipeYield":["4 servings","6"],"image":{"@id":"#none"}},'
    '{"@type":"Person","@id":"#me","name":"Bea"},{"@type":"Person","@id":"#me","name":"Later"}]}</script>',
    '<script type="application/ld+json">{"@type":"WebPage","mainEntity":{"@type":"https://schema.org/Recipe","name":"1 < 2 NAME &lt;b&gt;x","recipeCategory":"Dinner, Supper","recipeCuisine":["Thai"],"totalTime":"P1DTSIZEM","nutrition":{"calories":"1"},"recipeInstructions":"<ol><li>One</li><li>Two</li></ol>"}}</script>',
    '<script type="application/ld+json">{"@type":"Recipe","name":</script><script type="application/ld+json"><!-- {"@type":"schema:Recipe","name":"NAME","recipeInstructions":{"@type":"ItemList","itemListElement":[{"@type":"HowToStep","text":" ","itemListElement":[{"text":"Fold"}]}]}} --></script>',
    '<script type="application/ld+json">{"@type":"recipe","name":"NAME"}</script><script type="application/ld+json">{"@type":"Article","about":{"@type":"Recipe","name":"NAME"}}</script>',
    '<div itemscope itemtype="https://schema.org/Recipe"><h2 itemprop="name">NAME &amp; more</h2><p itemprop="author" itemscope><b itemprop="name">Cy</b></p><meta itemprop="prepTime" content="PTSIZEM"><ul itemprop="recipeIngredient"><li>SIZE pears</li><li>tea</li></ul>'
    '<div itemscope><i itemprop="name">other</i></div><div itemprop="recipeInstructions">Wash.<br>Cut.</div><img itemprop="image" src="https://www.pics.com/m.png"></div><p itemprop="recipeIngredient">outside</p>',
    '<script type="application/ld+json">{"@graph":[{"@type":"Recipe","name":"NAME one"},[{"@type":"Recipe","name":"NAME two"}]],"mainEntity":{"@type":"Recipe","name":"NAME three"}}</script>',
)

META = '<!-- <meta property="og:title" content="no"> --><script>"<meta property=\'og:title\' content=\'nor this\'>"</script><meta content="NAME &gt; all" property="OG:Title"><meta name=\'og:site_name\' content=\'Site "KEY"\'/><meta name="twitter:image" content="https://www.pics.com/KEY.png?ref=a&amp;v=2">'


def built(spark, d, forms: tuple[str, ...]) -> DataFrame:
    """page_id, html: the form that its number asks for stands before the end of the head."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), "p_name", "p_size")
    made = F.element_at(F.array(*(F.lit(f) for f in forms)), (F.col("page_id") % len(forms) + 1).cast("int"))
    for mark, value in (("NAME", F.col("p_name")), ("KEY", F.col("page_id").cast("string")), ("SIZE", F.col("p_size").cast("string"))):
        made = F.replace(made, F.lit(mark), value)
    return table(spark, d, "pages").join(part, "page_id").select("page_id", F.replace(F.col("html"), F.lit("</head>"), F.concat(made, F.lit("</head>"))).alias("html"))


@query("""WITH x AS (SELECT page_id, page_id % 8 AS m, p_name AS n, CAST(p_size AS VARCHAR) AS s, p_size AS k FROM pages JOIN part ON page_id = p_partkey)
SELECT page_id, CAST(1 AS INTEGER) AS block, CAST(1 AS INTEGER) AS place, n || ' & rice' AS name, s || ' cups flour|½ tsp salt fine|named' AS ingredients, k AS servings, 60 + k AS prep, CAST(NULL AS INTEGER) AS cook, CAST(NULL AS INTEGER) AS total, 'Ada, Bo' AS author, NULL AS category, NULL AS cuisine,
  NULL AS site_name, 'Base: Mix it|Base: Bake it|Serve|Eat' AS steps, 'https://www.pics.com/large.jpg|https://www.pics.com/small.jpg' AS images, false AS has_nutrition FROM x WHERE m = 0
UNION ALL SELECT page_id, 1, 1, n, s || ' g rice|water', 4, NULL, 2, NULL, NULL, NULL, NULL, 'Pantry', '', 'https://www.pics.com/a.jpg?b=1', false FROM x WHERE m = 1
UNION ALL SELECT page_id, 1, 1, n, s || ' eggs', NULL, NULL, NULL, NULL, 'Bea', NULL, NULL, 'Org ' || page_id, '', '', false FROM x WHERE m = 2
UNION ALL SELECT page_id, 1, 1, '1 < 2 ' || n || ' x', '', NULL, NULL, NULL, 1440 + k, NULL, 'Dinner', 'Thai', NULL, 'One|Two', '', true FROM x WHERE m = 3
UNION ALL SELECT page_id, 2, 1, n, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Fold', '', false FROM x WHERE m = 4
UNION ALL SELECT page_id, 0, 1, n || ' & more', s || ' pears|tea', NULL, k, NULL, NULL, 'Cy', NULL, NULL, NULL, 'Wash.|Cut.', 'https://www.pics.com/m.png', false FROM x WHERE m = 6
UNION ALL SELECT page_id, 1, i, n || ' ' || ['one', 'two', 'three'][i], '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', '', false FROM x, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS i) WHERE m = 7""")
def a23_page_recipes(spark, d):
    """Every recipe of every page: blocks as lists, graphs, main entities, references, comments, two in a page, none, microdata where there is no block."""
    out = pages.candidates(built(spark, d, FORMS))
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(": ", s["section"], s["text"])), "|")
    return out.select("page_id", "block", "place", "name", F.array_join("ingredients", "|").alias("ingredients"), "servings", "prep", "cook", "total", "author", "category", "cuisine", "site_name", steps.alias("steps"), F.array_join("images", "|").alias("images"), "has_nutrition")


@query("""SELECT page_id, CAST(unnest(CASE page_id % 8 WHEN 4 THEN [1, 2] WHEN 5 THEN [1, 2] WHEN 6 THEN [] ELSE [1] END) AS INTEGER) AS block, unnest(CASE page_id % 8 WHEN 4 THEN ['not JSON', NULL] WHEN 5 THEN [NULL, NULL] WHEN 6 THEN [] ELSE [NULL] END) AS problem,
  unnest(CASE page_id % 8 WHEN 1 THEN [3] WHEN 2 THEN [5] WHEN 3 THEN [2] WHEN 4 THEN [0, 1] WHEN 5 THEN [1, 1] WHEN 6 THEN [] WHEN 7 THEN [4] ELSE [1] END)::BIGINT - (page_id % 8 = 1)::INT AS n_nodes FROM pages JOIN part ON page_id = p_partkey""")
def j01_page_blocks(spark, d):
    """The JSON-LD blocks of every page, why one is skipped, and how many objects a walk through lists, @graph and mainEntity finds in it."""
    found = pages.blocks(built(spark, d, FORMS))
    n = pages.nodes(found).groupBy("page_id", "block").agg(F.count("*").alias("n"))
    return found.join(n, ["page_id", "block"], "left").select("page_id", "block", "problem", F.coalesce("n", F.lit(0)).cast("long").alias("n_nodes"))


@query("""SELECT page_id, p_name || ' > all' AS title, 'Site "' || page_id || '"' AS site_name, 'https://www.pics.com/' || page_id || '.png?v=2' AS image FROM pages JOIN part ON page_id = p_partkey""")
def j03_page_meta(spark, d):
    """Title, site and image that every page gives of itself, outside comments and scripts."""
    return pages.page_meta(built(spark, d, (META,)))
