"""Pages, markup and links by hand."""

import json

from pyspark.sql import functions as F

from larderflow.functions import markup, text
from larderflow.sources import pages


def recipes(spark, html):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    return {(r["page_id"], r["block"], r["place"]): r for r in pages.candidates(df).collect()}


def block(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


def test_blocks_that_are_none(spark):
    deep = '{"@type":"Recipe","name":"d","x":' + "[" * 70 + "]" * 70 + "}"
    html = [None, "", "no page", block("{"), block(deep), block({"@type": "Recipe", "name": "x" * 9}) * 25, '<script type="application/json">{"@type":"Recipe"}</script>', block(json.dumps({"@type": "Recipe", "name": "y", "description": "z" * 600_000}))]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    problems = {(r["page_id"], r["block"]): r["problem"] for r in pages.blocks(df).collect()}
    assert problems[3, 1] == "not JSON" and problems[4, 1] == "nested too deep" and problems[7, 1] == "too long"
    assert [problems[5, i] for i in (1, 20, 21, 25)] == [None, None, "too many blocks", "too many blocks"] and not any(k[0] in (0, 1, 2, 6) for k in problems)
    assert pages.candidates(df.limit(0)).count() == 0


def test_a_script_in_a_script_is_text(spark):
    html = '<script>var s = "<script type=\\"application/ld+json\\">{}";</script>' + block({"@type": "Recipe", "name": "real"})
    assert [r["name"] for r in recipes(spark, [html]).values()] == ["real"]


def test_references_are_followed_once_and_only_to_data(spark):
    graph = [
        {"@type": "Recipe", "name": "r", "author": [{"@id": "#a"}, {"@id": "#b"}, {"@id": "#lost"}, {"name": "Own"}], "image": [{"@id": "#i"}, "https://www.pics.com/b.jpg", "javascript:x"]},
        {"@type": "Person", "@id": "#a", "name": "Ann"}, {"@type": "Thing", "@id": "#b", "name": "No person"}, {"@type": "ImageObject", "@id": "#i", "contentUrl": "https://www.pics.com/a.jpg"},
    ]
    (r,) = recipes(spark, [block({"@graph": graph})]).values()
    assert r["author"] == "Ann, Own" and r["images"] == ["https://www.pics.com/a.jpg", "https://www.pics.com/b.jpg"]


def test_microdata_ends_with_its_element(spark):
    html = '<DIV itemscope itemtype="http://schema.org/Recipe"><div><span itemprop="name">A &lt;b&gt; dish</span></div><div itemprop="recipeIngredient">1 egg</div><!-- <p itemprop="recipeIngredient">no</p> --><br itemprop="x"><p itemprop=recipeYield>4</p></DIV><p itemprop="recipeIngredient">out</p>'
    (r,) = recipes(spark, [html]).values()
    assert (r["name"], r["ingredients"], r["servings"], r["block"]) == ("A dish", ["1 egg"], 4, 0)
    assert pages.recipe_of_microdata("<p itemtype='http://schema.org/RecipeBook'>") is None
    assert pages.recipe_of_microdata('<div itemtype="https://schema.org/Recipe"' + " <" * 50_000) is None  # never closed: one scan


def test_plain_text_and_links(spark):
    cases = {"1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "a &copy b": "a &copy b", "&lt;script&gt;x&lt;/script&gt;y": "y", "<!-- c": None, "x" * 600: "x" * 500, "a\u202eb\u200b": "a b", "\u00a0 ": None, "&#x1F600;&#0;": "😀�", "a<style>p{}</style >b": "a b"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", markup.plain(F.col("t"))).collect()} == cases
    links = {"https://a.com/r#top": "https://a.com/r", "https://a.com/p q?x=%20a&utm_source=b": "https://a.com/p%20q?x=%20a", "http://WWW.A.com:80/": "http://www.a.com/", "https://a.com:8443/x/": "https://a.com:8443/x/"}
    got = {r["u"]: r["l"] for r in spark.createDataFrame([(k,) for k in links], "u string").select("u", text.link("u").alias("l")).collect()}
    assert {k: v["url"] for k, v in got.items()} == links and got["https://a.com:8443/x/"]["key"] == "a.com:8443/x"
