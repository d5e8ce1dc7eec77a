"""URL filters: allow and block rules, then multinomial naive Bayes over host and path words, host names being split by a unigram Viterbi."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import mapped

#: (verdict, rule): a rule holds for its host and all hosts below it, if the path starts with the rule's path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Labelled URLs to learn from: host names as they are registered, often several words written as one.
BLOCKED = """casinowin.com/slots free-bets.net/jackpot onlinecasino.com/bonus bestpokerbets.com/win winbigcasino.org/free betting-tips.net/odds cheappills.com/viagra
cheap-pills.net/order buypillsonline.com/discount pharmacypills.org/cheap adultdating.com/free adult-cams.net/live xxxadult.org/videos adultvideos.com/watch spamfarm.com/links
spam-links.net/farm linkfarm.org/spam ads-track.com/click adstracker.net/pixel trackingads.com/click clickads.org/banner freeprizewin.com/claim win-free-phone.net/prize
cheapwatches.org/replica replicabags.com/sale loansfast.com/cash paydayloans.net/cash hotgirls.com/adult freespins.net/casino luckyslots.com/spins popupads.net/track
cheapmeds.com/pills malwarefree.org/download crackedsoft.net/keygen torrentfree.com/warez escortsonline.com/adult gamblingwin.net/bets spamblast.org/mail""".split()
ALLOWED = """citynews.org/world dailynews.com/article schoolbooks.org/library university.edu/research sciencedaily.com/article cookingrecipes.org/dinner weatherreport.net/today
opensource.org/docs pythonguide.org/tutorial historymuseum.org/visit localgarden.com/plants travelguide.com/city musiclessons.org/piano healthadvice.org/family
childrensbooks.com/stories parkhistory.org/about governmentoffice.gov/services citycouncil.gov/meeting bankaccount.com/login bookstore.com/order mathlessons.org/algebra
languageschool.org/course photogallery.net/nature carrepair.com/guide homegarden.org/tools forumdiscussion.net/thread blogposts.com/writing worldatlas.org/maps
sportnews.net/football theatretickets.com/show filmreview.org/cinema artmuseum.org/paintings birdwatching.org/species foodmarket.com/fruit healthnews.org/story trainschedule.com/timetable""".split()
#: Words beside those of the labelled URLs and of the pages' texts that names are split into.
WORDS = """the and for with from about this that best free online home world news city daily open book books school guide game games shop store market music video videos photo health
food travel car house garden sport science history art film cinema map maps forum blog mail web page pages site link links farm spam ads track tracker tracking click casino
slot slots poker bet bets betting win winner bonus jackpot lucky cheap pills pill meds pharmacy adult dating cams live xxx prize claim loan loans cash payday replica sale spin spins
gambling discount order buy fast hot phone watch watches""".split()
#: Prior odds of "block".
PRIOR = 0.2
LONGEST = 24
#: A word of the pages' texts is one that names are split into if at least one in so many of their words is it: at most so many words are sent about.
RARE = 200_000


def parts_of(url: str | None) -> tuple[str, str]:
    """(host, path): the host follows the first `://`, up to `/`, `?`, `#` or the end, with A-Z in lower case; the path goes on to `?`, `#` or the
    end. Both are empty without a `://`."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(LOWER), m[2]


LOWER = {c: c + 32 for c in range(65, 91)}


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest fitting rule; rules by host."""
    best, at = (None, None), host
    while at:
        for start, rule, verdict in rules.get(at, ()):
            if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        at = at.partition(".")[2]
    return best


def rules_by_host(rules=RULES) -> dict[str, list[tuple[str, str, str]]]:
    out: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, verdict))
    return out


def split_words(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name: a known word costs -log of its share, any other run of letters `unknown` for each letter and once more."""
    n = len(name)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            c = cost.get(name[start:end])
            if c is None:
                c = unknown * (end - start + 1)
            if best[start] + c < best[end]:
                best[end], back[end] = best[start] + c, start
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


@dataclass
class Model:
    """Unigram costs and log odds per word: those of the labelled URLs and the word list, and at most RARE words of pages."""

    cost: dict[str, float]
    unknown: float
    odds: dict[str, float]
    prior: float
    known: dict[str, list[str]] = field(default_factory=dict)

    def words(self, host: str, path: str) -> list[str]:
        """Words of the host, without its last label, and of the path. Splits are kept for 100,000 names at most."""
        out = []
        for name in [*re.findall(r"[^\W\d_]+", host.rpartition(".")[0]), *re.findall(r"[^\W\d_]+", path.lower())]:
            if name not in self.known:
                if len(self.known) >= 100_000:
                    self.known.clear()
                self.known[name] = split_words(name, self.cost, self.unknown)
            out += self.known[name]
        return out

    def log_odds(self, host: str, path: str) -> float:
        """Of "block"; words never seen with a label say nothing."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in self.words(host, path))


def page_words(pages: DataFrame, rare: int = RARE) -> dict[str, float]:
    """The share of each word among the words of all pages' texts (html without its tags), of those with a share of at least 1 / rare: words of two to
    LONGEST letters a-z. Hosts are left out, since their names are what is to be split. Null html has no words."""
    text = F.regexp_replace(F.lower("html"), r"(?s)<[^>]*>", " ")
    words = pages.select(F.explode(F.filter(F.split(text, "[^a-z]+"), lambda w: F.length(w).between(2, LONGEST))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] / total for r in words.filter(F.col("n") >= -(-total // rare)).collect()}  # at most `rare` rows


def separate(url: F.Column) -> F.Column:
    """Words that a URL itself sets apart: those of its path, and those of host labels with hyphens."""
    bare = F.regexp_replace(F.lower(url), "^[^:]*://", "")
    host, path = F.substring_index(bare, "/", 1), F.regexp_replace(bare, "^[^/]*", "")
    hyphened = F.flatten(F.transform(F.filter(F.split(host, "[.]"), lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "[^a-z]+")))
    return F.filter(F.concat(F.split(path, "[^a-z]+"), hyphened), lambda w: F.length(w) > 1)


def train(labelled: DataFrame, words: list[str] = WORDS, prior: float = PRIOR, pages: DataFrame | None = None) -> Model:
    """From labelled URLs (url, blocked) and pages (html): a word's share is the mean of that among the words that labelled URLs set apart and the word
    list, and that among the words of the pages; then words are counted by class over the labelled URLs' split names."""
    spark = labelled.sparkSession
    rows = labelled.select("url", "blocked").filter("url is not null and blocked is not null")
    counts = dict.fromkeys(words, 1)
    for r in rows.select(F.explode(separate(F.col("url"))).alias("name")).groupBy("name").count().collect():  # as many as the labelled URLs have
        counts[r["name"]] = counts.get(r["name"], 0) + r["count"]
    total, seen = sum(counts.values()), page_words(pages) if pages is not None else {}
    known, found = (0.5, 0.5) if seen else (1.0, 0.0)
    counts = {w: known * counts.get(w, 0) / total + found * seen.get(w, 0.0) for w in counts.keys() | seen.keys()}
    model = Model({w: -math.log(c) for w, c in counts.items()}, 5.0, {}, math.log(prior / (1 - prior)))

    def split(batches):
        for batch in batches:
            urls, blocked = batch.column("url").to_pylist(), batch.column("blocked").to_pylist()
            pairs = [(w, bool(b)) for u, b in zip(urls, blocked, strict=True) for w in model.words(*u.lower().split("/", 1))]
            yield pa.record_batch([pa.array([w for w, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.bool_())], ["word", "blocked"])

    plain = rows.select(F.concat(F.regexp_replace("url", "^[^:]*://", ""), F.lit("/")).alias("url"), "blocked")
    table = plain.mapInArrow(split, "word string, blocked boolean").groupBy("word").agg(F.count_if("blocked").alias("bad"), F.count_if(~F.col("blocked")).alias("good")).collect()
    bad, good, n = sum(r["bad"] for r in table), sum(r["good"] for r in table), len(table)
    model.odds = {r["word"]: math.log((r["bad"] + 0.2) / (bad + 0.2 * n)) - math.log((r["good"] + 0.2) / (good + 0.2 * n)) for r in table}
    return model


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"https://{u}", True) for u in BLOCKED] + [(f"https://{u}", False) for u in ALLOWED], "url string, blocked boolean")


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's probability of "block" for every row of pages (page_id, url); other columns are ignored.
    An empty host has the prior's verdict."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def step(batch):
        m, by_host, out = held.value, rules_by_host(rules), []
        for url in batch.column("url").to_pylist():
            host, path = parts_of(url)
            rule, verdict = rule_for(host, path, by_host)
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, m.log_odds(host, path)))))
            out.append((host, path, rule, verdict or ("block" if p >= 0.5 else "allow"), p))
        columns = [pa.array([x[i] for x in out], pa.string()) for i in range(4)]
        return pa.record_batch([batch.column("page_id"), *columns, pa.array(np.array([x[4] for x in out]))], ["page_id", "host", "path", "rule", "verdict", "p_block"])

    return mapped(pages.select("page_id", "url"), step, "url", "page_id long, host string, path string, rule string, verdict string, p_block double")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of `pages`, a row for each row, repeated ones too. A null url, or one without `://`, has an empty host and path and the prior's verdict;
    an empty table gives an empty one; other columns are left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, train(labelled_urls(spark), pages=pages))
