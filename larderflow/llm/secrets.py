"""Secret scans: candidates by pattern, judged by a random forest that labelled findings have trained. Everything on documents is a column expression:
candidates, their features and the forest's trees run inside one projection, without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm.common import REST, documents, materialised, opened, sealed

#: What candidates are made of. `=` is no part of it but for padding at the end: what stands before it is a name.
CLASS = r"[A-Za-z0-9_+/\-]"
PADDING = r"(?:={1,2}(?![A-Za-z0-9_+/=\-\"'`]))?+"
KEYWORDS = r"token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer"
#: A name with a keyword, and what may stand between it and its value.
NAMED = rf"(?i:{KEYWORDS})(?:[_-][A-Za-z0-9_-]{{0,16}})?"
#: A candidate: a whole run of these characters, of at least 16 with its padding, that has a digit; or a run of any length and kind that is assigned
#: to a name with a keyword, or follows "bearer". Each run is read once from its start.
LONG = rf"(?={CLASS}{{16}}|{CLASS}{{14,15}}=)[A-Za-z_+/\-]*+[0-9]{CLASS}*+"
#: The first condition is a cheap one that most words of a text fail.
ASSIGNED = rf"(?<=[:=]\s{{0,3}}[\"'`]?|(?i:arer)\s{{1,3}}[\"'`]?)(?<=(?:{NAMED}[\"'`]?\s{{0,3}}[:=]{{1,2}}\s{{0,3}}|(?i:bearer)\s{{1,3}})[\"'`]?){CLASS}++"
CANDIDATE = rf"(?<!{CLASS})(?:{LONG}|{ASSIGNED}){PADDING}"
#: Characters of the text before and after a candidate whose words are looked at.
BEFORE, AFTER = 48, 24
TREES, DEPTH = 24, 6
#: Labelled findings that the query's forest learns from.
LABELLED_ROWS = 6_000
MASK = "[secret]"

DICTIONARY = """the and for that with this from have not are was were will your you one all would there their what about which when make can like time just know take people into
year good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any these give day most
user name file data test code line list item page image color style class value index table order number string config server client local main master example sample version
update delete insert create table article story news report summer winter lorem ipsum dolor amet""".split()
PLAIN = r"commit|sha[_-]?(1|256|512)|md5|hash|digest|checksum|integrity|revision|etag|uuid|guid|order|invoice|isbn|phone|card|serial|build|base64"

#: name -> SQL over a candidate c (value, left, right, path).
FEATURES = {
    "length": "cast(length(c.value) as double)",
    "digits": "length(regexp_replace(c.value, '[^0-9]', '')) / length(c.value)",
    "upper": "length(regexp_replace(c.value, '[^A-Z]', '')) / length(c.value)",
    "lower": "length(regexp_replace(c.value, '[^a-z]', '')) / length(c.value)",
    "marks": "length(regexp_replace(c.value, '[A-Za-z0-9]', '')) / length(c.value)",
    "hex": "if(c.value rlike '^([0-9a-f]+|[0-9A-F]+)$', 1D, 0D)",
    "only_digits": "if(c.value rlike '^[0-9_+/=-]+$', 1D, 0D)",
    "uuid": "if(c.value rlike '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$', 1D, 0D)",
    "known_start": "if(c.value rlike '^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|eyJ|AIza|glpat-)', 1D, 0D)",
    "repeats": r"if(c.value rlike '(.)\\1{3}', 1D, 0D)",
    "different": "size(array_distinct(split(c.value, ''))) / length(c.value)",
    "class_changes": "regexp_count(c.value, '(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]') / length(c.value)",
    "vowel_changes": "regexp_count(lower(c.value), '(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]') / length(c.value)",
    "dictionary": f"1 - length(regexp_replace(lower(c.value), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / length(c.value)",
    "test_path": "if(lower(c.path) rlike 'test|spec|example|fixture|sample|mock|docs?/', 1D, 0D)",
    "lock_path": r"if(lower(c.path) rlike 'lock|\\.sum|package|vendor', 1D, 0D)",
    "key_before": f"if(c.left rlike '(?i){NAMED}[^A-Za-z0-9]{{0,8}}$', 1D, 0D)",
    "key_near": f"if(c.left rlike '(?i)({KEYWORDS})', 1D, 0D)",
    "plain_before": f"if(c.left rlike '(?i)({PLAIN})[^A-Za-z0-9]{{0,8}}$', 1D, 0D)",
    "assigned": r"if(c.left rlike '[:=]\\s*[\"\'`]?$', 1D, 0D)",
    "quoted": r"if(c.left rlike '[\"\'`]$' and c.right rlike '^[\"\'`]', 1D, 0D)",
    "in_url": r"if(c.left rlike '://\\S*$' or c.left rlike '/$', 1D, 0D)",
    "suffix": r"if(c.right rlike '^\\.[a-z]{2,4}', 1D, 0D)",
}


def with_candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """docs with _pieces (the text between candidates) and _candidates (value, left, right, path; left and right are the text's characters before and
    after the value, other candidates among them); a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    out = docs.withColumns({"_pieces": F.split(text, CANDIDATE, -1), "_values": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), "_path": where})
    # between two candidates is a character at least: so many of them and their pieces hold all that is looked at
    n, m = BEFORE // 2, AFTER // 2
    earlier = f"array_join(zip_with(slice(_pieces, greatest(i - {n}, 0) + 1, least(i, {n})), slice(_values, greatest(i - {n}, 0) + 1, least(i, {n})), (p, x) -> concat(right(p, {BEFORE}), right(x, {BEFORE}))), '')"
    later = f"array_join(zip_with(slice(_values, i + 2, {m}), slice(_pieces, i + 3, {m}), (x, p) -> concat(left(x, {AFTER}), left(p, {AFTER}))), '')"
    left = f"right(concat({earlier}, right(_pieces[i], {BEFORE})), {BEFORE})"
    right = f"left(concat(left(_pieces[i + 1], {AFTER}), {later}), {AFTER})"
    return out.withColumn("_candidates", F.expr(f"transform(_values, (v, i) -> struct(v as value, {left} as left, {right} as right, _path as path))")).drop("_values", "_path")


def feature_struct() -> str:
    return "named_struct(" + ", ".join(f"'{name}', cast({sql} as double)" for name, sql in FEATURES.items()) + ")"


def labelled_findings(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """Findings (value, left, right, path, secret) of the kinds that scans meet: the candidates of whole texts that are made from hashes of their
    numbers, with credentials where credentials stand, and digests, identifiers, numbers, names and placeholders that look like them. A user's own
    reviewed findings take their place."""
    texts = labelled_texts(spark, rows)
    found = with_candidates(texts, "path").select("credential", F.explode("_candidates").alias("c")).select("c.*", F.when(F.instr(F.col("credential"), F.col("c.value")) > 0, 1).otherwise(0).alias("secret"))
    return materialised(found, "labelled-findings")  # training reads them several times


def labelled_texts(spark: SparkSession, rows: int = LABELLED_ROWS) -> DataFrame:
    """text, path and credential (the part of the text that is secret, or null)."""
    r = spark.range(rows).withColumns({"h": F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 512), "k": F.pmod(F.xxhash64("id"), F.lit(31))})
    r = r.withColumns({"b64": F.regexp_replace(F.base64(F.unhex("h")), "\\s", ""), "n": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("int"), "u": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100))})
    word = F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(w) for w in DICTIONARY]), (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    lead = F.concat(word, F.lit(" "), other, F.lit(" "))
    key = F.element_at(F.array(*[F.lit(x) for x in ('token = "', "api_key=", 'password: "', "secret = '", "access_key: ", "auth_token=", "Authorization: Bearer ")]), F.col("n") + 1)
    plain = F.element_at(F.array(*[F.lit(x) for x in ("commit ", "sha1: ", "md5 ", "checksum=", 'integrity="', "revision ", "etag: ")]), F.col("n") + 1)
    digits = F.regexp_replace(F.translate("h", "abcdef", "123456"), "[^0-9]", "")
    line = F.element_at(F.array(*[F.lit(x) for x in ("password: ", 'token = "', "secret: ", "auth=", 'passwd = "', "api_key: ", 'password = "')]), F.col("n") + 1)
    setting = F.element_at(F.array(*[F.lit(x) for x in ("AWS_SECRET_ACCESS_KEY=", "DB_PASSWORD=", "api_key_prod_2024=", "GITHUB_TOKEN=", "client_secret_2023_v10=", "API_KEY: ", "auth-token-live-01: ")]), F.col("n") + 1)
    letters = F.translate("b64", "0123456789+/=", "qzxkvbnwjyfgh")
    # written: the kinds below name these parts many times, and would each be compiled with all of them in place
    parts = {"word": word, "other": other, "lead": lead, "key": key, "plain": plain, "digits": digits, "line": line, "setting": setting, "letters": letters}
    r = materialised(r.select("id", "h", "k", "b64", "n", "u", *(c.alias(name) for name, c in parts.items())), "labelled-parts")
    word, other, lead, key, plain, digits, line, setting, letters = (F.col(name) for name in parts)
    kinds = [  # value, left, secret
        (F.substring("h", 1, 40), F.concat(lead, key), 1),
        (F.upper(F.substring("h", 1, 40)), F.concat(lead, F.upper(key)), 1),
        (F.substring("h", 1, 32), F.concat(lead, key), 1),
        (F.substring("h", 1, 64), F.concat(lead, key), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring("h", 1, 16))), F.concat(lead, F.lit("aws_access_key_id=")), 1),
        (F.concat(F.lit("ghp_"), F.regexp_replace(F.substring("b64", 1, 40), "[+/=]", "9")), lead, 1),
        (F.substring("b64", 1, 44), F.concat(lead, key), 1),
        (F.concat(F.lit("sk-"), F.regexp_replace(F.substring("b64", 5, 40), "[+/=]", "x7")), F.concat(lead, key), 1),
        (F.concat(F.lit("eyJ"), F.regexp_replace("b64", "[+/=]", "_")), F.concat(lead, F.lit("bearer ")), 1),
        (F.regexp_replace(F.substring("b64", 1, 20), "[+/=]", "4"), F.concat(lead, key), 1),
        (F.substring("h", 1, 40), F.concat(lead, plain), 0),
        (F.substring("h", 1, 64), F.concat(lead, plain), 0),
        (F.substring("h", 1, 32), F.concat(lead, plain), 0),
        (F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), F.concat(lead, F.lit("id=")), 0),
        (F.substring(digits, 1, 18), lead, 0),
        (F.concat(word, other, F.lit("2"), word, other, F.lit("0")), lead, 0),
        (F.concat_ws("-", word, other, F.substring(digits, 1, 4), word, other), F.concat(lead, F.lit("https://site.example/")), 0),
        (F.concat(F.lit("your_"), word, F.lit("_key_123456")), F.concat(lead, key), 0),
        (F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.substring(digits, 1, 3)), F.concat(lead, key), 0),
        (F.concat(F.substring("b64", 1, 60)), F.concat(lead, F.lit("data:image/png;base64,")), 0),
        (F.substring("b64", 1, 40), F.concat(lead, setting), 1),
        (F.substring("h", 1, 40), F.concat(lead, setting), 1),
        (F.concat_ws(".", F.concat(F.lit("eyJ"), F.regexp_replace(F.substring("b64", 1, 33), "[+/=]", "_")), F.concat(F.lit("eyJ"), F.regexp_replace(F.substring("b64", 20, 50), "[+/=]", "-")), F.regexp_replace(F.substring("b64", 9, 43), "[+/=]", "_")), F.concat(lead, F.when(F.col("n") < 4, "Authorization: Bearer ").otherwise(setting)), 1),
        (F.substring(letters, 1, 24), F.concat(lead, line), 1),
        (F.substring(letters, 3, 10), F.concat(lead, line), 1),
        (F.lower(F.substring(letters, 13, 12)), F.concat(lead, line), 1),
        (F.concat(word, F.substring(digits, 1, 3), F.substring(letters, 5, 5)), F.concat(lead, line), 1),
        (F.concat(word, F.lit(" "), other), F.concat(lead, line), 0),
        (F.concat_ws("_", word, other), F.concat(lead, line), 0),
        (F.element_at(F.array(*[F.lit(x) for x in ("None", "null", "true", "false", "required", "os", "process")]), F.col("n") + 1), F.concat(lead, line), 0),
        (F.substring("h", 1, 40), F.concat(lead, F.lit("GIT_COMMIT=")), 0),
    ]
    pick = lambda i: F.coalesce(*[F.when(F.col("k") == k, F.lit(x[i]) if i == 2 else x[i]) for k, x in enumerate(kinds)])
    path = F.when(F.col("u") < 5, F.lit("src/tests/fixtures.py")).when(F.col("u") < 10, F.concat(F.lit("web/"), word, F.lit(".lock"))).when(F.col("u") < 40, F.concat(F.lit("src"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("app/"), word, F.lit(".py")))
    # some findings stand in running text whose marks and case have been changed
    left = F.when(F.col("u") % 10 == 3, F.upper(pick(1))).otherwise(pick(1))
    right = F.when(F.col("u") % 3 == 0, '" end').when(F.col("u") % 3 == 1, F.lit(" and more")).otherwise(F.lit('"&&& end'))
    return r.select(F.concat(left, pick(0), right).alias("text"), path.alias("path"), F.when(pick(2) == 1, pick(0)).alias("credential"))


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> str:
    """A random forest from findings (value, left, right, path, secret), as a SQL expression over a struct f of FEATURES: the share of trees that vote
    "secret". The arrays in it are bounded by trees and depth. With one class only, it is that class."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.filter("value is not null and secret is not null").selectExpr("struct(value, coalesce(left, '') as left, coalesce(right, '') as right, coalesce(path, '') as path) as c", "cast(secret as double) as label")
    rows = rows.selectExpr("label", f"{feature_struct()} as f").select("label", "f.*")
    classes = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(classes) < 2:
        return str(classes[0] if classes else 0.0) + "D"
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(data)
    return forest_sql(model.toDebugString, list(FEATURES), depth)


def forest_nodes(printed: str) -> tuple[list[int], list[tuple[int, float, int, int, float]]]:
    """(roots, nodes) of a printed forest; a node is (feature, threshold, yes, no, vote), a leaf has the feature -1. yes and no: the next node."""
    lines = [x.strip() for x in printed.splitlines()]
    roots: list[int] = []
    nodes: list[tuple[int, float, int, int, float]] = []
    at = 0

    def node() -> int:
        nonlocal at
        here = len(nodes)
        nodes.append((-1, 0.0, here, here, 0.0))
        if m := re.match(r"Predict: (\S+)", lines[at]):
            at += 1
            nodes[here] = (-1, 0.0, here, here, float(m[1]))
            return here
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at])
        at += 1
        yes = node()
        at += 1  # its Else
        nodes[here] = (int(m[1]), float(m[2]), yes, node(), 0.0)
        return here

    while at < len(lines):
        at += 1
        if lines[at - 1].startswith("Tree "):
            roots.append(node())
    return roots, nodes


def forest_sql(printed: str, names: list[str], depth: int = DEPTH) -> str:
    """A printed forest as a SQL expression over a struct f: its nodes are constant arrays, and each tree is walked from its root, `depth` steps down. The
    expression's size doesn't grow with the trees, so code is generated for it whatever the forest."""
    roots, nodes = forest_nodes(printed)

    def constant(values, kind: str) -> str:
        return f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)"

    feature, threshold, yes, no, vote = (constant([n[i] for n in nodes], kind) for i, kind in enumerate(("int", "double", "int", "int", "double")))
    step = f"if({feature}[n] < 0, n, if(x[greatest({feature}[n], 0)] <= {threshold}[n], {yes}[n], {no}[n]))"
    walk = f"aggregate(sequence(1, {depth}), r, (n, i) -> {step})"
    votes = f"aggregate({constant(roots, 'int')}, 0D, (s, r) -> s + {vote}[{walk}]) / {len(roots)}D"
    return f"transform(array(array({', '.join(f'f.{x}' for x in names)})), x -> {votes})[0]"


def scanned(docs: DataFrame, forest: str, path: str = "source") -> DataFrame:
    """docs with _pieces, _candidates and _scores (of each candidate, from 0 to 1)."""
    out = with_candidates(docs, path).withColumn("_features", F.expr(f"transform(_candidates, c -> {feature_struct()})"))
    return out.withColumn("_scores", F.expr(f"transform(_features, f -> {forest})")).drop("_features")


def findings(docs: DataFrame, forest: str, path: str = "source") -> DataFrame:
    """doc_id, start (0-based, code points), length, score, secret (score >= 0.5) and a digest of each candidate of docs (doc_id, text, path).

    Rows without candidates, null and empty texts have no findings; repeated rows have theirs each; other columns are ignored."""
    kept = docs.select("doc_id", "text", (F.col(f"`{path}`").cast("string") if path in docs.columns else F.lit(None).cast("string")).alias("path"))
    rows = scanned(kept, forest, "path").filter("size(_candidates) > 0")
    # running sums of the lengths, candidate by candidate: no row leaves its task
    ends = "aggregate(zip_with(_pieces, _candidates, (p, c) -> struct(length(p) as gap, length(c.value) as length)), cast(array() as array<bigint>), (a, x) -> array_append(a, coalesce(try_element_at(a, -1), 0L) + x.gap + coalesce(x.length, 0)))"
    rows = rows.withColumn("_ends", F.expr(ends))
    found = rows.select("doc_id", F.explode(F.expr("transform(_candidates, (c, i) -> struct(_ends[i] - length(c.value) as start, length(c.value) as length, sha2(c.value, 256) as value_sha256, _scores[i] as score))")).alias("c"))
    return found.select("doc_id", F.col("c.start").alias("start"), F.col("c.length").cast("long").alias("length"), F.col("c.score").alias("score"), (F.col("c.score") >= 0.5).alias("secret"), F.col("c.value_sha256").alias("value_sha256"))


def redacted(docs: DataFrame, forest: str, path: str = "source") -> DataFrame:
    """docs with the candidates that the forest calls secrets replaced by MASK; null texts stay null, empty ones empty, repeated rows stay repeated.
    Other columns are handed on unchanged, whatever their names; `path`, if it is one of them, tells the forest where a text is from."""
    columns = docs.columns
    held = sealed(docs, ("text",))
    where = F.col(REST).getField(path).cast("string") if path in columns else F.lit(None).cast("string")
    out = scanned(held.withColumn("path", where), forest, "path")
    out = out.withColumn("_masks", F.expr(f"zip_with(_candidates, _scores, (c, s) -> if(s >= 0.5, '{MASK}', c.value))"))
    joined = F.array_join(F.zip_with("_pieces", "_masks", lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(m, F.lit("")))), "")
    return out.withColumn("text", F.when(F.size("_candidates") > 0, joined).otherwise(F.col("text"))).select(*opened(columns, ("text",)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """findings() of `documents`: one row for each candidate of each row; rows without one, among them null and empty texts, have none, repeated rows
    have theirs each; a null doc_id stays null; other columns are left out, `source` is the path."""
    return findings(documents(spark, sf_dir), train_forest(labelled_findings(spark)))
