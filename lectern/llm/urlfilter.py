"""URL filtering: fixed rules first, mined association rules for the rest.

Urls that a fixed rule judges are the labels.  The tokens that the fixed rules
themselves look at say nothing of other urls and are left out.  Spark's
FP-growth mines the token combinations that go with a verdict; rules below a
confidence, support or lift, or no surer than one of their parts, are pruned.
The rules left are indexed by token: a url's tokens look up the rules that hold
them, and a rule fires when all its tokens were found.

Tokens that stand in the very same labelled urls are one to the miner, and any
of them counts as it, so that a site's template of many tokens makes one
pattern and not all its subsets.

Cases: a null url, or one without ``://``, has empty host and path, no tokens,
and is allowed.  Repeated rows are judged each.  Without labels or rules, and
for an empty table, nothing is mined and all other urls are allowed.  Of rules
that fire the surest wins, then the longest, then the verdict's and tokens'
order.  Urls are read whole, however long.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side

#: (host, path, verdict); a rule is written host + path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 0.7, 1.1
#: Least labelled urls that hold a rule's tokens, for small tables.
MIN_COUNT = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, words of host labels, path words, names of query parameters; digits are one token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(host, r"[.\-_]"), lambda x: F.concat(F.lit("w:"), x))
    words = F.transform(F.split(F.lower(path), r"[/.\-_]+"), lambda x: F.concat(F.lit("p:"), F.when(x.rlike(r"^\d+$"), F.lit("#")).otherwise(x)))
    names = F.transform(F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("")), F.lit(r"(?:^|&)([^=&]+)"), 1), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.filter(F.concat(labels, parts, words, names), lambda x: F.length(x) > 2))


def rule_tokens(rules=RULES) -> list[str]:
    """The tokens of the fixed rules' own hosts and paths."""
    hosts = {x for h, _, _ in rules for x in h.split(".")}
    return sorted({f"{k}:{x}" for x in hosts for k in "hw"} | {f"p:{x}" for _, p, _ in rules for x in p.lower().split("/") if x})


def baskets_of(labelled: DataFrame, least: int, without: list[str]) -> tuple[DataFrame, DataFrame]:
    """(items), (token, name) of (page_id, tokens, verdict): items are names of tokens and the verdict.

    Tokens of fewer than ``least`` urls go; those in the same urls have one name, the first of them.
    """
    rows = labelled.withColumn("id", F.xxhash64("page_id", "tokens"))
    each = rows.select("id", F.explode("tokens").alias("token")).where(~F.col("token").isin(without))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("where")).where(F.col("n") >= least)
    first = seen.groupBy("n", "where").agg(F.min("token").alias("name"))
    names = materialize(seen.join(first, ["n", "where"]).select("token", "name"), "names")
    kept = each.join(names.where("token = name").select("token"), "token").groupBy("id").agg(F.collect_set("token").alias("kept"))
    met = rows.join(kept, "id", "left")
    return met.select(F.concat(F.coalesce("kept", F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "verdict"))).alias("items")), names


def mine(labelled: DataFrame, min_support: float, min_confidence: float, without: list[str] = rule_tokens(), min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """(rule_id, antecedent, verdict, confidence, support), (token, name): pruned rules over names of tokens, mined from (page_id, tokens, verdict)."""
    total = labelled.count()
    min_support = min(1.0, max(min_support, MIN_COUNT / max(total, 1)))
    baskets, names = baskets_of(labelled, max(1, int(min_support * total)), without)
    baskets = materialize(baskets, "baskets")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where("consequent[0] like '=%' and not exists(antecedent, x -> x like '=%')").where(F.col("lift") >= min_lift)
    found = materialize(found.select(F.array_sort("antecedent").alias("antecedent"), F.substr(F.col("consequent")[0], F.lit(2)).alias("verdict"), "confidence", "support"), "rules")
    parts = found.select(F.col("antecedent").alias("whole"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    # A rule is looked up by each of its parts that leave out one token.
    less = found.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("t")).where(F.size("antecedent") > 1)
    less = less.withColumn("part", F.array_remove("antecedent", F.col("t")))
    beaten = less.join(parts, (F.col("part") == F.col("whole")) & (F.col("verdict") == F.col("same")) & (F.col("sure") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    kept = found.join(beaten, ["antecedent", "verdict"], "left_anti")
    return kept.withColumn("rule_id", F.xxhash64("antecedent", "verdict")), names


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict; matched: the mined rule's tokens, confidence."""
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    mined, names = mine(rows.where("rule is not null"), min_support, min_confidence, rule_tokens(rules))
    mined = materialize(mined, "mined")
    index = mined.select(F.explode("antecedent").alias("name"), "rule_id", F.size("antecedent").alias("n"), F.col("verdict").alias("said"), "confidence", "antecedent")
    index = materialize(index.join(names, "name"), "index")
    # The rest is judged once for each set of tokens, found by its hash and the set itself.
    sets = rows.where("rule is null").select("tokens").distinct()
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(small_side(index, index.count(), 512), "token")
    fired = hits.groupBy("tokens", "rule_id", "n", "said", "confidence", "antecedent").agg(F.count_distinct("name").alias("found")).where("found = n")
    best = fired.groupBy("tokens").agg(F.max(F.struct("confidence", "n", "said", "antecedent")).alias("best"))
    done = rows.where("rule is not null").select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("matched"))
    rest = rows.where("rule is null").select("page_id", "host", "path", "rule", "tokens").join(best, "tokens", "left")
    rest = rest.select("page_id", "host", "path", "rule", F.coalesce("best.said", F.lit("allow")).alias("verdict"), F.col("best.confidence").alias("confidence"), F.col("best.antecedent").alias("matched"))
    return done.unionByName(rest)
