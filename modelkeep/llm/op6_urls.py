"""URL filters: host rules, then a tree of path templates.

A rule names a host and the beginning of a path; it fits that host and its
subdomains, and the longest rule that fits decides.  The urls a rule decides
label the rest.  The paths of a host, of any depth, fall into a tree of
templates: a segment that varies (numbers, long hexadecimal strings, segments
that are rare among their siblings) becomes ``*``, and ``html``-like endings
are cut off.  Siblings whose labelled rates agree by a chi-square test of
homogeneity are merged into one branch, and so are the paths below them.  The
evidence of a branch shrinks towards its template over all hosts of the parent
domain, that towards the template over all hosts, and that towards its parent
template.  A template is rejected where the smoothed share of blocked urls
passes a threshold.

All of it is grouped aggregation and joins on the grouped tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelkeep.llm.common import fresh, settle, staged

#: (verdict, host, path) in the order they were given.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Upper 5 % point of the normal distribution: siblings whose rates differ by more aren't merged.
DIFFERS = 1.6449

#: A segment with less than this share of its siblings' urls is a variable.
LEAST_SHARE = 0.01

#: Urls that a template's parent counts for.
PRIOR = 4.0

THRESHOLD = 0.5


def _text(url: Column) -> Column:
    return F.coalesce(url.cast("string"), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", _text(url))
    return F.when(at > 0, F.substring(_text(url), at + 3, F.length(_text(url)))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    # The shortest is tried last, so the longest that fits comes first; among equals the first given.
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _generalised(segment: Column) -> Column:
    bare = F.regexp_replace(segment, r"\.[A-Za-z0-9]{1,5}$", "")
    variable = bare.rlike(r"^[0-9]+$") | bare.rlike(r"^[0-9a-fA-F-]{16,}$") | bare.rlike(r"[0-9]{3,}")
    return F.when(variable, "*").when(bare == "", segment).otherwise(bare)


def merged(siblings: DataFrame) -> DataFrame:
    """``siblings`` (host, node, name, bad, m: blocked and labelled urls of a
    branch below ``node``) with ``branch``: the smallest name among the branches
    it is merged with.

    The siblings of a node are one branch unless a chi-square test of
    homogeneity rejects that; then those above and below the common rate are
    tested on their own, and so on.  Equal rates are never parted.  A branch
    without labels has no rate and stays alone.
    """
    rates = siblings.where("m > 0").groupBy("host", "node", "bad", "m").agg(F.count("*").alias("k"), F.min("name").alias("least"))
    rates = staged(rates.withColumn("part", F.lit("")), "rates")
    part_of = lambda df, *more: df.select(F.concat("host", F.lit("")).alias("h"), F.concat("node", F.lit("")).alias("o"), F.concat("part", F.lit("")).alias("t"), *more)
    same_part = (F.col("host") == F.col("h")) & (F.col("node") == F.col("o")) & (F.col("part") == F.col("t"))
    while True:
        groups = rates.groupBy("host", "node", "part").agg(
            F.sum(F.col("k") * F.col("bad")).alias("b"), F.sum(F.col("k") * F.col("m")).alias("n"), F.sum("k").alias("branches"),
            F.sum(F.col("k") * F.col("bad") * F.col("bad") / F.col("m")).alias("squares")).withColumn("p", F.col("b") / F.col("n"))
        free = F.greatest(F.col("branches") - 1, F.lit(1)).cast("double")
        # Wilson and Hilferty's approximation of the chi-square quantile.
        limit = free * F.pow(1 - 2 / (9 * free) + DIFFERS * F.sqrt(2 / (9 * free)), 3)
        differ = groups.where((F.col("branches") > 1) & (F.col("squares") - F.col("b") * F.col("p") > limit * F.col("p") * (1 - F.col("p"))) & (F.col("b") > 0) & (F.col("b") < F.col("n")))
        differ = staged(part_of(differ, "b", "n"), "differ")
        if differ.isEmpty():
            break
        # Whole numbers: rounded rates could part branches of equal rates.
        side = F.when(F.col("n").isNull(), "").when(F.col("bad") * F.col("n") > F.col("b") * F.col("m"), "1").otherwise("0")
        rates = staged(rates.join(differ, same_part, "left").select("host", "node", "bad", "m", "k", "least", F.concat("part", side).alias("part")), "rates")
    named = part_of(rates.groupBy("host", "node", "part").agg(F.min("least").alias("branch")), "branch")
    named = rates.join(named, same_part).select(*[F.col(c).alias(f"r_{c}") for c in ("host", "node", "bad", "m")], "branch")
    of = [F.col(c) == F.col(f"r_{c}") for c in ("host", "node", "bad", "m")]
    return siblings.join(staged(named, "branches"), of, "left").select("host", "node", "name", F.coalesce("branch", "name").alias("branch"))


def templates(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, verdict, ...) with domain, template (an array of
    segments, variable ones as *) and branch (what the template is merged to).

    Each round takes all segments that the paths below a node have in common,
    then one at which they part, so a round is a fork and not a depth.
    """
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _generalised)
    known = staged(urls.withColumn("key", F.array_join(segments, "/")).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)), "urls")
    paths = known.groupBy("host", "key").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"), F.count_if(F.col("verdict").isNotNull()).alias("m"))
    going = staged(paths.select("*", F.lit("").alias("node"), F.array().cast("array<string>").alias("template"), F.filter(F.split("key", "/"), lambda s: s != "").alias("rest")), "paths")
    at = lambda df, *more: df.select(F.concat("host", F.lit("")).alias("h"), F.concat("node", F.lit("")).alias("o"), *more)
    below = (F.col("host") == F.col("h")) & (F.col("node") == F.col("o"))
    ended = []
    while True:
        ends = at(going.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")), "lo", "hi")
        parts = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
        shared = F.when(parts == 0, F.size("lo")).otherwise(parts - 1).cast("int")
        common = F.slice("rest", F.lit(1), F.col("shared"))
        going = staged(going.join(ends, below).withColumn("shared", shared).select(
            "host", "key", "n", "bad", "m", F.concat("node", F.array_join(F.transform(common, lambda s: F.concat(F.lit("/"), s)), "")).alias("node"),
            F.concat("template", common).alias("template"), F.slice("rest", F.col("shared") + 1, F.size("rest")).alias("rest")), "paths")
        ended.append(going.where(F.size("rest") == 0).select("host", "key", "template", "node"))
        going = going.where(F.size("rest") > 0)
        if going.isEmpty():
            break
        going = going.withColumn("own", F.get("rest", F.lit(0)))
        here = staged(going.groupBy("host", "node", "own").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "m")]), "segments")
        total = at(here.groupBy("host", "node").agg(F.sum("n").alias("all")), "all")
        rare = (F.col("own") != "*") & (F.col("n") < LEAST_SHARE * F.col("all"))
        here = staged(here.join(total, below).select("host", "node", "own", F.when(rare, "*").otherwise(F.col("own")).alias("name"), "bad", "m"), "siblings")
        branch = merged(here.groupBy("host", "node", "name").agg(F.sum("bad").alias("bad"), F.sum("m").alias("m")))
        branch = at(branch, F.concat("name", F.lit("")).alias("of_name"), "branch")
        step = here.join(branch, below & (F.col("name") == F.col("of_name"))).select("h", "o", F.col("own").alias("of_own"), "name", "branch")
        going = staged(going.join(staged(step, "steps"), below & (F.col("own") == F.col("of_own"))).select(
            "host", "key", "n", "bad", "m", F.concat_ws("/", "node", "branch").alias("node"), F.concat("template", F.array("name")).alias("template"),
            F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "paths")
    of = ended[0]
    for more in ended[1:]:
        of = of.unionByName(more)
    of = staged(of.select(F.col("host").alias("h"), F.col("key").alias("of_key"), "template", F.col("node").alias("branch")), "templates")
    return known.join(of, (F.col("host") == F.col("h")) & (F.col("key") == F.col("of_key"))).drop("h", "key", "of_key")


def purity(known: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``known`` (host, domain, template, branch, verdict) with ``blocked``:
    the smoothed share of blocked urls at its branch.

    From the tree's root down: a template over all hosts shrinks towards its
    parent, the same template in a domain towards that, and in a host the
    branch it is merged to towards its domain's.
    """
    counts = staged(known.groupBy("host", "domain", "template", "branch").agg(
        F.count_if(F.col("verdict") == "block").alias("bad"), F.count_if(F.col("verdict").isNotNull()).alias("n")), "counts")
    bad, n = counts.agg(F.sum("bad"), F.sum("n")).first()
    root = ((bad or 0) + 1.0) / ((n or 0) + 2.0)
    smooth = lambda b, m, p: (F.coalesce(b, F.lit(0)) + prior * p) / (F.coalesce(m, F.lit(0)) + prior)
    nodes = counts.select(F.explode(F.sequence(F.lit(0), F.size("template"))).alias("depth"), "template", "bad", "n").select(
        F.slice("template", F.lit(1), F.col("depth")).alias("node"), "bad", "n").groupBy("node").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    nodes = staged(nodes, "nodes")
    chain = counts.where(F.size("template") > 0).select(F.col("template").alias("template_of")).distinct().withColumn(
        "depth", F.explode(F.sequence(F.lit(1), F.size("template_of")))).withColumn("above", F.slice("template_of", F.lit(1), F.col("depth")))
    chain = chain.join(nodes, F.col("above") == F.col("node")).groupBy("template_of").agg(F.array_sort(F.collect_list(F.struct("depth", "bad", "n"))).alias("chain"))
    tree = chain.select("template_of", F.aggregate("chain", F.lit(root), lambda p, x: smooth(x["bad"], x["n"], p)).alias("p"))
    tree = tree.unionByName(counts.where(F.size("template") == 0).select(F.col("template").alias("template_of")).distinct().withColumn("p", F.lit(root)))
    in_domain = counts.groupBy("domain", "template").agg(F.sum("bad").alias("b"), F.sum("n").alias("m"))
    in_domain = in_domain.join(tree, F.col("template") == F.col("template_of")).select(
        F.col("domain").alias("d"), F.col("template").alias("t"), smooth(F.col("b"), F.col("m"), F.col("p")).alias("q"))
    branches = counts.groupBy("host", "branch").agg(F.sum("bad").alias("branch_bad"), F.sum("n").alias("branch_n"))
    branches = branches.select(F.concat("host", F.lit("")).alias("h"), F.concat("branch", F.lit("")).alias("w"), "branch_bad", "branch_n")
    judged = counts.join(in_domain, (F.col("domain") == F.col("d")) & (F.col("template") == F.col("t"))).join(branches, (F.col("host") == F.col("h")) & (F.col("branch") == F.col("w")))
    judged = staged(judged.select(F.col("host").alias("host_of"), F.col("template").alias("template_of"), smooth(F.col("branch_bad"), F.col("branch_n"), F.col("q")).alias("blocked")), "judged")
    return known.join(judged, (F.col("host") == F.col("host_of")) & (F.col("template") == F.col("template_of"))).drop("host_of", "template_of")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict,
    template (joined by /) and blocked, the smoothed share of blocked urls there.

    Urls without :// (and null) have empty host and path, fit no rule, and
    are judged as one template.  Ids may be null or repeated; an empty table
    gives no rows.
    """
    settle(pages.sparkSession)
    url = F.col(f"`{url_col}`")
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "found.rule", "found.verdict")
    known = purity(templates(own))
    verdict = F.coalesce("verdict", F.when(F.col("blocked") > threshold, "block").otherwise("allow"))
    return known.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "blocked")


def allowed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """The rows of ``pages`` whose url isn't blocked (a repeated id goes if any of its urls is)."""
    key = fresh(pages, "blocked_id")
    bad = judge(pages, id_col, url_col, **options).where("verdict = 'block'").select(F.col("page_id").alias(key)).distinct()
    return pages.join(bad, F.col(f"`{id_col}`").cast("long") == F.col(key), "left_anti")


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """Every page's url, its rule and the verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "template", "blocked")
