"""URL filter: host and path rules first, then a path-template tree for each host.

A node is a host and a template of the first segments of its paths. It is followed level by level where it branches, and at
once along what all paths below a template share, so rounds are bounded by branching, not by depth. Segments that look like
numbers or long hex strings become wildcards by their shape. A branch with its own literal stays only while it differs
from its siblings under the same node: siblings whose labelled rates and whose next segments' shapes agree within
sampling error merge into one wildcard; how many siblings there are plays no part. The labels are the rules' verdicts on
the URLs they cover. A template's purity is its labelled share of blocks, smoothed towards its parent's. The root's is
smoothed towards PRIOR. A literal that stayed apart differs from its siblings, so its parent alone says little: it is
smoothed towards a mean of its parent's purity, that of the same template on other hosts, and PRIOR, which counts twice.
So URLs without a label of their own are blocked only where both the host and the template are bad elsewhere. Templates
at or above REJECT block the URLs without a rule. Only counts per node are shuffled, added up before the exchange, so a
host with a third of all pages is a few rows a task, and joins are salted where a node has most of the branches.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinweave.llm._common import lookup_join, materialise, private

#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
STRENGTH, PRIOR, REJECT = 4.0, 0.2, 0.5
#: Standard errors within which two rates agree.
Z = 2.0
SHAPES = ("end", "number", "hex", "word")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule_text(host: str, path: str) -> str:
    return f"{host}{path}"


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    found = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: len(rule_text(*r[:2]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, rule_text(rule_host, rule_path)).otherwise(found)
        verdict = F.when(fits, says).otherwise(verdict)
    return found, verdict


def _shape(segment: Column) -> Column:
    """A wildcard for a variable segment, else the segment itself, escaped where it looks like a wildcard."""
    name = F.regexp_replace(segment, r"\.[A-Za-z0-9]{1,5}$", "")
    literal = F.replace(F.replace(segment, F.lit("*"), F.lit("%2A")), F.lit("{"), F.lit("%7B"))
    return F.when(name.rlike("^[0-9]+$"), "{number}").when(name.rlike("^[0-9a-fA-F-]{8,}$") & name.rlike("[0-9]"), "{hex}").otherwise(literal)


def _shape_no(shape: Column) -> Column:
    return F.when(shape == "", 0).when(shape == "{number}", 1).when(shape == "{hex}", 2).otherwise(3)


def _smoothed(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + STRENGTH * prior) / (labelled + STRENGTH)


def path_templates(pages: DataFrame) -> DataFrame:
    """``pages`` has host, path, label (1 block, 0 allow, null). Adds template and purity; other columns stay."""
    (seg,) = private(pages, "_seg")
    host = F.coalesce("host", F.lit(""))
    segments = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda s: s != "")
    rows = pages.withColumn(seg, F.concat_ws("/", F.transform(segments, _shape)))
    paths = rows.groupBy(host.alias("host"), F.col(seg).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("blk"))
    paths = materialise(paths, "url-paths")
    root = paths.groupBy("host").agg(_smoothed(F.sum("blk"), F.sum("lab"), F.lit(PRIOR)).alias("up"), F.count(F.lit(1)).alias("of"))
    # node is the template so far, rest what follows it; paths without a rest end at it.
    nodes = lookup_join(paths, materialise(root, "url-hosts"), "host", "of", "path").drop("of")
    nodes = materialise(nodes.withColumn("node", F.lit("")).withColumn("rest", F.col("path")), "url-nodes")
    done = []
    for step in itertools.cycle((_jump, _descend)):
        done.append(nodes.where("rest = ''").select("host", "path", F.col("node").alias("template"), F.col("up").alias("purity")))
        nodes = nodes.where("rest <> ''")
        if nodes.isEmpty():
            break
        nodes = step(nodes)
    templates = done[0]
    for more in done[1:]:
        templates = templates.unionByName(more)
    of = paths.select(F.concat("host", F.lit("\n"), "path").alias("_key"), "n")
    templates = templates.select(F.concat("host", F.lit("\n"), "path").alias("_key"), "template", "purity").join(of, "_key")
    templates = materialise(templates.select("_key", "template", "purity", "n"), "url-templates")
    (key,) = private(rows, "_key")
    keyed = rows.withColumn(key, F.concat(host, F.lit("\n"), seg)).drop(seg)
    uid, n, template, purity = private(keyed, "_uid", "_n", "template", "purity")
    joined = lookup_join(keyed.withColumn(uid, F.monotonically_increasing_id()), templates.toDF(key, template, purity, n), key, n, uid)
    return joined.drop(key, uid, n)


def _behind(rest: Column, first: Column) -> Column:
    """What follows the first segments of a rest."""
    return F.substring(rest, F.length(first) + 2, F.length(rest))


def _jump(nodes: DataFrame) -> DataFrame:
    """Nodes moved down along the segments that everything below their template shares, on all hosts that have it.

    Such a run doesn't branch: each node on it has one branch, which stays what it is, and the same labels as the node above,
    so its purity follows from that above at once. What is left to descend by levels is only where a template branches.
    """
    keyed = nodes.withColumn("key", F.concat("host", F.lit("\n"), "node"))
    end = F.concat("rest", F.lit("/"))
    own = keyed.groupBy("key", "node").agg(F.first("up").alias("up"), F.sum("lab").alias("lab"), F.sum("blk").alias("blk"), F.count(F.lit(1)).alias("paths"), F.min(end).alias("low"), F.max(end).alias("high"))
    own = materialise(own, "url-runs")
    every = own.groupBy("node").agg(F.sum("lab").alias("all_lab"), F.sum("blk").alias("all_blk"), F.count(F.lit(1)).alias("of"), F.min("low").alias("low"), F.max("high").alias("high"))
    # The least and the greatest rest share as many whole segments as all rests do.
    low, high = F.split("low", "/"), F.split("high", "/")
    most = F.least(F.size(low), F.size(high)) - 1
    differ = F.array_position(F.zip_with(F.slice(low, F.lit(1), most), F.slice(high, F.lit(1), most), lambda x, y: x == y), False)
    every = every.select("node", "all_lab", "all_blk", "of", F.slice(low, F.lit(1), F.when(differ == 0, most).otherwise(differ - 1).cast("int")).alias("run")).where(F.size("run") > 1)
    every = materialise(every.withColumn("shared", F.array_join("run", "/")), "url-shared-runs")
    if every.isEmpty():
        return nodes
    runs = lookup_join(own.drop("low", "high"), every, "node", "of", "key")
    elsewhere = _smoothed(F.col("all_blk") - F.col("blk"), F.col("all_lab") - F.col("lab"), F.lit(PRIOR))

    def one(up: Column, segment: Column) -> Column:
        prior = F.when(segment.startswith("{"), up).otherwise((up + elsewhere + 2 * PRIOR) / 4)
        return _smoothed(F.col("blk"), F.col("lab"), prior)

    runs = materialise(runs.select("key", "paths", "shared", F.aggregate("run", F.col("up"), one).alias("moved")), "url-moves")
    at = runs.select("key")
    still = keyed.join(at, "key", "left_anti").drop("key")
    gone = lookup_join(keyed, runs, "key", "paths", "path")
    gone = gone.select("host", "path", "n", "lab", "blk", F.col("moved").alias("up"), F.concat("node", F.lit("/"), "shared").alias("node"), _behind(F.col("rest"), F.col("shared")).alias("rest"))
    return materialise(still.select(gone.columns).unionByName(gone), "url-nodes")


def _descend(nodes: DataFrame) -> DataFrame:
    """The nodes one level down: node, up and rest of each path."""
    branch = F.substring_index("rest", "/", 1)
    after = _shape_no(F.substring_index(_behind(F.col("rest"), branch), "/", 1))
    nodes = nodes.withColumn("branch", branch).withColumn("key", F.concat("host", F.lit("\n"), "node"))
    sums = [F.sum(F.when(after == i, F.col("n")).otherwise(0)).alias(f"s{i}") for i in range(len(SHAPES))]
    branches = nodes.groupBy("key", "node", "branch").agg(F.first("up").alias("up"), F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("blk").alias("blk"), F.count(F.lit(1)).alias("paths"), *sums)
    literal = ~F.col("branch").startswith("{")
    branches = materialise(branches.withColumn("literal", literal), "url-branches")
    # Wildcards are no literals: they neither merge nor count as siblings.
    counts = ("n", "lab", "blk", *(f"s{i}" for i in range(len(SHAPES))))
    totals = branches.groupBy("key").agg(*[F.sum(F.when(F.col("literal"), F.col(c)).otherwise(0)).alias(f"t_{c}") for c in counts], F.count(F.lit(1)).alias("of"))
    judged = lookup_join(branches, materialise(totals, "url-totals"), "key", "of", "branch")
    stays = ~F.col("literal") | ~_agrees(judged)
    judged = judged.select("key", "node", "branch", "up", "lab", "blk", "paths", F.when(stays, F.col("branch")).otherwise("*").alias("name"), (F.col("literal") & stays).alias("apart"))
    judged = materialise(judged, "url-judged")
    merged = judged.groupBy("key", "node", "name", "apart").agg(F.first("up").alias("up"), F.sum("lab").alias("lab"), F.sum("blk").alias("blk"), F.count(F.lit(1)).alias("branches"))
    merged = materialise(merged.withColumn("template", F.concat("node", F.lit("/"), "name")), "url-merged")
    shared = merged.groupBy("template").agg(F.sum("lab").alias("all_lab"), F.sum("blk").alias("all_blk"), F.count(F.lit(1)).alias("of"))
    merged = lookup_join(merged, materialise(shared, "url-shared"), "template", "of", "key")
    elsewhere = _smoothed(F.col("all_blk") - F.col("blk"), F.col("all_lab") - F.col("lab"), F.lit(PRIOR))
    prior = F.when(F.col("apart"), (F.col("up") + elsewhere + 2 * PRIOR) / 4).otherwise(F.col("up"))
    merged = merged.select("key", "name", "template", "branches", _smoothed(F.col("blk"), F.col("lab"), prior).alias("purity"))
    # Many branches of one node may be one wildcard.
    merged = merged.withColumn("merged", F.concat("key", F.lit("/"), "name")).drop("key", "name")
    merged = materialise(merged, "url-purities")
    names = lookup_join(judged.select(F.concat("key", F.lit("/"), "name").alias("merged"), F.concat("key", F.lit("/"), "branch").alias("edge"), "paths"), merged, "merged", "branches", "edge")
    names = materialise(names.select("edge", "template", "purity", "paths"), "url-names")
    edges = nodes.select("host", "path", "n", "lab", "blk", _behind(F.col("rest"), F.col("branch")).alias("rest"), F.concat("key", F.lit("/"), "branch").alias("edge"))
    found = lookup_join(edges, names, "edge", "paths", "path")
    return materialise(found.select("host", "path", "n", "lab", "blk", F.col("purity").alias("up"), F.col("template").alias("node"), "rest"), "url-nodes")


def _agrees(branches: DataFrame) -> Column:
    """Whether a literal branch is like the rest of its siblings; an only child has nothing to merge with."""
    n, rest = F.col("n"), F.col("t_n") - F.col("n")
    lab, rest_lab = F.col("lab"), F.col("t_lab") - F.col("lab")
    pooled = F.col("t_blk") / F.col("t_lab")
    gap = F.abs(F.col("blk") / lab - (F.col("t_blk") - F.col("blk")) / rest_lab)
    error = F.sqrt(pooled * (1 - pooled) * (1 / lab + 1 / rest_lab))
    same_label = F.when((lab == 0) & (rest_lab == 0), True).when((lab == 0) | (rest_lab == 0), False).otherwise(gap <= Z * error)
    same_shape = F.lit(True)
    for i in range(len(SHAPES)):
        share = F.col(f"t_s{i}") / F.col("t_n")
        apart = F.abs(F.col(f"s{i}") / n - (F.col(f"t_s{i}") - F.col(f"s{i}")) / rest)
        same_shape = same_shape & (apart <= Z * F.sqrt(share * (1 - share) * (1 / n + 1 / rest)))
    return F.when(rest > 0, same_label & same_shape).otherwise(False)


def judge_urls(pages: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row.

    Null urls and urls without ``://`` have empty host and path and share one node. Long paths are judged to their last
    segment; rounds of counting are as many as levels at which a template branches. Repeated rows count and are judged each for itself; other columns are not
    read; an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_says", says).withColumn("label", F.when(F.col("_says") == "block", 1).when(F.col("_says") == "allow", 0))
    judged = path_templates(rows)
    verdict = F.coalesce("_says", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
