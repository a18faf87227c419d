"""URL filter: listed rules first, then a path-template tree per host.

The tree is built from the distinct shapes of the paths (digit runs become ``#``).  Going down from a host's
root, a node with more than ``FANOUT`` different children keeps those that hold ``COMMON`` of its rows and turns
all others into the wildcard ``*``, down to the last segment.  A path's segments, so generalised, are its
template.  A node of at most ``FANOUT`` shapes can keep all its segments at once, so the tree is built in as many
rounds as there are levels with a larger node.  Rows that a rule judges are the labels.  Templates of a host that differ in a
literal first segment are siblings; siblings with at least ``LABELLED`` labels whose share of blocked rows does
not differ from the siblings' common share by a two-sided test are merged.  A template is rejected if its
smoothed purity ``(blocked + 1) / (labelled + 2)`` reaches ``PURITY``, so a template without labels is allowed.

Only DataFrame functions are used.  All joins below the rows are on distinct shapes; the last one joins every
row to its shape and takes the most frequent shapes through a bounded broadcast.

Rows and edge cases: a null url, or one without ``://``, has an empty host and path and so fits no rule; the
same holds for a path that does not begin with a rule's.  Null or repeated ``page_id`` pass through, one result
row for each row.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorekeep.llm.common import read
from lorekeep.operators.first_wins import attach_per_key
from lorekeep.session import stage

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
FANOUT = 16
COMMON = 0.05
LABELLED = 5
NORMAL_95 = 1.96
PURITY = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)`` of the text after the first ``://``; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, begin = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{begin}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def template_tree(shapes: DataFrame) -> DataFrame:
    """Adds ``template`` to distinct ``(host, shape, n, ...)``."""
    parts = F.split(F.regexp_replace("shape", "^/", ""), "/")
    tree = shapes.withColumn("parts", F.when(F.col("shape") != "", parts).otherwise(F.array().cast("array<string>")))
    tree = stage(tree.withColumn("template", F.lit("")), "url-tree")
    ended = F.size("parts") == 0
    done, tree, level = [tree.where(ended)], tree.where(~ended), 0
    while not tree.isEmpty():
        here = tree.withColumn("segment", F.get("parts", F.lit(level)))
        children = here.groupBy("host", "template", "segment").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_shapes"))
        nodes = children.groupBy("host", "template").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_fan"))
        rare = (F.col("_fan") > FANOUT) & (F.col("_n") < F.col("_all") * COMMON)
        general = children.join(nodes, ["host", "template"]).select(
            "host", "template", "segment", "_shapes", F.when(rare, "*").otherwise(F.col("segment")).alias("_to")
        )
        sizes = general.groupBy("host", "template", "_to").agg(F.sum("_shapes").alias("_size"))
        general = general.drop("_shapes").join(sizes, ["host", "template", "_to"])
        deeper = F.concat("template", F.lit("/"), "_to")
        rest = F.array_join(F.slice("parts", level + 2, F.size("parts")), "/")
        ended = F.size("parts") == level + 1
        small = F.col("_size") <= FANOUT
        joined = here.join(general, ["host", "template", "segment"]).withColumns(
            {"template": F.when(small & ~ended, F.concat(deeper, F.lit("/"), rest)).otherwise(deeper), "_done": small | ended}
        )
        tree = stage(joined.drop("segment", "_to", "_size"), "url-tree")
        done.append(tree.where("_done").drop("_done"))
        tree, level = tree.where("not _done").drop("_done"), level + 1
    return reduce(DataFrame.union, [part.select(*done[0].columns) for part in done]).drop("parts")


def template_purity(tree: DataFrame) -> DataFrame:
    """``(host, template, purity)`` after merging similar siblings."""
    own = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    family = F.regexp_replace("template", r"^/[^/*#]+", "/?")
    own = stage(own.withColumn("family", family), "url-templates")
    common = own.where(F.col("labelled") >= LABELLED).groupBy("host", "family").agg(
        (F.sum("blocked") / F.sum("labelled")).alias("share")
    )
    off = F.abs(F.col("blocked") / F.col("labelled") - F.col("share"))
    noise = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("labelled"))
    alike = F.coalesce((F.col("labelled") >= LABELLED) & (off <= NORMAL_95 * noise), F.lit(False))
    judged = own.join(common, ["host", "family"], "left").withColumn("alike", alike)
    pooled = judged.where("alike").groupBy("host", "family").agg(
        F.sum("blocked").alias("_blocked"), F.sum("labelled").alias("_labelled")
    )
    blocked = F.when(F.col("alike"), F.col("_blocked")).otherwise(F.col("blocked"))
    labelled = F.when(F.col("alike"), F.col("_labelled")).otherwise(F.col("labelled"))
    return judged.join(pooled, ["host", "family"], "left").select(
        "host", "template", ((blocked + 1) / (labelled + 2)).alias("purity")
    )


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` of every page."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("listed"), F.regexp_replace("path", "[0-9]+", "#").alias("shape"))
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("listed").alias("labelled"),
        F.count(F.when(F.col("listed") == "block", 1)).alias("blocked"),
    )
    tree = template_tree(shapes)
    judged = tree.join(template_purity(tree), ["host", "template"])
    key = F.concat_ws("\u0001", "host", "shape")
    per_key = stage(judged.select(key.alias("_key"), "n", "template", "purity"), "url-shapes")
    rows = rows.withColumns({"_key": key, "seq": F.monotonically_increasing_id()})
    found = attach_per_key(rows.withColumnRenamed("_key", "shape_key"), per_key.withColumnRenamed("_key", "shape_key"), "shape_key")
    learned = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("listed", learned).alias("verdict"), "template", "purity"
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def oracle(rules=RULES) -> str:
    """The same result in DuckDB SQL: the tree by recursion, level by level."""
    cases = {"rule": "null", "listed": "null"}
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, begin = text.partition("/")
        fits = f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{begin}')"
        cases = {
            "rule": f"case when {fits} then '{text}' else {cases['rule']} end",
            "listed": f"case when {fits} then '{kind}' else {cases['listed']} end",
        }
    ctes = [
        "cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages)",
        f"""parsed as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut)""",
        f"""ruled as (select *, {cases['rule']} as rule, {cases['listed']} as listed,
            regexp_replace(path, '[0-9]+', '#', 'g') as shape from parsed)""",
        """shapes as (select host, shape, count(*) as n, count(listed) as labelled,
            count(*) filter (listed = 'block') as blocked from ruled group by host, shape)""",
        """tree0 as (select *, case when shape <> '' then string_split(regexp_replace(shape, '^/', ''), '/')
            else [] end as parts, '' as template from shapes)""",
    ]
    ctes.append(
        f"""tree as (select *, 0 as level from tree0 union all
            select host, shape, n, labelled, blocked, parts,
                template || '/' || case when fan > {FANOUT} and k < total * cast({COMMON} as double) then '*' else segment end,
                level + 1
            from (select *, sum(n) over (partition by host, template, segment) as k,
                    sum(n) over (partition by host, template) as total,
                    count(distinct segment) over (partition by host, template) as fan
                from (select *, parts[level + 1] as segment from tree where level < len(parts))))"""
    )
    ctes += [
        f"""own as (select host, template, regexp_replace(template, '^/[^/*#]+', '/?') as family,
            sum(blocked)::double as blocked, sum(labelled)::double as labelled from tree where level = len(parts) group by all)""",
        f"""common as (select host, family, sum(blocked) / sum(labelled) as share from own
            where labelled >= {LABELLED} group by all)""",
        f"""marked as (select own.*, coalesce(labelled >= {LABELLED} and abs(blocked / labelled - share)
            <= {NORMAL_95}::double * sqrt(share * (1 - share) / labelled), false) as alike
            from own left join common using (host, family))""",
        "pooled as (select host, family, sum(blocked) as b, sum(labelled) as l from marked where alike group by all)",
        """purity as (select host, template, case when alike then (b + 1) / (l + 2)
            else (blocked + 1) / (labelled + 2) end as purity from marked left join pooled using (host, family))""",
        f"placed as (select host, shape, template, purity from tree join purity using (host, template) where level = len(parts))",
    ]
    return f"""with recursive {', '.join(ctes)}
        select page_id, host, path, rule,
            coalesce(listed, case when purity >= cast({PURITY} as double) then 'block' else 'allow' end) as verdict, template, purity
        from ruled join placed using (host, shape)"""
