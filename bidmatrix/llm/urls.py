"""URL filter: rules, and for all other pages a tree of path templates per host.

Rules name a verdict for a host with its subdomains and a beginning of the path; the longest that fits wins.
Pages with a rule are the labelled ones. Per host, a path segment becomes a wildcard where it varies: it
holds a digit, or many values stand at its place and it is a rare one. Paths that agree then are one
template, a leaf of the tree: all pages, the last label of the host, its last two, the host, the template's
first segment, its first two, the template. Branches of one host and one parent whose shares of blocked labels
do not differ beyond chance, neighbour to neighbour in the order of that share, are merged. From the top down, a
branch's share of blocked pages is smoothed by its parent's; one without labels, or with all of its parent's,
has its parent's. A template is blocked if that reaches the threshold.

Only column functions, groupings, windows over branches and joins: no Python in any row path. A host with
very many pages meets its few literals and its branches' verdicts in plain joins, which Spark splits; a window
has a row per distinct pair of counts among the branches of a parent, not one per branch.

Cases: a null url, or one without "://", has an empty host and path and no rule. Hosts keep ports. Repeated
rows are judged alike. Very long paths are templated whole. An empty table gives an empty result. Other
columns are ignored.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.llm.common import lower_ascii
from bidmatrix.session import stored

Rules = Sequence[tuple[str, str]]

#: Verdict, and host and path from the first slash on.
RULES: Rules = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)


@dataclass(frozen=True)
class Tree:
    few_values: int = 20  # up to so many values at a place, all stay
    rare_share: float = 0.05  # beyond that, those below this share of the place's pages become wildcards
    same_z: float = 1.96  # branches whose shares differ by fewer standard errors are merged
    prior_pages: float = 8.0  # labelled pages that the parent's share counts as
    block_share: float = 0.8


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(given, pattern, 1)), F.regexp_extract(given, pattern, 2)


def rule_of(host: Column, path: Column, rules: Rules) -> Column:
    """The longest fitting rule, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def literals(pages: DataFrame, tree: Tree) -> DataFrame:
    """host, kept: the segments that stay, as "place:value"; few per place, so the list of a host is short."""
    seen = pages.select("host", F.posexplode(segments(F.col("path"))).alias("place", "value"))
    seen = seen.where(~F.rlike("value", F.lit("[0-9]"))).groupBy("host", "place", "value").agg(F.count(F.lit(1)).alias("n"))
    places = stored(seen).groupBy("host", "place").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("pages"))
    kept = seen.join(places, ["host", "place"]).where(
        (F.col("values") <= tree.few_values) | (F.col("n") >= F.col("pages") * F.lit(tree.rare_share))
    )
    return kept.groupBy("host").agg(F.collect_set(F.concat_ws(":", "place", "value")).alias("kept"))


#: The tree from its first level to its leaves; those from the host's first segments on are merged with their like.
LEVELS = ("suffix", "domain", "host", "first", "second", "template")
MERGED_FROM = LEVELS.index("first")


def merge_alike(nodes: DataFrame, parent: list[str], same_z: float) -> DataFrame:
    """nodes with n and x, the labelled and blocked pages of all branches of their parent that they are merged with.

    Branches with equal counts are alike and go first into one row.
    """
    alike = nodes.where("own_n > 0").groupBy(*parent, "own_n", "own_x").agg(
        (F.col("own_n") * F.count(F.lit(1))).alias("all_n"), (F.col("own_x") * F.count(F.lit(1))).alias("all_x")
    )
    order = Window.partitionBy(*parent).orderBy(F.col("all_x") / F.col("all_n"), "own_n")
    n, x, n0, x0 = F.col("all_n"), F.col("all_x"), F.lag("all_n").over(order), F.lag("all_x").over(order)
    both = (x + x0 + 1.0) / (n + n0 + 2.0)
    error = F.sqrt(both * (1.0 - both) * (1.0 / n + 1.0 / n0))
    apart = F.coalesce(F.abs(x / n - x0 / n0) > F.lit(same_z) * error, F.lit(False))
    alike = alike.withColumn("apart", apart.cast("int"))
    alike = alike.withColumn("cluster", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cluster = Window.partitionBy(*parent, "cluster")
    sums = alike.select(*parent, "own_n", "own_x", F.sum("all_n").over(cluster).alias("n"), F.sum("all_x").over(cluster).alias("x"))
    met = nodes.join(sums, [*parent, "own_n", "own_x"], "left")
    return met.withColumns({"n": F.coalesce("n", "own_n"), "x": F.coalesce("x", "own_x")})


def branches(pages: DataFrame, tree: Tree) -> DataFrame:
    """host, template, purity: every template with its share of blocked pages, smoothed from the top of the tree down."""
    label = F.when(F.col("label") == "block", 1).when(F.col("label") == "allow", 0)
    own = stored(
        pages.groupBy(*LEVELS).agg(F.count(label).alias("own_n"), F.coalesce(F.sum(label), F.lit(0)).alias("own_x"))
    )
    total = own.agg(F.sum("own_n").alias("n"), F.sum("own_x").alias("x")).first()
    above, pages_above = F.lit(((total["x"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)), F.lit(total["n"] or 0)
    known = None
    for depth in range(1, len(LEVELS) + 1):
        names, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = own.groupBy(*names).agg(F.sum("own_n").alias("own_n"), F.sum("own_x").alias("own_x"))
        if depth > MERGED_FROM:
            nodes = merge_alike(nodes, parent, tree.same_z)
        else:
            nodes = nodes.withColumns({"n": F.col("own_n"), "x": F.col("own_x")})
        if known is not None:
            nodes = nodes.join(known.withColumnsRenamed({"purity": "above", "own_n": "pages_above"}), parent)
            above, pages_above = F.col("above"), F.col("pages_above")
        smoothed = (F.col("x") + F.lit(tree.prior_pages) * above) / (F.col("n") + F.lit(tree.prior_pages))
        same_evidence = (F.col("n") == 0) | (F.col("n") == pages_above)
        known = nodes.select(*names, "own_n", F.when(same_evidence, above).otherwise(smoothed).alias("purity"))
    return known.select("host", "template", "purity")


def judge(pages: DataFrame, rules: Rules = RULES, tree: Tree = Tree()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row."""
    host, path = parse(F.col("url"))
    named = pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path"))
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])
    named = named.withColumn("label", F.when(F.col("rule").isNotNull(), verdicts[F.col("rule")])) if rules else (
        named.withColumn("label", F.lit(None).cast("string"))
    )
    kept = stored(literals(named, tree).withColumnRenamed("host", "kept_host"))
    joined = named.join(kept, F.col("host") == F.col("kept_host"), "left")
    stays = lambda value, place: F.coalesce(F.array_contains("kept", F.concat_ws(":", place.cast("string"), value)), F.lit(False))
    parts = F.transform(segments(F.col("path")), lambda value, place: F.when(stays(value, place), value).otherwise("*"))
    beginning = lambda n: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, n), "/"))
    templated = stored(
        joined.withColumn("parts", parts)
        .withColumns({
            "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
            "first": beginning(1), "second": beginning(2), "template": F.concat(F.lit("/"), F.array_join("parts", "/")),
        })
        .drop("kept", "kept_host", "parts")
    )
    found = stored(branches(templated, tree))
    out = templated.join(found, ["host", "template"])
    by_tree = F.when(F.col("purity") >= tree.block_share, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", by_tree).alias("verdict"), "template", "purity")
