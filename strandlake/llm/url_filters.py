"""URL filters: host and path rules, then a tree of path templates per host.

Rules: a rule ``host/path`` fits that host and all its subdomains where the url's
path starts with the rule's; the longest fitting rule decides. A url that no rule
fits is judged by the template tree, built with DataFrame operations only:

1. *Generalise.* Every path segment is typed: digits, hex strings, identifiers
   that mix letters and digits, each with its file ending; other segments stay.
2. *Merge.* The tree's nodes are (host, typed prefix). A literal branch becomes a
   wildcard where its parent has many branches and the branch is rare, or where
   its labelled share of bad pages doesn't differ from its siblings' (a two-sided
   test of proportions), so that statistically similar branches share a template.
3. *Reject.* The purity of a level (host, then each prefix of a template) is its share
   of bad labels, smoothed towards the level above it; the host's is smoothed towards the
   corpus's. So a template without labels of its own is judged by its branch or host.
   It is rejected at ``reject`` or more, if its host has ``min_labels`` labels.

Labels come from a table (page_id, bad) or, without one, from the urls that rules
judge. Only counts per (host, typed path) are shuffled, partially aggregated, so
a host with a third of all pages is no hot group; the join that returns verdicts
to the pages keeps to keys that a rejected template has, and the pages of hot keys stay in place.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and is allowed. Paths of any depth are read whole. Repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import common

# The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

MANY_BRANCHES = 20
RARE_SHARE = 0.05
Z_SIMILAR = 1.96
MIN_BRANCH_LABELS = 5
SMOOTHING = 5.0
REJECT = 0.8
MIN_LABELS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def matched_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, tail = text.partition("/")
        fits = ((F.col(host) == own) | F.col(host).endswith(f".{own}")) & F.col(path).startswith(f"/{tail}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def typed(segment: Column) -> Column:
    """A segment's type where it looks variable, else the segment."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return (
        F.when(stem.rlike("^[0-9]+$"), F.concat(F.lit("<num>"), ending))
        .when(stem.rlike("^[0-9a-f-]{8,}$") & stem.rlike("[0-9]"), F.concat(F.lit("<hex>"), ending))
        .when(stem.rlike("[0-9]") & stem.rlike("^[A-Za-z0-9_-]+$"), F.concat(F.lit("<id>"), ending))
        .otherwise(segment)
    )


def segments(path: str = "path") -> Column:
    return F.transform(F.filter(F.split(F.col(path), "/"), lambda s: s != ""), typed)


def _prefix(segs: str, n: Column) -> Column:
    """Stands for the first ``n`` segments within a host, in eight bytes however deep the path."""
    return F.xxhash64(F.slice(segs, F.lit(1), n))


def path_counts(pages: DataFrame) -> DataFrame:
    """(host, segs) with n, n_labels and n_bad; the input has host, segs and bad (0, 1 or null)."""
    return pages.where(F.col("host") != "").groupBy("host", "segs").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_labels"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("n_bad")
    )


def template_tree(counts: DataFrame) -> DataFrame:
    """Each (host, segs) with its template: an array of the segments, merged branches as ``*``."""
    nodes = (
        counts.select("host", "segs", "n", "n_labels", "n_bad", F.posexplode("segs").alias("at", "seg"))
        .groupBy("host", _prefix("segs", F.col("at")).alias("parent"), _prefix("segs", F.col("at") + 1).alias("prefix"), "seg")
        .agg(*(F.sum(c).alias(c) for c in ("n", "n_labels", "n_bad")))
    )
    parents = nodes.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("branches"), *(F.sum(c).alias(f"p_{c}") for c in ("n", "n_labels", "n_bad")))
    share = F.col("p_n_bad") / F.greatest(F.col("p_n_labels"), F.lit(1))
    error = F.sqrt(share * (1 - share) / F.greatest(F.col("n_labels"), F.lit(1)))
    similar = (F.col("n_labels") >= MIN_BRANCH_LABELS) & (F.col("p_n_labels") > F.col("n_labels")) & (F.abs(F.col("n_bad") / F.greatest(F.col("n_labels"), F.lit(1)) - share) <= Z_SIMILAR * error)
    rare = F.col("n") < RARE_SHARE * F.col("p_n")
    merged = (
        nodes.join(parents, ["host", "parent"])
        .where(~F.col("seg").startswith("<") & (((F.col("branches") > MANY_BRANCHES) & rare) | similar))
        .select("host", "prefix", F.lit("*").alias("star"))
    )
    spots = counts.select("host", "segs", F.posexplode_outer("segs").alias("at", "seg")).withColumn("prefix", _prefix("segs", F.coalesce(F.col("at"), F.lit(-1)) + 1))
    return (
        spots.join(merged, ["host", "prefix"], "left")
        .groupBy("host", "segs")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("star", "seg", F.lit("")).alias("seg")))).alias("t"))
        .select("host", "segs", F.filter("t.seg", lambda s: s != "").alias("template"))
    )


def template_purity(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """(host, template) with the host's labels and the purity, smoothed level by level."""
    sums = [F.sum(c).alias(c) for c in ("n_labels", "n_bad")]
    templates = common.cut(counts.join(tree, ["host", "segs"]).groupBy("host", "template").agg(*sums))
    spots = templates.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("template")))).withColumn("prefix", _prefix("template", F.col("at")))
    levels = spots.groupBy("host", "at", "prefix").agg(*sums)  # at 0: the host
    whole = templates.agg(((F.coalesce(F.sum("n_bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n_labels"), F.lit(0)) + 2)).alias("prior"))  # one row
    chain = (
        spots.select("host", "template", "at", "prefix").join(levels, ["host", "at", "prefix"])
        .groupBy("host", "template")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n_labels", "n_bad"))).alias("levels"))  # as many as the template is deep
    )
    smoothed = F.aggregate("levels", F.col("prior"), lambda p, x: (x.n_bad + SMOOTHING * p) / (x.n_labels + SMOOTHING))
    return chain.join(F.broadcast(whole)).select("host", "template", F.col("levels")[0]["n_labels"].alias("h_labels"), smoothed.alias("purity"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None, reject: float = REJECT, min_labels: int = MIN_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict, template_rejected of every row; ``labels``: (page_id, bad)."""
    host, path = host_and_path()
    pages = common.only(pages, "page_id", "url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, rule_verdict = matched_rule(rules)
    rows = rows.withColumn("rule", rule).withColumn("rule_verdict", rule_verdict).withColumn("segs", segments())
    if labels is None:
        labelled = rows.withColumn("bad", F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("int")))
    else:
        labelled = rows.join(common.only(labels, "page_id", "bad").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad")), "page_id", "left")
    counts = common.cut(path_counts(labelled))
    tree = common.cut(template_tree(counts))
    rejected = template_purity(counts, tree).where((F.col("purity") >= reject) & (F.col("h_labels") >= min_labels))
    bad_paths = common.cut(counts.join(tree.join(rejected, ["host", "template"], "left_semi"), ["host", "segs"]).select("host", "segs", "n", F.lit(True).alias("template_rejected")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return (
        common.keyed_join(rows, bad_paths, ["host", "segs"], "n", total, "left")
        .withColumn("template_rejected", F.coalesce("template_rejected", F.lit(False)))
        .withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("template_rejected"), F.lit("block")).otherwise(F.lit("allow"))))
        .select("page_id", "host", "path", "rule", "verdict", "template_rejected")
    )


def _oracle_typed(seg: str) -> str:
    ending = rf"regexp_extract({seg}, '(\.[A-Za-z]{{1,5}})$', 1)"
    stem = rf"regexp_replace({seg}, '\.[A-Za-z]{{1,5}}$', '')"
    return (
        f"CASE WHEN regexp_matches({stem}, '^[0-9]+$') THEN '<num>' || {ending} "
        f"WHEN regexp_matches({stem}, '^[0-9a-f-]{{8,}}$') AND regexp_matches({stem}, '[0-9]') THEN '<hex>' || {ending} "
        f"WHEN regexp_matches({stem}, '[0-9]') AND regexp_matches({stem}, '^[A-Za-z0-9_-]+$') THEN '<id>' || {ending} ELSE {seg} END"
    )


def _oracle_rules() -> tuple[str, str]:
    rule = verdict = "CASE "
    for text, what in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        own, _, tail = text.partition("/")
        fits = f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{tail}') THEN "
        rule, verdict = rule + fits + f"'{text}' ", verdict + fits + f"'{what}' "
    return rule + "END", verdict + "END"


_RULE, _VERDICT = _oracle_rules()
ORACLE_SQL = f"""
WITH RECURSIVE r0 AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r1 AS (SELECT *, {_RULE} AS rule, {_VERDICT} AS rv,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM r0),
r AS (SELECT page_id, host, path, rule, rv, list_transform(parts, lambda s: {_oracle_typed('s')}) AS segs,
    CASE WHEN rv IS NOT NULL THEN (rv = 'block')::INT END AS bad FROM r1),
c AS (SELECT host, segs, count(*) AS n, count(bad) AS nl, coalesce(sum(bad), 0) AS nb FROM r WHERE host <> '' GROUP BY ALL),
e AS (SELECT host, segs, n, nl, nb, unnest(range(1, len(segs) + 1)) AS i FROM c),
nodes AS (SELECT host, segs[1:i - 1] AS parent, segs[i] AS seg, sum(n) AS n, sum(nl) AS nl, sum(nb) AS nb FROM e GROUP BY ALL),
par AS (SELECT host, parent, count(*) AS b, sum(n) AS pn, sum(nl) AS pl, sum(nb) AS pb FROM nodes GROUP BY ALL),
m AS (SELECT host, parent || [seg] AS prefix FROM nodes JOIN par USING (host, parent) WHERE NOT starts_with(seg, '<') AND (
    (b > {MANY_BRANCHES} AND n < {RARE_SHARE} * pn) OR (nl >= {MIN_BRANCH_LABELS} AND pl > nl AND
    abs(nb / greatest(nl, 1) - pb / greatest(pl, 1)) <= {Z_SIMILAR} * sqrt(pb / greatest(pl, 1) * (1 - pb / greatest(pl, 1)) / greatest(nl, 1))))),
t0 AS (SELECT e.host, e.segs, i, CASE WHEN m.host IS NULL THEN e.segs[i] ELSE '*' END AS seg FROM e LEFT JOIN m ON m.host = e.host AND m.prefix = e.segs[1:i]),
t1 AS (SELECT host, segs, list(seg ORDER BY i) AS template FROM t0 GROUP BY ALL),
t AS (SELECT host, segs, coalesce(template, []) AS template FROM c LEFT JOIN t1 USING (host, segs)),
tp AS (SELECT host, template, sum(nl) AS nl, sum(nb) AS nb FROM c JOIN t USING (host, segs) GROUP BY ALL),
w AS (SELECT (coalesce(sum(nb), 0) + 1) / (coalesce(sum(nl), 0) + 2) AS prior FROM tp),
lv AS (SELECT host, i, template[1:i] AS prefix, sum(nl) AS nl, sum(nb) AS nb FROM (SELECT *, unnest(range(0, len(template) + 1)) AS i FROM tp) GROUP BY ALL),
pu AS (SELECT host, i, prefix, nl AS hl, (nb + {SMOOTHING} * prior) / (nl + {SMOOTHING}) AS p FROM lv, w WHERE i = 0
    UNION ALL SELECT lv.host, lv.i, lv.prefix, pu.hl, (lv.nb + {SMOOTHING} * pu.p) / (lv.nl + {SMOOTHING}) FROM lv JOIN pu ON lv.host = pu.host AND lv.i = pu.i + 1 AND lv.prefix[1:pu.i] = pu.prefix),
bad AS (SELECT tp.host, template FROM tp JOIN pu ON tp.host = pu.host AND tp.template = pu.prefix WHERE hl >= {MIN_LABELS} AND p >= {REJECT}),
bp AS (SELECT host, segs FROM t JOIN bad USING (host, template))
SELECT page_id, r.host, path, rule, coalesce(rv, CASE WHEN bp.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, bp.host IS NOT NULL AS template_rejected
FROM r LEFT JOIN bp ON r.host = bp.host AND r.segs = bp.segs
"""
