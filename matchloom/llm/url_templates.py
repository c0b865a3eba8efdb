"""URL filters: host rules, and per host a tree of path templates judged by smoothed labelled purity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

WILD, REST = "*", "**"

#: For callers who bound the tree: its levels; what lies deeper is one segment, ``**``. Without a bound it goes to the end.
DEPTH = 6

#: A node's segments vary if it has this many different children, and more than this share of its URLs lead to rare ones.
MIN_CHILDREN, RARE_SHARE = 5, 0.5

#: A child is rare below this share of its node's URLs.
RARE = 0.01

#: Standard errors, and one URL, within which a branch's bad URLs are what its node's rate lets expect, so it merges.
MERGE_Z = 2.0

#: Weight, in labelled URLs, of the rate over all labelled URLs, and the smoothed bad rate from which a template is rejected.
PRIOR_WEIGHT, REJECT = 8.0, 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or URL."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, null if none fits. Of equal lengths the first by name wins.

    Rules are a list in the program, not a table; they become one expression and nothing is shuffled.
    """
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path: Column, depth: int | None = None) -> Column:
    """Non-empty parts of a path, all or at most ``depth``; what lies deeper is then ``**``."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    if depth is None:
        return parts
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit(REST)))).otherwise(parts)


def templates(urls: DataFrame, depth: int | None = DEPTH, min_children: int = MIN_CHILDREN, rare_share: float = RARE_SHARE, rare: float = RARE, merge_z: float = MERGE_Z) -> DataFrame:
    """``(host, path, n, n_labelled, n_bad, template)`` of distinct (host, path) rows with counts.

    From the top down, the children of a node are counted. Where they vary, rare ones become ``*``. Of the others,
    those whose bad URLs are within ``merge_z`` standard errors and one URL of what their node's rate lets expect, such
    as those without labels, merge into ``*`` as well, so what stays literal is a branch that differs. A level sums by
    (host, template, segment), combined before the shuffle, so a hot host is spread over its segments; its per-node
    sums are one row. Levels end with the last path (``depth`` None) or at ``depth``; only rows with further segments go
    on, and a row alone at its node keeps the rest of its path, as nothing there can vary or merge.
    """
    out = []
    level = urls.withColumn("_seg", segments(F.col("path"), depth)).withColumn("_t", F.lit("")).withColumn("_alone", F.lit(False))
    d = 0
    while True:
        ended = F.col("_alone") | (F.coalesce(F.size("_seg"), F.lit(0)) <= d)
        out.append(level.filter(ended))
        level = level.filter(~ended)
        if level.isEmpty():
            break
        here = F.get("_seg", F.lit(d))
        kids = level.groupBy("host", "_t", here.alias("_s")).agg(
            F.sum("n").alias("c_n"), F.sum("n_labelled").alias("c_lab"), F.sum("n_bad").alias("c_bad"), F.count(F.lit(1)).alias("c_rows"))
        kids = stored(kids, f"children-{d}")
        nodes = kids.groupBy("host", "_t").agg(F.sum("c_n").alias("t_n"), F.sum("c_lab").alias("t_lab"), F.sum("c_bad").alias("t_bad"), F.count(F.lit(1)).alias("t_kids"), F.sum("c_rows").alias("t_rows"))
        judged = kids.join(nodes, ["host", "_t"]).withColumn("_rare", F.col("c_n") < rare * F.col("t_n"))
        loose = judged.groupBy("host", "_t").agg(F.sum(F.when(F.col("_rare"), F.col("c_n")).otherwise(0)).alias("_loose"))
        judged = judged.join(loose, ["host", "_t"])
        varies = (F.col("t_kids") >= min_children) & (F.col("_loose") > rare_share * F.col("t_n"))
        pooled = F.try_divide("t_bad", "t_lab")
        off, error = F.abs(F.col("c_bad") - F.col("c_lab") * pooled), F.sqrt(F.col("c_lab") * pooled * (1 - pooled))
        alike = (F.col("t_kids") > 1) & (F.col("t_lab") > 0) & (off <= merge_z * error + 1)
        wild = (varies & F.col("_rare")) | alike
        named = judged.select("host", "_t", "_s", F.concat("_t", F.lit("/"), F.when(wild, WILD).otherwise(F.col("_s"))).alias("_next"), (F.col("t_rows") == 1).alias("_one"))
        named = stored(named, f"templates-{d}")
        rest = F.concat(F.col("_t"), F.lit("/"), F.array_join(F.slice("_seg", d + 1, F.size("_seg")), "/"))
        level = level.withColumn("_s", here).join(named, ["host", "_t", "_s"])
        level = level.withColumn("_t", F.when(F.col("_one"), rest).otherwise(F.col("_next"))).withColumn("_alone", F.col("_one")).drop("_s", "_next", "_one")
        level = stored(level, f"level-{d}")
        d += 1
    return reduce(DataFrame.unionByName, out).withColumnRenamed("_t", "template").drop("_seg", "_alone")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", label_col: str = "bad", prior_weight: float = PRIOR_WEIGHT,
          reject: float = REJECT, depth: int | None = None) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``n_labelled``, ``purity``.

    ``label_col`` (boolean, null where unknown) says which pages are known to be bad. A rule decides where one fits.
    Elsewhere a page is blocked if the bad rate of its template, smoothed towards the rate over all labelled pages, is
    at least ``reject``; without any label nothing is blocked. Null URLs and those without ``://`` have an empty host
    and path and share one template. Repeated rows stay and each counts; an empty table gives an empty one; other
    columns are not read.
    """
    mine = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(label_col).alias("_bad"))
    labelled, bad = F.count("_bad"), F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0))
    urls = stored(mine.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), labelled.alias("n_labelled"), bad.alias("n_bad")), "urls")
    known = stored(templates(urls, depth), "path-templates")
    total = known.agg(F.sum("n_labelled"), F.sum("n_bad")).first()
    prior = (total[1] or 0) / total[0] if total[0] else 0.0
    purity = (F.col("_tbad") + prior_weight * prior) / (F.col("_tlab") + prior_weight)
    rated = known.groupBy("host", "template").agg(F.sum("n_labelled").alias("_tlab"), F.sum("n_bad").alias("_tbad")).withColumn("purity", purity)
    by_url = known.select("host", "path", "template").join(rated, ["host", "template"])
    by_url = by_url.select("host", "path", "template", F.col("_tlab").alias("n_labelled"), "purity")
    out = mine.drop("_bad").join(by_url, ["host", "path"], "left").withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    method = F.when((F.col("n_labelled") > 0) & (F.col("purity") >= reject), "block").otherwise("allow")
    return out.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", method).alias("verdict"), "template", "n_labelled", "purity")
