"""URL filter: hand-written rules, and for other urls a tree of path templates per host.

A path is cut into segments, in which runs of digits count as one number. From the top of each host's tree down, level by level:

1. a segment value that holds less than 1 / FAN of the urls under its parent is variable and becomes a wildcard, so a node has at most FAN named children and one wildcard;
2. sibling branches that no Hoeffding bound tells apart, neither by the forms of the segments that follow nor by the share of blocked urls among
   labelled ones, become one branch. A branch without labels that fits several groups of labelled siblings joins none of them.

What urls end in one node is a template. The rules' verdicts are the labels: a template is rejected if its share of blocked urls, smoothed towards its host's and
that towards all hosts', reaches REJECT. So rules for some urls of a template decide about the rest, and templates without any label fall back on their host.

Urls are counted by host and segments first, in the tasks that read them; everything after works on these counts, with joins on whole keys whose written sides Spark can
split or broadcast, and no task holds a host.

Defined results: a null url, or one without ``://``, has an empty host and path, which is judged like any other host; hosts fold A-Z only; a url's case, escapes and dots stay as they are;
rules of equal length go by their order; segments behind the DEPTH-th count as one; repeated rows and null ids are rows like any other; an empty table gives no rows.
Only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkstave.session import drop_stored, stored

#: A value is named if it holds 1 / FAN of its parent's urls, and at least LEAST.
FAN, LEAST = 32, 3
DEPTH = 8
#: Odds of keeping two like branches apart.
ALPHA = 0.05
#: Weight of the wider share in a smoothed one, and the share at which a template is rejected.
SMOOTH, REJECT = 4.0, 0.8
BROADCAST_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, TAIL, END = "*", "**", "$"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):  # the last one tried wins
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column, depth: int = DEPTH) -> Column:
    """Segments with numbers for digits; marks of this module are escaped; what lies behind ``depth`` is one."""
    plain = reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit(f"%{ord(mark):02X}")), "*|{}$", F.regexp_replace(path, "^/", ""))
    cut = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, "[0-9]+", "{n}"), "/"))
    return F.when(F.size(cut) > depth, F.concat(F.slice(cut, 1, depth), F.array(F.lit(TAIL)))).otherwise(cut)


def small_side(side: DataFrame, *texts: str) -> DataFrame:
    """A written side of a join, marked for broadcast if all its texts and rows are few bytes."""
    width = reduce(lambda a, b: a + b, (F.octet_length(c) for c in texts), F.lit(64))
    n_bytes = side.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(side) if n_bytes <= BROADCAST_BYTES else side.hint("merge")


def compatible(a: dict, b: dict, alpha: float = ALPHA) -> bool:
    """No Hoeffding bound tells two branches apart: neither a form of the next segment nor the share of blocked urls."""
    root = math.sqrt(math.log(2 / alpha) / 2)

    def same(x: float, n: float, y: float, m: float) -> bool:
        return abs(x / n - y / m) < root * (n**-0.5 + m**-0.5)

    forms = a["forms"].keys() | b["forms"].keys()
    if not all(same(a["forms"].get(f, 0), a["n"], b["forms"].get(f, 0), b["n"]) for f in forms):
        return False
    return not a["labelled"] or not b["labelled"] or same(a["blocked"], a["labelled"], b["blocked"], b["labelled"])


def merged_branches(branches: list[dict]) -> dict[str, str]:
    """Siblings (name, n, labelled, blocked, forms: counts of the next segment's) to names of their groups.

    Labelled ones go first, most labels first, and join the compatible group of the nearest share of blocked urls. One without labels joins the only labelled group
    that it fits, else the first group without labels that it fits.
    """
    groups: list[dict] = []

    def join(group: dict | None, own: dict) -> None:
        if group is None:
            groups.append(own | {"names": [own["name"]], "forms": dict(own["forms"])})
            return
        group["names"].append(own["name"])
        for c in ("n", "labelled", "blocked"):
            group[c] += own[c]
        for f, n in own["forms"].items():
            group["forms"][f] = group["forms"].get(f, 0) + n

    share = lambda x: x["blocked"] / x["labelled"]
    for own in sorted(branches, key=lambda b: (-b["labelled"], -b["n"], b["name"])):
        fits = [g for g in groups if compatible(g, own)]
        marked = [g for g in fits if g["labelled"]]
        if own["labelled"]:
            join(min(marked, key=lambda g: (abs(share(g) - share(own)), g["names"]), default=None), own)
        else:
            bare = [g for g in fits if not g["labelled"]]
            join(marked[0] if len(marked) == 1 else bare[0] if bare else None, own)
    label = lambda names: WILD if WILD in names else "|".join(sorted(names))
    return {name: label(g["names"]) for g in groups for name in g["names"]}


def _merged_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    branches = [
        {"name": r.name_, "n": int(r.n), "labelled": int(r.labelled), "blocked": int(r.blocked), "forms": {} if r.forms is None else {f["form"]: int(f["n"]) for f in r.forms}}
        for r in group.itertuples(index=False)
    ]
    names = merged_branches(branches)
    return pd.DataFrame({"host": key[0], "prefix": key[1], "name_": list(names), "merged": list(names.values())})


SUMS = ("n", "labelled", "blocked")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS]


def one_level(shapes: DataFrame, level: int) -> DataFrame:
    """Shapes with segment number ``level`` (from 1) put at the end of their prefix, as its branch's name; ended shapes stay as they are."""
    parent, branch = ["host", "prefix"], ["host", "prefix", "name_"]
    ended = shapes.filter(F.size("segs") < level)
    rows = shapes.filter(F.size("segs") >= level).withColumn("seg", F.element_at("segs", level))
    counts = rows.groupBy(*parent, "seg").agg(F.sum("n").alias("own"))
    totals = stored(counts.groupBy(*parent).agg(F.sum("own").alias("total")), "totals")
    often = counts.join(small_side(totals, *parent), parent).filter((F.col("own") * FAN >= F.col("total")) & (F.col("own") >= LEAST))
    named = stored(often.select(*parent, "seg", F.col("seg").alias("name_")), "named")
    rows = rows.join(small_side(named, *parent, "seg"), [*parent, "seg"], "left").withColumn("name_", F.coalesce("name_", F.lit(WILD)))
    following = F.when(F.size("segs") == level, END).otherwise(F.regexp_replace(F.try_element_at("segs", F.lit(level + 1)), r"[^\p{Punct}]+", "a"))
    cells = stored(rows.groupBy(*branch, following.alias("form")).agg(*_sums()), "cells")
    branches = stored(cells.groupBy(*branch).agg(*_sums()), "branches")
    shares = cells.select(*branch, "form", F.col("n").alias("own")).join(small_side(branches.select(*branch, "n"), *branch), branch)
    forms = shares.filter(F.col("own") * FAN >= F.col("n")).groupBy(*branch).agg(F.collect_list(F.struct("form", F.col("own").alias("n"))).alias("forms"))
    # A parent has FAN + 1 branches at most, each with FAN forms at most.
    siblings = branches.join(forms, branch, "left").groupBy(*parent).applyInPandas(_merged_group, "host string, prefix string, name_ string, merged string")
    merged = stored(siblings, "merged")
    grown = rows.join(small_side(merged, *branch), branch).withColumn("prefix", F.concat("prefix", F.lit("/"), "merged"))
    out = stored(ended.unionByName(grown.select(*shapes.columns)), "shapes")
    for done in (totals, named, cells, branches, merged):
        drop_stored(done)
    return out


def judged_templates(shapes: DataFrame) -> DataFrame:
    """Per host and segments: template, and the smoothed share of blocked urls in it."""
    sums = stored(shapes.groupBy("host", "prefix", F.size("segs").alias("depth")).agg(*_sums()), "templates")
    hosts = stored(sums.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked")), "hosts")
    total = hosts.agg(F.sum("host_labelled").alias("l"), F.sum("host_blocked").alias("b")).first()
    widest = ((total["b"] or 0) + 1) / ((total["l"] or 0) + 2)
    host_share = (F.col("host_blocked") + SMOOTH * widest) / (F.col("host_labelled") + SMOOTH)
    purity = (F.col("blocked") + F.lit(SMOOTH) * host_share) / (F.col("labelled") + SMOOTH)
    scored = stored(sums.join(small_side(hosts, "host"), "host").select("host", "prefix", "depth", purity.alias("blocked_share")), "scored")
    own = shapes.select("host", "segs", "prefix", F.size("segs").alias("depth"))
    return own.join(small_side(scored, "host", "prefix"), ["host", "prefix", "depth"]).select("host", "segs", F.col("prefix").alias("template"), "blocked_share")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template and its smoothed share of blocked urls."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", ruled(F.col("host"), F.col("path"), rules).alias("found"), segments(F.col("path")).alias("segs"))
    labelled = F.col("found").isNotNull().cast("bigint")
    blocked = F.coalesce(F.col("found.verdict") == "block", F.lit(False)).cast("bigint")
    counted = rows.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum(labelled).alias("labelled"), F.sum(blocked).alias("blocked"))
    shapes = stored(counted.withColumn("prefix", F.lit("")), "shapes")
    for level in range(1, (shapes.agg(F.max(F.size("segs"))).first()[0] or 0) + 1):
        before, shapes = shapes, one_level(shapes, level)
        drop_stored(before)
    known = stored(judged_templates(shapes), "judged").withColumn("key", F.concat_ws("/", "segs"))
    out = rows.join(small_side(known, "host", "key", "template").drop("key"), ["host", "segs"])
    own = F.when(F.col("blocked_share") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "template", "blocked_share")
