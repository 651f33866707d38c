import math
import random
import re
import string

import pytest

from sparkstave.llm import queries
from sparkstave.llm import urls as op

SCHEMA = "page_id bigint, url string, html string, host int, verdict int, prefix string"
PUNCT = re.escape(string.punctuation)


def frame(spark, urls, parts=3):
    return spark.createDataFrame([(i, u, "x", 1, 2, "y") for i, u in enumerate(urls)], SCHEMA).repartition(parts)


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest, re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :], re.S)[0]


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def plain(urls, rules=op.RULES):
    """The whole filter on lists of urls in memory: per url host, path, rule, verdict, template, share."""
    rows = []
    for u in urls:
        host, path = cut(u)
        segs = [] if path == "" else path.removeprefix("/").split("/")
        segs = [re.sub("[*|{}$]", lambda m: f"%{ord(m[0]):02X}", s) for s in segs]
        segs = [re.sub("[0-9]+", "{n}", s) for s in segs]
        rows.append({"host": host, "path": path, "segs": segs[: op.DEPTH] + ["**"] * (len(segs) > op.DEPTH), "rule": rule_of(host, path, rules), "prefix": ""})
    for level in range(op.DEPTH + 1):
        parents = {}
        for r in rows:
            if len(r["segs"]) > level:
                parents.setdefault((r["host"], r["prefix"]), []).append(r)
        for under in parents.values():
            values = [r["segs"][level] for r in under]
            for r in under:
                n = values.count(r["segs"][level])
                r["name"] = r["segs"][level] if n >= op.LEAST and n * op.FAN >= len(under) else "*"
            siblings = []
            for name in sorted({r["name"] for r in under}):
                mine = [r for r in under if r["name"] == name]
                forms = [re.sub(f"[^{PUNCT}]+", "a", r["segs"][level + 1]) if len(r["segs"]) > level + 1 else "$" for r in mine]
                many = {f: forms.count(f) for f in set(forms) if forms.count(f) * op.FAN >= len(mine)}
                marked = [r["rule"].verdict for r in mine if r["rule"]]
                siblings.append({"names": [name], "n": len(mine), "l": len(marked), "b": marked.count("block"), "forms": many})
            groups = []
            for s in sorted(siblings, key=lambda s: (-s["l"], -s["n"], s["names"])):
                fits = [g for g in groups if alike(g, s)]
                marked = [g for g in fits if g["l"]]
                if s["l"]:
                    marked.sort(key=lambda g: (abs(g["b"] / g["l"] - s["b"] / s["l"]), g["names"]))
                    to = marked[:1]
                else:
                    to = marked if len(marked) == 1 else [g for g in fits if not g["l"]][:1]
                if to:
                    for c in ("n", "l", "b", "names"):
                        to[0][c] = to[0][c] + s[c]
                    to[0]["forms"] = {f: to[0]["forms"].get(f, 0) + s["forms"].get(f, 0) for f in {*to[0]["forms"], *s["forms"]}}
                else:
                    groups.append(s)
            for r in under:
                names = next(g["names"] for g in groups if r["name"] in g["names"])
                r["prefix"] += "/" + ("*" if "*" in names else "|".join(sorted(names)))

    def counts(mine):
        verdicts = [r["rule"].verdict for r in mine if r["rule"]]
        return verdicts.count("block"), len(verdicts)

    b, n = counts(rows)
    widest = (b + 1) / (n + 2)
    out = []
    for i, r in enumerate(rows):
        b, n = counts([x for x in rows if x["host"] == r["host"]])
        share = (b + 4 * widest) / (n + 4)
        b, n = counts([x for x in rows if (x["host"], x["prefix"], len(x["segs"])) == (r["host"], r["prefix"], len(r["segs"]))])
        share = (b + 4 * share) / (n + 4)
        rule = r["rule"]
        out.append((i, r["host"], r["path"], rule and rule.host + rule.path, rule.verdict if rule else "block" if share >= 0.8 else "allow", r["prefix"], round(share, 12)))
    return out


def alike(a, b):
    bound = lambda n, m: math.sqrt(math.log(40) / 2) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    if any(abs(a["forms"].get(f, 0) / a["n"] - b["forms"].get(f, 0) / b["n"]) >= bound(a["n"], b["n"]) for f in {*a["forms"], *b["forms"]}):
        return False
    return not a["l"] or not b["l"] or abs(a["b"] / a["l"] - b["b"] / b["l"]) < bound(a["l"], b["l"])


def got(df):
    names = ["page_id", "host", "path", "rule", "verdict", "template", "blocked_share"]
    return sorted(tuple(r[c] if c != "blocked_share" else round(r[c], 12) for c in names) for r in df.collect())


ODD = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG", "http://example.org/es/x", "http://notexample.org/es/x", "x://y.org?q=://z/", "a://b.com#/fr/", "https://ÀB.Com/fr/?x",
    "http://c.net/*/|/{n}/$", "http://c.net//a//b", "http://org/", "http://org", "http://com/fr/1\n2", "s://u@d.com:80/de/" + "x" * 50_000, "s://deep.net/" + "/".join("abcdefghijklmnop"), "://e.com/fr/a",
]


def made(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = rng.choice(["a.example.org", "b.com", "b.com", "c.shop.com", "d.net", "D.net"])
        section = rng.choice(["fr", "de", "en", "es", "blog", f"user-{rng.randrange(200)}"])
        rest = rng.choice([str(rng.randrange(1000)), f"{rng.randrange(99)}.html", f"{rng.randrange(99)}/", "-".join(rng.choices(["red", "blue", "old", "new"], k=3)), "index", ""])
        out.append(f"{rng.choice(['http', 'https'])}://{host}/{section}/{rest}{rng.choice(['', '?a=1/2', '#top'])}")
    return out


def test_equals_plain(spark):
    urls = ODD + made(1, 500)
    urls += urls[:40]
    assert got(op.judged(frame(spark, urls))) == sorted(plain(urls))


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_BYTES", -1)
    urls = made(2, 300)
    assert got(op.judged(frame(spark, urls, 5))) == sorted(plain(urls))


def test_rules_of_part_of_a_template_decide_the_rest(spark):
    """Listed spam pages block their unlisted siblings under names of any kind; the shop next to them stays."""
    rules = (op.Rule("block", "spam.net", "/offer-1"), op.Rule("allow", "spam.net", "/help/"), op.Rule("allow", "good.net", "/"))
    urls = [f"http://spam.net/offer-{i}/buy.html" for i in range(300)] + [f"http://spam.net/help/{i}" for i in range(200)] + [f"http://good.net/{i}/x" for i in range(50)]
    verdicts = {u: r[4] for u, r in zip(urls, got(op.judged(frame(spark, urls), rules)), strict=True)}
    assert all((v == "block") == ("/offer" in u) for u, v in verdicts.items())


def test_similar_branches_merge_and_unlike_stay_apart():
    branch = lambda name, n, labelled, blocked, forms: {"name": name, "n": n, "labelled": labelled, "blocked": blocked, "forms": forms}
    page, file = {"{a}": 200}, {"{a}.a": 200}
    assert op.merged_branches([branch("x", 200, 50, 50, page), branch("y", 200, 0, 0, page), branch("z", 200, 0, 0, file)]) == {"x": "x|y", "y": "x|y", "z": "z"}
    mixed = op.merged_branches([branch("de", 200, 90, 90, page), branch("fr", 200, 90, 0, page), branch("en", 200, 0, 0, page), branch("*", 9, 9, 9, {"{a}": 9})])
    assert mixed == {"de": "*", "*": "*", "fr": "fr", "en": "en"}


def test_empty(spark):
    assert op.judged(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["op12_path_templates"])
def test_query(spark, small_dir, name):
    df = queries.QUERIES[name](spark, small_dir)
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    want = {r["page_id"]: p[1:] for r, p in zip(pages, plain([r["url"] for r in pages]), strict=True)}
    assert {r[0]: r[1:] for r in got(df)} == want
