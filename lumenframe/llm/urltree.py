"""URL filter: fixed rules, and per host a tree of path templates judged by labelled purity.

Rules come first: a rule fits its host and all subdomains if the path starts with the rule's; of those that fit, the
longest wins.  URLs that no rule decides are judged by the method:

1. Tree.  A host's paths are cut into segments and grown into a tree from the root.  At a node, a segment that stands in at least
   ``LITERAL_SHARE`` of all URLs of the host there (and in ``LITERAL_ROWS`` of them) and isn't a number is a literal child.  All other segments are generalised
   into wildcards that keep whether the segment is a number, and its file suffix; a wildcard with as many URLs is a child
   too, and what is left below the node is one last wildcard for the rest of the path.  So a host has at most
   1 / ``LITERAL_SHARE`` nodes at a depth (and a last wildcard for each), however many URLs it has, and no depth is the last.
2. Merging.  From the root down, sibling branches are merged if likelihood-ratio tests can't tell them apart: neither how
   their URLs go on (the children) nor their labels (blocked against allowed).  A branch without labels is merged only with others without, as nothing shows
   it to be like a labelled one.  Branches are compared in order of their blocked share with what is merged so far.  A merged branch has the children of all its
   members; equal ones are pooled.
3. Purity.  A node's smoothed purity is (blocked + prior * ``STRENGTH``) / (labelled + ``STRENGTH``).  Its prior is the purity of the
   node above, drawn back to that node's own prior by the share of its URLs that have no label.  Above a host's root are its parent domains,
   up to all hosts (whose prior is ``PRIOR``).  So labels reach templates without any, as far as they cover what lies around those.  From ``MIN_PURITY`` on a template is rejected.

Labels come from the URLs that rules decide (or from a label column: block, allow or anything else for none).  Null URLs
and URLs without "://" have an empty host and path, fit no rule and share one template.  Repeated rows count each for
itself.  An empty table gives an empty result.  Only the id and URL columns (and the label column, if given) are read.

URLs of a node are grown in one task when they are ``NODE_PATHS`` at most; larger nodes are split level by level with grouped
counts first.  Both ways give the same tree.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import mapped_by_key, packed, settle

LITERAL_SHARE, LITERAL_ROWS = 0.01, 5
#: Distinct paths below a node that one task grows, at most.
NODE_PATHS = 2000
STRENGTH, PRIOR, MIN_PURITY = 4.0, 0.5, 0.8
#: Standard normal deviate of the likelihood-ratio tests (one in a hundred).
DEVIATE = 2.326
#: Template nodes and domains that are broadcast at most; beyond that rows are joined to them by host.
BROADCAST_NODES = 100_000
#: Wildcards inside a tree; no segment holds a "#".  They are shown as {n}, {s} and {**}.
NUMBER, STRING, REST = "#n", "#s", "#*"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first "://" and the path up to a query or fragment; empty without."""
    pattern = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)"
    known = F.coalesce(url.contains("://"), F.lit(False))
    host = F.when(known, F.regexp_extract(url, pattern, 1)).otherwise("")
    path = F.when(known, F.regexp_extract(url, pattern, 2)).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


_SUFFIX = re.compile(r"\.[A-Za-z]{1,5}\Z")
_NUMBER = re.compile(r"[0-9]+\Z")


def segments(path: str) -> list[str]:
    """Segments of a path without its leading slash; an empty path has none."""
    return path.removeprefix("/").split("/") if path else []


def wildcard(segment: str) -> str:
    if not segment:
        return ""
    suffix = _SUFFIX.search(segment)
    stem = segment[: suffix.start()] if suffix else segment
    return (NUMBER if _NUMBER.match(stem) else STRING) + (suffix[0] if suffix else "")


def shown(template: str) -> str:
    for mark, text in ((NUMBER, "{n}"), (STRING, "{s}"), (REST, "{**}")):
        template = template.replace(mark, text)
    return template


def is_literal(segment: str) -> bool:
    """Whether a segment may be a literal: it is no number (with or without a suffix)."""
    return not wildcard(segment).startswith(NUMBER)


def _wildcard_column(segment: Column) -> Column:
    suffix = F.regexp_extract(segment, r"(?s)(\.[A-Za-z]{1,5})\z", 1)
    stem = F.expr("substring(__seg, 1, length(__seg) - length(__suffix))")
    return F.when(segment == "", "").otherwise(F.concat(F.when(stem.rlike(r"\A[0-9]+\z"), NUMBER).otherwise(STRING), suffix))


def needed(total: int, share: float, rows: int) -> int:
    """URLs that a child node needs in a host of ``total``."""
    return max(rows, math.ceil(total * share))


def grown(paths: list[tuple[str, tuple]], need: int, prefix: str = "") -> dict[str, list[int]]:
    """Counts (blocked, allowed, unlabelled) by template of the paths below one node; ``paths`` are what follows its prefix."""
    out: dict[str, list[int]] = {}
    todo = [(prefix, 0, [(segments(p), c) for p, c in paths])]

    def add(template: str, counts: tuple) -> None:
        row = out.setdefault(template, [0, 0, 0])
        for k in range(3):
            row[k] += counts[k]

    while todo:
        node, at, rows = todo.pop()
        literals: Counter = Counter()
        for s, c in rows:
            if len(s) > at and is_literal(s[at]):
                literals[s[at]] += sum(c)
        wild: Counter = Counter()
        for s, c in rows:
            if len(s) > at and literals[s[at]] < need:
                wild[wildcard(s[at])] += sum(c)
        below: dict[str, list] = {}
        for s, c in rows:
            if len(s) == at:
                add(node, c)
                continue
            child = s[at] if literals[s[at]] >= need else wildcard(s[at])
            if literals[s[at]] < need and wild[child] < need:
                add(f"{node}/{REST}", c)
            else:
                below.setdefault(child, []).append((s, c))
        todo += [(f"{node}/{child}", at + 1, own) for child, own in below.items()]
    return out


_COUNTS = ["blocked", "allowed", "unlabelled"]


def templates(urls: DataFrame, literal_share: float = LITERAL_SHARE, literal_rows: int = LITERAL_ROWS, node_paths: int = NODE_PATHS) -> DataFrame:
    """(host, template, blocked, allowed, unlabelled) of ``urls`` (host, path and those counts; a row per distinct path), settled."""
    n = F.col("blocked") + F.col("allowed") + F.col("unlabelled")
    need = F.greatest(F.lit(literal_rows), F.ceil(F.sum(n) * F.lit(literal_share))).cast("long")
    sizes = urls.groupBy("host").agg(need.alias("need"), F.count(F.lit(1)).alias("paths"))
    # hosts with many paths are few: at most as many as all paths over node_paths
    large = packed(settle(sizes.filter(F.col("paths") > node_paths).select(F.col("host").alias("__h"), "need")))

    def grow(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        counts = list(zip(*(g[c].tolist() for c in _COUNTS)))
        least = int(g["need"].iloc[0]) or needed(sum(map(sum, counts)), literal_share, literal_rows)
        found = grown(list(zip(g["rest"], counts)), least, key[1])
        return pd.DataFrame({"host": [key[0]] * len(found), "template": list(found), **{c: [v[k] for v in found.values()] for k, c in enumerate(_COUNTS)}})

    schema = "host string, template string, blocked long, allowed long, unlabelled long"
    start = urls.select("host", F.lit("").alias("prefix"), F.col("path").alias("rest"), *_COUNTS)
    small_hosts = start.join(_small(large.select("__h")), F.col("host") == F.col("__h"), "left_anti").withColumn("need", F.lit(0).cast("long"))
    done = [small_hosts.groupBy("host", "prefix").applyInPandas(grow, schema)]
    live = start.join(_small(large), F.col("host") == F.col("__h")).drop("__h") if not large.isEmpty() else None
    while live is not None:
        # a rest is empty or starts with a slash
        live = settle(live)
        done.append(live.filter("rest = ''").groupBy("host", F.col("prefix").alias("template")).agg(*[F.sum(c).alias(c) for c in _COUNTS]))
        going = live.filter("rest <> ''").withColumn("__seg", F.split(F.expr("substring(rest, 2)"), "/")[0])
        going = going.withColumn("rest", F.expr("substring(rest, length(__seg) + 2)")).withColumn("__suffix", F.regexp_extract("__seg", r"(?s)(\.[A-Za-z]{1,5})\z", 1)).withColumn("__wild", _wildcard_column(F.col("__seg")))

        def heavy(d: DataFrame, k: str) -> DataFrame:
            often = d.groupBy("host", "prefix", k, "need").agg(F.sum(n).alias("__n")).filter(F.col("__n") >= F.col("need"))
            return packed(settle(often.select(F.col("host").alias("__h"), F.col("prefix").alias("__p"), F.col(k).alias("__k"))))

        def marked(d: DataFrame, known: DataFrame, k: str, out: str) -> DataFrame:
            on = (F.col("host") == F.col("__h")) & (F.col("prefix") == F.col("__p")) & (F.col(k) == F.col("__k"))
            return d.join(_small(known), on, "left").withColumn(out, F.col("__k").isNotNull()).drop("__h", "__p", "__k")

        going = marked(going, heavy(going.filter(~F.col("__wild").startswith(NUMBER)), "__seg"), "__seg", "__lit")
        going = marked(going, heavy(going.filter("not __lit"), "__wild"), "__wild", "__known")
        child = F.when(F.col("__lit"), F.col("__seg")).when(F.col("__known"), F.col("__wild")).otherwise(REST)
        rest = F.when(F.col("__lit") | F.col("__known"), F.col("rest")).otherwise("")
        moved = settle(going.select("host", F.concat("prefix", F.lit("/"), child).alias("prefix"), rest.alias("rest"), *_COUNTS, "need"))
        nodes = moved.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("paths"), F.count(F.when(F.col("rest") != "", 1)).alias("longer"))
        nodes = packed(settle(nodes.select(F.col("host").alias("__h"), F.col("prefix").alias("__p"), (F.col("longer") > node_paths).alias("__large"))))
        sized = moved.join(_small(nodes), (F.col("host") == F.col("__h")) & (F.col("prefix") == F.col("__p"))).drop("__h", "__p")
        done.append(sized.filter("not __large and rest = ''").groupBy("host", F.col("prefix").alias("template")).agg(*[F.sum(c).alias(c) for c in _COUNTS]))
        done.append(sized.filter("not __large and rest <> ''").drop("__large").groupBy("host", "prefix").applyInPandas(grow, schema))
        live = sized.filter("__large").drop("__large") if not nodes.filter("__large").isEmpty() else None
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    return settle(whole.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in _COUNTS]))


def _small(df: DataFrame) -> DataFrame:
    """``df`` (settled) broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def _likelihood_ratio(a: Counter, b: Counter) -> tuple[float, int]:
    """Twice the log-likelihood ratio of two counts against their pooled shares, and its degrees of freedom."""
    keys = [k for k in a.keys() | b.keys() if a[k] + b[k]]
    na, nb = sum(a.values()), sum(b.values())
    out = 0.0
    for k in keys:
        both = a[k] + b[k]
        for x, total in ((a[k], na), (b[k], nb)):
            if x:
                out += 2 * x * math.log(x * (na + nb) / (both * total))
    return out, max(0, len(keys) - 1)


def alike(a: Counter, b: Counter, deviate: float = DEVIATE) -> bool:
    """Whether a likelihood-ratio test can't tell two counts apart (its limit by Wilson and Hilferty's approximation)."""
    ratio, free = _likelihood_ratio(a, b)
    if not free:
        return True
    return ratio < free * (1 - 2 / (9 * free) + deviate * math.sqrt(2 / (9 * free))) ** 3


@dataclass
class Node:
    counts: list[int] = field(default_factory=lambda: [0, 0, 0])  # of all URLs below
    ends: bool = False  # a template
    children: dict[str, Node] = field(default_factory=dict)


def tree_of(rows: list[tuple[str, list[int]]]) -> Node:
    root = Node()
    for template, counts in rows:
        node = root
        for step in [None, *(template.split("/")[1:] if template else [])]:
            if step is not None:
                node = node.children.setdefault(step, Node())
            for k in range(3):
                node.counts[k] += counts[k]
        node.ends = True
    return root


def _pooled(nodes: list[Node]) -> list[int]:
    return [sum(n.counts[k] for n in nodes) for k in range(3)]


def _shape(nodes: list[Node]) -> Counter:
    """How many URLs go on by which child (None: they end)."""
    out: Counter = Counter()
    for n in nodes:
        out[None] += sum(n.counts)
        for k, c in n.children.items():
            out[k] += sum(c.counts)
            out[None] -= sum(c.counts)
    return out


def merged(children: dict[str, list[Node]], deviate: float = DEVIATE) -> list[list[str]]:
    """Groups of sibling branches that tests can't tell apart."""
    pooled = {k: _pooled(v) for k, v in children.items()}
    labelled = lambda c: c[0] + c[1]
    order = sorted(children, key=lambda k: (-labelled(pooled[k]) > -1, pooled[k][0] / max(1, labelled(pooled[k])), k))
    groups: list[tuple[list[str], list[int], Counter]] = []
    for k in order:
        own, shape = pooled[k], _shape(children[k])
        for members, counts, all_shapes in groups:
            if (labelled(own) > 0) == (labelled(counts) > 0) and alike(Counter(b=own[0], a=own[1]), Counter(b=counts[0], a=counts[1]), deviate) and alike(shape, all_shapes, deviate):
                members.append(k)
                for i in range(3):
                    counts[i] += own[i]
                all_shapes.update(shape)
                break
        else:
            groups.append(([k], list(own), Counter(shape)))
    return [g[0] for g in groups]


def smoothed(blocked: float, allowed: float, prior: float, strength: float = STRENGTH) -> float:
    return (blocked + prior * strength) / (blocked + allowed + strength)


def passed_on(purity: float, counts: list[int], prior: float) -> float:
    """The prior that a node hands down: its purity as far as labels cover it, else its own prior."""
    total = sum(counts)
    return prior + (purity - prior) * ((counts[0] + counts[1]) / total if total else 0.0)


def judged(root: Node, root_prior: float, strength: float = STRENGTH, deviate: float = DEVIATE) -> list[tuple[str, str, float]]:
    """(template, its merged template, purity) of a host's tree."""
    out = []
    todo = [([("", root)], "", root_prior)]
    while todo:
        members, name, above = todo.pop()
        counts = _pooled([n for _, n in members])
        purity = smoothed(counts[0], counts[1], above, strength)
        out += [(path, name, purity) for path, n in members if n.ends]
        children: dict[str, list[tuple[str, Node]]] = {}
        for path, n in members:
            for k, c in n.children.items():
                children.setdefault(k, []).append((f"{path}/{k}", c))
        for group in merged({k: [c for _, c in v] for k, v in children.items()}, deviate):
            own = [x for k in group for x in children[k]]
            todo.append((own, f"{name}/{'|'.join(sorted(group))}", passed_on(purity, counts, above)))
    return out


def root_priors(found: DataFrame, strength: float = STRENGTH, prior: float = PRIOR) -> DataFrame:
    """(host, prior): what the parent domains of each host hand down to its root, from all hosts to the nearest parent."""
    hosts = settle(found.groupBy("host").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    parts = F.split("host", r"\.")
    # all hosts together (level 0), then the last part, the last two parts, ... of a host's name, itself not included
    suffix = lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), ".")
    parents = F.concat(F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("domain"))), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(i.alias("level"), suffix(i).alias("domain")))).otherwise(F.array().cast("array<struct<level:int,domain:string>>")))
    each = hosts.select("host", F.explode(parents).alias("p"), *_COUNTS).select("host", "p.level", "p.domain", *_COUNTS)
    domains = settle(each.groupBy(F.col("level").alias("__l"), F.col("domain").alias("__d")).agg(*[F.sum(c).alias(f"__{c}") for c in _COUNTS]))
    chain = each.select("host", "level", "domain").join(_small(domains), (F.col("level") == F.col("__l")) & (F.col("domain") == F.col("__d")))
    chain = chain.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("level", *[F.col(f"__{c}").alias(c) for c in _COUNTS]))).alias("chain"))
    step = lambda p, d: p + ((d["blocked"] + p * strength) / (d["blocked"] + d["allowed"] + strength) - p) * (d["blocked"] + d["allowed"]) / (d["blocked"] + d["allowed"] + d["unlabelled"])
    return chain.select("host", F.aggregate("chain", F.lit(prior), step).alias("prior"))


def judged_templates(found: DataFrame, strength: float = STRENGTH, prior: float = PRIOR, min_purity: float = MIN_PURITY, deviate: float = DEVIATE) -> DataFrame:
    """(host, n, judged: array of template, branch, purity, rejected), settled; ``found`` as ``templates`` gives it."""

    def judge(g: pd.DataFrame) -> pd.DataFrame:
        root = tree_of([(t, [int(b), int(a), int(u)]) for t, b, a, u in zip(g["template"], *(g[c] for c in _COUNTS))])
        rows = judged(root, float(g["prior"].iloc[0]), strength, deviate)
        listed = [{"template": t, "branch": shown(m), "purity": p, "rejected": p >= min_purity} for t, m, p in rows]
        return pd.DataFrame({"host": [g["host"].iloc[0]], "n": [len(rows)], "judged": [listed]})

    priors = root_priors(found, strength, prior).withColumnRenamed("host", "__h")
    both = found.join(priors, F.col("host") == F.col("__h")).drop("__h")
    # a host's tree is bounded (see the module docstring), however many URLs it has
    return settle(both.groupBy("host").applyInPandas(judge, "host string, n long, judged array<struct<template:string,branch:string,purity:double,rejected:boolean>>"))


class Judge:
    """Finds the template of a path in a host's judged tree."""

    def __init__(self, rows) -> None:
        self.found = {r["template"]: (r["branch"], r["purity"], r["rejected"]) for r in rows}
        self.nodes = set()
        for t in self.found:
            while t and t not in self.nodes:
                self.nodes.add(t)
                t = t[: t.rindex("/")]

    def __call__(self, path: str) -> tuple[str, str, float, bool]:
        node = ""
        for s in segments(path):
            if is_literal(s) and f"{node}/{s}" in self.nodes:
                node = f"{node}/{s}"
            elif (child := f"{node}/{wildcard(s)}") in self.nodes:
                node = child
            else:
                node = f"{node}/{REST}"
                break
        return node, *self.found[node]


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, **options) -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict, template (its branch after merging), purity.

    Options are those of ``templates`` and ``judged_templates``.
    """
    host, path = host_and_path(F.col("__url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("__url"), label.alias("__label"))
    rows = rows.select("page_id", "__label", host.alias("host"), path.alias("path")).select("page_id", "host", "path", "__label", rule.alias("rule"), verdict.alias("__v"))
    known = F.coalesce("__label", "__v", F.lit(""))
    count = lambda x: F.sum(F.when(x, 1).otherwise(0)).alias
    urls = settle(rows.groupBy("host", "path").agg(count(known == "block")("blocked"), count(known == "allow")("allowed"), count(~known.isin("block", "allow"))("unlabelled")))
    own = {k: options.pop(k) for k in ("literal_share", "literal_rows", "node_paths") if k in options}
    trees = judged_templates(templates(urls, **own), **options)

    def read(b: pa.RecordBatch, tree: Callable) -> pa.RecordBatch:
        found = [tree(h, i)(p) for i, (h, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))]
        verdicts = [v or ("block" if f[3] else "allow") for v, f in zip(b.column(4).to_pylist(), found)]
        columns = [pa.array(verdicts, pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*b.columns[:4], *columns], names=["page_id", "host", "path", "rule", "verdict", "template", "purity"])

    schema = "page_id long, host string, path string, rule string, verdict string, template string, purity double"
    return mapped_by_key(rows, ["page_id", "host", "path", "rule", "__v"], F.col("host"), trees, "host", ["judged"], "n", BROADCAST_NODES, lambda rows: Judge(rows), read, schema)
