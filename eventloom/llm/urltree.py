"""URL filters: rules for hosts and paths, and a tree of path templates a host that carries verdicts over to what no rule names.

A rule has a host, a path and a verdict. It fits urls of that host and of all its subdomains whose path starts with the rule's; of
several that fit, that with the longest text wins (of equally long ones the first given).

The tree is grown level by level for all hosts at once. A path's segments (empty ones left out) lose what varies by form: runs of
digits become ``#``, long hexadecimal names ``*``. At each node, segments that fewer than ``least`` urls have, or less than a ``1/most``
share of the node's, become ``*``. Of those that are left, statistically similar branches merge: each is compared with the largest of
those with the same prevailing label (block, allow, none) by a chi-square test of homogeneity over labels and remaining depths, and joins it
unless they differ at the 1 % level. What is below ``levels`` segments is one ``**``. A template is a path through the tree; it is rejected
when its smoothed labelled purity (blocked + 1) / (labelled + 2) reaches ``purity``, so it takes at least eight labelled urls at 0.9.
The labels are urls whose verdict is known, from the rules or from elsewhere; a template without labels is allowed.

Counts are aggregated by host and segments before anything else and a level is a few joins and sums of those, so no host's tree has to fit into
a task; the table of a level is written before the next one. Only DataFrame functions are used.

A null url, or one without ``://``, has an empty host and path and is allowed. Rows aren't merged: repeated urls and ids give a row each.
A very long path has only its first ``levels`` segments told apart. An empty table gives no rows. Only page_id and url are read, other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventloom.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"://([^/?#]*)([^?#]*)"
LEVELS, LEAST, MOST, PURITY = 4, 10, 50, 0.9
#: 1 % point of the normal distribution, from which that of chi-square is made (Wilson and Hilferty).
NORMAL_POINT = 2.3263478740408408
LABELS = ("block", "allow", "none")
#: Keys of urls that no template can decide are spread over so many values.
SPREAD = 4096


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """Segments of a path without what varies by form."""
    shape = lambda s: F.when(s.rlike("^[0-9A-Fa-f-]{16,}$"), F.lit("*")).otherwise(F.regexp_replace(s, "[0-9]+", "#"))
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def _chi_square(a: str, b: str, cells: list[str]) -> tuple[Column, Column]:
    """Statistic and degrees of freedom of two samples' homogeneity, whose counts are the columns ``a_<cell>`` and ``b_<cell>``."""
    x, y = ([F.col(f"{p}_{c}").cast("double") for c in cells] for p in (a, b))
    n, m = reduce(Column.__add__, x), reduce(Column.__add__, y)
    terms = [F.when(i + j > 0, (i * F.sqrt(m / n) - j * F.sqrt(n / m)) ** 2 / (i + j)).otherwise(0.0) for i, j in zip(x, y)]
    return reduce(Column.__add__, terms), reduce(Column.__add__, [F.when(i + j > 0, 1.0).otherwise(0.0) for i, j in zip(x, y)]) - 1


def _point(df: Column) -> Column:
    spread = 2 / (9 * df)
    return F.when(df <= 0, F.lit(0.0)).otherwise(df * (1 - spread + NORMAL_POINT * F.sqrt(spread)) ** 3)


def _grown(rows: DataFrame, levels_left: int, least: int, most: int) -> DataFrame:
    """One level: rows (host, segs, rest, prefix, block, allow, none) with the head of ``rest`` moved to ``prefix`` as the tree names it."""
    live = rows.where(F.size("rest") > 0).withColumn("head", F.get("rest", F.lit(0)))
    depth = F.least(F.size("rest") - 1, F.lit(levels_left))
    cells = [f"{label}{d}" for label in LABELS for d in range(levels_left + 1)]
    sums = [F.sum(F.when(depth == d, F.col(label)).otherwise(0)).alias(f"a_{label}{d}") for label in LABELS for d in range(levels_left + 1)]
    heads = live.groupBy("host", "prefix", "head").agg(*[F.sum(label).alias(label) for label in LABELS], *sums)
    heads = heads.withColumn("n", F.col("block") + F.col("allow") + F.col("none"))
    nodes = heads.groupBy("host", "prefix").agg(F.sum("n").alias("total"))
    names = heads.where(F.col("n") >= least).join(nodes, ["host", "prefix"]).where(F.col("n") * most >= F.col("total"))
    #: At most ``most`` rows a node from here on.
    top = F.greatest(*LABELS)
    names = names.withColumn("kind", F.when(F.col("block") == top, "block").when(F.col("allow") == top, "allow").otherwise("none"))
    peers = Window.partitionBy("host", "prefix", "kind")
    anchor = F.first(F.struct("head", *[f"a_{c}" for c in cells])).over(peers.orderBy(F.col("n").desc(), "head"))
    names = names.withColumn("anchor", anchor).select("host", "prefix", "head", "kind", *[f"a_{c}" for c in cells], F.col("anchor.head").alias("first"), *[F.col(f"anchor.a_{c}").alias(f"b_{c}") for c in cells])
    statistic, df = _chi_square("a", "b", cells)
    names = names.select("host", "prefix", "head", "kind", F.when(statistic <= _point(df), F.col("first")).otherwise(F.col("head")).alias("leader"))
    members = F.array_join(F.sort_array(F.collect_list("head").over(Window.partitionBy("host", "prefix", "kind", "leader"))), "|")
    names = names.select("host", "prefix", "head", members.alias("name"))
    live = live.join(names, ["host", "prefix", "head"], "left")
    moved = live.select("host", "segs", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), F.concat("prefix", F.lit("/"), F.coalesce("name", F.lit("*"))).alias("prefix"), *LABELS)
    return rows.where(F.size("rest") == 0).unionByName(moved)


def templates(urls: DataFrame, levels: int = LEVELS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """host, segs, template and label counts of all distinct (host, segments of the path). ``urls``: host, path, label (block, allow, else null)."""
    counted = [F.count_if(F.col("label") == label).alias(label) for label in LABELS[:2]]
    rows = urls.select("host", segments(F.col("path")).alias("segs"), "label").groupBy("host", "segs")
    rows = rows.agg(*counted, F.count_if(F.col("label").isNull()).alias("none"))
    rows = rows.select("host", "segs", F.col("segs").alias("rest"), F.lit("").alias("prefix"), *LABELS)
    for level in range(levels):
        rows = written(_grown(rows, levels - level - 1, least, most), "templates")
    return rows.select("host", "segs", F.concat("prefix", F.when(F.size("rest") > 0, "/**").otherwise("")).alias("template"), *LABELS)


def rejected(found: DataFrame, purity: float = PURITY) -> DataFrame:
    """host, segs of the templates whose smoothed labelled purity reaches ``purity``."""
    totals = found.groupBy("host", "template").agg(F.sum("block").alias("bad"), F.sum("allow").alias("good"))
    bad = totals.where((F.col("bad") + 1) >= purity * (F.col("bad") + F.col("good") + 2)).select("host", "template")
    return found.join(bad, ["host", "template"], "left_semi").select("host", "segs")


def judge(pages: DataFrame, rules=RULES, levels: int = LEVELS, least: int = LEAST, most: int = MOST, purity: float = PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    bad = rejected(templates(rows.select("host", "path", F.col("found.verdict").alias("label")), levels, least, most), purity)
    key = lambda segs: F.concat(F.col("host"), F.lit("/"), F.array_join(segs, "/"))
    #: Urls with a rule or without a host need no template; their keys meet nothing and are spread.
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SPREAD)).cast("string"))
    open_ = F.col("found").isNull() & (F.col("host") != "")
    rows = rows.withColumn("key", F.when(open_, key(segments(F.col("path")))).otherwise(spread))
    bad = bad.where(F.col("host") != "").select(key(F.col("segs")).alias("key"), F.lit("block").alias("method"))
    verdict = F.coalesce("found.verdict", "method", F.lit("allow"))
    return rows.join(bad, "key", "left").select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def judge_sql(rules=RULES, levels: int = LEVELS, least: int = LEAST, most: int = MOST, purity: float = PURITY) -> str:
    """The same in DuckDB's SQL, a few table expressions a level."""
    longest = sorted(rules, key=lambda r: -len(r.text))
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    case = lambda what: "case " + " ".join(f"when {fits(r)} then '{what(r)}'" for r in longest) + " end"
    steps = [
        f"p as materialized (select page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '{URL}', 2), '') as path from pages)",
        f"r as materialized (select *, {case(lambda r: r.text)} as rule, {case(lambda r: r.verdict)} as label, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), "
        "lambda s: case when regexp_full_match(s, '[0-9A-Fa-f-]{16,}') then '*' else regexp_replace(s, '[0-9]+', '#', 'g') end) as segs from p)",
        "l0 as materialized (select host, segs, segs as rest, '' as prefix, count(*) filter (label = 'block') as block, count(*) filter (label = 'allow') as allow, count(*) filter (label is null) as \"none\" from r group by host, segs)",
    ]
    for k in range(levels):
        deep = levels - k - 1
        cells = [f"{label}{d}" for label in LABELS for d in range(deep + 1)]
        sums = ", ".join(f"sum(case when least(len(rest) - 1, {deep}) = {d} then \"{label}\" else 0 end)::double as a_{label}{d}" for label in LABELS for d in range(deep + 1))
        n, m = " + ".join(f"a_{c}" for c in cells), " + ".join(f"b_{c}" for c in cells)
        chi = " + ".join(f"case when a_{c} + b_{c} > 0 then power(a_{c} * sqrt(m / n) - b_{c} * sqrt(n / m), 2) / (a_{c} + b_{c}) else 0.0 end" for c in cells)
        df = " + ".join(f"case when a_{c} + b_{c} > 0 then 1.0::double else 0.0 end" for c in cells) + " - 1"
        over = ", ".join(f"first_value(a_{c}) over w as b_{c}" for c in cells)
        steps += [
            f"h{k} as materialized (select host, prefix, rest[1] as head, sum(block) as block, sum(allow) as allow, sum(\"none\") as \"none\", count(*) as c, {sums} from l{k} where len(rest) > 0 group by all)",
            f"n{k} as materialized (select *, case when block >= allow and block >= \"none\" then 'block' when allow >= \"none\" then 'allow' else 'none' end as kind from "
            f"(select *, block + allow + \"none\" as urls, sum(block + allow + \"none\") over (partition by host, prefix) as total from h{k}) where urls >= {least} and urls * {most} >= total)",
            f"a{k} as materialized (select *, {n} as n, {m} as m from (select *, first_value(head) over w as first, {over} from n{k} window w as (partition by host, prefix, kind order by urls desc, encode(head))))",
            f"c{k} as materialized (select host, prefix, head, kind, first, {chi} as chi, {df} as df from a{k})",
            f"m{k} as materialized (select host, prefix, head, string_agg(head, '|') over (partition by host, prefix, kind, leader order by encode(head) rows between unbounded preceding and unbounded following) as name from "
            f"(select *, case when chi <= case when df <= 0 then 0.0 else df * power(1 - 2 / (9 * df) + {NORMAL_POINT} * sqrt(2 / (9 * df)), 3) end then first else head end as leader from c{k}))",
            f"l{k + 1} as materialized (select host, segs, rest, prefix, block, allow, \"none\" from l{k} where len(rest) = 0 union all select l.host, segs, rest[2:], l.prefix || '/' || coalesce(name, '*'), block, allow, \"none\" "
            f"from l{k} l left join m{k} m on l.host = m.host and l.prefix = m.prefix and l.rest[1] = m.head where len(rest) > 0)",
        ]
    steps += [
        f"t as materialized (select host, segs, prefix || case when len(rest) > 0 then '/**' else '' end as template, block, allow from l{levels})",
        f"x as materialized (select host, template from t group by host, template having sum(block) + 1 >= {purity} * (sum(block) + sum(allow) + 2))",
        "bad as (select distinct host, segs from t join x using (host, template))",
    ]
    return "with " + ",\n".join(steps) + "\nselect page_id, r.host, path, rule, coalesce(label, case when r.host <> '' and bad.host is not null then 'block' else 'allow' end) as verdict from r left join bad on r.host = bad.host and r.segs = bad.segs"
