"""URL filters: a path-template tree per host, judged by labelled purity.

Rules (host and path prefix) decide the urls they fit; the urls so decided are
the labels of the others. Per host, the paths form a tree of segments:

1. segments that are numbers, long hexadecimal strings or long mixtures of
   letters and digits become typed wildcards at once;
2. level by level, the sibling branches under a parent are compared with the
   parent as a whole, by a chi-square statistic over what follows the segment
   (end, number, other wildcard, word) and over the labels; the branches that do
   not differ significantly from it are merged into one wildcard branch;
3. a template (a merged path) is rejected if its share of blocked labels,
   smoothed by ``SMOOTHING`` labels of equal parts, reaches ``PURITY``.

The tree is as deep as the longest path: levels are built until no path has a further
segment. Paths that have ended stay as they are and are not joined again.
Everything is built from DataFrame functions. Pages are first reduced to counts per
(host, generalised path) with partial aggregation, so the tree's joins work on
distinct generalised paths; only the last join meets the pages, on keys whose
rows Spark may split between tasks.

Edge cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is judged as the template of that empty host: allowed, as are all
templates without labels. Null ids pass through; repeated rows
count as often as they occur; without any label nothing is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgate.llm.common import cut, fresh, quoted

#: Segments that the DuckDB oracle reads; equal to the tree on paths that have no more.
DEPTH = 3
PURITY = 0.9
SMOOTHING = 2.0
#: Chi-square of 4 degrees of freedom (3 for what follows, 1 for the labels)
#: at a significance of 1 %.
CRITICAL = 13.277

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KINDS = ("k_end", "k_number", "k_other", "k_word")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; block before allow
    among equal ones."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def general(segment: Column) -> Column:
    """A segment, or the typed wildcard it is an instance of."""
    ending = F.regexp_extract(segment, r"^[0-9]+(\.[A-Za-z]+)$", 1)
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(ending != "", F.concat(F.lit("{n}"), ending))
        .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$") & segment.rlike("[0-9]"), F.lit("{x}"))
        .when((F.length(segment) >= 12) & segment.rlike("[0-9]") & segment.rlike("[A-Za-z]"), F.lit("{m}"))
        .otherwise(segment)
    )


def _parts(df: DataFrame, url: str, rules: tuple[Rule, ...], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and host__, path__, rule__, mark__, seg__ (the
    generalised segments)."""
    named = df.select(*[quoted(c) for c in keep], quoted(url).alias("url__"))
    named = named.withColumn(
        "rest__", F.expr("if(instr(url__, '://') > 0, substring(url__, instr(url__, '://') + 3), '')")
    ).withColumn("rest__", F.coalesce("rest__", F.lit("")))
    named = named.withColumn("raw__", F.regexp_extract("rest__", r"^[^/?#]*", 0))
    named = named.withColumn("host__", F.translate("raw__", UPPER, LOWER)).withColumn(
        "path__", F.regexp_extract(F.expr("substring(rest__, length(raw__) + 1)"), r"^[^?#]*", 0)
    )
    text, verdict = fitting_rule(F.col("host__"), F.col("path__"), rules)
    segments = F.filter(F.split("path__", "/"), lambda s: s != "")
    named = named.withColumn("rule__", text).withColumn("mark__", verdict).withColumn(
        "seg__", F.transform(F.coalesce(segments, F.array().cast("array<string>")), general)
    )
    return named.drop("url__", "rest__", "raw__")


def _kind(segment: Column) -> list[Column]:
    number = segment.startswith("{n}")
    return [segment == "", number, segment.startswith("{") & ~number, ~segment.startswith("{") & (segment != "")]


def template_tree(paths: DataFrame) -> DataFrame:
    """``paths`` (host__, seg__, n, labels, blocked: counts) with the
    template__ that each generalised path belongs to."""
    deepest = paths.agg(F.max(F.size("seg__"))).first()[0] or 0
    tree = paths.withColumn("template__", F.lit(""))
    done = []
    for level in range(1, deepest + 1):
        # the ends of this level count as siblings, but keep their templates
        here = F.coalesce(F.get("seg__", F.lit(level - 1)), F.lit(""))
        after = F.coalesce(F.get("seg__", F.lit(level)), F.lit(""))
        weights = [F.when(is_, F.col("n")).otherwise(0).alias(k) for k, is_ in zip(KINDS, _kind(after), strict=True)]
        sums = ["n", "labels", "blocked", *KINDS]
        branches = (
            tree.select("host__", "template__", here.alias("here__"), "n", "labels", "blocked", *weights)
            .groupBy("host__", "template__", "here__").agg(*[F.sum(c).alias(c) for c in sums])
        )
        branches = cut(branches, "branches")
        parents = branches.groupBy("host__", "template__").agg(*[F.sum(c).alias(f"p_{c}") for c in sums])
        parents = cut(parents, "parents")
        both = branches.join(parents, ["host__", "template__"])
        statistic = F.lit(0.0)
        for k in KINDS:
            expected = F.col("n") * F.col(f"p_{k}") / F.col("p_n")
            statistic = statistic + F.when(expected > 0, (F.col(k) - expected) * (F.col(k) - expected) / expected).otherwise(0.0)
        share = F.try_divide("p_blocked", "p_labels")  # null without labels
        spread = F.col("labels") * share * (1 - share)
        gap = F.col("blocked") - F.col("labels") * share
        statistic = statistic + F.when((F.col("p_labels") > 0) & (spread > 0), gap * gap / spread).otherwise(0.0)
        # wildcards and ends stay what they are; words that look like the whole merge
        is_word = _kind(F.col("here__"))[3]
        step = F.when(is_word & (statistic <= CRITICAL), "/{*}").otherwise(F.concat(F.lit("/"), "here__"))
        steps = cut(both.where(F.col("here__") != "").select("host__", "template__", "here__", step.alias("step__")), "steps")
        done.append(tree.where(F.size("seg__") < level))
        tree = tree.where(F.size("seg__") >= level).withColumn("here__", here).join(steps, ["host__", "template__", "here__"])
        tree = cut(tree.withColumn("template__", F.concat("template__", "step__")).drop("step__", "here__"), "tree")
    for ended in done:
        tree = tree.unionByName(ended)
    return tree


def judge_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns, or those in ``keep``) plus host, path, rule,
    verdict, template (null where a rule decides) and purity."""
    keep = df.columns if keep is None else keep
    names = {c: fresh(df.select(*[quoted(k) for k in keep]), c) for c in ("host", "path", "rule", "verdict", "template", "purity")}
    parts = _parts(df, url, rules, keep)
    key = ["host__", "seg__"]
    paths = cut(
        parts.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), F.count("mark__").alias("labels"), F.count_if(F.col("mark__") == "block").alias("blocked")
        ),
        "paths",
    )
    tree = template_tree(paths)
    leaves = cut(tree.groupBy("host__", "template__").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b")), "leaves")
    purity = (F.col("b") + SMOOTHING / 2) / (F.col("l") + SMOOTHING)
    judged = cut(tree.join(leaves, ["host__", "template__"]).select(*key, "template__", purity.alias("purity__")), "judged")
    columns = [quoted(c) for c in keep]
    fixed = [F.col("host__").alias(names["host"]), F.col("path__").alias(names["path"]), F.col("rule__").alias(names["rule"])]
    ruled = parts.where(F.col("mark__").isNotNull()).select(
        *columns, *fixed, F.col("mark__").alias(names["verdict"]),
        F.lit(None).cast("string").alias(names["template"]), F.lit(None).cast("double").alias(names["purity"]),
    )
    free = parts.where(F.col("mark__").isNull()).join(judged, key).select(
        *columns, *fixed, F.when(F.col("purity__") >= PURITY, "block").otherwise("allow").alias(names["verdict"]),
        F.col("template__").alias(names["template"]), F.col("purity__").alias(names["purity"]),
    )
    return ruled.unionByName(free)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The judgement of ``pages`` in DuckDB's SQL, for paths of ``DEPTH`` segments at most."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    ranked = sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text), reverse=True)

    def chosen(value: str) -> str:
        cases = " ".join(
            f"WHEN (host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)}) "
            f"THEN {quote(getattr(r, value))}" for r in ranked
        )
        return f"CASE {cases} END"

    def wild(s: str) -> str:
        ending = rf"regexp_extract({s}, '^[0-9]+(\.[A-Za-z]+)$', 1)"
        return (
            f"CASE WHEN {s} IS NULL THEN '' WHEN regexp_full_match({s}, '[0-9]+') THEN '{{n}}' "
            f"WHEN {ending} <> '' THEN '{{n}}' || {ending} "
            f"WHEN regexp_full_match({s}, '[0-9a-fA-F-]{{8,}}') AND regexp_matches({s}, '[0-9]') THEN '{{x}}' "
            f"WHEN length({s}) >= 12 AND regexp_matches({s}, '[0-9]') AND regexp_matches({s}, '[A-Za-z]') THEN '{{m}}' ELSE {s} END"
        )

    def kinds(s: str) -> list[str]:
        number = f"starts_with({s}, '{{n}}')"
        return [f"{s} = ''", number, f"starts_with({s}, '{{') AND NOT {number}", f"NOT starts_with({s}, '{{') AND {s} <> ''"]

    steps = []
    for level in range(1, DEPTH + 1):
        here, after = f"s{level}", f"s{level + 1}" if level < DEPTH else "tail"
        weights = ", ".join(f"sum(CASE WHEN {is_} THEN n ELSE 0 END) AS {k}" for k, is_ in zip(KINDS, kinds(after), strict=True))
        sums = ", ".join(f"sum({c}) AS p_{c}" for c in ("n", "labels", "blocked", *KINDS))
        chi = " + ".join(
            f"CASE WHEN p_{k} > 0 THEN ({k} - n * p_{k} / p_n) * ({k} - n * p_{k} / p_n) / (n * p_{k} / p_n) ELSE 0 END" for k in KINDS
        )
        spread = "labels * (p_blocked / p_labels) * (1 - p_blocked / p_labels)"
        gap = "(blocked - labels * (p_blocked / p_labels))"
        chi += f" + CASE WHEN p_labels > 0 AND {spread} > 0 THEN {gap} * {gap} / ({spread}) ELSE 0 END"
        steps.append(f"""
    b{level} AS (SELECT host, template, {here} AS seg, sum(n) AS n, sum(labels) AS labels, sum(blocked) AS blocked, {weights}
                 FROM t{level - 1} GROUP BY ALL),
    p{level} AS (SELECT host, template, {sums} FROM b{level} GROUP BY ALL),
    d{level} AS (SELECT host, template, seg, CASE WHEN seg = '' THEN ''
                   WHEN {kinds('seg')[3]} AND {chi} <= {CRITICAL} THEN '/{{*}}' ELSE '/' || seg END AS step
                 FROM b{level} JOIN p{level} USING (host, template)),
    t{level} AS (SELECT t.* REPLACE (t.template || d.step AS template) FROM t{level - 1} t
                 JOIN d{level} d ON d.host = t.host AND d.template = t.template AND d.seg = t.{here})""")
    segments = ", ".join(f"{wild(f'seg[{i}]')} AS s{i}" for i in range(1, DEPTH + 1))
    key = ", ".join(["host", *[f"s{i}" for i in range(1, DEPTH + 1)], "tail"])
    return f"""
    WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
    r AS (SELECT page_id, host, path, {chosen('text')} AS rule, {chosen('verdict')} AS mark,
                 list_filter(string_split(path, '/'), lambda s: s <> '') AS seg FROM h),
    parts AS (SELECT page_id, path, rule, mark, host, {segments}, CASE WHEN len(seg) > {DEPTH} THEN '{{+}}' ELSE '' END AS tail FROM r),
    t0 AS (SELECT {key}, '' AS template, count(*)::DOUBLE AS n, count(mark)::DOUBLE AS labels,
                  count(*) FILTER (mark = 'block')::DOUBLE AS blocked FROM parts GROUP BY {key}),{','.join(steps)},
    leaf AS (SELECT {key}, template || tail AS template,
                    (sum(blocked) OVER w + {SMOOTHING / 2}) / (sum(labels) OVER w + {SMOOTHING}) AS purity
             FROM t{DEPTH} WINDOW w AS (PARTITION BY host, template || tail))
    SELECT page_id, p.host, path, rule, CASE WHEN mark IS NOT NULL THEN mark WHEN purity >= {PURITY} THEN 'block' ELSE 'allow' END AS verdict,
           CASE WHEN mark IS NULL THEN l.template END AS template, CASE WHEN mark IS NULL THEN purity END AS purity
    FROM parts p JOIN leaf l USING ({key})"""
