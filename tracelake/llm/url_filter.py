"""URL filter: explicit rules, then a path-template tree per host whose templates are judged by labelled purity.

The tree of a host is grown level by level over distinct shapes of paths, never over pages: digits are one sign in a shape, so
a host with a third of all pages has few shapes, and each level is a grouped aggregate. At each level
a segment becomes ``*`` if its parent has many different segments, it is rare among them and its labels are few or do not set it apart, and
branches whose share of bad labels does not differ from that of their siblings (two-proportion test) are merged into ``~``. A template is rejected if its share of bad
labels, smoothed towards that of all labels, reaches ``PURITY``; a template without labels is never rejected.

Segments beyond ``DEPTH`` are one last segment. A url that is null or has no ``://`` has an empty host and path and is
judged like any other; null labels count as unlabelled; repeated rows are counted and judged again; an empty table gives no
rows. Other columns pass through, but for those named ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import stage

DEPTH = 6
MAX_RULES = 1_000
#: A parent with more segments than this generalises those with under ``RARE`` of its pages that labels do not set apart.
FANOUT, RARE = 20, 0.05
#: Labels that a branch must have to be compared with its siblings, and the score below which they are alike.
LEAST_LABELS, ALIKE = 5, 1.96
#: Labels that the overall share weighs in the smoothing, and the smoothed share of bad labels that rejects.
WEIGHT, PURITY = 4.0, 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and a start of the path; ``text`` is like ``example.com/en/``."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.text.partition("/")
        return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")


RULES = (
    Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"), Rule("net/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _ADDRESS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _ADDRESS, 2)


def _longest(rules: tuple[Rule, ...], value: str, host: Column, path: Column) -> Column:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are supported")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last that fits is the longest
        found = F.when(rule.fits(host, path), F.lit(getattr(rule, value))).otherwise(found)
    return found


def _shape(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), "[0-9]+", "{n}")


def _segments(shape: Column) -> Column:
    parts = F.split(F.regexp_replace(shape, "^/", ""), "/")
    rest = F.array_join(F.slice(parts, DEPTH, F.greatest(F.size(parts) - DEPTH + 1, F.lit(1))), "/")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH - 1), F.array(rest))).otherwise(parts)


def templates(shapes: DataFrame) -> DataFrame:
    """Shapes (host, shape, n, labelled, bad) with the template that the tree gives them."""
    now = stage(shapes.withColumns({"segments": _segments(F.col("shape")), "template": F.lit("")}))
    deepest = now.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(min(deepest, DEPTH)):
        here = now.withColumn("segment", F.get("segments", F.lit(level)))
        parent, branch = ["host", "template"], ["host", "template", "segment"]
        count = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        branches = here.where("segment IS NOT NULL").groupBy(*branch).agg(*count)
        whole = branches.groupBy(*parent).agg(F.count("*").alias("fan"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")])
        rare = (F.col("fan") > FANOUT) & (F.col("n") < RARE * F.col("all_n"))
        rest = F.col("all_labelled") - F.col("labelled")
        share = F.col("all_bad") / F.col("all_labelled")
        apart = F.col("bad") / F.col("labelled") - (F.col("all_bad") - F.col("bad")) / rest
        spread = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / rest))
        enough = (F.col("labelled") >= LEAST_LABELS) & (rest >= LEAST_LABELS)
        alike = F.when(enough, F.abs(apart) <= ALIKE * spread).otherwise(False)
        unlike = F.when(enough, F.abs(apart) > ALIKE * spread).otherwise(False)
        named = branches.join(whole, parent).select(*branch, F.when(rare & ~unlike, "*").when(alike, "~").otherwise(F.col("segment")).alias("sign"))
        grown = F.when(F.col("sign").isNotNull(), F.concat("template", F.lit("/"), "sign")).otherwise(F.col("template"))
        now = stage(here.join(named, branch, "left").withColumn("template", grown).drop("segment", "sign"))
    return now.drop("segments")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", bad: str | None = None) -> DataFrame:
    """Pages with host, path, rule, verdict (``allow`` or ``block``), template and its purity. ``bad`` names a boolean label column."""
    made = ("host", "path", "rule", "verdict", "template", "purity")
    address = F.col(url).cast("string")
    label = F.col(bad).cast("boolean") if bad else F.lit(None).cast("boolean")
    rows = pages.select(*[c for c in pages.columns if c not in made], host_of(address).alias("host"), path_of(address).alias("path"), label.alias("_bad"))
    rows = rows.withColumn("shape", _shape(F.col("path")))
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("_bad").alias("labelled"), F.count_if("_bad").alias("bad"))
    found = templates(shapes)
    labelled, bad_ones = found.agg(F.sum("labelled"), F.sum("bad")).first()  # two numbers
    prior = bad_ones / labelled if labelled else 0.0
    counts = found.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + F.lit(WEIGHT) * F.lit(prior)) / (F.col("labelled") + WEIGHT)
    reject = (F.col("labelled") >= LEAST_LABELS) & (purity >= PURITY)
    verdicts = counts.select("host", "template", purity.alias("purity"), F.when(reject, "block").otherwise("allow").alias("_verdict"))
    known = found.select("host", "shape", "template").join(verdicts, ["host", "template"])
    rule, ruled = (_longest(rules, v, F.col("host"), F.col("path")) for v in ("text", "verdict"))
    joined = rows.join(known, ["host", "shape"], "left")
    kept = [c for c in pages.columns if c not in made]
    return joined.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(ruled, "_verdict").alias("verdict"), "template", "purity")


def oracle_sql(bad_sql: str, depth: int = DEPTH, rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in SQL; ``bad_sql`` is a query of (page_id, url, bad)."""
    cases = {"text": [], "verdict": []}
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        own, _, rest = rule.text.partition("/")
        for value, out in cases.items():
            out.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}') THEN '{getattr(rule, value)}'")
    levels = []
    for k in range(depth):
        before, here = f"t{k}", f"t{k + 1}"
        levels.append(f"""
        b{k} AS (SELECT host, template, segments[{k + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad
                 FROM {before} WHERE len(segments) > {k} GROUP BY ALL),
        w{k} AS (SELECT host, template, count(*) AS fan, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM b{k} GROUP BY ALL),
        s{k} AS (SELECT host, template, segment, CASE WHEN fan > {FANOUT} AND n < {RARE} * all_n THEN '*'
                        WHEN labelled >= {LEAST_LABELS} AND all_labelled - labelled >= {LEAST_LABELS}
                             AND abs(bad / labelled - (all_bad - bad) / (all_labelled - labelled))
                                 <= {ALIKE} * sqrt((all_bad / all_labelled) * (1 - all_bad / all_labelled) * (1 / labelled + 1 / (all_labelled - labelled))) THEN '~'
                        ELSE segment END AS sign FROM b{k} JOIN w{k} USING (host, template)),
        {here} AS (SELECT t.host, t.shape, t.n, t.labelled, t.bad, t.segments, CASE WHEN sign IS NULL THEN t.template ELSE t.template || '/' || sign END AS template
                   FROM {before} t LEFT JOIN s{k} s ON t.host = s.host AND t.template = s.template AND t.segments[{k + 1}] = s.segment)""")
    parts = "string_split(regexp_replace(shape, '^/', ''), '/')"
    return f"""
        WITH p AS (SELECT page_id, bad, regexp_replace(lower(path), '[0-9]+', '{{n}}', 'g') AS shape, host, path FROM (
                     SELECT page_id, bad, translate(regexp_extract(coalesce(url, ''), '{_ADDRESS}', 1), '{_UPPER}', '{_LOWER}') AS host,
                            regexp_extract(coalesce(url, ''), '{_ADDRESS}', 2) AS path FROM ({bad_sql}))),
        g AS (SELECT host, shape, CAST(count(*) AS DOUBLE) AS n, CAST(count(bad) AS DOUBLE) AS labelled, CAST(count(*) FILTER (bad) AS DOUBLE) AS bad FROM p GROUP BY ALL),
        t0 AS (SELECT *, CASE WHEN len({parts}) > {DEPTH} THEN list_append(list_slice({parts}, 1, {DEPTH - 1}), array_to_string(list_slice({parts}, {DEPTH}, len({parts})), '/'))
                              ELSE {parts} END AS segments, '' AS template FROM g), {",".join(levels)},
        c AS (SELECT host, template, sum(labelled) AS labelled, sum(bad) AS bad FROM t{depth} GROUP BY ALL),
        pr AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad) / sum(labelled) ELSE 0 END AS prior FROM g),
        v AS (SELECT host, template, (bad + {WEIGHT} * prior) / (labelled + {WEIGHT}) AS purity, labelled FROM c, pr)
        SELECT page_id, host, path, CASE {" ".join(cases["text"])} END AS rule,
               CASE {" ".join(cases["verdict"])} WHEN v.labelled >= {LEAST_LABELS} AND purity >= {PURITY} THEN 'block' ELSE 'allow' END AS verdict, template, purity
        FROM p JOIN t{depth} USING (host, shape) JOIN v USING (host, template)"""
