"""URL rules with redirect equivalence, by DataFrame expressions and joins only.

Rules decide urls by host and path. Urls joined by redirects or canonical links are aliases: connected
components over those edges carry a block from any blocked alias to those that no rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .html_tags import attribute, is_tag, let, opening_tags
from .shared import aside, materialise

#: Rule lists up to this length are matched inside the row; longer ones by an equi-join on host suffixes.
INLINE_RULES = 200
#: Bytes of blocks passed on to aliases up to which they are broadcast; beyond, urls are shuffled.
MOST_BROADCAST = 8 << 20


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(rest, upper, lower), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _inline(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    entries = [F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(a).alias("a")) for h, p, a in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))]
    fits = F.filter(F.array(*entries), lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["p"]))
    best = F.get(fits, F.lit(0)) if entries else F.lit(None).cast("struct<h:string,p:string,a:string>")
    return df.withColumn("_best", best).withColumns({"rule": F.concat("_best.h", "_best.p"), "_action": F.col("_best.a")}).drop("_best")


def _joined(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Distinct (host, path) pairs meet the rules on each suffix of the host, in the same order of precedence."""
    table = df.sparkSession.createDataFrame(rules, "h string, p string, a string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    urls = df.select("host", "path").distinct()
    hits = urls.select("host", "path", F.explode(suffixes).alias("h")).join(table, "h").where(F.startswith("path", F.col("p")))
    order = F.struct((-F.length(F.concat("h", "p"))).alias("n"), (F.col("a") != "allow").alias("blocks"), "h", "p", "a")
    best = hits.groupBy("host", "path").agg(F.min(order).alias("b"))
    best = best.select("host", "path", F.concat("b.h", "b.p").alias("rule"), F.col("b.a").alias("_action"))
    return df.join(best.hint("merge"), ["host", "path"], "left")


def match_rules(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """Adds host, path, rule and _action. rules: (host, path prefix, 'block' or 'allow'); the longest that fits wins.

    Of equally long ones an allow wins, then the first by host and path, however many rules there are.
    """
    df = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    return _inline(df, rules) if len(rules) <= INLINE_RULES else _joined(df, rules)


def resolved(target: Column, base: Column) -> Column:
    """A link's target as a full url, by the page's own url where it has no scheme; null if the page's url has none either."""
    root = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    own = url_path(base)
    path, rest = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.regexp_extract(F.concat(F.lit("/"), F.regexp_replace(own, "^/", "")), r"(?s)^.*/", 0), path))
    parts = F.split(whole, "/")
    none = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
    walked = F.aggregate(parts, none, lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    walked = F.concat(F.array_join(walked, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    full = (
        F.when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.lit(":"), target))
        .when(path != "", F.concat(root, walked, rest))
        .when(F.startswith(target, F.lit("?")), F.concat(root, own, target))
        .otherwise(base)
    )
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target).when(root != "", full)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): each page's url and the targets of its canonical links and of its refresh tags.

    Relative targets are resolved by the page's first base element with a target, if it has one, or else its url.
    Tags in comments, scripts and quoted values do not count; of an attribute given twice the first does.
    """
    def links(tags: Column, a: Column) -> Column:
        hrefs = F.filter(F.transform(F.filter(tags, lambda t: is_tag(t, "base")), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
        base = let(_cleaned(F.get(hrefs, F.lit(0))), lambda h: F.when(h != "", F.coalesce(resolved(h, a), a)).otherwise(a))
        rel = lambda t: F.split(F.lower(attribute(t, "rel")), r"[\t\n\f\r ]+")
        canonical = F.filter(tags, lambda t: is_tag(t, "link") & F.array_contains(rel(t), "canonical"))
        refresh = F.filter(tags, lambda t: is_tag(t, "meta") & (F.trim(F.lower(attribute(t, "http-equiv"))) == "refresh"))
        after = lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)^\s*[0-9.]+(?:\s*[;,]|\s)\s*(?:url\s*=\s*)?(.*)", 1)
        quoted = lambda x: F.when(x.rlike("^[\"']"), F.regexp_extract(x, "(?s)^([\"'])(.*?)(?:\\1|$)", 2)).otherwise(x)
        targets = F.concat(F.transform(canonical, lambda t: attribute(t, "href")), F.transform(refresh, lambda t: let(after(t), quoted)))
        targets = F.filter(F.transform(targets, _cleaned), lambda b: b != "")
        return let(base, lambda base: F.filter(F.transform(targets, lambda b: resolved(b, base)), lambda b: F.contains(b, F.lit("://"))))

    # a page without these words in plain or referenced letters has no such tag
    linked = pages.where(F.col(url).isNotNull() & F.col(html).rlike(r"(?i)canonical|http-equiv|rel\s*=[^>]*&"))
    return linked.select(F.col(url).alias("a"), F.explode(let(opening_tags(F.col(html), ["link", "meta", "base"]), lambda tags: links(tags, F.col(url)))).alias("b"))


def _cleaned(target: Column) -> Column:
    """Without blanks and control characters at its ends and line breaks and tabs inside, which urls do not have."""
    return F.regexp_replace(target, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")


def url_key(url: Column) -> Column:
    """What aliases are compared by: the url without fragment and its scheme's own port, scheme and host in lower case,
    an empty path as /, blanks as %20; null for what has no ://."""
    scheme, host = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), url_host(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = F.when(scheme == "http", F.regexp_replace(host, ":(?:80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(?:443)?$", "")).otherwise(host)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host, F.replace(rest, F.lit(" "), F.lit("%20"))))


def _forms(node: Column) -> Column:
    """A key as it is and with its scheme's port written out, for rules that name the port."""
    plain = ~url_host(node).rlike(":[0-9]*$")
    port = F.when(plain & F.startswith(node, F.lit("http://")), ":80").when(plain & F.startswith(node, F.lit("https://")), ":443")
    return F.array_compact(F.array(node, F.concat(F.regexp_extract(node, "(?s)^[^:]*://[^/]*", 0), port, F.regexp_extract(node, "(?s)^[^:]*://[^/]*(.*)", 1))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict ('allow' or 'block') to every row.

    Edges come from canonical links and refresh tags in `html` (None: not read) and from `redirects`
    (a, b). A rule decides its own urls. Any other url is blocked if an alias is blocked by a rule and no
    alias is explicitly allowed: within a component an explicit allow takes precedence over blocks that
    would be passed on. All else is allowed. Of equally long rules an allow wins, then the first by host and path. A null or malformed url has an empty host and path, fits no rule
    and has no aliases. Rows are neither merged nor lost; columns of the same names are replaced.
    """
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c not in (url, html)])
    pages, back = aside(pages, *(c for c in ("_action", "_key", "_passed", "_best") if c not in (url, html)))
    judged = match_rules(pages, rules, url)
    edges = [page_links(pages, url, html)] if html else []
    edges += [redirects.select("a", "b")] if redirects is not None else []
    own = F.coalesce(F.col("_action"), F.lit("allow"))
    if not edges:
        return judged.withColumn("verdict", own).drop("_action").withColumnsRenamed(back)
    links = edges[0].union(edges[1]) if len(edges) > 1 else edges[0]
    links = links.select(url_key(F.col("a")).alias("a"), url_key(F.col("b")).alias("b")).where("a is not null and b is not null")
    member = connected_components(links)
    decided = match_rules(member.withColumn("form", F.explode(_forms(F.col("node")))), rules, "form").where("_action is not null")
    groups = decided.groupBy("component").agg(F.bool_or(F.col("_action") == "block").alias("b"), F.bool_or(F.col("_action") == "allow").alias("a"))
    passed = member.join(groups.where("b and not a").hint("merge"), "component").select(F.col("node").alias("_key"), F.lit("block").alias("_passed"))
    passed = materialise(passed, "passed-on")
    size = passed.agg(F.coalesce(F.sum(F.octet_length("_key") + 64), F.lit(0))).first()[0]
    # broadcast only if all of it is small
    passed = F.broadcast(passed) if size <= MOST_BROADCAST else passed.hint("merge")
    judged = judged.withColumn("_key", url_key(F.col(url))).join(passed, "_key", "left")
    return judged.withColumn("verdict", F.coalesce("_action", "_passed", F.lit("allow"))).drop("_action", "_key", "_passed").withColumnsRenamed(back)
