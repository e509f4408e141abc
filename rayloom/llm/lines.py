"""Line dedup by site-relative frequency, in DataFrame functions only.

Rows are grouped by host; a line is boilerplate on a host if at least `min_pages` of the host's
pages hold it and their share of the host's pages is above `ratio`. All its occurrences on that
host are dropped, the other lines stay in place and order.

Only 128-bit line keys are shuffled and counted, pre-aggregated before the shuffle, so a line
that stands on a third of all pages costs one row per task. Pages meet the boilerplate keys in
a join on (host, key), which the adaptive planner can split where one key is hot; the texts
themselves move once, to meet their page's list of dropped keys.

Defined results: a null text stays null, has no lines and loses none; an empty line (no visible
character) is never counted nor dropped; a null host is a host of its own; rows are told apart
by their place in the input, so rows that repeat are pages of their own. Very long texts are taken
whole; an empty table gives no rows. Other columns pass through untouched, but for input columns named
`line_dedup` (the result's own takes its place) and `__row`, `__host`, `__keys` and `__drop`, which are
used up on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Production parameters.
RATIO, MIN_PAGES = 0.1, 5


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port and user; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def html_lines(html: Column) -> Column:
    """The visible text of a page, one block to a line: scripts, styles, comments and tags go."""
    t = F.regexp_replace(html, r"(?is)<(?:script.*?</script|style.*?</style)>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)</?(p|br|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|title|table|tr|td|head|body|html)(\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(t, r"[ \t]*\n[ \t\n]*", "\n"), F.lit(" \n\t"))


def _line_key(line: Column) -> Column:
    line = F.trim(line, F.lit(" \t\r"))
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")))


def line_dedup(df: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`df` with `text` cleaned, plus `n_lines` and `n_dropped` (longs) in the struct `line_dedup`."""
    keys = F.transform(F.split(F.col(text), "\n", -1), _line_key)
    site = F.coalesce(F.concat(F.lit("h"), host), F.lit("n"))
    # read, cleaned and hashed once: three uses follow, and the row numbers are settled
    own = cut(df.withColumns({"__row": F.monotonically_increasing_id(), "__host": site, "__keys": keys}), "lines")
    total = own.groupBy("__host").agg(F.count("*").alias("pages"))
    lines = own.select("__row", "__host", F.explode(F.array_distinct(F.array_compact("__keys"))).alias("k")).select("__row", "__host", "k.a", "k.b")
    counted = lines.groupBy("__host", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    boiler = counted.join(total, "__host").where(F.col("n") > ratio * F.col("pages")).select("__host", "a", "b")
    dropped = lines.join(boiler, ["__host", "a", "b"], "left_semi").groupBy("__row").agg(F.collect_set(F.struct("a", "b")).alias("__drop"))
    own = own.join(dropped, "__row", "left")
    gone = lambda k: F.coalesce(F.array_contains(F.col("__drop"), k), F.lit(False))
    left = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~gone(F.get(F.col("__keys"), i)))
    kept = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    counts = F.struct(n(F.array_compact("__keys")).alias("n_lines"), F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(n(F.filter("__keys", gone))).cast("long").alias("n_dropped"))
    return own.select(*[kept.alias(text) if c == text else F.col(c) for c in df.columns if c != "line_dedup"], counts.alias("line_dedup"))
