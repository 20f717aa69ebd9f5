"""URL filters by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import UPPER

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of a digest that are joined on; the full digest is compared afterwards.
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    empty for a null url or one without ``://``."""
    host = F.regexp_extract(url, PARTS, 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where ``host_of`` finds none."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One verdict per row of ``pages`` (``page_id``, ``url``; other columns are not read).

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and
    all subdomains where the url's path starts with the rule's. Among the rules that fit, the
    longest ``host`` + ``path`` wins, then the longer host, then block; without one the verdict is
    ``default``, as a list only speaks about what it names. Returns ``page_id, host, path, rule,
    verdict``, one row per input row: repeated rows are judged alike, a null url has an empty host
    and path and gets the default. Rules with a null or empty host, a null path or a null verdict
    fit nothing. Empty tables of pages or of rules are fine.

    Each distinct url is expanded only into the shapes (number of host labels, length of path)
    that some rule has, so a host of a thousand labels costs no more than the rules do. The
    expressions meet the rules on a short prefix of their digests; then the full digest decides.
    """
    known = rules.where(
        "host is not null and host <> '' and path is not null and verdict is not null"
    ).select(
        F.translate("host", UPPER, UPPER.lower()).alias("_host"),
        F.col("path").alias("_path"),
        F.col("verdict").alias("_verdict"),
    )
    known = known.withColumn("_rule", F.concat("_host", "_path"))
    shapes = known.agg(
        F.collect_set(F.struct(_labels(F.col("_host")).alias("labels"), F.length("_path").alias("chars")))
    ).scalar()
    digests = known.select(
        "_host",
        "_rule",
        "_verdict",
        F.sha2("_rule", 256).alias("_digest"),
        F.substring(F.sha2("_rule", 256), 1, PREFIX_DIGITS).alias("_prefix"),
    )
    parsed = pages.select(
        F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    urls = parsed.where("host <> ''").select("host", "path").distinct()
    fits = (F.col("_shape.labels") <= _labels(F.col("host"))) & (F.col("_shape.chars") <= F.length("path"))
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("_shape.labels"))
    expanded = (
        urls.select("host", "path", F.explode(shapes).alias("_shape"))
        .where(fits)
        .select("host", "path", F.concat(suffix, F.substring("path", F.lit(1), F.col("_shape.chars"))).alias("_expression"))
    )
    hashed = expanded.select(
        "host",
        "path",
        F.sha2("_expression", 256).alias("_full"),
        F.substring(F.sha2("_expression", 256), 1, PREFIX_DIGITS).alias("_prefix"),
    )
    hits = hashed.join(digests, "_prefix").where(F.col("_full") == F.col("_digest"))
    order = F.struct(
        F.length("_rule").alias("length"),
        F.length("_host").alias("host_length"),
        (F.col("_verdict") == "block").alias("blocks"),
        F.col("_rule").alias("rule"),
        F.col("_verdict").alias("verdict"),
    )
    best = hits.groupBy("host", "path").agg(F.max(order).alias("_best"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
