"""Browser, terminal and clipboard captures as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions.text import strip


def host(url: Column) -> Column:
    """Lower-case host of a URL, null where it cannot be parsed."""
    return F.lower(F.regexp_extract(F.try_parse_url(url, F.lit("HOST")), "^(.*)$", 1))


def is_excluded(name: Column, patterns: tuple[str, ...] = config.EXCLUDED_DOMAINS) -> Column:
    """`*.x` ends with x; `x.*` starts with `x.`; else the host itself or a subdomain. Null hosts are not excluded."""
    tests = [
        F.endswith(name, F.lit(p[2:])) if p.startswith("*.") else F.startswith(name, F.lit(p[:-1])) if p.endswith(".*") else (name == p) | F.endswith(name, F.lit("." + p))
        for p in (p.lower() for p in patterns)
    ]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def is_login_page(html: Column) -> Column:
    low = F.lower(html)
    return F.contains(low, F.lit("<form")) & F.contains(low, F.lit("password"))


def browser_documents(rows: DataFrame, patterns: tuple[str, ...] = config.EXCLUDED_DOMAINS) -> DataFrame:
    """(url, title, visited_at, browser) rows as raw documents, excluded hosts left out."""
    kept = rows.filter(F.startswith("url", F.lit("http")) & ~is_excluded(host(F.col("url")), patterns))
    content = F.concat_ws("\n", F.coalesce("title", F.lit("")), "url")
    return kept.select(F.lit("browser").alias("source_type"), F.col("url").alias("source_path"), content.alias("content"), F.col("visited_at").alias("captured_at"), F.sha2(content, 256).alias("checksum"), F.create_map(F.lit("url"), "url", F.lit("title"), F.coalesce("title", F.lit("")), F.lit("browser"), "browser").alias("source_metadata"), F.lit(2).alias("priority"))


def new_visits(visits: DataFrame, urls: DataFrame, after: int, limit: int = 200) -> DataFrame:
    """Visits with an id over `after`, oldest first, at most `limit`; keep one `after` per browser."""
    return visits.alias("v").join(urls.alias("u"), F.col("v.url") == F.col("u.id")).filter((F.col("v.id") > after) & F.startswith("u.url", F.lit("http"))).select(F.col("v.id").alias("visit_id"), F.col("u.url").alias("url"), F.col("u.title").alias("title"), F.col("v.visit_time").alias("visit_time")).orderBy("visit_id").limit(limit)


def commands(history: Column) -> Column:
    """Commands of a shell history text: time stamps off, groups parted by blank lines, at least 3 characters."""
    lines = F.transform(F.split(history, "\n"), lambda x: F.regexp_replace(x, r"^: [^;]*;", ""))
    groups = F.split(F.array_join(lines, "\n"), r"\n[ \t]*\n")
    return F.filter(F.transform(groups, strip), lambda x: F.length(x) >= 3)


def terminal_documents(rows: DataFrame) -> DataFrame:
    """(path, history, captured_at) rows as one raw document per distinct command."""
    split = rows.select("path", "captured_at", F.posexplode(commands(F.col("history"))).alias("position", "command"))
    shell = F.when(F.contains("path", F.lit("zsh")), F.lit("zsh")).otherwise(F.lit("bash"))
    first = F.row_number().over(Window.partitionBy("checksum").orderBy("captured_at", "path", "position"))
    return split.withColumn("checksum", F.sha2("command", 256)).withColumn("_n", first).filter("_n = 1").select(F.lit("terminal").alias("source_type"), F.col("path").alias("source_path"), F.col("command").alias("content"), "captured_at", "checksum", F.create_map(F.lit("shell"), shell, F.lit("preview"), F.substring("command", 1, 200)).alias("source_metadata"), F.lit(1).alias("priority"))


def clipboard_changes(polls: DataFrame, stream: str, order: str, content: str) -> DataFrame:
    """Polls whose content is not blank and differs from the poll before of the same stream."""
    w = Window.partitionBy(stream).orderBy(order)
    kept = polls.filter(F.length(strip(F.col(content))) > 0).withColumn("checksum", F.sha2(content, 256))
    return kept.withColumn("_before", F.lag("checksum").over(w)).filter(~F.col("checksum").eqNullSafe(F.col("_before"))).drop("_before")
