"""Lint, incremental compilation and output of a knowledge base: articles are rows of path, title, category, content, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweft.functions.exprs import slug, summary_of, title_of, wikilinks
from panelweft.operators.text import concept_map, jaccard_pairs, most_common, orphans, search

CONCEPTS = "concepts/"


def articles(files: DataFrame, path: str = "path", content: str = "content", category: str = "category") -> DataFrame:
    """(path, title, category, content, links, has_summary) of wiki files."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    group = F.col(category) if category in files.columns else F.regexp_extract(path, r"^(?:.*/)?([^/]+)/[^/]+$", 1)
    return files.select(F.col(path).alias("path"), title_of(content, name).alias("title"), group.alias("category"), F.col(content).alias("content"), wikilinks(content).alias("links"), F.col(content).rlike(r"(?m)^> \*\*Summary\*\*:").alias("has_summary"))


def _finding(df: DataFrame, check: str, severity: str, item, detail) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), item.cast("string").alias("item"), detail.cast("string").alias("detail"))


def missing_summaries(docs: DataFrame) -> DataFrame:
    """Articles, concept stubs aside, without a summary section."""
    return docs.filter(~F.col("has_summary") & ~F.startswith("path", F.lit(CONCEPTS)))


def stale_sources(sources: DataFrame) -> DataFrame:
    """Sources (original_name, compiled) that aren't compiled."""
    return sources.filter(~F.coalesce("compiled", F.lit(False)))


def unlinked(docs: DataFrame) -> DataFrame:
    """Articles, concept stubs aside, whose title no link names."""
    return orphans(docs, "title", "links").filter(~F.startswith("path", F.lit(CONCEPTS)))


def dangling(docs: DataFrame) -> DataFrame:
    """(path, link): links whose target no article has as title, an occurrence a row."""
    return docs.select("path", F.explode("links").alias("link")).join(docs.select(F.col("title").alias("link")).distinct(), "link", "left_anti").select("path", "link")


def token_set(content) -> Column:
    """Distinct runs of three word characters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(r"(?U)\w{3,}"), F.lit(0)))


def unbalanced(docs: DataFrame) -> DataFrame:
    """(folder, n, mean): first folders that hold one article where the mean is over 3, or over four times the mean and over 10.

    Articles outside folders are in `root`; with one folder alone nothing is out of balance.
    """
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("root")
    n = docs.groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))
    mean = n.agg(F.avg("n").alias("mean"), F.count("*").alias("_folders"))
    return n.crossJoin(F.broadcast(mean)).filter((F.col("_folders") > 1) & ((F.col("n") == 1) & (F.col("mean") > 3) | (F.col("n") > F.col("mean") * 4) & (F.col("n") > 10))).drop("_folders")


def lint(docs: DataFrame, sources: DataFrame | None = None, *, duplicates: bool = True, threshold: float = 0.85) -> DataFrame:
    """(check, severity, item, detail) of all checks; paths are relative to the wiki's folder."""
    out = _finding(unlinked(docs), "orphan_detection", "warning", F.col("path"), F.col("title"))
    out = out.unionByName(_finding(dangling(docs), "broken_links", "error", F.col("path"), F.col("link")))
    out = out.unionByName(_finding(missing_summaries(docs), "missing_summaries", "warning", F.col("path"), F.col("title")))
    if sources is not None:
        out = out.unionByName(_finding(stale_sources(sources), "stale_sources", "info", F.concat(F.lit("raw/"), F.col("original_name")), F.col("original_name")))
    if duplicates:
        pairs = jaccard_pairs(docs.select("path", token_set("content").alias("tokens")), "path", "tokens", threshold)
        out = out.unionByName(_finding(pairs, "duplicate_content", "warning", F.col("a"), F.col("b")))
    return out.unionByName(_finding(unbalanced(docs), "category_balance", "info", F.col("folder"), F.col("n")))


def lint_summary(findings: DataFrame) -> DataFrame:
    """(check, severity, n)."""
    return findings.groupBy("check", "severity").agg(F.count("*").alias("n"))


def pending(sources: DataFrame, compiled: DataFrame, key: str = "sha256") -> DataFrame:
    """What an incremental compile has to do: sources whose content wasn't compiled yet."""
    return sources.join(compiled.select(key).distinct(), key, "left_anti")


def compiled(sources: DataFrame, *, name: str = "original_name", content: str = "content") -> DataFrame:
    """(path, title, summary, content) of the articles that sources become."""
    title = title_of(content, F.regexp_replace(name, r"\.[^.]*$", ""))
    return sources.select(F.concat(slug(title), F.lit(".md")).alias("path"), title.alias("title"), summary_of(content).alias("summary"), F.col(content).alias("content"))


def concept_stubs(docs: DataFrame, title: str, concepts: str, least: int = 3) -> DataFrame:
    """(path, concept, n, body): a page for every concept that at least so many articles have."""
    c = concept_map(docs, title, concepts, least)
    lines = F.array_join(F.transform("articles", lambda a: F.concat(F.lit("- [["), a, F.lit("]]"))), "\n")
    return c.select(F.concat(F.lit(CONCEPTS), slug("concept"), F.lit(".md")).alias("path"), "concept", "n", F.concat(F.lit("# "), F.col("concept"), F.lit("\n\n"), lines).alias("body"))


def master_index(docs: DataFrame, concepts: str | None = None, top: int = 50) -> DataFrame:
    """(section, line): articles by category, then the most common concepts with their counts."""
    out = docs.select(F.col("category").alias("section"), F.concat(F.lit("- [["), F.col("title"), F.lit("]]")).alias("line"))
    if concepts:
        c = most_common(docs.select(F.explode(F.array_distinct(concepts)).alias("c")), "c", top)
        out = out.unionByName(c.select(F.lit("Concepts").alias("section"), F.concat(F.lit("- "), F.col("value"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line")))
    return out


def report(docs: DataFrame, query: str, *, id_col: str = "path", title: str = "title", text: str = "content", top: int = 5) -> str:
    """A report on a query: its best articles with their summaries."""
    found = search(docs, query, id_col=id_col, text_col=text, title_col=title, top=top)
    rows = found.join(docs.select(id_col, title, summary_of(text).alias("_s")), id_col).orderBy(F.desc("score"), id_col).collect()  # at most top
    parts = [f"# {query}", f"{len(rows)} articles"] + [f"## {r[title]}\n\n{r['_s']}\n\nScore {r['score']}" for r in rows]
    return "\n\n".join(parts) + "\n"


def slides(docs: DataFrame, query: str, *, id_col: str = "path", title: str = "title", text: str = "content", top: int = 8) -> str:
    """The same as slides: one for each article, parted by rules."""
    head, *rest = report(docs, query, id_col=id_col, title=title, text=text, top=top).split("\n\n## ")
    return "\n\n---\n\n".join([head, *(f"## {r.rstrip()}" for r in rest)]) + "\n"


