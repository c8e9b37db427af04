"""Targets: what they are, what they are called, which servers configure them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


CONFIG = "mcpServers map<string,struct<command:string,args:array<string>,env:map<string,string>>>"
# The file at a project's root that tells its language, first one wins.
PROJECT_FILES = [("package.json", "javascript"), ("pyproject.toml", "python"), ("requirements.txt", "python"), ("setup.py", "python"), ("go.mod", "go")]


def servers(configs: DataFrame) -> DataFrame:
    """One row for each server that a client configuration (path, content) names."""
    parsed = configs.select("path", F.from_json("content", CONFIG).alias("c"))
    return parsed.select(F.explode("c.mcpServers").alias("name", "s"), F.col("path").alias("source")).select("name", "s.command", "s.args", "s.env", "source")


def coverage(found: DataFrame) -> DataFrame:
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("servers"))


def server_target(command: Column, args: Column) -> Column:
    """The first argument that isn't a flag, else the command."""
    return F.coalesce(F.get(F.filter(args, lambda a: (a != "") & ~F.startswith(a, F.lit("-"))), 0), command)


def target_kind(target: Column) -> Column:
    local = target.rlike(r"^(\./|\.\./|/|~)")
    return F.when(local, "local").when(F.startswith(target, F.lit("github:")), "github").when(F.startswith(target, F.lit("@")) | ~F.contains(target, F.lit("/")), "npm").otherwise("local")


def sweep_target(install: Column, package: Column, repo: Column) -> Column:
    path = F.replace(repo, F.lit("https://github.com/"), F.lit(""))
    return F.when((install == "npm") & (F.coalesce(package, F.lit("")) != ""), package).otherwise(F.concat(F.lit("github:"), F.substring_index(path, "/", 2)))


def safe_name(target: Column) -> Column:
    """A name for files: marks of packages and paths as hyphens, runs of hyphens as one, none at either end."""
    out = F.regexp_replace(F.translate(target, "@/ ()", "-----"), "-{2,}", "-")
    return F.regexp_replace(out, "^-|-\\z", "")


def project_language(files: DataFrame) -> DataFrame:
    """target and language, by the first telling file at its root."""
    rank, lang = F.lit(None).cast("int"), F.lit("unknown")
    for i, (name, language) in reversed(list(enumerate(PROJECT_FILES))):
        rank = F.when(F.col("path") == name, i).otherwise(rank)
    best = files.groupBy("target").agg(F.min(rank).alias("rank"))
    for i, (_, language) in enumerate(PROJECT_FILES):
        lang = F.when(F.col("rank") == i, language).otherwise(lang)
    return best.select("target", lang.alias("language"))


def limit_targets(targets: DataFrame, n: int, order: str = "pos") -> DataFrame:
    return targets.orderBy(order).limit(n)
