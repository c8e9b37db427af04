"""Path expressions: parts, languages, exclusions, globs."""

import re

from pyspark.sql import Column, functions as F

from riskweave.rules import catalog as c

# File name extensions by language.
EXTENSIONS = {
    "python": [".py"],
    "javascript": [".js", ".mjs", ".cjs"],
    "typescript": [".ts", ".mts"],
    "go": [".go"],
}
UNKNOWN = "unknown"
# Generated files, by lower-case name.
GENERATED_NAME = (r"(\.d\.ts|\.d\.mts|\.cjs|\.min\.js|\.min\.mjs|\.min\.cjs|\.bundle\.js|\.bundle\.mjs)$"
                  r"|^bundle\.m?js$|-bundle\.|_bundle\.")
# Test files; "mock" is looked up in the lower-case name.
TEST_NAME = r"(_test\.go|\.test\.js|\.test\.ts|\.spec\.js|\.spec\.ts|\.test\.mjs|\.spec\.mjs|_test\.py)$|^test_"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash, '' for a bare name."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*\z", 0))


def language(path: Column) -> Column:
    ext = extension(path)
    expr = F.when((ext == ".json") & F.lower(base_name(path)).isin(c.CONFIG_FILES), "json")
    for name, extensions in EXTENSIONS.items():
        expr = expr.when(ext.isin(extensions), name)
    return expr.otherwise(UNKNOWN)


def in_excluded_dir(path: Column) -> Column:
    """One of the directories above the file is a dependency, build, VCS or test one."""
    names = "|".join(re.escape(n) for n in c.DEPENDENCY_DIRS + c.TEST_DIRS)
    return path.rlike(rf"(?:^|/)(?:{names})/")


def is_generated(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(GENERATED_NAME)


def is_test_file(path: Column) -> Column:
    base = base_name(path)
    return base.rlike(TEST_NAME) | F.contains(F.lower(base), F.lit("mock"))


def _steps(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root``, ``.`` for the root itself, with ``..`` steps for a path outside it; a relative path stays."""
    own, base = _steps(path), _steps(root)
    common = F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(base), F.lit(1))), lambda n: (n > 0) & (n <= F.size(base)) & (F.slice(own, F.lit(1), n) == F.slice(base, F.lit(1), n))))
    up = F.array_repeat(F.lit(".."), F.size(base) - common)
    out = F.array_join(F.concat(up, F.slice(own, common + 1, F.greatest(F.size(own) - common, F.lit(0)))), "/")
    return F.when(F.startswith(path, F.lit("/")) & F.startswith(root, F.lit("/")), F.when(out == "", ".").otherwise(out)).otherwise(path)


def join_path(directory: Column, relative: Column) -> Column:
    """Join and clean: no empty or '.' steps, '..' takes back the step before it; '.' if nothing is left."""
    rooted = F.startswith(directory, F.lit("/"))
    resolved = F.aggregate(
        _steps(F.concat_ws("/", directory, relative)), F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
                              F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & rooted, acc)
        .otherwise(F.concat(acc, F.array(s))))
    clean = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(resolved, "/"))
    return F.when(clean == "", ".").otherwise(clean)


# One token of a glob: escaped character, class, or single character.
_GLOB_TOKEN = r"(?s)\\.|\[\^?(?:\\.|[^\]\\])+\]|."


def glob_to_regex(glob: Column) -> Column:
    """A regular expression for whole paths, equivalent to matching the glob with the
    path, its base name, (globs with a slash) every trailing sub-path, and, for
    ``dir/**``, everything at or below ``dir``.  Translated once per rule row."""
    tokens = F.regexp_extract_all(glob, F.lit(_GLOB_TOKEN), F.lit(0))
    body = F.array_join(F.transform(tokens, _glob_token), "")
    lead = F.when(F.contains(glob, F.lit("/")), r"(?:.*/)?").otherwise(r"(?:.*/(?=[^/]*\z))?")
    below = F.when(
        F.endswith(glob, F.lit("/**")),
        F.concat(F.lit("|(?:^|/)"), _literal(F.substring(glob, F.lit(1), F.length(glob) - 3)),
                 F.lit(r"(?:/|\z)"))).otherwise("")
    return F.concat(F.lit("(?s)^"), lead, body, F.lit(r"\z"), below)


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([^0-9A-Za-z_/])", r"\\$1")


def _glob_token(token: Column) -> Column:
    in_class = F.replace(F.replace(F.substring(token, F.lit(2), F.length(token) - 2),
                                   F.lit("["), F.lit("\\[")), F.lit("&"), F.lit("\\&"))
    return (F.when(token == "*", "[^/]*")
            .when(token == "?", "[^/]")
            .when(token.isin("[", "\\"), "(?!)")
            .when(token.rlike(r"^\[\^?[-\]]"), "(?!)")
            .when(F.startswith(token, F.lit("[")) & (F.length(token) > 1),
                  F.concat(F.lit("["), in_class, F.lit("]")))
            .when(F.startswith(token, F.lit("\\")), _literal(F.substring(token, 2, 1)))
            .otherwise(_literal(token)))


def glob_match(path: Column, regex: Column) -> Column:
    """Does the path fall under a translated glob?  No path, no match."""
    return F.coalesce(path != "", F.lit(False)) & F.coalesce(F.regexp_like(path, regex), F.lit(False))
