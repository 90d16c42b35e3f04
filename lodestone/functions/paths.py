"""Path expressions: globs, ignore rules, fuzzy scores, related files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import base_name


def _segment(pattern: str) -> str:
    """One path segment's *, ?, [] as a regular expression."""
    out, k = "", 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end]
            body = "^" + body[1:] if body[0] in "^!" else body
            out += "[" + body.replace("\\", "\\\\") + "]"
            k = end
        elif ch == "\\" and k + 1 < len(pattern):
            k += 1
            out += _literal(pattern[k])
        else:
            out += _literal(ch)
        k += 1
    return out


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ch in "_/- " or ord(ch) > 127 else "\\" + ch


def glob_regex(pattern: str) -> str:
    """An anchored expression: ``**`` crosses folders, ``*`` does not; a pattern without a slash also fits the base name."""
    pattern = pattern.removeprefix("./")
    if "**" not in pattern:
        return ("^(?:.*/)?" if "/" not in pattern else "^") + _segment(pattern) + "$"
    parts = pattern.split("/")
    out = "^"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part.startswith("**"):
            rest = part[2:]
            out += (".*" if last else "(?:.*/)?") if not rest else f"(?:.*/)?{_segment(rest)}" + ("" if last else "/")
        else:
            out += _segment(part) + ("" if last else "/")
    return out + "$"


def glob_match(path: Column, pattern: str) -> Column:
    return F.regexp_replace(path, r"^\./", "").rlike("(?s)" + glob_regex(pattern))


def parse_ignore(text: str) -> list[dict]:
    """Rules of an ignore file: ``!`` negates, a trailing slash means folders only, a leading one is dropped."""
    rules = []
    for line in text.split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negate = line.startswith("!")
        line = line[1:].strip() if negate else line
        pattern = line.removesuffix("/").removeprefix("/")
        if pattern:
            rules.append({"negate": negate, "dir_only": line.endswith("/"), "pattern": pattern})
    return rules


def ignored(path: Column, is_dir: Column, layers: list[tuple[str, list[dict]]]) -> Column:
    """Layers are (folder, rules) from the root down; of all rules that fit, the last one decides."""
    tests = []
    for base, rules in layers:
        root = base in ("", ".")
        local = path if root else F.regexp_replace(path, rf"^\Q{base}/\E", "")
        inside = F.lit(True) if root else path.startswith(base + "/")
        for rule in rules:
            # a rule fits the whole local path, its base name, or any tail of it that begins a segment
            fits = local.rlike(f"(?s)(?:{glob_regex(rule['pattern'])}|{glob_regex('**/' + rule['pattern'])})")
            if rule["dir_only"]:
                fits = fits & is_dir
            tests.append(F.when(inside & fits, F.lit(not rule["negate"])))
    return F.coalesce(*reversed(tests), F.lit(False))


def normal_path(text: Column) -> Column:
    """Lower case, forward slashes, no white space."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("\\"), F.lit("/")), r"\s+", "")


def _subsequence(query: str, target: str) -> float | None:
    """In-order match: runs and boundary characters score, long spans dilute; null if a character is missing."""
    score, run, at = 0.0, 0, 0
    for ch in query:
        hit = target.find(ch, at)
        if hit < 0:
            return None
        if hit and (ch in "/_-." or ch.isspace()):
            score, run = score + 3, 0
        run += 1
        score += run if run > 1 else 0
        at = hit + 1
    return score * len(query.encode()) / (at + 1)


def fuzzy_score(path: Column, query: str) -> Column:
    """Tiers from equality to a substring, then an in-order subsequence; null if nothing fits."""
    q = "".join(query.lower().replace("\\", "/").split())
    if not q:
        return F.lit(None).cast("double")
    t = normal_path(path)
    base = base_name(t)
    share = F.lit(float(len(q.encode()))) / F.octet_length(t)

    def boundary(text: Column) -> Column:
        # the character looked at is the one where the match begins
        return (F.instr(text, q) == 1) | F.lit(q[0] in "/_-.")

    @F.pandas_udf("double")
    def spread(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _subsequence(q, x))

    return (
        F.when(t == "", F.lit(None).cast("double"))
        .when(t == q, 100.0)
        .when(base == q, 95.0)
        .when(t.endswith(q), 85 + share)
        .when(base.contains(q), 70 + F.when(boundary(base), 8).otherwise(0) + share)
        .when(t.contains(q), 55 + F.when(boundary(t), 6).otherwise(0) + share)
        .otherwise(spread(t))
    )


def resolve(paths: DataFrame, query: str, limit: int = 20, path_col: str = "path", shown_col: str | None = None) -> DataFrame:
    """Best paths for a query: score descending, then shorter, then by name. Scores go over ``path_col``."""
    query = query.strip().lstrip("@").strip("\"'")
    shown = F.col(shown_col or path_col)
    scored = paths.select(shown.alias("path"), fuzzy_score(F.col(path_col), query).alias("raw")).filter("raw IS NOT NULL")
    top = scored.orderBy(F.col("raw").desc(), F.octet_length("path"), "path").limit(limit)
    return top.select("path", (F.floor(F.col("raw") * 10 + 0.5) / 10).alias("score"))


# Extensions of one language family.
FAMILIES = {
    ".go": [".go"],
    ".ts": [".ts", ".tsx"],
    ".tsx": [".tsx", ".ts"],
    ".js": [".js", ".jsx"],
    ".jsx": [".jsx", ".js"],
    ".py": [".py"],
    ".rs": [".rs"],
    ".c": [".c", ".h"],
    ".h": [".h", ".c"],
    ".cpp": [".cpp", ".cc", ".cxx", ".hpp", ".h"],
    ".cc": [".cc", ".cpp", ".hpp", ".h"],
    ".cxx": [".cxx", ".cpp", ".hpp", ".h"],
    ".hpp": [".hpp", ".cpp", ".cc", ".cxx"],
    ".java": [".java"],
}
# End of fixed values.


def path_parts(path: Column) -> dict[str, Column]:
    """Folder, base name, stem, extension, whether it is a test, and the stem without the test mark."""
    base = base_name(path)
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    stem = F.left(base, F.length(base) - F.length(ext))
    low_ext, low = F.lower(ext), F.lower(stem)
    go_py = low_ext.isin(".go", ".py") & (stem.endswith("_test") | ((low_ext == ".py") & stem.startswith("test_")))
    js = low_ext.isin(".ts", ".tsx", ".js", ".jsx", ".rs") & (low.endswith(".test") | low.endswith(".spec"))
    test = go_py | js
    tail = low.rlike(r"(?:_test|\.test|\.spec)$")
    pair = F.when(test & tail, F.left(stem, F.length(stem) - 5)).when(test, F.substr(stem, F.lit(6))).otherwise(stem)
    return {"dir": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "base": base, "stem": stem, "ext": ext, "is_test": test, "pair": pair}


def related(paths: DataFrame, target: str, limit: int = 10, path_col: str = "path") -> DataFrame:
    """Files related to ``target`` by name and place: score descending, then path."""
    rows = paths.select(F.col(path_col).alias("path")).filter(F.col("path") != target)
    own = paths.sparkSession.createDataFrame([(target,)], "path string")
    own = {k: v for k, v in own.select(*[c.alias(k) for k, c in path_parts(F.col("path")).items()]).first().asDict().items()}
    rows = rows.select("path", *[c.alias(k) for k, c in path_parts(F.col("path")).items()])
    family = FAMILIES.get(own["ext"].lower(), [])
    same, kin = F.col("pair") == own["pair"], F.col("ext").isin(family) if family else F.lit(False)
    long_own = len(own["pair"].encode()) >= 4
    prefix = F.lit(long_own) & (F.octet_length("pair") >= 4) & (F.col("pair").startswith(own["pair"]) | F.startswith(F.lit(own["pair"]), F.col("pair")))
    score = F.when(same & kin & (F.col("is_test") != own["is_test"]), 100).when(same & kin, 90).when(same, 70).when(F.col("dir") == own["dir"], 40).when(prefix, 30)
    reason = (
        F.when(score == 100, F.concat(F.lit("test/impl pair with "), "base"))
        .when(score == 90, F.concat(F.lit(f"same stem ({own['ext']} ↔ "), "ext", F.lit(")")))
        .when(score == 70, "same stem, other extension")
        .when(score == 40, F.concat(F.lit("sibling in "), "dir"))
        .otherwise("stem prefix match")
    )
    hits = rows.select("path", score.cast("double").alias("score"), reason.alias("reason")).filter("score IS NOT NULL")
    return hits.orderBy(F.col("score").desc(), "path").limit(limit)


def wildcard_only(pattern: str) -> bool:
    """True for a search pattern with metacharacters but nothing literal to find."""
    k, meta = 0, False
    while k < len(pattern):
        ch = pattern[k]
        if ch == "\\" and pattern[k + 1 : k + 2] in ("b", "B", "A", "z", "Z", "\\"):
            meta, k = True, k + 2
            continue
        if ch in ".*+?^$|()[]{}\\":
            meta = True
        elif not ch.isspace():
            return False
        k += 1
    return meta


def display_path(path: Column, roots: list[str]) -> Column:
    """Relative to the first root that holds it, else unchanged."""
    out = path
    for root in reversed(roots):
        out = F.when(path == root, F.lit(".")).when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2))).otherwise(out)
    return out


def inside(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root + "/")
    return out
