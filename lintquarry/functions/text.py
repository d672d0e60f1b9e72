"""Text functions: paths, patterns, labels, literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(content: Column) -> Column:
    """The lines of a text, whichever way they end; none for what follows the last line break if it is empty."""
    parts = F.split(content, r"\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines_between(content: Column, s: Column, e: Column) -> Column:
    """The lines s to e of a text (from 1), joined and without white space at either end; the empty text if there are none."""
    lines = lines_of(content)
    inside = (s >= 1) & (e >= s) & (s <= F.size(lines))
    return F.when(inside, trimmed(F.array_join(F.slice(lines, F.greatest(s, F.lit(1)), F.greatest(e - s + 1, F.lit(0))), "\n"))).otherwise("")


def trimmed(c: Column) -> Column:
    """Without control characters and spaces at either end."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def not_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(not_blank(c), c)


def file_name(path: Column) -> Column:
    return F.coalesce(F.substring_index(path, "/", -1), F.lit(""))


def short_path(path: Column) -> Column:
    """At most 40 characters of a path with folders: dots, then its end."""
    return F.when(path.isNull(), "-").when(path.contains("/") & (F.length(path) > 40), F.concat(F.lit("..."), F.right(path, F.lit(37)))).otherwise(path)


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 1)), F.lit("…")))


def markdown_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def is_test_file(path: Column) -> Column:
    """Test sources as the scan sees them."""
    return path.contains("/test/") | path.startswith("test/") | path.endswith("Test.java") | path.endswith("Tests.java")


def is_test_path(path: Column) -> Column:
    """Test sources as the checkers see them: no leading folder, backslashes too."""
    return path.contains("/test/") | path.contains("\\test\\") | path.endswith("Test.java") | path.endswith("Tests.java")


def is_system_junk(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: (s == "__MACOSX") | (s == ".DS_Store") | s.startswith("._"))


def is_code_line(line: Column) -> Column:
    t = F.trim(line)
    return (t != "") & ~t.startswith("//") & ~t.startswith("*")


def longest_literal(line: Column) -> Column:
    """Length, in UTF-16 units, of the longest quoted literal, quotes included; one that isn't closed runs to the end."""
    found = F.regexp_extract_all(line, F.lit(r"(\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)"), 1)
    return F.coalesce(F.array_max(F.transform(found, lambda x: utf16_length(x))), F.lit(0))


def significant_words(c: Column) -> Column:
    """Lower-cased words of four letters or more, cut at signs and inner capitals."""
    humps = F.flatten(F.transform(F.split(c, r"[^A-Za-z0-9]+"), lambda w: F.split(w, r"(?<=[a-z0-9])(?=[A-Z])")))
    return F.array_distinct(F.filter(F.transform(humps, lambda w: F.lower(w)), lambda w: F.length(w) >= 4))


def line_label(points: Column) -> Column:
    """Closed intervals as text: 3, or 3-5, joined."""
    one = lambda p: F.when(p["s"] == p["e"], p["s"].cast("string")).otherwise(F.concat(p["s"].cast("string"), F.lit("-"), p["e"].cast("string")))
    return F.array_join(F.transform(points, one), "、")


def debt_text(minutes: Column) -> Column:
    """Minutes as days and hours, hours and minutes, or minutes; a day has 24 hours, and minutes beside days are dropped."""
    d, h, m = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60), minutes % 60
    s = lambda c: c.cast("bigint").cast("string")
    days = F.concat(s(d), F.lit("d"), F.when(h > 0, F.concat(F.lit(" "), s(h), F.lit("h"))).otherwise(""))
    hours = F.concat(s(h), F.lit("h"), F.when(m > 0, F.concat(F.lit(" "), s(m), F.lit("m"))).otherwise(""))
    return F.when(minutes <= 0, "0m").when(d > 0, days).when(h > 0, hours).otherwise(F.concat(s(m), F.lit("m")))


# ---------------------------------------------------------------- globs


def path_glob(pattern: str) -> str:
    """A regular expression for a file glob: * and ? within a segment, ** across segments, [...] and {a,b}."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            n = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            out += ".*" if n > 1 else "[^/]*"
            i += n
            continue
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            negated = inner.startswith("!")
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", inner[negated:]) + "]"
            i = end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def branch_glob(pattern: str, legacy: bool = False) -> str:
    """A regular expression for a branch pattern; legacy: the result of rewriting the pattern's signs one after another, so that
    signs which an earlier rewriting has put in are rewritten again."""
    if not legacy:
        out = re.escape(pattern).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace("\0", ".*").replace(r"\?", "[^/]")
        return f"^{out}$"
    for sign, by in ((".", "\\."), ("**/", "(.*/)?"), ("*", "[^/]*"), ("?", "[^/]")):
        pattern = pattern.replace(sign, by)
    return f"^{pattern}$"


# ---------------------------------------------------------------- repositories


def repo_path(url: Column) -> Column:
    """owner/name of a clone address: scheme, host, trailing slashes and .git taken off (of an ssh address the owner too: the
    host is gone by the time the first part is taken off)."""
    out = F.trim(url)
    for pattern in (r"^[a-zA-Z][a-zA-Z0-9+.-]*://", r"^git@[^:/]+:", r"^[^/]+/", r"/+$", r"(?i)\.git$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def owner_repo(url: Column) -> Column:
    path = repo_path(url)
    return F.when(path.contains("/"), path)


def in_repo_scope(url: Column, scope: Column) -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(F.trim(scope), r"/+$", ""), r"(?i)\.git$", ""))
    path = F.lower(repo_path(url))
    return F.when(F.coalesce(F.trim(scope), F.lit("")) == "", True).otherwise(F.coalesce((path == s) | path.endswith(F.concat(F.lit("/"), s)), F.lit(False)))


def commit_id(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9a-fA-F]{4,64}$"), c)


def request_id(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,10}$"), c)


def database_type(url: Column) -> Column:
    """The database that a JDBC address names: UNKNOWN for null, CUSTOM for others."""
    # Address beginnings and the names that they stand for.
    kinds = {
        "h2": "H2", "mysql": "MYSQL", "mariadb": "MARIADB", "oracle": "ORACLE", "postgresql": "POSTGRESQL", "opengauss": "OPENGAUSS", "kingbase8": "KINGBASE", "highgo": "HIGHGO",
        "vastbase": "VASTBASE", "dm": "DM", "yasdb": "YASHANDB", "sqlserver": "SQLSERVER", "db2": "DB2", "oceanbase": "OCEANBASE", "gbasedbt-sqli": "GBASE8S", "gbasedbt": "GBASE8S", "oscar": "OSCAR",
    }
    out = F.when(url.isNull(), "UNKNOWN").otherwise("CUSTOM")
    for start, name in kinds.items():
        out = F.when(F.lower(url).startswith(f"jdbc:{start}:"), F.lit(name)).otherwise(out)
    return out


# ---------------------------------------------------------------- templates and JSON


def render(template: Column, values: Column) -> Column:
    """${name} replaced by the map's value, once: what a value brings in is not read again. Unknown names stay; \\${ is a plain ${."""
    parts = F.split(template, r"(?=(?<!\\)\$\{[^}]+\})|(?<=\})")
    name = lambda p: trimmed(F.substring(p, F.lit(3), F.length(p) - 3))
    filled = F.transform(parts, lambda p: F.when(p.rlike(r"^\$\{[^}]+\}$"), F.coalesce(F.try_element_at(values, name(p)), p)).otherwise(p))
    return F.replace(F.array_join(filled, ""), F.lit("\\${"), F.lit("${"))


def json_array(text: Column) -> Column:
    """From the first [ to the last ]; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def json_int(text: Column, key: str, default: int) -> Column:
    return F.coalesce(F.get_json_object(text, f"$.{key}").try_cast("int"), F.lit(default))


def json_path(text: Column, path: str | None) -> Column:
    """What stands in a JSON text at a path like a[0].b.c, as text; null for no path and for what isn't there."""
    return F.get_json_object(text, f"$.{path}" if not path.startswith("[") else f"${path}") if path else F.lit(None).cast("string")


def partner_location(description: Column) -> Column:
    """The second place, file:from-to, that a duplicate's description in the older wording names."""
    # Fixed value: how that wording introduces the second place.
    found = F.regexp_extract(description, r"位置二：(.+:\d+-\d+)", 1)
    return F.when(found != "", found)
