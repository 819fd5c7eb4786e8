"""Scalar functions on names, paths and prose as Column builders: all stay in generated code, none is a Python UDF.

Nulls stay null, empty texts give empty results; see each function for what differs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _in(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def split_name(c: Column | str) -> Column:
    """Words of a camel, Pascal, snake, kebab or dotted name, lower case, in order."""
    spaced = F.regexp_replace(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.split(spaced, r"[\s\-_./]+", -1), F.lower)


def tokenize_name(c: Column | str) -> Column:
    """``split_name`` without stop words and words of one character."""
    return F.filter(split_name(c), lambda t: (F.length(t) > 1) & ~t.isin(*K.NAME_STOP_WORDS))


def symbol_tokens(c: Column | str) -> Column:
    """Words of an identifier, digits counted as lower case letters, without any stop list."""
    spaced = F.regexp_replace(F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(spaced, "[^A-Za-z0-9]+", -1), lambda t: t != ""), F.lower)


def extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), r"\.([A-Za-z0-9]+)$", 1))


def language_of_path(c: Column | str) -> Column:
    """Language of a path: by extension, ``.env*`` and ``Jenkinsfile*`` by name; null if unknown."""
    name, ext = F.element_at(F.split(_col(c), "/"), -1), extension(c)
    table = F.create_map(*[F.lit(x) for kv in K.EXTENSION_LANGUAGE.items() for x in kv])
    return F.when(name.rlike(r"^\.env(\.|$)"), "env").when(name.rlike("^Jenkinsfile"), "groovy").otherwise(F.try_element_at(table, ext))


def dirs_of(c: Column | str) -> Column:
    parts = F.split(_col(c), "/", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def under_excluded_dir(c: Column | str) -> Column:
    """A directory segment (not the file's name) is hidden or excluded."""
    return F.exists(dirs_of(c), lambda d: d.startswith(".") | d.isin(*K.EXCLUDED_DIRS))


def is_generated_name(c: Column | str) -> Column:
    return _col(c).rlike(r"(\.generated\.|\.pb\.|_generated\.|_pb\.)")


# The patterns of the next functions, of test files, documents, styles and vendored paths.
def is_test_filename(name: Column) -> Column:
    lower, stem = F.lower(name), F.regexp_replace(name, r"\.[^.]+$", "")
    return (
        lower.rlike(r"\.(test|spec|mock|e2e|cy)\.[a-z]+$") | lower.rlike(r"_(tests?|specs?)\.[a-z]+$") | lower.rlike(r"^test_.+\.(py|cpp|cc|cxx|h|hpp)$")
        | (lower == "conftest.py") | stem.rlike("(Test|Tests|Spec|Specs|ITCase)$") | stem.rlike("^Test[A-Z]")
    )


def is_test_path(c: Column | str) -> Column:
    """Test by file name, or a directory word (or a whole directory name) that stands for tests."""
    path = F.translate(_col(c), "\\", "/")
    words = _in(K.TEST_WORDS)
    return is_test_filename(F.element_at(F.split(path, "/", -1), -1)) | F.exists(dirs_of(path), lambda d: F.arrays_overlap(tokenize_name(d), words) | F.array_contains(words, F.lower(d)))


def fold_sep(c: Column | str) -> Column:
    return F.translate(_col(c), "-_", "")


def squash(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), r"[-_/.\s]+", "")


def is_doc(c: Column | str) -> Column:
    return F.lower(_col(c)).rlike(r"\.(md|markdown|rst|txt|adoc|rdoc)$")


def is_style(c: Column | str) -> Column:
    return F.lower(_col(c)).rlike(r"\.(css|scss|sass|less)$")


def is_vendor_or_minified(path: Column | str, tokens: Column | str, lines: Column | str) -> Column:
    """Vendored or ``.min.`` by path, or a script or style of more than 1000 characters a line."""
    low = F.lower(_col(path))
    wide = low.rlike(r"\.(js|jsx|ts|tsx|mjs|cjs|css|scss|sass|less)$") & (F.try_divide(_col(tokens) * 4, _col(lines)) > K.MINIFIED_CHARS)
    return low.rlike(r"(^|/)(node_modules|vendor|bower_components)/") | low.rlike(r"\.min\.(js|css)$") | F.coalesce(wide, F.lit(False))


def idf_find(df: Column | str, n: Column) -> Column:
    return F.log(1 + (n - _col(df) + 0.5) / (_col(df) + 0.5))


def idf_hook(df: Column | str, n: Column) -> Column:
    return F.log(1 + n / (1 + _col(df)))


def count_plain(hay: Column, term: Column) -> Column:
    """Occurrences of a term without overlap."""
    return (F.length(hay) - F.length(F.replace(hay, term, F.lit("")))) / F.length(term)


def count_occ(hay: Column, term: Column) -> Column:
    """Occurrences, or 1 where only the squashed texts agree. ``hay`` and ``term`` are lower case."""
    n = count_plain(hay, term)
    return F.when(n > 0, n).when(squash(hay).contains(squash(term)), 1.0).otherwise(0.0)


def is_code_shaped(c: Column | str) -> Column:
    return _col(c).rlike("[0-9_-]") | F.substring(_col(c), 2, 1 << 30).rlike("[A-Z]")


def stem(c: Column | str) -> Column:
    """Plural and tense suffixes taken off, nothing more."""
    w = F.lower(_col(c))
    cut = lambda n: w.substr(F.lit(1), F.length(w) - n)

    def dedouble(s: Column) -> Column:
        last = s.substr(F.length(s), F.lit(1))
        double = (F.length(s) > 2) & (last == s.substr(F.length(s) - 1, F.lit(1))) & ~last.isin("l", "s", "z")
        return F.when(double, s.substr(F.lit(1), F.length(s) - 1)).otherwise(s)

    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when((n > 4) & w.endswith("ing"), dedouble(cut(3))).when((n > 3) & w.endswith("ed"), dedouble(cut(2)))
        .when((n > 3) & w.rlike("(s|x|z|ch|sh)es$"), cut(2)).when((n > 3) & w.endswith("s") & ~w.endswith("ss"), cut(1)).otherwise(w)
    )


def same_stem(a: Column, b: Column) -> Column:
    """Stems agree, but for one silent ``e``."""
    x, y = stem(a), stem(b)
    return (x == y) | (x == F.concat(y, F.lit("e"))) | (y == F.concat(x, F.lit("e")))


def word_hit(hay: Column | str, term: Column) -> Column:
    """A whole word of ``hay`` equals the term or has its stem."""
    return F.exists(F.regexp_extract_all(_col(hay), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: (F.lower(w) == F.lower(term)) | same_stem(w, term))


def slugify(c: Column | str) -> Column:
    """Lower case, runs of other characters to one dash, 60 characters at most, no dash at an end."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(dashed, 1, 60), "-+$", "")


def file_note_id(path: Column | str) -> Column:
    return F.concat(slugify(path), F.lit("-"), F.substring(F.sha1(_col(path)), 1, 8))


def short_sha256(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(_col(c), 256), 1, 12))


def canonical_key(c: Column | str) -> Column:
    """A query's words, lower case, distinct, sorted: equal for equal questions."""
    words = F.filter(F.split(F.lower(_col(c)), r"[\s,|]+", -1), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def sanitize_prompt(c: Column | str, limit: int = 4000, tags: tuple[str, ...] = K.WRAPPER_TAGS) -> Column:
    """Paired wrapper tags with their content (nested ones too), then lone ones, taken out; blanks collapsed; cut to ``limit``."""
    names = "|".join(map(re.escape, tags))
    out = _col(c)
    for _ in range(4):
        out = F.regexp_replace(out, rf"(?is)<({names})(\s[^>]*)?>.*?</\1\s*>", " ")
    out = F.regexp_replace(F.regexp_replace(out, rf"(?i)</?({names})(\s[^>]*)?/?>", " "), r"[ \t]+", " ")
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return trim(F.substring(trim(out), 1, limit))


def first_sentence(c: Column | str, n: int) -> Column:
    """Up to the first full stop after 20 characters, else ``n`` characters, with an ellipsis where cut."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    at = F.regexp_instr(t, F.lit(r"[.!?](\s|$)"))
    one = F.when(at > 20, t.substr(F.lit(1), at)).otherwise(t)
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n), F.lit("…"))).otherwise(one)


def is_import_line(c: Column | str) -> Column:
    # Fixed value: the forms of an import in ten languages.
    return _col(c).rlike(r"^\s*(import\b|from\s+[\w.]+\s+import\b|export\s+[^=]*\bfrom\b|(const|let|var)\s+[^=]*=\s*require\s*\(|require\s*\(|use\s+[\w:\\]+|using\s+[\w.]+|#include\b|@import\b)")


def is_shaped_token(c: Column | str) -> Column:
    """A name of several words: snake with two parts, camel, Pascal of several words, constants; no leading underscore, five characters at least."""
    t = _col(c)
    several = t.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$") | t.rlike("^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$") | t.rlike("^([A-Z][a-z0-9]+){2,}$") | t.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$")
    return several & (F.length(t) >= 5)


def edge_bucket(c: Column | str) -> Column:
    """Kind of an edge's specifier: ``regular`` without a colon, the categories before a class name, else the whole."""
    s = _col(c)
    last = F.element_at(F.split(s, ":", -1), -1)
    return F.when(~s.contains(":"), "regular").when(last.rlike("^[A-Z]"), F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(last)), F.lit("*"))).otherwise(s)


def wrap_text(c: Column | str, width: int) -> Column:
    """Lines of at most ``width`` characters, filled word by word; a longer word has a line of its own."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))

    def step(acc: Column, w: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(w) > width)
        return F.struct(F.when(full, F.array_append(acc["lines"], acc["cur"])).otherwise(acc["lines"]).alias("lines"), F.when(full | (acc["cur"] == ""), w).otherwise(F.concat_ws(" ", acc["cur"], w)).alias("cur"))

    end = lambda acc: F.when(acc["cur"] != "", F.array_append(acc["lines"], acc["cur"])).otherwise(acc["lines"])
    return F.aggregate(F.split(_col(c), " ", -1), start, step, end)


def line_count(c: Column | str) -> Column:
    return F.size(F.split(_col(c), "\n", -1))


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.length(_col(c)) / 4)


# ---- at the driver: a query is a handful of words ------------------------------------------------


def parse_terms(raw: str, stop: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Distinct identifiers of a query of three characters or more, first spelling and order kept."""
    out: dict[str, str] = {}
    for w in re.split(r"[\s\[\]|,()'\".]+", raw):
        if len(w) >= 3 and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", w) and w.lower() not in stop:
            out.setdefault(w.lower(), w)
    return list(out.values())


def match_predicate(pattern: str, c: Column | str) -> Column:
    """``/re/`` is a regular expression (a broken one a plain text), ``a|b`` either text, all without case."""
    low = F.lower(_col(c))
    if len(pattern) > 2 and pattern[0] == "/" and (body := re.sub(r"/[a-z]*$", "", pattern[1:])) != pattern[1:]:
        try:
            re.compile(body)
            return _col(c).rlike(f"(?i){body}")
        except re.error:
            pass
    parts = [p for p in pattern.lower().split("|") if p]
    out = F.lit(False)
    for p in parts:
        out = out | low.contains(p)
    return out


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """(regular expression, negated) of one line of an ignore file."""
    negated = pattern.startswith("!")
    p = pattern[1:] if negated else pattern
    anchored = "/" in p.rstrip("/")
    folder = p.endswith("/")
    body = re.sub(r"\\\*\\\*/", "(.*/)?", re.escape(p.strip("/")))
    body = body.replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(^|/)") + body + ("/.*" if folder else "(/.*)?") + "$", negated


def ignored(c: Column | str, patterns: list[str]) -> Column:
    """The last matching line decides; ``!`` takes back."""
    out = F.lit(False)
    for p in patterns:
        if p.strip() and not p.startswith("#"):
            rx, negated = ignore_regex(p.strip())
            out = F.when(_col(c).rlike(rx), F.lit(not negated)).otherwise(out)
    return out


def glob_regex(glob: str) -> str:
    """The expression a glob stands for: ``*`` and ``?`` within a segment, ``**`` over segments, ``{a,b}``; a glob without
    a slash speaks of names in any directory, one that ends in a slash of all below it."""
    braces = re.fullmatch(r"[^{}]*(?:\{[^{}]*\}[^{}]*)*", glob) is not None
    out, deep = "" if "/" in glob else "(?:.*/)?", False
    for part in re.findall(r"\*\*/|\*\*|.", glob + "**" * glob.endswith("/"), re.DOTALL):
        deep = part == "{" or deep and part != "}"
        fixed = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"} | ({"{": "(?:", "}": ")"} | ({",": "|"} if deep else {}) if braces else {})
        out += fixed.get(part) or re.escape(part)
    return out


def cap_aliases(c: Column | str) -> Column:
    """Newest first (the end of the list), at most 12 aliases and 40 words, never fewer than 4."""
    rev = F.reverse(_col(c))
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        n = F.size(acc["kept"])
        fits = ~acc["full"] & (n < K.ALIAS_MAX) & ((n < K.ALIAS_FLOOR) | (acc["used"] + words(s) <= K.ALIAS_WORDS))
        return F.struct(F.when(fits, F.array_append(acc["kept"], s)).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["used"] + words(s)).otherwise(acc["used"]).alias("used"), (acc["full"] | ~fits).alias("full"))

    return F.reverse(F.aggregate(rev, start, step, lambda acc: acc["kept"]))
