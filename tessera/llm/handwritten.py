"""Files nobody wrote by hand: generated, minified, vendored, data saved as code (attribute rules and mined patterns).

A repository that has attribute files declares its generated and vendored paths: their patterns are parsed, a deeper
directory's file wins over a higher one's and a later line over an earlier one, ``-name`` takes a kind back and ``!name``
leaves it open. What a repository declares settles that kind for the path.

All other paths are judged by equivalent patterns mined from the corpus: every directory (``**/gen/**``), every last
part of a name (``*_pb2.*``) and the shapes of hashed names is a candidate, none is listed beforehand. Declared files count as their
repository says; of the others those count whose *content* shows what they are: a generator's header, a library's banner,
minified text, data, a copy known elsewhere as third-party, or, as a sign that is no reason by itself, lines that repeat a few
forms. A pattern holds for every file if the lower confidence limit of its precision is high, and for files that
show such a sign themselves from a small support on.

Content evidence looks at the whole text: a header is only read in comments, so code or prose that talks of
generating doesn't count.

Defined cases: null and empty texts have no content evidence and are judged by their path; a null path is no file;
rows of one file count once; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: A mined pattern must be met in REPOS repositories. It holds for all files if the lower limit of its precision (at 1.96 standard
#: errors) is LIMIT, for files that show a sign themselves if SUPPORT files are met and PRECISION of them show what they are.
REPOS, LIMIT, SUPPORT, PRECISION = 3, 0.95, 5, 0.9
#: Characters of numbers or encoded bytes from which a text without statements is a blob and no small table; characters of code
#: that a layout takes to show; distinct words from which two equal texts are copies and not both just short.
DATA_CHARS, LAYOUT_CHARS, COPY_WORDS = 500, 120, 5
#: Lines repeat a few forms if there are so many of them and at most this share of their forms is distinct.
FORM_LINES, FORM_SHARE = 8, 0.3
#: Ways the files of one directory or pattern are spread where they meet its rules.
SALTS = 16

# Comment leaders; what a header of a tool says, what one that doesn't count says.
_COMMENT = re.compile(r"/\*[\s\S]*?\*/|(?m:^[ \t]*(?://|#(?!!|\[)|--|<!--|;|%)[^\n]*)")
_TOOL = re.compile(
    r"code generated (?:by|from|with)\b.*?do not edit|@generated\b|<auto-?generated\b|(?:this (?:file|code|class) (?:is|was|has been) )?auto(?:matically)?[ -]?generated(?: file| by| from| code)?\b[^\n]*?(?:do not (?:edit|modify|change)|changes will be lost|by\b|from\b|don't edit)"
    r"|\bgenerated (?:by|from|with|using) [^\n]*?(?:do not (?:edit|modify|change)|don't edit|changes will be lost|edit the \w+ instead)|(?:do not (?:edit|modify)|don't (?:edit|modify))[^\n]{0,40}(?:generated|compiler|this file)\b"
    r"|\b(?:built|produced|emitted|written|compiled|created|made) by \S+ (?:from|out of) [^\n]*?(?:edit|change) the \w+ instead|generated by the protocol buffer compiler|generated by swagger|generated by openapi|\bmachine[- ]generated\b",
    re.IGNORECASE | re.DOTALL,
)
_VERSION = r"v?\d+\.\d+(?:\.\d+)?(?:[-+.][\w.]+)?"
_LICENCE = r"(?:licen[sc]ed?\b|copyright|\(c\)|©|released under)"
_BANNER = re.compile(rf"^[\s/*!#;-]*(?:@preserve\s+)?(?P<name>[A-Za-z@][\w.@/-]*)(?:\.js|\.css)?[ ,:@-]+{_VERSION}\b[^\n]*?(?:\n[^\n]*?){{0,4}}{_LICENCE}", re.IGNORECASE)
_VERSIONED = re.compile(r"^(?P<lib>[A-Za-z][A-Za-z0-9_.]*?)[-_.@]v?\d+\.\d+(?:\.\d+)*(?:[-.](?:min|slim|esm|umd|bundle|prod))*\.[a-z]+$")
_HASHED = re.compile(r"[.-][0-9a-f]{8,20}\.(?:js|mjs|css)$")
_NUMBER = re.compile(r"(?<![\w.$'\"])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?=\s*[,\]\)}]|\s*$)", re.MULTILINE)
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}|(?:\\x[0-9a-fA-F]{2}){8,}")
_STATEMENT = re.compile(r"^\s*(?:export\s+|pub\s+|async\s+|public\s+|private\s+|static\s+)*(?:function|def|class|func|fn|if|for|while|return|interface)\b", re.MULTILINE)
_SOURCEMAP = re.compile(r"^(?://|/\*)[#@] sourceMappingURL=", re.MULTILINE)
_PACKAGED = frozenset("node_modules bower_components third_party third-party thirdparty vendored vendor external externals extern deps jspm_packages Pods".split())
_FORM = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$][\w$-]*|\d[\w.]*")
_LAST = re.compile(r"[._-]([A-Za-z][A-Za-z0-9]*)$")


def header(text: str) -> str:
    """The comments before the first line of code."""
    out, at = [], 0
    while m := _COMMENT.match(text, at):
        out.append(m.group())
        at = m.end()
        while at < len(text) and text[at] in " \t\r\n﻿":
            at += 1
    if not out:
        skipped = len(text) - len(text.lstrip("﻿ \t\r\n"))
        return header(text[skipped:]) if 0 < skipped < len(text) else ""
    return "\n".join(out)


def data_share(text: str) -> tuple[float, int]:
    """Share of a text's visible characters that are numbers of lists or encoded bytes, and how many they are."""
    visible = len(text) - sum(map(text.count, " \n\t\r"))
    if not visible:
        return 0.0, 0
    encoded = sum(m.end() - m.start() for m in _ENCODED.finditer(text))
    numbers = sum(m.end() - m.start() + 1 for m in _NUMBER.finditer(text)) if text.count(",") > 20 else 0
    return min(1.0, (encoded + numbers) / visible), encoded + numbers


def minified(text: str, path: str) -> bool:
    """Whether a script or style sheet has the layout of a minifier: hardly a blank, or statements run together.

    Long literals are left out first, so a path or template in one long line is none.
    """
    if not re.search(r"\.(?:[mc]?jsx?|[mc]?tsx?|css|scss)$", path):
        return False
    body = _COMMENT.sub("", text)
    code = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", '""', body).strip()
    if len(code) < LAYOUT_CHARS:
        return False
    blanks = sum(map(code.count, " \t\n")) / len(code)
    lines = code.count("\n") + 1
    joints = len(re.findall(r"[;{},)](?=[\w$!({}.\[])|\)\{|\}\(", code)) / len(code)
    return (blanks < 0.08 and joints > 0.03) or (len(code) / lines > 150 and joints > 0.05)


def content_evidence(path: str, text: str | None) -> list[str]:
    """What the text itself shows: generated, minified, vendored, data."""
    if not text or not text.strip():
        return []
    found = []
    head = header(text)
    if head and _TOOL.search(head):
        found.append("generated")
    if head and _BANNER.match(head.lstrip("\ufeff \t\r\n")):
        found.append("vendored")
    if minified(text, path) or (_SOURCEMAP.search(text) and len(text) / (text.count("\n") + 1) > 60):
        found.append("minified")
    share, size = data_share(text)
    if share > 0.75 and size >= DATA_CHARS and not _STATEMENT.search(text):
        found.append("data")
    return found


def repeats_forms(text: str | None) -> bool:
    """Whether a text's lines repeat a few forms: equal but for their words, numbers and literals, as the lines of a template are."""
    forms = [f for line in (text or "").split("\n") if len(f := _FORM.sub("w", line.strip()).replace(" ", "")) >= 4]
    return len(forms) >= FORM_LINES and len(set(forms)) <= FORM_SHARE * len(forms)


def path_patterns(path: str) -> list[str]:
    """The candidate patterns a path lies under: its directories without digits, the last part of its name, a hash in its name."""
    *dirs, name = path.split("/")
    out = [f"**/{d}/**" for d in dict.fromkeys(dirs) if d and not any(c.isdigit() for c in d)]
    stem = name.rpartition(".")[0]
    if m := _LAST.search(stem):
        out.append(f"*{m.group()}.*")
    if _HASHED.search(name):
        out.append("*[.-]<hash>.*")
    return out


def _library_file(rest: list[str], name: str) -> bool:
    """Whether a file under a tree's directory is laid out as a library: its entry, or named as its directory."""
    stem = name.split(".")[0].lower()
    return len(rest) >= 1 and not rest[0][:1].isdigit() and (stem in ("index", "core", "main", "mod", "lib", "__init__", rest[0].lower()) or len(rest) >= 2 and rest[1] in ("src", "lib", "dist"))


#: Files that come with a library of its own.
_MANIFEST = re.compile(r"(?:package\.json|bower\.json|component\.json|go\.mod|cargo\.toml|setup\.(?:py|cfg)|pyproject\.toml|pom\.xml|metadata|record|(?:un)?licen[sc]e(?:[.-][\w.-]+)?|copying(?:\.\w+)?|notice(?:\.\w+)?)$", re.IGNORECASE)
_RELEASE = re.compile(r"[A-Za-z].*[-_@]v?\d+(?:\.\d+)+")


def library(path: str) -> tuple[str | None, str | None, bool]:
    """(tree, directory of the library, whether the path alone shows one) of a path in a package tree.

    The directory is that below the tree, below the owner of a scoped name, or below host and owner. A manifest or licence
    in it, a release in its name, a host above it or a library's layout shows a library.
    """
    *dirs, name = path.split("/")
    for n, d in enumerate(dirs[:-1]):
        if d in _PACKAGED:
            host = "." in dirs[n + 1] and not _RELEASE.fullmatch(dirs[n + 1])
            end = min(len(dirs), n + 2 + (2 if host else 1 if dirs[n + 1].startswith("@") else 0))
            return d, "/".join(dirs[:end]), host or bool(_RELEASE.fullmatch(dirs[end - 1])) or (end == len(dirs) and _MANIFEST.match(name) is not None) or _library_file(dirs[n + 1 :], name)
    return None, None, False


_FEATURES = pa.schema([("file_id", pa.string()), ("evidence", pa.list_(pa.string())), ("sign", pa.bool_()), ("patterns", pa.list_(pa.string())), ("digest", pa.string()), ("tree", pa.string()), ("library", pa.string()), ("shows", pa.bool_())])
_FEATURES_DDL = "file_id string, evidence array<string>, sign boolean, patterns array<string>, digest string, tree string, library string, shows boolean"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for fid, text in zip(batch.column("file_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            path = fid.partition("/")[2]
            evidence = content_evidence(path, text)
            if _VERSIONED.match(path.rpartition("/")[2]) and "vendored" not in evidence:
                evidence.append("vendored")
            words = text and len(set(re.findall(r"\w+", text))) >= COPY_WORDS
            digest = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if words else None
            rows.append((fid, evidence, repeats_forms(text), path_patterns(path), digest, *library(path)))
        cols = list(zip(*rows, strict=True)) or [()] * len(_FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _FEATURES, strict=True)], schema=_FEATURES)


#: Attributes of attribute files that speak about origin.
ATTRIBUTES = {"linguist-generated": "generated", "linguist-vendored": "vendored"}


def pattern_regex(pattern: str) -> str:
    """A regular expression for one attribute pattern, relative to its file's directory."""
    anchored = "/" in pattern.rstrip("/")
    body, at = "", 0
    p = pattern.strip("/") + ("/**" if pattern.endswith("/") else "")
    while at < len(p):
        if p.startswith("**/", at):
            body, at = body + "(?:.*/)?", at + 3
        elif p.startswith("**", at):
            body, at = body + ".*", at + 2
        elif p[at] == "*":
            body, at = body + "[^/]*", at + 1
        elif p[at] == "?":
            body, at = body + "[^/]", at + 1
        elif p[at] == "[" and "]" in p[at + 2 :]:
            end = p.index("]", at + 2)
            body, at = body + "[" + p[at + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            body, at = body + re.escape(p[at]), at + 1
    return ("" if anchored else "(?:.*/)?") + body


def parse_attributes(text: str | None) -> list[tuple[str, str, str]]:
    """(expression, kind, state) of every line of an attribute file that is about origin, in order; a state is set, unset or open."""
    out = []
    for line in (text or "").splitlines():
        m = re.match(r"\s*(?:\"((?:\\.|[^\"\\])*)\"|(\S+))\s+(.*)", line)
        if not m or line.lstrip().startswith(("#", "!", "[attr]")):
            continue
        pattern = re.sub(r"\\(.)", r"\1", m.group(1)) if m.group(1) is not None else m.group(2)
        for a in m.group(3).split():
            name, _, value = a.lstrip("-!").partition("=")
            if name in ATTRIBUTES:
                state = "open" if a[0] == "!" else "unset" if a[0] == "-" or value.lower() in ("false", "0", "unset") else "set"
                out.append((pattern_regex(pattern), ATTRIBUTES[name], state))
    return out


_RULES = pa.schema([("repo", pa.string()), ("folder", pa.string()), ("rules", pa.list_(pa.struct([("expression", pa.string()), ("kind", pa.string()), ("state", pa.string())])))])
_RULES_DDL = "repo string, folder string, rules array<struct<expression:string,kind:string,state:string>>"


def _attribute_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file_id, text in zip(batch.column("file_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            repo, _, path = file_id.partition("/")
            rules = [dict(zip(("expression", "kind", "state"), r, strict=True)) for r in parse_attributes(text)]
            if rules:
                rows.append((repo, path.rpartition("/")[0], rules))
        cols = list(zip(*rows, strict=True)) or [()] * len(_RULES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _RULES, strict=True)], schema=_RULES)


_HITS = pa.schema([("file_id", pa.string()), ("kind", pa.string()), ("depth", pa.int32()), ("state", pa.string())])


def _match_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one directory's rules say about a path below it: of each kind the last line that matches."""
    compiled: dict[str, re.Pattern] = {}
    for batch in batches:
        rows = []
        for file_id, relative, depth, rules in zip(*(batch.column(c).to_pylist() for c in ("file_id", "relative", "depth", "rules")), strict=True):
            said: dict[str, str] = {}
            for r in reversed(rules):
                if r["kind"] not in said:
                    rx = compiled.get(r["expression"]) or compiled.setdefault(r["expression"], re.compile(r["expression"]))
                    if rx.fullmatch(relative):
                        said[r["kind"]] = r["state"]
            rows += [(file_id, k, depth, v) for k, v in said.items()]
        cols = list(zip(*rows, strict=True)) or [()] * len(_HITS)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _HITS, strict=True)], schema=_HITS)


def attribute_rules(texts: DataFrame) -> DataFrame:
    """``repo, folder, rules`` of every attribute file that speaks about origin."""
    return texts.where("file_id = '.gitattributes' or file_id like '%/.gitattributes'").distinct().mapInArrow(_attribute_rules, _RULES_DDL)


def declared(rules: DataFrame, features: DataFrame) -> DataFrame:
    """``file_id, kind, state`` of the paths that attribute files speak of: the deepest directory whose file does decides.

    A path meets the rules of its directories by (repository, directory), one array a directory, so a large
    repository is a key per directory, and that of its root is spread over salts.
    """
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = F.split(F.expr("substring(file_id, length(repo) + 2)"), "/")
    paths = features.select("file_id", "repo", parts.alias("parts"), F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int").alias("salt")).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)))
    folder = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")
    at = paths.select("file_id", "repo", "salt", "depth", folder.alias("folder"), F.array_join(F.slice("parts", F.col("depth") + 1, F.size("parts") - F.col("depth")), "/").alias("relative"))
    hits = at.join(rules, ["repo", "folder", "salt"]).select("file_id", "relative", "depth", "rules").mapInArrow(_match_rules, "file_id string, kind string, depth int, state string")
    return hits.groupBy("file_id", "kind").agg(F.max_by("state", F.struct("depth", "state")).alias("state"))


#: Fixed value: what an attribute kind covers of the evidence.
KINDS = {"generated": ("generated", "minified", "data"), "vendored": ("vendored",)}


def _holds(n: Column, e: Column, repos: Column) -> tuple[Column, Column]:
    """(for all files, for files with a sign): whether ``e`` of ``n`` files are enough."""
    share, z = F.try_divide(e, n), 1.96
    low = F.try_divide(share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)), 1 + z * z / n)
    return F.when(n > 0, (repos >= REPOS) & (low >= LIMIT)).otherwise(False), F.when(n > 0, (repos >= REPOS) & (n >= SUPPORT) & (share >= PRECISION)).otherwise(False)


def mine(features: DataFrame, with_rules: DataFrame) -> DataFrame:
    """``pattern, kind, strict`` of the patterns that hold, from ``repo, patterns, is_generated, is_vendored``.

    A pattern is judged by all its files, and by those in repositories ``with_rules``, where what isn't declared is known not to be.
    """
    flag = lambda c: F.sum(F.col(c).cast("int"))
    per_repo = features.select("repo", F.explode("patterns").alias("pattern"), "is_generated", "is_vendored").withColumn("is_any", F.col("is_generated") | F.col("is_vendored")).groupBy("pattern", "repo").agg(F.count(F.lit(1)).alias("n"), flag("is_generated").alias("g"), flag("is_vendored").alias("v"), flag("is_any").alias("e"))
    ruled = per_repo.join(with_rules.withColumn("ruled", F.lit(True)), "repo", "left").withColumn("r", F.coalesce(F.col("ruled"), F.lit(False)).cast("int"))
    p = ruled.groupBy("pattern").agg(F.count(F.lit(1)).alias("repos"), F.sum("r").alias("ruled"), *[F.sum(c).alias(c) for c in "ngve"], F.sum(F.col("n") * F.col("r")).alias("rn"), F.sum(F.col("e") * F.col("r")).alias("re"))
    all_, signed = _holds(F.col("n"), F.col("e"), F.col("repos"))
    all_r, signed_r = _holds(F.col("rn"), F.col("re"), F.col("ruled"))
    return p.withColumn("strict", all_ | all_r).where(F.col("strict") | signed | signed_r).select("pattern", F.when(F.col("v") > F.col("g"), "vendored").otherwise("generated").alias("kind"), "strict")


def judge(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, reasons`` of the files nobody wrote by hand; ``reasons`` is a sorted list of kinds, ``declared:`` kinds and ``path:`` patterns.

    Only features move, never texts. ``files`` adds the files without a document, judged by path and by the stored
    counts (more than 1000 characters a line).
    """
    texts = docs.where("file_id is not null").select("file_id", "text")
    seen = texts.mapInArrow(_features, _FEATURES_DDL)
    stored = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.try_divide(F.col("token_estimate") * 4, F.col("line_count"))).alias("width"))
    long_lines = F.col("file_id").rlike(r"\.(?:[mc]?jsx?|css)$") & (F.col("width") > 1000)
    bare = stored.join(texts.select("file_id"), "file_id", "left_anti").select("file_id", F.when(long_lines, F.array(F.lit("minified"))).otherwise(F.array()).cast("array<string>").alias("stored"), F.lit(None).cast("string").alias("text"))
    unread = bare.select("file_id", "text").mapInArrow(_features, _FEATURES_DDL).join(bare.select("file_id", "stored"), "file_id").withColumn("evidence", F.array_union("evidence", "stored"))
    features = cut(seen.unionByName(unread.select(*_FEATURES.names)).withColumn("repo", F.substring_index("file_id", "/", 1)))

    # copies of one text are third-party if one of them is known to be; in a package tree also if they lie in several repositories
    copies = features.where("digest is not null").groupBy("digest").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.max(F.array_contains("evidence", "vendored") | F.coalesce("shows", F.lit(False))).alias("copied"))
    known = copies.where("lo < hi or copied").select("digest", "copied", (F.col("lo") < F.col("hi")).alias("spread"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    all_ = features.join(known, "digest", "left").withColumns({"copied": yes("copied"), "spread": yes("spread")})
    # a package tree is judged by library: what shows one of its files as third-party speaks for all files of its directory
    shown = all_.where("library is not null").where(F.col("shows") | F.array_contains("evidence", "vendored") | F.col("copied") | F.col("spread")).groupBy("repo", "library").agg(F.lit(True).alias("whole"))
    all_ = all_.join(shown, ["repo", "library"], "left").withColumn("whole", yes("whole"))
    attributes = attribute_rules(texts)
    said = declared(attributes, features).groupBy("file_id").agg(F.max(F.when(F.col("kind") == "generated", F.col("state"))).alias("said_generated"), F.max(F.when(F.col("kind") == "vendored", F.col("state"))).alias("said_vendored"))
    none = F.array().cast("array<string>")
    when = lambda c, *r: F.when(c, F.array(*r)).otherwise(none)
    own = F.array_union("evidence", F.array_union(when(F.col("copied"), F.lit("vendored")), when(F.col("whole"), F.concat(F.lit("tree:"), F.col("tree")))))
    kind_of = lambda e: F.when(e.isin(*KINDS["generated"]), "generated").otherwise("vendored")
    settled = lambda kind: F.col(f"said_{kind}").isin("set", "unset")
    is_kind = lambda kind, sign: F.when(F.coalesce(settled(kind), F.lit(False)), F.col(f"said_{kind}") == "set").otherwise(F.exists("own", lambda e: kind_of(e) == kind) | sign)
    judged = all_.join(said, "file_id", "left").withColumn("own", own)
    judged = cut(judged.select("file_id", "repo", "patterns", "sign", "own", "said_generated", "said_vendored", is_kind("generated", F.col("sign")).alias("is_generated"), is_kind("vendored", F.col("spread")).alias("is_vendored")))

    rules = mine(judged, attributes.select("repo").distinct()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    under = judged.select("file_id", "sign", F.explode("patterns").alias("pattern"), F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int").alias("salt"))
    by_rule = under.join(rules, ["pattern", "salt"]).where("strict or sign").groupBy("file_id").agg(F.collect_set(F.struct("kind", F.concat(F.lit("path:"), "pattern").alias("reason"))).alias("mined"))
    kept = lambda kind: ~F.coalesce(settled(kind), F.lit(False))
    taken_back = lambda kind: F.coalesce(F.col(f"said_{kind}") == "unset", F.lit(False))
    own_left = F.filter("own", lambda e: F.when(kind_of(e) == "generated", ~taken_back("generated")).otherwise(~taken_back("vendored")))
    mined_left = F.transform(F.filter(F.coalesce("mined", F.array().cast("array<struct<kind:string,reason:string>>")), lambda m: F.when(m["kind"] == "generated", kept("generated")).otherwise(kept("vendored"))), lambda m: m["reason"])
    said_so = F.flatten(F.array(*[when(F.coalesce(F.col(f"said_{k}") == "set", F.lit(False)), F.lit(f"declared:{k}")) for k in KINDS]))
    reasons = judged.join(by_rule, "file_id", "left").select("file_id", F.explode(F.concat(own_left, mined_left, said_so)).alias("reason"))
    return reasons.groupBy("file_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
