"""Source files that don't parse (every file against all supported grammars, by rank).

A file is parsed as the language of its current row; where that is null or spelt in another way, as that of its
extension. A file the grammar rejects is tried against all other grammars, best ranked by its tokens first: if one
accepts it, its extension is wrong, else the text is corrupt (or no code at all). A file its own grammar accepts
isn't tried further, as nothing the others say would change its finding.

Grammars: Python is compiled by the running interpreter, JSON read by RFC 8259, the others are the flat grammars
of ``syntax_script``, ``syntax_java``, ``syntax_go`` and ``syntax_rust``, which judge structure, not names.

Defined cases: a null text is no case; empty Python, JavaScript, TypeScript, Java and Rust are valid, empty Go and
JSON are not; languages without a grammar are never cases; repeated rows of a file count once.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.nested import parse_strict
from tessera.session import current_rows

# Extensions by language, and words that speak for a language.
EXTENSIONS = {"typescript": "ts mts cts tsx", "javascript": "js mjs cjs jsx", "python": "py pyi pyw", "java": "java", "go": "go", "rust": "rs", "json": "json"}
_RANK = {
    "typescript": r"\binterface \w+|: (?:string|number|boolean|unknown|any)\b|\bas \w+|\bimport \{|\bexport ",
    "javascript": r"\bconst |\blet |=>|\bfunction\b|===|\bexport |\bimport \{|\bmodule\.exports",
    "python": r"(?m:^\s*def \w+\(|^\s*class \w+.*:$|^from \S+ import|^import \w+$|\bself\b|\bNone\b|\belif\b)",
    "java": r"\bpublic (?:class|static|final)|\bprivate \w+|\bimport java|(?m:^package [\w.]+;)|\bnew \w+<",
    "go": r"(?m:^package \w+$|^func )|:=|\bnil\b|\bdefer\b|\berr != nil",
    "rust": r"\bfn \w+|\blet mut\b|\bimpl\b|&'|\bpub \w+|\buse \w+::|->",
    "json": r"\A\s*[\[{]|\"\w+\":",
}
_RANKS = {k: re.compile(v) for k, v in _RANK.items()}


def _json(text: str) -> bool:
    return parse_strict(text)[0]


def _python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text.encode("utf-8", "surrogatepass"), "file", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False
    return True


def parses(text: str, language: str) -> bool:
    """Whether a text is valid in a language that has a grammar."""
    if language == "python":
        return _python(text)
    if language == "json":
        return _json(text)
    if language in ("javascript", "typescript"):
        from tessera.llm import syntax_script

        return syntax_script.parses(text, language == "typescript")
    from tessera.llm import syntax_go, syntax_java, syntax_rust

    return {"java": syntax_java, "go": syntax_go, "rust": syntax_rust}[language].parses(text)


def ranked(text: str) -> list[str]:
    """Languages by how many of their words a text holds, ties by name."""
    return sorted(_RANKS, key=lambda k: (-sum(1 for _ in _RANKS[k].finditer(text)), k))


def examine(text: str, language: str) -> tuple[bool, str | None]:
    """(valid, language that accepts the text instead)."""
    if parses(text, language):
        return True, None
    if text.strip():
        for other in ranked(text):
            if other != language and parses(text, other):
                return False, other
    return False, None


def language_of(language: Column, path: Column) -> Column:
    """Language of a row if spelt as here, else of the extension; null without a grammar."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_extension = F.lit(None).cast("string")
    for name, ends in EXTENSIONS.items():
        by_extension = F.when(extension.isin(*ends.split()), name).otherwise(by_extension)
    return F.when(language.isin(*EXTENSIONS, "css", "markdown"), F.when(language.isin(*EXTENSIONS), language)).otherwise(by_extension)


_SCHEMA = pa.schema([("file_id", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("accepted_as", pa.string())])


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f, lang, *examine(t, lang)) for f, lang, t in zip(*(batch.column(c).to_pylist() for c in ("file_id", "language", "text")), strict=True)]
        cols = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def parsed(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, repo, language, valid, accepted_as`` of every file with a text and a grammar.

    The texts move once, by file, to meet the language of their row.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced: the work is the parse, not the bytes
    texts = docs.where("file_id is not null and text is not null").select("file_id", "text").repartition(n, "file_id")
    rows = current_rows(files, "language").select("file_id", F.col("language").alias("row_language"))
    known = texts.join(rows, "file_id", "left").select("file_id", language_of(F.col("row_language"), F.col("file_id")).alias("language"), "text").where("language is not null")
    return known.mapInArrow(_examine, "file_id string, language string, valid boolean, accepted_as string").select("file_id", F.substring_index("file_id", "/", 1).alias("repo"), "language", "valid", "accepted_as")


def rates(parsed_files: DataFrame) -> DataFrame:
    """Files, rejected files, wrong extensions and the rate of rejection per repository and language."""
    bad = (~F.col("valid")).cast("int")
    out = parsed_files.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(bad).alias("n_rejected"), F.count("accepted_as").alias("n_wrong_extension"))
    return out.withColumn("rate", F.round(F.col("n_rejected") / F.col("n_files"), 6))
