"""Queries of the scalar functions over paths, names and texts of the code index, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.operators.catalog_graph import TOKENIZE, _files, _symbols, _G
from tessera.session import table

IGNORE = ["*.css", "tests/", "generated", "!src/generators/*.css", "/lib/*.py"]


def tokenize_name(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where("name is not null").select("name", F.array_join(X.tokenize_name("name"), " ").alias("tokens")).distinct()


def symbol_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where("name is not null").select("name", F.array_join(X.symbol_tokens("name"), " ").alias("tokens")).distinct()


def _paths(spark, d):
    return table(spark, d, "files").where("path is not null").select("path").distinct()


def path_flags(spark: SparkSession, d: str) -> DataFrame:
    """Tests, excluded directories, documents, styles and generated names of every path."""
    return _paths(spark, d).select("path", X.is_test_path("path").alias("is_test"), X.under_excluded_dir("path").alias("excluded"), X.is_doc("path").alias("is_doc"), X.is_style("path").alias("is_style"), X.is_generated_name("path").alias("generated"))


def lang_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).groupBy(X.language_of_path("path").alias("language")).agg(F.count(F.lit(1)).alias("n"))


def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where(X.ignored("path", IGNORE)).select("path")


def vendor_or_minified(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(X.is_vendor_or_minified("path", "token_estimate", "line_count")).select("file_id")


def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("md5"), X.short_sha256("text").alias("sha"), X.line_count("text").cast("bigint").alias("n_lines"), X.token_estimate("text").cast("bigint").alias("n_tokens"))


def _words(spark, d):
    return table(spark, d, "documents").where("file_id is null and text is not null").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)))).alias("word")).distinct()


def stem_words(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("word", X.stem("word").alias("stem"))


def word_hit(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("file_id is null and text is not null")
    return t.where(X.word_hit("text", F.lit("wrapped"))).select("doc_id")


def code_shape(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("word", X.is_code_shaped("word").alias("code"), X.is_shaped_token("word").alias("shaped"))


def count_occ(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.count_occ(F.lower("text"), F.lit("ledger-map")).cast("bigint").alias("n")).where("n > 0")


def squash_fold(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("path", X.squash("path").alias("squashed"), X.fold_sep("path").alias("folded"))


def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("path", X.slugify("path").alias("slug"), X.file_note_id("path").alias("note"))


def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'commit' and text is not null").select("doc_id", X.canonical_key("text").alias("key"))


def sanitize_prompt(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").where("kind = 'prompt' and text is not null")
    wrapped = F.concat(F.lit("<system-reminder>x <b>"), F.lit("</system-reminder> "), "text", F.lit(" <environment_context/>"))
    return p.select("doc_id", X.sanitize_prompt(wrapped).alias("prompt"))


def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'note' and text is not null").select("doc_id", X.first_sentence(F.regexp_replace("text", "^[^\n]*\n", ""), 80).alias("gist"))


def import_lines(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.find import lines

    return lines(table(spark, d, "documents")).where(X.is_import_line("text")).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def match_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).where(X.match_predicate("/^load.*(map|key)/i", "name") | X.match_predicate("client|gate", "name")).select("symbol_id")


def index_totals(spark: SparkSession, d: str) -> DataFrame:
    """Distinct files, tokens estimated and approximate distinct names of the live index."""
    f = _files(spark, d).agg(F.count(F.lit(1)).alias("n_files"), F.sum("token_estimate").alias("n_tokens"), F.sum(F.coalesce("is_test_file", F.lit(False)).cast("bigint")).alias("n_tests"))
    return f


QUERIES = {f.__name__: f for f in (
    tokenize_name, symbol_tokens, path_flags, lang_dispatch, ignore_rules, vendor_or_minified, doc_stats, stem_words, word_hit, code_shape, count_occ, squash_fold, slugify, canonical_key, sanitize_prompt, first_sentence, import_lines, match_predicate, index_totals,
)}

_P = "(SELECT DISTINCT path FROM files WHERE path IS NOT NULL)"
_TW = ", ".join(f"'{w}'" for w in K.TEST_WORDS)
_EX = ", ".join(f"'{w}'" for w in K.EXCLUDED_DIRS)
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.EXTENSION_LANGUAGE.items()) + "}"
_SYM = "(SELECT DISTINCT symbol_id, name FROM symbols WHERE deleted_at IS NULL AND symbol_id IS NOT NULL)"
_WORD = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*')) AS word FROM documents WHERE file_id IS NULL AND text IS NOT NULL)"
_DD = "CASE WHEN length({0}) > 2 AND {0}[-1] = {0}[-2] AND {0}[-1] NOT IN ('l', 's', 'z') THEN {0}[:-2] ELSE {0} END"
STEM = "CASE WHEN length({0}) > 4 AND suffix({0}, 'ies') THEN {0}[:-4] || 'y' WHEN length({0}) > 4 AND suffix({0}, 'ing') THEN " + _DD.format("({0}[:-4])") + " WHEN length({0}) > 3 AND suffix({0}, 'ed') THEN " + _DD.format("({0}[:-3])") + " WHEN length({0}) > 3 AND regexp_matches({0}, '(s|x|z|ch|sh)es$') THEN {0}[:-3] WHEN length({0}) > 3 AND suffix({0}, 's') AND NOT suffix({0}, 'ss') THEN {0}[:-2] ELSE {0} END"
_SHAPED = "length({0}) >= 5 AND (regexp_matches({0}, '^[a-z][a-z0-9]*(_[a-z0-9]+)+$') OR regexp_matches({0}, '^[a-z]+[a-z0-9]*([A-Z][a-z0-9]*)+$') OR regexp_matches({0}, '^([A-Z][a-z0-9]+){{2,}}$') OR regexp_matches({0}, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$'))"
_FN = "string_split(path, '/')[-1]"
_ST = f"regexp_replace({_FN}, '\\.[^.]+$', '')"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60], '-+$', '')"
SQL = {
    "tokenize_name": f"SELECT DISTINCT name, array_to_string({TOKENIZE.format('name')}, ' ') AS tokens FROM {_SYM} WHERE name IS NOT NULL",
    "symbol_tokens": "SELECT DISTINCT name, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w)), ' ') AS tokens FROM " + _SYM + " WHERE name IS NOT NULL",
    "path_flags": f"""SELECT path, regexp_matches(lower({_FN}), '\\.(test|spec|mock|e2e|cy)\\.[a-z]+$') OR regexp_matches(lower({_FN}), '_(tests?|specs?)\\.[a-z]+$') OR regexp_matches(lower({_FN}), '^test_.+\\.(py|cpp|cc|cxx|h|hpp)$') OR lower({_FN}) = 'conftest.py' OR regexp_matches({_ST}, '(Test|Tests|Spec|Specs|ITCase)$') OR regexp_matches({_ST}, '^Test[A-Z]')
 OR len(list_filter(string_split(path, '/')[:-2], lambda dd: lower(dd) IN ({_TW}) OR len(list_filter({TOKENIZE.format('dd')}, lambda z: z IN ({_TW}))) > 0)) > 0 AS is_test,
 len(list_filter(string_split(path, '/')[:-2], lambda dd: starts_with(dd, '.') OR dd IN ({_EX}))) > 0 AS excluded, regexp_matches(lower(path), '\\.(md|markdown|rst|txt|adoc|rdoc)$') AS is_doc, regexp_matches(lower(path), '\\.(css|scss|sass|less)$') AS is_style, regexp_matches(path, '(\\.generated\\.|\\.pb\\.|_generated\\.|_pb\\.)') AS generated FROM {_P}""",
    "lang_dispatch": f"SELECT map_extract_value({_MAP}, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))) AS language, count(*) AS n FROM {_P} GROUP BY 1",
    "ignore_rules": f"SELECT path FROM {_P} WHERE CASE WHEN regexp_matches(path, '^lib/[^/]*\\.py(/.*)?$') THEN true WHEN regexp_matches(path, '^src/generators/[^/]*\\.css(/.*)?$') THEN false WHEN regexp_matches(path, '(^|/)generated(/.*)?$') THEN true WHEN regexp_matches(path, '(^|/)tests/.*$') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\\.css(/.*)?$') THEN true ELSE false END",
    "vendor_or_minified": _G + "SELECT file_id FROM part1 WHERE vendored UNION SELECT file_id FROM cur WHERE regexp_matches(lower(path), '(^|/)(node_modules|vendor|bower_components)/') OR regexp_matches(lower(path), '\\.min\\.(js|css)$') OR (regexp_matches(lower(path), '\\.(js|jsx|ts|tsx|mjs|cjs|css|scss|sass|less)$') AND token_estimate * 4 / nullif(line_count, 0)::DOUBLE > 1000)",
    "doc_stats": "SELECT doc_id, md5(text) AS md5, 'sha256:' || substr(sha256(text), 1, 12) AS sha, len(string_split(text, chr(10))) AS n_lines, CAST(ceil(length(text) / 4) AS BIGINT) AS n_tokens FROM documents WHERE text IS NOT NULL",
    "stem_words": f"SELECT word, {STEM.format('lower(word)')} AS stem FROM {_WORD}",
    "word_hit": f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents WHERE file_id IS NULL AND text IS NOT NULL) WHERE lower(w) = 'wrapped' OR {STEM.format('lower(w)')} IN ('wrap', 'wrape') OR {STEM.format('lower(w)')} || 'e' = 'wrap'",
    "code_shape": f"SELECT word, regexp_matches(word, '[0-9_-]') OR regexp_matches(word[2:], '[A-Z]') AS code, {_SHAPED.format('word')} AS shaped FROM {_WORD}",
    "count_occ": "SELECT doc_id, n FROM (SELECT doc_id, CASE WHEN contains(lower(text), 'ledger-map') THEN (length(text) - length(replace(lower(text), 'ledger-map', ''))) // 10 WHEN contains(regexp_replace(lower(text), '[-_/.\\s]+', '', 'g'), 'ledgermap') THEN 1 ELSE 0 END AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0",
    "squash_fold": f"SELECT path, regexp_replace(lower(path), '[-_/.\\s]+', '', 'g') AS squashed, replace(replace(path, '-', ''), '_', '') AS folded FROM {_P}",
    "slugify": f"SELECT path, {_SLUG.format('path')} AS slug, {_SLUG.format('path')} || '-' || substr(sha1(path), 1, 8) AS note FROM {_P}",
    "canonical_key": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s,|]+'), lambda w: w <> ''))), ' ') AS key FROM documents WHERE kind = 'commit' AND text IS NOT NULL",
    "import_lines": "WITH ln AS (SELECT file_id, unnest(string_split(text, chr(10))) AS text FROM documents WHERE file_id IS NOT NULL AND text IS NOT NULL) SELECT file_id, count(*) AS n FROM ln WHERE regexp_matches(text, '^\\s*(import\\b|from\\s+[\\w.]+\\s+import\\b|export\\s+[^=]*\\bfrom\\b|(const|let|var)\\s+[^=]*=\\s*require\\s*\\(|require\\s*\\(|use\\s+[\\w:\\\\]+|using\\s+[\\w.]+|#include\\b|@import\\b)') GROUP BY 1",
    "match_predicate": f"SELECT symbol_id FROM {_SYM} WHERE regexp_matches(name, '(?i)^load.*(map|key)') OR contains(lower(name), 'client') OR contains(lower(name), 'gate')",
    "index_totals": _G + "SELECT count(*) AS n_files, CAST(sum(token_estimate) AS BIGINT) AS n_tokens, CAST(sum(coalesce(is_test_file, false)::INT) AS BIGINT) AS n_tests FROM cur",
    "first_sentence": "WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^[^' || chr(10) || ']*' || chr(10), ''), '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents WHERE kind = 'note' AND text IS NOT NULL), p AS (SELECT doc_id, t, length(regexp_extract(t, '^(.*?[.!?])(?: |$)', 1)) AS pos FROM t), o AS (SELECT doc_id, CASE WHEN pos > 20 THEN t[1:pos] ELSE t END AS o FROM p) SELECT doc_id, CASE WHEN length(o) > 80 THEN o[1:80] || '…' ELSE o END AS gist FROM o",
    "sanitize_prompt": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')[1:4000], '^\\s+|\\s+$', '', 'g') AS prompt FROM documents WHERE kind = 'prompt' AND text IS NOT NULL",
}
