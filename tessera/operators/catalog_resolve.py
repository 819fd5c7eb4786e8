"""Queries of import and call resolution over the code index, and the same in SQL.

The stored specifiers of the index are of several kinds, and few point at a file by their own rules; so next to
them the queries resolve specifiers derived from the edges themselves, for which the right target is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import resolve as R
from tessera.operators.catalog_graph import _files, _symbols, _G
from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.session import table


def _within(spark, d):
    """Edges inside a repository, both ends live."""
    f = _files(spark, d).select("file_id")
    e = table(spark, d, "edges").where("src is not null and dst is not null and src <> dst").select("src", "dst", "ord", "specifier").distinct()
    return e.join(f.withColumnRenamed("file_id", "src"), "src", "left_semi").join(f.withColumnRenamed("file_id", "dst"), "dst", "left_semi").where("substring_index(src, '/', 1) = substring_index(dst, '/', 1)")


def _relative(spark, d):
    """The way from the source's directory to the target, without its extension."""
    up = F.repeat(F.lit("../"), F.size(F.split("src", "/")) - 2)
    return _within(spark, d).select(F.col("src").alias("file_id"), F.concat(F.lit("./"), up, F.regexp_replace(F.regexp_replace("dst", "^[^/]+/", ""), r"\.[^./]+$", "")).alias("specifier"))


def resolve_candidates_first(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_relative(_relative(spark, d), _files(spark, d))


def _aliases(spark, d):
    """Per repository: ``@`` its packages directory by directory, ``@shared`` a place that isn't there."""
    f = _files(spark, d)
    dirs = f.select("repo", F.regexp_extract("path", "^(.*?/)?src/", 0).alias("t")).where("t <> ''").distinct()
    order = F.row_number().over(R.Window.partitionBy("repo").orderBy("t"))
    at = dirs.select(F.col("repo").alias("scope"), F.lit("@").alias("prefix"), F.col("t").alias("target"), order.alias("ord"))
    return at.unionByName(f.select(F.col("repo").alias("scope"), F.lit("@shared").alias("prefix"), F.lit("shared").alias("target"), F.lit(1).alias("ord")).distinct())


def _alias_specs(spark, d):
    """Targets below a ``src`` directory as ``@/...``."""
    e = _within(spark, d).where("dst like '%/src/%'")
    return e.select(F.col("src").alias("file_id"), F.concat(F.lit("@/"), F.regexp_replace(F.regexp_replace("dst", "^.*?/src/", ""), r"\.[^./]+$", "")).alias("specifier")).unionByName(e.select(F.col("src").alias("file_id"), F.lit("@shared/x").alias("specifier"))).distinct()


def resolve_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return R.resolve_alias(_alias_specs(spark, d), _files(spark, d), _aliases(spark, d))


def resolve_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Python modules by their path below the nearest common ancestor."""
    e = _within(spark, d).where("src like '%.py' and dst like '%.py'")
    mod = F.translate(F.regexp_replace(F.regexp_replace("dst", "^[^/]+/", ""), r"\.py$", ""), "/", ".")
    tail = F.regexp_extract("dst", r"([^/]+)\.py$", 1)
    return R.resolve_python(e.select(F.col("src").alias("file_id"), F.explode(F.array(mod, tail, F.concat(F.lit("."), tail))).alias("specifier")).distinct(), _files(spark, d))


def resolve_fqcn(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    names = f.where("file_id like '%.java'").select("repo", F.concat_ws(".", "package_name", F.regexp_extract("file_id", r"([^/]+)\.java$", 1)).alias("fqcn"))
    specs = names.select("repo", F.explode(F.array("fqcn", F.concat("fqcn", F.lit(".LIMIT")), F.concat("fqcn", F.lit(".*")))).alias("specifier"))
    src = f.where("file_id like '%.java'").groupBy("repo").agg(F.min("file_id").alias("file_id"))
    return R.resolve_jvm(specs.join(src, "repo").select("file_id", "specifier").distinct(), f)


def _stored(spark, d):
    f = _files(spark, d).select(F.col("file_id").alias("src"), X.language_of_path("path").alias("language"))
    e = table(spark, d, "edges").where("src is not null and specifier is not null").join(f, "src")
    return e.select(F.col("src").alias("file_id"), "specifier", "language", F.lit(False).alias("is_bonus")).distinct()


def _resolved(spark, d):
    derived = _relative(spark, d).join(_files(spark, d).select("file_id", X.language_of_path("path").alias("language")), "file_id").where("language in ('typescript', 'javascript')").withColumn("is_bonus", F.lit(False))
    return R.resolve_imports(_stored(spark, d).unionByName(derived).distinct(), _files(spark, d), {})


def resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.resolution_stats(_resolved(spark, d))


def unresolved_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.unresolved_top(_resolved(spark, d))


def specifier_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the import edges and of the edges by convention."""
    both = table(spark, d, "edges").where("specifier is not null").select("specifier").unionByName(partial_pairs(spark, d).select("specifier")).unionByName(_files(spark, d).where("is_test_file").select(F.lit("convention:tests").alias("specifier")))
    return both.groupBy(X.edge_bucket("specifier").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _call_inputs(spark, d):
    """Calls with the callee's bare name, as an extractor would give them."""
    sy = _symbols(spark, d)
    e = table(spark, d, "symbol_edges").where("type = 'calls' and src is not null and dst is not null and dst like '%#%'").select("src", "dst", "line").distinct()
    calls = e.join(sy.select(F.col("symbol_id").alias("src"), "file_id"), "src").select(F.col("src").alias("symbol_id"), "file_id", F.substring_index("dst", "#", -1).alias("callee"), "line").distinct()
    exports = sy.where("is_exported and name is not null").select("file_id", "name")
    dotted = exports.unionByName(exports.where("name rlike '^[a-z]'").select("file_id", F.concat(F.lit("Owner."), "name").alias("name")).where("pmod(length(name), 3) = 0"))
    return calls, table(spark, d, "edges").where("src is not null and dst is not null"), exports.where("pmod(length(name), 3) <> 0").unionByName(dotted.where("name like 'Owner.%'"))


def _called(spark, d):
    calls, imports, exports = _call_inputs(spark, d)
    return R.resolve_calls(calls, imports, exports)


def call_resolve_direct(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d).where("pass = 1").select("symbol_id", "callee", "line", "target")


def call_resolve_unique_suffix(spark: SparkSession, d: str) -> DataFrame:
    return _called(spark, d).where("pass = 2").select("symbol_id", "callee", "line", "target")


def partial_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Files of one repository that declare a class of one name."""
    s = _symbols(spark, d).where("kind = 'class' and name is not null").select(F.substring_index("file_id", "/", 1).alias("namespace"), "name", "file_id")
    return R.partial_pairs(s)


def idempotent_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("specifier").alias("specifier"))
    new = partial_pairs(spark, d)
    once = R.merge_edges(e, new)
    return R.merge_edges(once, new).groupBy(F.when(F.col("specifier").startswith("partial:"), "partial").otherwise("import").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    resolve_candidates_first, resolve_longest_prefix, resolve_ancestors, resolve_fqcn, resolution_stats, unresolved_topk, specifier_buckets, call_resolve_direct, call_resolve_unique_suffix, partial_pairs, idempotent_merge,
)}

_EXT = ", ".join(f"({n}, '{e}')" for n, e in enumerate([*R.EXTENSIONS, *["/" + i for i in R.INDEX_FILES]]))
_R = _G + f""",
tail AS (SELECT * FROM (VALUES {_EXT}) v(n, e)),
inside AS (SELECT DISTINCT src, dst, ord, specifier FROM edges WHERE src <> dst AND src IN (SELECT file_id FROM cur) AND dst IN (SELECT file_id FROM cur) AND split_part(src, '/', 1) = split_part(dst, '/', 1)),
rel AS (SELECT DISTINCT src AS file_id, './' || repeat('../', len(string_split(src, '/')) - 2) || regexp_replace(regexp_replace(dst, '^[^/]+/', ''), '\\.[^./]+$', '') AS specifier, split_part(dst, '/', 1) || '/' || regexp_replace(regexp_replace(dst, '^[^/]+/', ''), '\\.[^./]+$', '') AS base FROM inside),
relr AS (SELECT file_id, specifier, arg_min(c, n) AS target FROM (
  SELECT file_id, specifier, n, base || e AS c FROM rel, tail WHERE NOT regexp_matches(base, '[^/]\\.[^./]+$')
  UNION ALL SELECT file_id, specifier, n, c FROM (SELECT file_id, specifier, unnest([base] || CASE regexp_extract(base, '(\\.[^./]+)$') WHEN '.js' THEN [base[:-3] || 'ts', base[:-3] || 'tsx'] WHEN '.jsx' THEN [base[:-4] || 'tsx'] WHEN '.mjs' THEN [base[:-4] || 'mts'] WHEN '.cjs' THEN [base[:-4] || 'cts'] ELSE [] END) AS c, generate_subscripts([1, 2, 3], 1) AS n FROM rel WHERE regexp_matches(base, '[^/]\\.[^./]+$')) WHERE c IS NOT NULL
  ) WHERE c IN (SELECT file_id FROM cur) GROUP BY 1, 2)
"""
_UP = "list_transform(range(len(string_split({0}, '/')) - 1, 0, -1), lambda k: array_to_string(string_split({0}, '/')[1:k], '/'))"
_LANG = ", ".join(f"('{e}', '{v}')" for e, v in K.EXTENSION_LANGUAGE.items())
_STATS = _R + f""", lang AS (SELECT * FROM (VALUES {_LANG}) v(ext, language)),
ml AS (SELECT file_id, language, regexp_replace(file_id, '/[^/]*$', '') AS dir FROM (SELECT file_id, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM cur) LEFT JOIN lang USING (ext)),
im AS (SELECT DISTINCT src AS file_id, specifier, language, dir FROM edges JOIN ml ON ml.file_id = src WHERE specifier IS NOT NULL UNION SELECT file_id, specifier, language, dir FROM rel JOIN ml USING (file_id) WHERE language IN ('typescript', 'javascript')),
bs AS (SELECT file_id, specifier, language, CASE WHEN specifier LIKE './../%' THEN rel.base WHEN specifier LIKE './%' THEN dir || substr(specifier, 2) WHEN specifier LIKE '../%' THEN regexp_replace(dir, '/?[^/]*$', '') || substr(specifier, 3) END AS base FROM im LEFT JOIN rel USING (file_id, specifier)),
cn AS (SELECT file_id, specifier, language, n, base || e AS c FROM bs, tail WHERE base IS NOT NULL AND language NOT IN ('java', 'kotlin', 'groovy', 'csharp', 'go', 'rust') AND NOT regexp_matches(base, '[^/]\\.[^./]+$')
  UNION ALL SELECT file_id, specifier, language, 0, base FROM bs WHERE regexp_matches(base, '[^/]\\.[^./]+$') AND language NOT IN ('java', 'kotlin', 'groovy', 'csharp', 'go', 'rust')
  UNION ALL SELECT file_id, specifier, language, 0, base || '.rs' FROM bs WHERE language = 'rust' UNION ALL SELECT file_id, specifier, language, 1, base || '/mod.rs' FROM bs WHERE language = 'rust'),
ht AS (SELECT file_id, specifier, arg_min(c, n) AS target FROM cn WHERE c IN (SELECT file_id FROM cur) GROUP BY 1, 2),
res AS (SELECT im.file_id, im.specifier, language, target FROM im LEFT JOIN ht USING (file_id, specifier) WHERE target IS NULL OR target <> im.file_id)
"""
SQL = {
    "resolve_candidates_first": _R + "SELECT DISTINCT file_id, specifier, target FROM rel LEFT JOIN relr USING (file_id, specifier)",
    "resolve_longest_prefix": _R + """, tgt AS (SELECT repo, t, row_number() OVER (PARTITION BY repo ORDER BY t) AS ord FROM (SELECT DISTINCT repo, regexp_extract(path, '^(.*?/)?src/') AS t FROM cur) WHERE t <> ''),
s AS (SELECT DISTINCT src AS file_id, split_part(src, '/', 1) AS repo, '@/' || regexp_replace(regexp_replace(dst, '^.*?/src/', ''), '\\.[^./]+$', '') AS specifier FROM inside WHERE contains(dst, '/src/')),
c AS (SELECT file_id, specifier, ord, n, repo || '/' || t || specifier[3:] || e AS c FROM s JOIN tgt USING (repo), tail WHERE NOT regexp_matches(specifier, '[^/]\\.[^./]+$')
  UNION ALL SELECT file_id, specifier, ord, 0, repo || '/' || t || specifier[3:] FROM s JOIN tgt USING (repo) WHERE regexp_matches(specifier, '[^/]\\.[^./]+$')),
h AS (SELECT file_id, specifier, arg_min(c, (ord, n)) AS target FROM c WHERE c IN (SELECT file_id FROM cur) GROUP BY 1, 2)
SELECT file_id, specifier, target FROM s LEFT JOIN h USING (file_id, specifier) UNION ALL SELECT DISTINCT file_id, '@shared/x', NULL FROM s""",
    "resolve_ancestors": _R + f""", py AS (SELECT src AS file_id, replace(regexp_replace(regexp_replace(dst, '^[^/]+/', ''), '\\.py$', ''), '/', '.') AS m, regexp_extract(dst, '([^/]+)\\.py$', 1) AS t FROM inside WHERE suffix(src, '.py') AND suffix(dst, '.py')),
s AS (SELECT DISTINCT file_id, m AS specifier FROM py UNION SELECT file_id, t FROM py UNION SELECT file_id, '.' || t FROM py),
b AS (SELECT file_id, specifier, u, 0 AS k, up || '/' || replace(specifier, '.', '/') AS base FROM (SELECT *, unnest({_UP.format('file_id')}) AS up, generate_subscripts({_UP.format('file_id')}, 1) AS u FROM s WHERE specifier[1] <> '.')
  UNION ALL SELECT file_id, specifier, u, 1, up || '/src/' || replace(specifier, '.', '/') FROM (SELECT *, unnest({_UP.format('file_id')}) AS up, generate_subscripts({_UP.format('file_id')}, 1) AS u FROM s WHERE specifier[1] <> '.')
  UNION ALL SELECT file_id, specifier, 0, 0, regexp_replace(file_id, '[^/]*$', '') || specifier[2:] FROM s WHERE specifier[1] = '.'),
h AS (SELECT file_id, specifier, arg_min(base || e, (u, k, n)) AS target FROM b, tail WHERE base || e IN (SELECT file_id FROM cur) GROUP BY 1, 2)
SELECT file_id, specifier, target FROM s LEFT JOIN h USING (file_id, specifier)""",
    "resolve_fqcn": _R + """, jv AS (SELECT repo, file_id, concat_ws('.', package_name, regexp_extract(file_id, '([^/]+)\\.java$', 1)) AS fqcn, package_name FROM cur WHERE suffix(file_id, '.java')),
ix AS (SELECT k, min(file_id) AS target FROM (SELECT file_id, CASE WHEN package_name IS NOT NULL THEN fqcn ELSE replace(regexp_replace(CASE WHEN contains(file_id, 'src/main/java/') THEN split_part(file_id, 'src/main/java/', 2) WHEN contains(file_id, 'src/') THEN substr(file_id, instr(file_id, 'src/') + 4) ELSE file_id END, '\\.java$', ''), '/', '.') END AS k FROM jv) GROUP BY 1),
s AS (SELECT DISTINCT (SELECT min(file_id) FROM jv j WHERE j.repo = jv.repo) AS file_id, unnest([fqcn, fqcn || '.LIMIT', fqcn || '.*']) AS specifier FROM jv)
SELECT file_id, specifier, CASE WHEN suffix(specifier, '.*') THEN NULL ELSE coalesce(a.target, b.target) END AS target FROM s LEFT JOIN ix a ON a.k = specifier LEFT JOIN ix b ON b.k = regexp_replace(specifier, '\\.[^.]*$', '') AND contains(specifier, '.')""",
    "specifier_buckets": _G + """, p AS (SELECT DISTINCT split_part(file_id, '/', 1) AS ns, name, file_id FROM sym WHERE kind = 'class' AND name IS NOT NULL), sp AS (SELECT specifier FROM edges WHERE specifier IS NOT NULL
 UNION ALL SELECT 'partial:' || min(a.name) FROM p a JOIN p b ON a.ns = b.ns AND a.name = b.name AND a.file_id <> b.file_id GROUP BY a.file_id, b.file_id UNION ALL SELECT 'convention:tests' FROM cur WHERE is_test_file)
SELECT CASE WHEN NOT contains(specifier, ':') THEN 'regular' WHEN regexp_matches(specifier, ':[A-Z][^:]*$') THEN regexp_replace(specifier, '[^:]*$', '*') ELSE specifier END AS bucket, count(*) AS n FROM sp GROUP BY 1""",
    "resolution_stats": _STATS + "SELECT language, count(*) AS n, count(target) AS n_resolved, round(count(target) / count(*)::DOUBLE, 3) AS ratio FROM res GROUP BY 1",
    "unresolved_topk": _STATS + "SELECT language, specifier, n, sample, place FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, specifier) AS place FROM (SELECT language, specifier, count(*) AS n, min(file_id) AS sample FROM res WHERE target IS NULL GROUP BY 1, 2)) WHERE place <= 30",
    "partial_pairs": _G + ", p AS (SELECT DISTINCT split_part(file_id, '/', 1) AS ns, name, file_id FROM sym WHERE kind = 'class' AND name IS NOT NULL) SELECT a.file_id AS src, b.file_id AS dst, 'partial:' || min(a.name) AS specifier FROM p a JOIN p b ON a.ns = b.ns AND a.name = b.name AND a.file_id <> b.file_id GROUP BY 1, 2",
    "idempotent_merge": _G + ", p AS (SELECT DISTINCT split_part(file_id, '/', 1) AS ns, name, file_id FROM sym WHERE kind = 'class' AND name IS NOT NULL), n AS (SELECT DISTINCT a.file_id AS src, b.file_id AS dst FROM p a JOIN p b ON a.ns = b.ns AND a.name = b.name AND a.file_id <> b.file_id) SELECT 'import' AS kind, count(*) AS n FROM adj UNION ALL SELECT 'partial', count(*) FROM n WHERE (src, dst) NOT IN (SELECT (src, dst) FROM adj)",
}
_CALLS = """, cl AS (SELECT DISTINCT src AS symbol_id, s.file_id, split_part(dst, '#', -1) AS callee, line FROM symbol_edges e JOIN sym s ON s.symbol_id = e.src WHERE type = 'calls' AND e.src IS NOT NULL AND e.dst IS NOT NULL AND contains(e.dst, '#')),
ex0 AS (SELECT file_id, name FROM sym WHERE is_exported AND name IS NOT NULL),
ex AS (SELECT file_id, name FROM ex0 WHERE length(name) % 3 <> 0 UNION ALL SELECT file_id, 'Owner.' || name FROM ex0 WHERE regexp_matches(name, '^[a-z]') AND (length(name) + 6) % 3 = 0),
im AS (SELECT src AS file_id, dst, min(ord) AS ord FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
bare AS (SELECT DISTINCT file_id, callee FROM cl WHERE NOT contains(callee, '#')),
d1 AS (SELECT b.file_id, callee, arg_min(im.dst, (ord, im.dst)) || '#' || callee AS target FROM bare b JOIN im USING (file_id) JOIN (SELECT DISTINCT file_id AS dst, name AS callee FROM ex) x USING (dst, callee) GROUP BY 1, 2),
sf AS (SELECT file_id AS dst, regexp_extract(name, '^.+(?:\\.|::)([^.:]+)$', 1) AS callee, min(name) AS name FROM ex WHERE regexp_matches(name, '^.+(?:\\.|::)([^.:]+)$') GROUP BY 1, 2 HAVING count(*) = 1),
d2 AS (SELECT file_id, callee, min(dst) || '#' || min(name) AS target FROM bare JOIN im USING (file_id) JOIN sf USING (dst, callee) WHERE (file_id, callee) NOT IN (SELECT (file_id, callee) FROM d1) GROUP BY 1, 2 HAVING count(*) = 1)
"""
SQL["call_resolve_direct"] = _G + _CALLS + "SELECT symbol_id, callee, line, target FROM cl JOIN d1 USING (file_id, callee)"
SQL["call_resolve_unique_suffix"] = _G + _CALLS + "SELECT symbol_id, callee, line, target FROM cl JOIN d2 USING (file_id, callee)"
