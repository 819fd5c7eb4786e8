"""find: files ranked for a set of terms, and everything the page shows about them.

A query's terms are a handful of literals in the plan; candidates come from the bodies, names, paths and symbols,
scores from coverage, document frequency and where a term stands. One pass over the bodies gives the candidates, a few flags a
file; they are written once and all of ranking, evidence and relations reads only them. Lines are cut, masked and matched inside
their file's row, so of a body only lines that hold a term ever move.

Defined cases: no usable term gives empty results; a term no file has gets df 0; null texts, paths and names match
nothing; ties rank by file id.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import fixed as K
from tessera.functions import text as X
from tessera.operators.graph import drop_containers
from tessera.session import current_rows, cut, top_k


def live_files(files: DataFrame) -> DataFrame:
    """Current rows of the files that aren't deleted."""
    cols = ["repo", "path", "language", "line_count", "token_estimate", "is_barrel", "is_test_file", "reexport_ratio", "package_name", "hash", "mtime_ms", "size_bytes", "imported_by_count", "deleted_at", "domain_map", "exports"]
    return current_rows(files, *cols).where("deleted_at is null").drop("deleted_at")


def live_symbols(symbols: DataFrame) -> DataFrame:
    """One row per live symbol (repeated rows are equal)."""
    cols = ["file_id", "name", "kind", "start_line", "end_line", "is_exported", "extends_name", "implements"]
    return symbols.where("deleted_at is null and symbol_id is not null").groupBy("symbol_id").agg(F.max(F.struct("indexed_at", *cols)).alias("r")).select("symbol_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def matching(c: Column, terms: list[str], fold: bool = False) -> Column:
    """The terms a text contains, without case; with ``fold`` dashes and underscores of both sides don't count."""
    low = F.lower(X.fold_sep(c) if fold else c)
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit((t.replace("-", "").replace("_", "") if fold else t).lower()).alias("k")) for t in terms])
    return F.transform(F.filter(pairs, lambda p: low.contains(p["k"])), lambda p: p["t"])


def body_coverage(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(file_id, term) of the texts: one pass over the texts, no join."""
    return docs.where("file_id is not null").select("file_id", F.explode(matching(F.col("text"), terms)).alias("term")).distinct()


def name_coverage(files: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(file_id, term, in_name, in_path): a symbol's name or the path contains the term, separators folded."""
    path = files.select("file_id", F.explode(matching(F.col("path"), terms, True)).alias("term"), F.lit(False).alias("in_name"), F.lit(True).alias("in_path"))
    name = symbols.select("file_id", F.explode(matching(F.col("name"), terms, True)).alias("term"), F.lit(True).alias("in_name"), F.lit(False).alias("in_path"))
    return path.unionByName(name).groupBy("file_id", "term").agg(F.max("in_name").alias("in_name"), F.max("in_path").alias("in_path"))


def symbol_names(symbols: DataFrame) -> DataFrame:
    """``file_id, name`` of the live symbols, repeated rows and all: enough for whether a name contains a term."""
    return symbols.where("deleted_at is null and symbol_id is not null").select("file_id", "name")


def candidates(docs: DataFrame, files: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(file_id, term, in_name, in_path, in_body) of live files, written once: the union of all channels.

    Each channel gives a flag per term and row; one aggregation by file joins them and tells the live files.
    """
    n = len(terms)

    def channel(df: DataFrame, c: str, at: int, live: bool) -> DataFrame:
        low = F.lower(X.fold_sep(c) if at < 2 else F.col(c))
        keys = [(t.replace("-", "").replace("_", "") if at < 2 else t).lower() for t in terms]
        flags = [F.coalesce(low.contains(k), F.lit(False)) if m // n == at else F.lit(False) for m, k in enumerate(keys * 3)]
        return df.where(f"file_id is not null and ({c} is not null or {str(live).lower()})").select("file_id", *[f.alias(f"f{m}") for m, f in enumerate(flags)], F.lit(live).alias("live"))

    rows = channel(symbols, "name", 0, False).unionByName(channel(files, "path", 1, True)).unionByName(channel(docs, "text", 2, False))
    per_file = rows.groupBy("file_id").agg(*[F.max(f"f{m}").alias(f"f{m}") for m in range(3 * n)], F.max("live").alias("live")).where("live")
    met = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"f{m}").alias("in_name"), F.col(f"f{n + m}").alias("in_path"), F.col(f"f{2 * n + m}").alias("in_body")) for m, t in enumerate(terms)])
    return cut(per_file.select("file_id", F.explode(F.filter(met, lambda x: x["in_name"] | x["in_path"] | x["in_body"])).alias("x")).select("file_id", "x.*"))


def doc_freq(cand: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df), 0 for terms that no candidate has."""
    asked = cand.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return asked.join(cand.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def term_weights(cand: DataFrame, terms: list[str], n_files: int) -> DataFrame:
    """(term, df, idf, max_idf, is_rare, is_disc): one row per term, so the table is as small as the query."""
    n = F.lit(n_files)
    w = Window.partitionBy(F.lit(1))
    scored = doc_freq(cand, terms).withColumn("idf", X.idf_find("df", n))
    median = F.element_at(F.array_sort(F.collect_list("idf").over(w)), F.floor((F.count("idf").over(w) - 1) / 2).cast("int") + 1)
    return scored.select("term", "df", "idf", F.greatest(F.lit(1.0), F.max("idf").over(w)).alias("max_idf"), (F.col("df") / n < K.RARE_FRACTION).alias("is_rare"), (F.col("idf") >= median).alias("is_disc"))


def rank(cand: DataFrame, weights: DataFrame, limit: int | None = K.JSON_LISTED) -> DataFrame:
    """(file_id, score, coverage), best first: 3 per term, and idf shares for names and paths."""
    part = (K.NAME_WEIGHT * F.col("idf") * F.col("in_name").cast("int") + K.PATH_WEIGHT * F.col("idf") * F.col("in_path").cast("int")) / F.col("max_idf")
    out = cand.join(F.broadcast(weights), "term").groupBy("file_id").agg(F.count(F.lit(1)).alias("coverage"), F.sum(part).alias("evidence"))  # weights: a row per term of the query
    out = out.select("file_id", F.round(K.COVERAGE_WEIGHT * F.col("coverage") + F.col("evidence"), 4).alias("score"), "coverage").orderBy(F.desc("score"), "file_id")
    return out.limit(limit) if limit else out


def import_carriers(cand: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, term, ord, target): imports of a live file whose path or symbols contain the term."""
    named = cand.where("in_name or in_path").select(F.col("file_id").alias("dst"), "term")
    e = imports.where("src is not null and dst is not null").select("src", "dst", "ord").distinct()
    return e.join(named, "dst").select(F.col("src").alias("file_id"), "term", "ord", F.col("dst").alias("target"))


def evidence(cand: DataFrame, weights: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, term, class): declares > in_path > imports (rare terms) > mentions (rare terms); the first that holds.

    A file imports a term if an edge of its leads to a file that declares the term or has it in its path.
    """
    spec = import_carriers(cand, imports).select("file_id", "term").distinct().withColumn("imports", F.lit(True))
    all_ = cand.join(F.broadcast(weights.select("term", "is_rare")), "term").join(spec, ["file_id", "term"], "left")
    kind = F.when(F.col("in_name"), "declares").when(F.col("in_path"), "in_path").when(F.col("is_rare") & F.col("imports"), "imports").when(F.col("is_rare") & F.col("in_body"), "mentions")
    return all_.select("file_id", "term", kind.alias("class")).where("class is not null")


def partition(cand: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, class, shown): doc, style or code; vendored ones and code without evidence aren't shown."""
    n = found.groupBy("file_id").agg(F.count(F.lit(1)).alias("disc"))
    f = files.join(cand.select("file_id").distinct(), "file_id", "left_semi").join(n, "file_id", "left")
    kind = F.when(X.is_doc("path"), "doc").when(X.is_style("path"), "style").otherwise("code")
    hidden = X.is_vendor_or_minified("path", "token_estimate", "line_count")
    return f.select("file_id", kind.alias("class"), hidden.alias("vendored"), F.coalesce("disc", F.lit(0)).alias("disc")).withColumn("shown", ~F.col("vendored") & ((F.col("class") != "code") | (F.col("disc") > 0)))


def lines(docs: DataFrame) -> DataFrame:
    """(file_id, line, text) of source files, lines from 0."""
    return docs.where("file_id is not null and text is not null").select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


#: Noncharacters of Unicode, put in for what stands inside triple quotes and for the quotes themselves.
_INSIDE, _QUOTES = "\ufdd0", "\ufdd1"


def masked(text: Column | str) -> Column:
    """A text's lines as an array of (line, text, excluded), in one pass over the text.

    Excluded are comment lines by their leader, and lines of triple-quoted texts by the parity of the quotes before: every
    second stretch between such quotes is inside, so its line ends get a mark that the split leaves at the front of its lines.
    """
    clean = F.translate(text if isinstance(text, Column) else F.col(text), _INSIDE + _QUOTES, "\ufffd\ufffd")
    woven = F.array_join(F.transform(F.split(clean, '"""|\'\'\'', -1), lambda s, n: F.when(n % 2 == 1, F.replace(s, F.lit("\n"), F.lit("\n" + _INSIDE))).otherwise(s)), _QUOTES)
    comment = lambda t: F.trim(t).rlike(r"^(#|//|/\*|\*|<!--|;;|--\s)")
    return F.transform(F.split(woven, "\n", -1), lambda t, n: F.struct(n.alias("line"), t.alias("text"), (t.startswith(_INSIDE) | t.contains(_QUOTES) | comment(t)).alias("excluded")))


def masked_lines(docs: DataFrame) -> DataFrame:
    """(file_id, lines) of source files."""
    return docs.where("file_id is not null and text is not null").select("file_id", masked("text").alias("lines"))


def line_counts(docs: DataFrame) -> DataFrame:
    """(file_id, n_lines, n_excluded): lines of a file and those its mask leaves out."""
    m = masked_lines(docs).select("file_id", F.size("lines").alias("n"), F.size(F.filter("lines", lambda x: x["excluded"])).alias("x"))
    return m.groupBy("file_id").agg(F.sum("n").alias("n_lines"), F.sum("x").alias("n_excluded"))


def convergence(docs: DataFrame, weights: DataFrame, terms: list[str], n_files: int) -> DataFrame:
    """(file_id, line, n_terms, score) of the lines worth a preview: two terms within three lines, or a rare one.

    Only lines with a term leave their text's row.
    """
    with_terms = F.filter(F.transform(F.filter("lines", lambda x: ~x["excluded"]), lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text"), matching(x["text"], terms).alias("terms"))), lambda x: F.size(x["terms"]) > 0)
    rows = masked_lines(docs).select("file_id", F.explode(with_terms).alias("x")).select("file_id", "x.line", X.is_import_line("x.text").alias("is_import"), F.explode("x.terms").alias("term"))
    hits = rows.join(F.broadcast(weights.select("term", "df", "is_rare")), "term")  # weights: a row per term of the query
    near = Window.partitionBy("file_id").orderBy("line").rangeBetween(-K.WINDOW_LINES, K.WINDOW_LINES)
    hits = hits.withColumn("near", F.collect_set(F.struct("term", "df")).over(near))
    per_line = hits.groupBy("file_id", "line").agg(F.first("near").alias("near"), F.max("is_rare").alias("rare"), F.max("is_import").alias("is_import"))
    weight = F.aggregate("near", F.lit(0.0), lambda a, t: a + F.lit(float(n_files)) / F.greatest(F.lit(1), t["df"]))
    score = weight * F.when(F.col("is_import"), K.IMPORT_BOOST).otherwise(1.0)
    return per_line.where((F.size("near") >= 2) | F.col("rare")).select("file_id", "line", F.size("near").cast("bigint").alias("n_terms"), F.round(score, 6).alias("score"))


def clusters(hits: DataFrame) -> DataFrame:
    """(file_id, cluster, first_line, last_line, peak, peak_rank): hits more than three lines apart part ways."""
    w = Window.partitionBy("file_id").orderBy("line")
    gap = F.when(F.col("line") - F.lag("line").over(w) > K.WINDOW_LINES, 1).otherwise(0)
    marked = hits.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(w))
    out = marked.groupBy("file_id", "cluster").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max("score").alias("peak"))
    return out.withColumn("peak_rank", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("peak"), "first_line")).cast("bigint"))


def relations(cand: DataFrame, imports: DataFrame, hub: int = K.HUB_DEGREE) -> DataFrame:
    """(a, b, relation) among candidates: consumes (a imports b), or siblings (a < b share a neighbour that is no hub).

    Neighbours with a degree above ``hub`` are cut before the self-join, which bounds its rows per neighbour.
    """
    among = cand.select("file_id").distinct()
    e = imports.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
    a, b = among.withColumnRenamed("file_id", "src"), among.withColumnRenamed("file_id", "dst")
    direct = e.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    targets = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= hub).select("dst")
    sources = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= hub).select("src")
    shared = e.join(targets, "dst", "left_semi").join(a, "src", "left_semi").select(F.concat(F.lit("t:"), "dst").alias("key"), F.col("src").alias("file_id")).unionByName(
        e.join(sources, "src", "left_semi").join(b, "dst", "left_semi").select(F.concat(F.lit("s:"), "src").alias("key"), F.col("dst").alias("file_id"))
    )
    left, right = shared.select("key", F.col("file_id").alias("a")), shared.select("key", F.col("file_id").alias("b"))
    pairs = left.join(right, "key").where("a < b").select("a", "b").distinct()
    either = direct.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return direct.withColumn("relation", F.lit("consumes")).unionByName(pairs.join(either, ["a", "b"], "left_anti").withColumn("relation", F.lit("siblings")))


def import_targets(cand: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, term, target): the first import, by its order, of a live file whose path or symbols contain the term."""
    return import_carriers(cand, imports).groupBy("file_id", "term").agg(F.min(F.struct("ord", "target")).alias("first")).select("file_id", "term", "first.target")


def rare_postings(tokens: DataFrame, files: DataFrame, lo: int = K.MIN_POSTINGS, hi: int = K.MAX_POSTINGS) -> DataFrame:
    """(token, df, files): shaped tokens of two to five files, tests and barrels aside. The bound on df is what
    makes the self-join of ``bridges`` small."""
    plain = files.where("not coalesce(is_test_file, false) and not coalesce(is_barrel, false)").select("file_id")
    t = tokens.join(plain, "file_id", "left_semi").select("file_id", "token").distinct()
    few = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(lo, hi))  # counted before anything is collected
    return t.join(few, "token").groupBy("token", "df").agg(F.array_sort(F.collect_set("file_id")).alias("files")).select("token", "df", "files")


def content_tokens(docs: DataFrame) -> DataFrame:
    """(file_id, token, bits), written once: shaped names of the code (1) and of its string literals (2), comments left out."""
    code = F.array_join(F.transform(F.filter("lines", lambda x: ~x["excluded"]), lambda x: x["text"]), "\n")
    literal = F.lit("\"[^\"\n]*\"|'[^'\n]*'")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)))
    both = masked_lines(docs).select("file_id", code.alias("code")).select("file_id", words(F.regexp_replace("code", literal, F.lit(" "))).alias("bare"), words(F.array_join(F.regexp_extract_all("code", literal, F.lit(0)), " ")).alias("quoted"))
    # distinct words leave the row, so their shape is judged in generated code
    bit = lambda c, n: F.transform(F.col(c), lambda t: F.struct(t.alias("word"), F.lit(n).alias("bit")))
    one = both.select("file_id", F.explode(F.concat(bit("bare", 1), bit("quoted", 2))).alias("w")).select("file_id", "w.word", "w.bit").where(X.is_shaped_token("word")).select("file_id", F.lower("word").alias("token"), "bit")
    return cut(one.groupBy("file_id", "token").agg(F.bit_or("bit").alias("bits")))


def bridges(postings: DataFrame, tokens: DataFrame, imports: DataFrame) -> DataFrame:
    """(a, b, n_shared, min_df): files of different directories that share rare tokens and no import edge.

    One shared token is enough if it stands in a string literal of either file, or is in at most three files and has
    three words; else there must be two.
    """
    p = postings.select("token", "df", F.explode("files").alias("file_id")).join(tokens, ["file_id", "token"])
    pairs = p.select("token", "df", F.col("file_id").alias("a"), F.col("bits").alias("x")).join(p.select("token", F.col("file_id").alias("b"), F.col("bits").alias("y")), "token").where("a < b")
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    quoted = (F.col("x").bitwiseOR(F.col("y")).bitwiseAND(F.lit(2)) != 0).cast("int")
    scored = pairs.where(folder(F.col("a")) != folder(F.col("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"), F.min("df").alias("min_df"), F.max(F.size(X.split_name("token"))).alias("words"), F.max(quoted).alias("quoted"))
    strong = scored.where("n_shared >= 2 or quoted = 1 or (min_df <= 3 and words >= 3)")
    e = imports.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return strong.join(e, ["a", "b"], "left_anti").select("a", "b", "n_shared", "min_df")


def query_stems(terms: list[str]) -> list[str]:
    """The terms of four characters or more, and such parts of them between underscores and signs."""
    return sorted({p for t in terms for p in [t.lower(), *re.split(r"[_\W]+", t.lower())] if len(p) >= 4})


def near_query(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose ``token`` contains a stem of the query or is contained in one; all of them if the query has no stem."""
    stems = query_stems(terms)
    if not stems:
        return tokens
    near = F.lit(False)
    for s in stems:
        near = near | F.col("token").contains(s) | F.lit(s).contains(F.col("token"))
    return tokens.where(near)


def related_files(linked: DataFrame, cap: int = 3) -> DataFrame:
    """(file_id, related, n_shared, place): the three files each file shares most rare tokens with, rarer ones first."""
    both = linked.select(F.col("a").alias("file_id"), F.col("b").alias("related"), "n_shared", "min_df").unionByName(linked.select(F.col("b").alias("file_id"), F.col("a").alias("related"), "n_shared", "min_df"))
    return top_k(both, ["file_id"], [F.desc("n_shared"), "min_df", "related"], cap).select("file_id", "related", "n_shared", "place")


def page_links(pairs: list[tuple[str, str, int]], cap: int = 6) -> list[tuple[str, str, int]]:
    """The links of one page, strongest first: a link between files that two stronger links join already is implied and left out.

    ``pairs`` are (a, b, shared tokens) among the dozen files of a page, so this runs at the driver.
    """
    kept: list[tuple[str, str, int]] = []
    near: dict[str, set[str]] = {}
    for a, b, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if len(kept) == cap:
            break
        if near.get(a, set()) & near.get(b, set()):
            continue
        kept.append((a, b, n))
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return kept


def name_echo(files: DataFrame, terms: list[str], most: int = 200) -> DataFrame:
    """(file_id, term): file names that contain a term, for terms that few names contain."""
    name = F.element_at(F.split("path", "/"), -1)
    hits = files.select("file_id", F.explode(matching(name, terms, True)).alias("term"))
    few = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most)
    return hits.join(few, "term", "left_semi").distinct()


# ---- the page ----------------------------------------------------------------------------------------


def matched_symbols(symbols: DataFrame, files: DataFrame, weights: DataFrame, terms: list[str]) -> DataFrame:
    """(file_id, symbol_id, name, start_line, end_line, place): symbols of long files whose name has a discriminating term.

    Those that contain another one are left out, the six with most weight kept, back in the order of their lines.
    """
    s = symbols.join(files.where(F.col("line_count") >= K.LONG_FILE).select("file_id"), "file_id", "left_semi")
    met = s.select("file_id", "symbol_id", "name", "start_line", "end_line", F.explode(matching(F.col("name"), terms, True)).alias("term"))
    disc = weights.where("is_disc").select("term", "idf")  # a row per term of the query
    scored = met.join(F.broadcast(disc), "term").groupBy("file_id", "symbol_id", "name", "start_line", "end_line").agg(F.round(F.sum("idf"), 6).alias("weight"))
    scored = cut(scored)  # read on both sides of the next join
    inner = drop_containers(scored)
    top = top_k(inner, ["file_id"], [F.desc("weight"), F.col("start_line").asc_nulls_last(), "symbol_id"], K.MATCHED_SYMBOLS)
    back = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("start_line").asc_nulls_last(), "symbol_id"))  # six rows a file
    return top.withColumn("place", back.cast("bigint")).select("file_id", "symbol_id", "name", "start_line", "end_line", "place")


def listed(cand: DataFrame, weights: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, class, score, coverage, place): the page's files, twelve of code, four documents, four styles, best first."""
    shown = partition(cand, files, found).where("shown").select("file_id", "class")
    ranked = rank(cand, weights, None).join(shown, "file_id")
    return top_k(ranked, ["class"], [F.desc("score"), "file_id"], K.LISTED).where(F.col("place") <= F.when(F.col("class") == "code", K.LISTED).when(F.col("class") == "doc", K.DOCS_LISTED).otherwise(K.STYLES_LISTED))


def via(pairs: DataFrame, found: DataFrame, cand: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, term, place): why ``a`` consumes ``b``: the discriminating terms that b declares and a has, two with the best idf."""
    declared = found.where("class = 'declares'").select(F.col("file_id").alias("b"), "term")
    both = pairs.join(declared, "b").join(cand.select(F.col("file_id").alias("a"), "term"), ["a", "term"], "left_semi").join(F.broadcast(weights.where("is_disc").select("term", "idf")), "term")
    return top_k(both, ["a", "b"], [F.desc("idf"), "term"], 2).select("a", "b", "term", "place")


def page(cand: DataFrame, weights: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, terms: list[str], notes: DataFrame | None = None) -> DataFrame:
    """One row per listed file: ``class, place, file_id, score, coverage``, what it does with the terms (``declares, in_path,
    imports, mentions``), the symbols to read, its relations to other listed files of code (``uses, used_by, near``, three
    each, and ``via`` terms of what it uses), and the best note of its path where ``notes(path, note_id)`` is given.

    All that comes after ``listed`` is about two dozen files at most.
    """
    found = evidence(cand, weights, imports)
    top = cut(listed(cand, weights, files, found))
    ids = top.select("file_id")
    order = {t: n for n, t in enumerate(terms)}
    rank_of = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    words = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("class") == c, F.struct(rank_of[F.col("term")].alias("n"), "term")))), lambda x: x["term"]).alias(c)
    role = found.join(ids, "file_id", "left_semi").groupBy("file_id").agg(*[words(c) for c in ("declares", "in_path", "imports", "mentions")])
    read = matched_symbols(symbols.join(ids, "file_id", "left_semi"), files, weights, terms)
    read = read.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.format_string("%s [L%s-%s]", "name", "start_line", "end_line").alias("t")))), lambda x: x["t"]).alias("symbols"))
    code = top.where("class = 'code'").select("file_id", "place")
    rel = cut(relations(code, imports))
    place = lambda k, o: rel.join(code.select(F.col("file_id").alias(o), F.col("place").alias("n")), o)
    three = lambda df, k, o, name: df.groupBy(F.col(k).alias("file_id")).agg(F.transform(F.slice(F.array_sort(F.collect_set(F.struct("n", F.col(o).alias("o")))), 1, 3), lambda x: x["o"]).alias(name))
    uses = three(place("a", "b").where("relation = 'consumes'"), "a", "b", "uses")
    used = three(place("b", "a").where("relation = 'consumes'"), "b", "a", "used_by")
    sib = rel.where("relation = 'siblings'")
    both = sib.select("a", "b").unionByName(sib.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(code.select(F.col("file_id").alias("b"), F.col("place").alias("n")), "b")
    near = three(both, "a", "b", "near")
    why = via(rel.where("relation = 'consumes'").select("a", "b"), found, cand, weights).groupBy(F.col("a").alias("file_id")).agg(F.array_sort(F.collect_set("term")).alias("via"))
    out = top
    for part in (role, read, uses, used, near, why):
        out = out.join(part, "file_id", "left")
    none = F.array().cast("array<string>")
    lists = ["declares", "in_path", "imports", "mentions", "symbols", "uses", "used_by", "near", "via"]
    out = out.select("class", "place", "file_id", "score", "coverage", *[F.coalesce(c, none).alias(c) for c in lists])
    return out if notes is None else out.join(notes.select(F.col("path").alias("file_id"), "note_id"), "file_id", "left")


def bridged(tops: DataFrame, shown: DataFrame, tokens: DataFrame, files: DataFrame, imports: DataFrame, terms: list[str], cap: int = K.BRIDGES_LISTED) -> DataFrame:
    """(source, related, tokens, place): files that no import joins to one of ``tops(file_id, place)`` but rare names do, some of
    them near the query; those ``shown`` aside, three a source, six in all, each once under its best source."""
    post = rare_postings(tokens, files)
    linked = bridges(post, tokens, imports)
    two = linked.select(F.col("a").alias("source"), F.col("b").alias("related"), "n_shared", "min_df").unionByName(linked.select(F.col("b").alias("source"), F.col("a").alias("related"), "n_shared", "min_df"))
    mine = two.join(tops.select(F.col("file_id").alias("source"), F.col("place").alias("rank")), "source").join(shown.select(F.col("file_id").alias("related")), "related", "left_anti")
    where = post.select("token", F.explode("files").alias("file_id"))
    names = mine.select("source", "related").join(where.withColumnRenamed("file_id", "source"), "source").join(where.select("token", F.col("file_id").alias("related")), ["related", "token"])
    names = names.groupBy("source", "related").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    stems = query_stems(terms)
    close = lambda t: reduce(lambda x, y: x | y, [t.contains(s) | F.lit(s).contains(t) for s in stems], F.lit(not stems))
    rows = top_k(mine.join(names, ["source", "related"]).where(F.exists("tokens", close)), ["source"], [F.desc("n_shared"), "min_df", "related"], 3)
    once = rows.groupBy("related").agg(F.min(F.struct("rank", "place", "source", F.slice("tokens", 1, 3).alias("tokens"))).alias("b")).select("related", "b.*").orderBy("rank", "place").limit(cap)
    return once.select("source", "related", "tokens", F.row_number().over(Window.orderBy("rank", "place")).cast("bigint").alias("place"))  # over ``cap`` rows
