"""The relational operators as queries over plain tables: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import blocks, buckets, content, graph, groups
from . import assess

WORD = r"([^ \n\t\r]+)"
SUFFIXES = {"py": "python", "js": "javascript", "ts": "typescript", "html": "html", "md": "markdown"}
TIERS = ("recommended_edit", "review_candidate", "maintenance_note", "observation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(WORD))


def word_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("all").alias("group"), F.col("doc_id").alias("id"), F.array_distinct(words()).alias("tokens"), F.sha2("text", 256).alias("body"))


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("all").alias("group"), F.col("doc_id").alias("unit"), F.split("text", "\n", -1).alias("keys"))


def lines_as_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_units(spark, sf_dir).select("unit", F.posexplode("keys").alias("pos", "line"))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("line").orderBy("unit", "pos"))
    return lines.select(F.col("unit").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.sha2("line", 256).alias("line_hash"), n.cast("long").alias("ordinal"))


def exact_body_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("body_hash"), "doc_id")
    return d.groupBy("body_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("copies > 1")


def token_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.document_frequency(word_items(spark, sf_dir)).select("token", "df")


def rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.rare_tokens(word_items(spark, sf_dir), 16).select("token", "df")


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = word_items(spark, sf_dir)
    return content.content_edges(items, items.filter(F.size("tokens") >= 4))


def content_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(spark, sf_dir).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "similarity")


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = word_items(spark, sf_dir)
    pairs = content.shared_rare(items, items.filter(F.size("tokens") >= 4), 16, 2)
    return content.verified(pairs, items, 0.55).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "similarity")


def top8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = similarity_pairs(spark, sf_dir)
    sides = e.select(F.col("left_id").alias("node"), F.col("right_id").alias("neighbour"), "similarity").union(e.select(F.col("right_id"), F.col("left_id"), "similarity"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "neighbour"))
    return sides.withColumn("place", place.cast("long")).filter("place <= 8")


def shared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = blocks.windows(line_units(spark, sf_dir), 4)
    return blocks.rare_windows(w, 8).select(F.col("window"), F.col("df"))


def maximal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = line_units(spark, sf_dir)
    w = blocks.windows(units, 4)
    runs = blocks.maximal_runs(units, blocks.seeds(w, blocks.rare_windows(w, 8)))
    return runs.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.col("a_start").cast("long").alias("left_start"), F.col("b_start").cast("long").alias("right_start"), F.col("length").cast("long").alias("length"))


def shared_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by member set after overlap removal: order-dependent, so without SQL."""
    runs = maximal_runs(spark, sf_dir)
    pairs = runs.select(F.concat_ws(",", F.least("left_id", "right_id"), F.greatest("left_id", "right_id")).alias("block"), F.col("left_id").alias("unit"), F.col("left_start").alias("start"), "length").union(
        runs.select(F.concat_ws(",", F.least("left_id", "right_id"), F.greatest("left_id", "right_id")), F.col("right_id"), F.col("right_start"), "length")
    )
    return blocks.without_overlaps(pairs)


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges_of(spark, sf_dir).select("a", "b")).select(F.col("node").alias("doc_id"), F.col("root").alias("component"))


def bounded_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bounded_components(edges_of(spark, sf_dir).select("a", "b", F.col("similarity").alias("weight")), 12).select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "component")


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_type", F.col("p_partkey"))
    keys = F.array(F.concat(F.lit("name:"), "p_name"), F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("role:"), "p_type", F.lit("|"), F.split("p_name", " ")[0]))
    return p.select(F.col("p_brand").alias("cluster"), F.explode(keys).alias("key"), F.col("p_partkey").alias("member"), F.col("p_partkey").alias("place"))


def bucket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_pairs(part_keys(spark, sf_dir), 32).select("cluster", F.col("a").alias("left_id"), F.col("b").alias("right_id"))


def bucket_cut_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.bucket_cuts(part_keys(spark, sf_dir), 32).select("cluster", F.col("cut").cast("long").alias("cut"))


def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("member"), F.split("p_name", " ").alias("tokens"))
    pairs = buckets.bucket_pairs(part_keys(spark, sf_dir), 32)
    scored = pairs.join(p.select(F.col("member").alias("a"), F.col("tokens").alias("x")), "a").join(p.select(F.col("member").alias("b"), F.col("tokens").alias("y")), "b")
    scored = scored.withColumn("estimate", S.jaccard(F.array_distinct("x"), F.array_distinct("y")))
    return buckets.best_candidates(scored, "estimate", 400).select("cluster", F.col("a").alias("left_id"), F.col("b").alias("right_id"), "estimate")


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and the distinct names of parts that share their first letter."""
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(table(spark, sf_dir, "part").select(F.lower("p_name"))).distinct().withColumn("initial", F.substring("name", 1, 1))
    pairs = names.select("initial", F.col("name").alias("left_name")).join(names.select("initial", F.col("name").alias("right_name")), "initial").filter("left_name < right_name")
    return pairs.select("left_name", "right_name", S.name_similarity(F.col("left_name"), F.col("right_name")).cast("double").alias("similarity"))


def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names joined to identifiers in mixed case: parts' names run together with their types."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("HTTP2x"))).alias("identifier"))
    c = table(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("p_partkey"), F.col("c_name").alias("identifier"))
    both = p.union(c)
    return both.select(F.col("p_partkey").alias("key"), "identifier", S.normalized_identifier(F.col("identifier")).alias("normalized"), F.size(S.identifier_tokens(F.col("identifier"))).cast("long").alias("n_tokens"))


def constants_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the analysis finds among parts as named constants: the name and brand, the items (brand and words of the type) and a file (size)."""
    from .analyze import constant_clusters

    p = table(spark, sf_dir, "part")
    items, name = F.array_sort(F.array_distinct(F.concat(F.array("p_brand"), F.split("p_type", " ")))), F.concat_ws(" ", "p_name", "p_brand")
    rows = p.select(F.concat(F.lit("f"), F.col("p_size")).alias("file"), F.col("p_partkey").alias("start_line"), F.col("p_partkey").alias("end_line"), name.alias("symbol"), name.alias("normalized_symbol"), F.lit("list").alias("literal_kind"), items.alias("literal_items"), F.lit("source").alias("role"))
    return constant_clusters(rows.withColumn("literal_preview", F.array_join("literal_items", "|")).withColumn("literal_hash", F.sha2("literal_preview", 256)))


def constant_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constants_of(spark, sf_dir).filter("kind = 'identical'").select(F.array_join("symbols", ",").alias("symbols"), "members", F.size("files").cast("long").alias("files"), "line_span")


def constant_drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose variants share at least half of the smallest one's items, in two files or more."""
    return constants_of(spark, sf_dir).filter("kind = 'drifted'").select(F.array_join("symbols", ",").alias("symbols"), "variants", F.size("files").cast("long").alias("files"), F.col("overlap").cast("double").alias("overlap"))


def constant_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constants_of(spark, sf_dir).filter("kind = 'scattered'").select(F.array_join("symbols", ",").alias("symbols"), "members")


#: Folders and file names of the paths that file_records() describes, by part.
FOLDERS = ("src", "tests", "vendor", "dist", "generated", "fixtures", "docs", "Test", "node_modules", "lib")
FILES = ("main.py", "test_a.py", "a_test.ts", "a.spec.js", "README.md", "setup.cfg", "package.json", "b.generated.ts", "conftest.py", "notes.txt", "x.rs", "c.py", "D.TSX")


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, role and test flag of a path for each part."""
    from ..sources import files

    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    path = F.concat_ws("/", pick(FOLDERS), F.replace("p_name", F.lit(" "), F.lit("/")), pick(FILES))
    p = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return p.select("p_partkey", "path", files.language(F.col("path")).alias("language"), files.role(F.col("path")).alias("role"), files.flags(F.col("path"))["is_test"].alias("is_test"))


def multiset_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts against those of the same customer's next order, as multisets of size classes."""
    from pyspark.sql import Window

    sizes = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 5).cast("string").alias("cls")), "l_partkey")
    bags = sizes.groupBy("l_orderkey", "cls").agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("bag"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), "o_custkey").withColumn("next", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).filter("next is not null")
    both = o.join(bags.select(F.col("l_orderkey").alias("o_orderkey"), F.col("bag").alias("x")), "o_orderkey").join(bags.select(F.col("l_orderkey").alias("next"), F.col("bag").alias("y")), "next")
    return both.select(F.col("o_orderkey").alias("left_key"), F.col("next").alias("right_key"), S.multiset_jaccard(F.col("x"), F.col("y")).cast("double").alias("similarity"))


def mean_jaccard_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users against the next user: for each event type the set of days."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    maps = e.groupBy("user_id", "event_type").agg(F.collect_set("day").alias("days")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "days"))).alias("m"))
    both = maps.select("user_id", F.col("m").alias("x")).join(maps.select((F.col("user_id") - 1).alias("user_id"), F.col("m").alias("y")), "user_id")
    return both.select("user_id", S.mean_jaccard_by_key(F.col("x"), F.col("y")).cast("double").alias("similarity"))


def lcs_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role sequences of conversations against the next conversation's."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"))
    both = c.select("conv_id", F.col("roles").alias("x")).join(c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("y")), "conv_id")
    x, y = F.col("x"), F.col("y")
    return both.select("conv_id", S.common_prefix(x, y).cast("long").alias("prefix"), S.common_suffix(x, y).cast("long").alias("suffix"))


def lcs_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"))
    both = c.select("conv_id", F.col("roles").alias("x")).join(c.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("y")), "conv_id")
    return both.select("conv_id", S.lcs_length(F.col("x"), F.col("y")).cast("long").alias("lcs"))


def url_path(url: str = "url") -> Column:
    return F.regexp_extract(url, r"^[^:]*://[^/?#]*(/[^?#]*)?", 1)


def language_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url_path(), r"\.([A-Za-z0-9]+)$", 1).alias("suffix"))
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return p.select("page_id", "suffix", F.coalesce(F.element_at(known, F.col("suffix")), F.lit("other")).alias("language"))


def role_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = F.split(url_path(), "/")
    p = table(spark, sf_dir, "pages").select("page_id", segments.alias("s"), F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"))
    has = lambda *names: F.arrays_overlap("s", F.array(*map(F.lit, names)))
    role = F.when(has("fr"), "vendor").when(has("es"), "generated").when(F.startswith("host", F.lit("blog.")), "documentation").when(F.startswith("host", F.lit("m.")), "test").otherwise("source")
    return p.select("page_id", role.alias("role"))


def path_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url", url_path().alias("path"))
    marks = F.array_compact(F.array(F.when(F.col("path").rlike(r"/$"), "directory"), F.when(F.col("url").contains("?"), "query"), F.when(F.col("url").contains("#"), "anchor"), F.when(F.col("path").rlike(r"\.html$"), "file")))
    return p.select("page_id", F.array_join(F.array_sort(marks), ",").alias("roles"))


def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include globs and exclude globs on page paths."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(url_path(), "^/", "").alias("path"))
    chosen = S.glob_any(F.col("path"), ["en/**", "de/*", "*.html"]) & ~S.glob_any(F.col("path"), ["**/1*", "de/*.html"])
    return p.select("page_id", "path", chosen.alias("selected"))


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.zero_filled_counts(table(spark, sf_dir, "documents"), "lang", ("de", "en", "es", "fr", "it", "pt"))


def lead_row_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return groups.lead_rows(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


def group_structural_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each left document: kinds, labels and extents."""
    e = edges_of(spark, sf_dir)
    kind = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("b")).agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    j = e.join(kind, "b", "left")
    return j.groupBy(F.col("a").alias("doc_id")).agg(
        F.count("*").alias("edges"), F.count_if(F.col("similarity") == 1).alias("exact"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.max("similarity").alias("strongest"), F.min("b").alias("first_neighbour"), F.max("b").alias("last_neighbour")
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as findings: members are line items, files are suppliers, lines are quantities, risk and cost come from discount and tax."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(F.count("*").alias("members"), F.count_distinct("l_suppkey").alias("files"), F.max("l_quantity").alias("lines"), F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


def floor4(x: Column) -> Column:
    return F.floor(x * 10000.0 + 0.5) / 10000.0


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics(spark, sf_dir)
    scope = S.noisy_or(S.ramp_count(F.col("members"), 20, 60), S.ramp(F.col("lines"), 12.0, 120.0), S.ramp_count(F.col("files"), 2, 8))
    payoff = F.when(F.col("returned") > 0, 1.0).otherwise(0.65) * scope
    risk = S.clamp01(F.col("discount") * 4)
    cost = S.clamp01(F.col("tax") * 5)
    stable = S.ramp(F.col("members").cast("double"), 1.0, 40.0)
    fit = F.least(F.when(cost >= 0.65, 0.40).otherwise(1.0), F.greatest(F.lit(0.35), stable) * F.greatest(F.lit(0.15), S.inverse_ramp(F.col("files").cast("double"), 0.0, 12.0)) * F.greatest(F.lit(0.20), 1 - cost))
    detection = F.when(F.col("returned") >= 8, 0.90).when(F.col("returned") >= 4, F.least(F.lit(0.85), 0.30 + 0.05 * F.col("returned"))).when(F.col("members") >= 2, 0.18).otherwise(0.0)
    return m.select("l_partkey", "members", "files", "returned", floor4(payoff).alias("payoff"), floor4(risk).alias("risk"), floor4(cost).alias("cost"), floor4(fit).alias("fit"), floor4(detection.cast("double")).alias("detection"))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as drafts of the analysis: counts of their line items give members, pairs and lengths, the key decides the kind of evidence."""
    k, members, returned, none = F.col("l_partkey"), F.col("members"), F.col("returned"), F.array().cast("array<string>")
    m = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("members"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max("l_quantity").alias("lines"), F.collect_set((F.col("l_suppkey") % 7).cast("string")).alias("files"))
    named = lambda **names: F.array_compact(F.array(*[F.when(c, n) for n, c in names.items()]))
    one_of = lambda key, *names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    part = {f"{name}_members": F.when(k % 13 == i, members % 8).otherwise(0) for i, name in enumerate(("declaration", "api", "interface", "trivial", "example", "test", "protocol", "constructor", "special"))}
    return m.withColumns({
        "member_count": members % 8, "duplicate_pairs": F.when(k % 5 == 0, returned).otherwise(0), "blocks": F.when(k % 5 == 1, members).otherwise(0), "constants": F.when((k % 5 == 2) & (returned % 2 == 0), 1).otherwise(0),
        "relation_pairs": F.when(k % 5 == 3, members).otherwise(0), "body_matches": F.when(k % 10 == 0, returned).otherwise(0), "evidence_kinds": F.when(k % 5 == 4, F.array(F.lit("argument_normalization_wrapper"))).otherwise(none),
        "basis": named(body_structure_similarity=returned % 2 == 0, call_fingerprint_overlap=returned % 3 == 0, parameter_use_similarity=members % 2 == 0, anti_unification_template=members % 3 == 0),
        "extraction": one_of(returned, "high", "medium", "low", "unknown"), "editable_skeleton": k % 7 == 0, "clean_clone": k % 6 == 0, "scope": one_of(k, "same_language", "analogous", "same_language"),
        "lead_confidence": returned / members, "lead_relatedness": members % 10 / 10.0, "lead_refactorability": returned % 7 / 8.0, "lead_tree": members % 8 / 8.0, "lead_stable": members % 6, "lead_holes": returned % 4, "lead_hole_size": members % 9,
        "lead_cost": returned % 5 / 5.0, "lead_risk": F.when(k % 4 == 0, 0.0).otherwise(members % 11 / 16.0), "risks": returned % 3, "semantic_shared": k % 2, "semantic_declarations": members % 2, "semantic_unresolved": returned % 2,
        "semantic_ambiguous": F.when(k % 8 == 0, 1).otherwise(0), "semantic_divergent": F.when(k % 9 == 0, 1).otherwise(0), "line_span": F.col("lines") + members, "block_lines": members % 20, "max_body_lines": members % 14,
        "file_roles": F.when(k % 4 == 1, F.array(F.lit("source"), F.lit("test"))).when(k % 4 == 2, F.array(F.lit("test"))).when(k % 4 == 3, F.array(F.lit("generated"))).otherwise(none),
        "same_role_pairs": returned, "covered_members": F.when(k % 13 == 9, 0).otherwise(members % 8), **part,
        "tier": one_of(k, *TIERS), "action": one_of(members, *assess.EDITS, *assess.NOTES), "status": one_of(returned, "recommended", "cautious"),
    })


def noisy_or_payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.score(drafts(spark, sf_dir)).select("l_partkey", "payoff", "payoff_band")


def ramp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    return o.select("o_orderkey", floor4(S.ramp(price, 50_000.0, 200_000.0)).alias("ramp"), floor4(S.inverse_ramp(price, 50_000.0, 200_000.0)).alias("inverse"), floor4(S.combine(S.ramp(price, 0.0, 400_000.0), F.lit(0.5))).alias("product"))


def fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.score(drafts(spark, sf_dir)).select("l_partkey", "fit", "cost", "fit_band")


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.score(drafts(spark, sf_dir)).select("l_partkey", "risk", "risk_band")


def detection_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.score(drafts(spark, sf_dir)).select("l_partkey", "detection", "detection_band")


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    band = lambda c: F.when(c >= 0.75, "high").when(c >= 0.45, "medium").when(c > 0, "low").otherwise("none")
    tier = F.when((F.col("detection") >= 0.75) & (F.col("payoff") >= 0.45) & (F.col("risk") < 0.30), "recommended_edit").when((F.col("detection") >= 0.45) & (F.col("payoff") >= 0.12), "review_candidate").when(F.col("detection") > 0.18, "maintenance_note").otherwise("observation")
    return s.withColumns({"detection_band": band(F.col("detection")), "risk_band": band(F.col("risk")), "tier": tier, "score": floor4(F.col("detection") * F.col("payoff") * (1 - F.greatest("risk", "cost")))})


def review_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts with an action asked for: the gates that fail, the action that is left, its status, attention and tier."""
    asked = drafts(spark, sf_dir).withColumnRenamed("action", "requested_action").drop("tier", "status")
    out = assess.classify(assess.recommend(assess.score(asked)))
    return out.select("l_partkey", "detection_band", "risk_band", F.size("failed_gates").cast("long").alias("failed"), "action", "status", "attention", "tier")


def semantic_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of every tier, action and status after the caps; the first rule that applies."""
    return assess.cap(drafts(spark, sf_dir)).select("l_partkey", F.col("cap_rule").alias("rule"), "tier", "action", "status")


def summary_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.count_if((F.col("members") > 1) & (F.col("files") > 1) & (F.col("risk") < 0.65)).alias("eligible"))


def equivalence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the same set of size classes: the one with the highest price stays."""
    s = order_sets(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice"), "key")
    return groups.equivalents(s, "members", [F.desc("o_totalprice"), F.col("key")]).select("key", F.array_join(F.array_sort("members"), ",").alias("members"))


def subsumed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.without_subsumed(order_sets(spark, sf_dir), "key", "members", ["kind"], "rank").select("key")


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings: members are the size classes of their parts' quantities, kind the customer, rank the priority."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_quantity") % 9).cast("int").cast("string").alias("x"))
    sets = li.groupBy("key").agg(F.collect_set("x").alias("members"))
    return sets.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("kind"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank")), "key")


def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tiered(spark, sf_dir)
    order = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(TIERS) for x in (name, i)]), F.col("tier"))
    return groups.ranked(t.withColumn("_t", order), [F.col("_t"), F.desc("score"), F.col("l_partkey")]).select("l_partkey", "tier", "score", "rank")


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per size class the first part by rank, and the surface on which it shows."""
    r = ranked_findings(spark, sf_dir).withColumn("target", F.col("l_partkey") % 500).withColumn("visible", F.col("score") > 0)
    return groups.surfaces(r, "target", "rank", "tier", "visible").select("target", "l_partkey", "surface")


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars"))
    return groups.stable_ids(d, "doc_", ["lang", "source", "n_chars"], ["doc_id"]).select("doc_id", "id")


def semi_anti_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs that aren't exact copies of each other."""
    items = word_items(spark, sf_dir)
    known = content.exact_pairs(items, "body", 16).select("a", "b")
    e = edges_of(spark, sf_dir).select("a", "b", "similarity")
    return e.join(known, ["a", "b"], "left_anti").select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), "similarity")


def union_exact_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = word_items(spark, sf_dir)
    rare = content.shared_rare(items, items, 16, 2).select("a", "b")
    return rare.union(content.exact_pairs(items, "body", 16).select("a", "b")).distinct().select(F.col("a").alias("left_id"), F.col("b").alias("right_id"))


def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a conversation's user and assistant both say, with the smaller count, and what the user says more often."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(words()).alias("word"))
    n = c.groupBy("conv_id", "word").agg(F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return n.groupBy("conv_id").agg(F.sum(F.least("u", "a")).cast("long").alias("shared"), F.sum(F.greatest(F.lit(0), F.col("u") - F.col("a"))).cast("long").alias("user_more"))


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many documents have labels, and what that covers."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(1))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    one = d.agg(F.count("*").alias("files"), F.count("labelled").alias("covered"), F.sum("n_chars").alias("chars"), F.coalesce(F.sum(F.when(F.col("labelled") == 1, F.col("n_chars"))), F.lit(0)).alias("covered_chars"))
    share = F.col("covered") / F.col("files")
    return one.withColumn("coverage", F.when(F.col("files") == 0, "none").when(share == 1, "full").when(share >= 0.5, "most").when(share > 0, "partial").otherwise("none"))


def mirror_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties seen on both kinds of path."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").isin("click", "view").alias("fast"))
    return e.groupBy("user_id").agg(F.count_distinct("fast").alias("kinds"), F.count("*").alias("n")).filter("kinds = 2").select("user_id", "n")


def candidate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts about candidate generation."""
    keys = part_keys(spark, sf_dir)
    k = keys.agg(F.count_distinct("cluster").alias("clusters"), F.count_distinct("cluster", "key").alias("buckets"), F.count_distinct("member").alias("members"))
    p = buckets.bucket_pairs(keys, 32).agg(F.count("*").alias("pairs"))
    return k.join(F.broadcast(p))


def subcluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by kind inside each cluster: number, strongest and mean in exact thousandths."""
    t = candidate_topk(spark, sf_dir).withColumn("kind", F.when(F.col("estimate") == 1, "same").when(F.col("estimate") > 0, "part").otherwise("none"))
    return t.groupBy("cluster", "kind").agg(F.count("*").alias("pairs"), F.max("estimate").alias("strongest"), F.sum(F.floor(F.col("estimate") * 1000 + 0.5).cast("long")).alias("thousandths"))


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five names and the total of sizes of each brand."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "p_name")))), lambda x: x["p_name"]), ";").alias("first_names"), F.sum(F.greatest(F.lit(1), F.col("p_size"))).cast("long").alias("total"))


def shape_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of like shape (language and line count), and shapes that occur in several languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))
    return d.groupBy("lines").agg(F.count("*").alias("members"), F.count_distinct("lang").alias("languages"), F.min("doc_id").alias("first_id")).filter("members > 1 and languages > 1")


def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five brands with most pairs: a report of five rows."""
    return bucket_pairs(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("pairs")).orderBy(F.desc("pairs"), "cluster").limit(5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """lines_as_statements exact_body_groups token_document_frequency rare_tokens content_edges similarity_pairs top8_neighbours shared_windows
    maximal_runs shared_blocks connected_components bounded_components bucket_pairs bucket_cut_counts candidate_topk name_similarity identifier_tokens constant_identical
    constant_drifted constant_scattered file_records multiset_similarity mean_jaccard_by_key lcs_prefix_suffix lcs_lengths language_by_suffix role_ladder path_roles file_selection
    role_counts zero_filled_counts lead_row_per_group group_structural_metrics noisy_or_payoff ramp_scores fit_score risk_score detection_ladder review_tier semantic_cap
    summary_eligible equivalence_dedupe subsumed_anti_join ranked_findings surfaces stable_ids semi_anti_pairs union_exact_rare multiset_intersection coverage_summary
    mirror_members candidate_statistics subcluster_scores cluster_summary shape_groups top_clusters""".split()
    return {n: globals()[n] for n in names}
