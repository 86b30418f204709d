"""The analysis of a source corpus: files to functions, candidate pairs, relations, clusters, blocks, constants and ranked findings.

Every stage is a DataFrame over all functions at once; Python runs only to parse files (once each), to read pair features of
candidate members, and to align and compare trees. Stages that feed several others are written once in the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars as S
from ..operators import blocks, buckets, content, graph, groups, pairs
from ..policy import Policy
from ..sources import files as sources
from ..sources import ecmascript, python_code
from . import assess

CORE = (
    "language string, language_family string, adapter string, file string, symbol string, normalized_symbol string, container string, start_line int, end_line int, role string, type_source string, "
    "parameters array<string>, return_type string, canonical_shape string, shape_hash string, body_line_count int, body_hash string, tree_node_count int, statements array<string>, statement_keys array<string>, "
    "statement_spans array<struct<start:int,end:int>>, calls array<string>, controls array<string>, branch_count int, loop_count int, return_count int, max_nesting int, is_async boolean, is_public boolean, "
    "semantic_roles array<string>, duplicate_blocks array<struct<fingerprint:string,kind:string,statement_count:int,line_count:int,occurrences:array<struct<start_line:int,end_line:int>>>>, source string"
)
CONSTANT = "symbol string, normalized_symbol string, start_line int, end_line int, literal_kind string, literal_preview string, literal_hash string, literal_items array<string>"
DETAIL = (
    "parameter_default_roles array<string>, graph_features array<string>, literal_shapes array<string>, receiver_shapes array<string>, parameter_features map<string,array<string>>, transforms array<string>, "
    "statement_arg_reads array<struct<idx:int,roles:array<string>>>, tree struct<label:array<string>,arity:array<int>>"
)


def struct_of(columns: str) -> str:
    """A struct type from a list of columns."""
    return f"struct<{columns}>"


@dataclass
class Corpus:
    files: DataFrame
    functions: DataFrame
    constants: DataFrame
    diagnostics: DataFrame


def staged(df: DataFrame) -> DataFrame:
    return graph.reliable(df)


def extract(files: DataFrame) -> Corpus:
    """Functions, policy constants and diagnostics of described files. Files of languages without a parser here give a diagnostic, broken ones too, and no rows."""
    chosen = files.filter("selected").select("path", "content", "language", "role")

    def run(parts):
        for pdf in parts:
            rows = []
            for path, data, language, role in pdf.itertuples(index=False, name=None):
                if language == "Python":
                    found = python_code.extract(path, bytes(data), role)
                elif vocab.FAMILIES.get(language) == "ecmascript":
                    found = ecmascript.extract(path, bytes(data), role, language)
                else:
                    found = [], [], f"unsupported_language: {language}"
                rows.append((path, role, *found))
            yield pd.DataFrame(rows, columns=["file", "role", "functions", "constants", "diagnostic"])

    parsed = staged(chosen.mapInPandas(run, f"file string, role string, functions array<{struct_of(CORE)}>, constants array<{struct_of(CONSTANT)}>, diagnostic string"))
    functions = parsed.select(F.explode("functions").alias("f")).select("f.*")
    functions = functions.withColumns({"qualified": F.concat_ws(".", F.when(F.col("container") != "", F.col("container")), F.col("symbol")), "content_digest": F.sha2("source", 256)})
    place = ["file", "start_line", "end_line", "container", "symbol"]
    functions = groups.stable_ids(functions, "fn_", ["file", "qualified", "content_digest"], place, "function_id")
    functions = groups.stable_ids(functions, "sigrec_", ["file", "qualified", "shape_hash", "body_hash"], place, "signature_id")
    functions = functions.withColumn("is_test", F.col("role").isin(*vocab.TEST_ROLES))
    constants = parsed.select("file", "role", F.explode("constants").alias("c")).select("file", "role", "c.*")
    return Corpus(files, staged(functions), constants, parsed.filter("diagnostic <> ''").select("file", "diagnostic"))


def details(functions: DataFrame) -> DataFrame:
    """(signature_id, pair features) of functions, from their own source lines."""

    def run(parts):
        for pdf in parts:
            rows = []
            for sid, family, source in pdf.itertuples(index=False, name=None):
                read = python_code.detail_of if family == "python" else ecmascript.detail_of
                rows.append({"signature_id": sid, "detail": read(source)})
            yield pd.DataFrame(rows, columns=["signature_id", "detail"])

    return functions.select("signature_id", "language_family", "source").mapInPandas(run, f"signature_id string, detail {struct_of(DETAIL)}").select("signature_id", "detail.*")


def shingles() -> Column:
    """Structural shingles of a function: statement shapes and their pairs, calls, callees, and calls under each kind of control."""
    generic = lambda c: F.regexp_replace(c, r"ARG\d+", "ARG")

    def shape(s: Column) -> Column:
        parts = F.filter(F.split(s, ":", -1), lambda p: p != "")
        return F.when(F.size(parts) == 0, "").when(F.size(parts) == 1, parts[0]).otherwise(F.concat(parts[0], F.lit(":"), generic(parts[1])))

    shapes = F.transform("statements", shape)
    calls = F.filter(F.transform("calls", lambda c: F.trim(F.substring_index(c, "(args=", 1))), lambda c: c != "")
    tag = lambda name, a: F.transform(a, lambda x: F.concat(F.lit(f"{name}:"), x))
    after = F.slice(shapes, 2, F.greatest(F.size(shapes) - 1, F.lit(0)))
    bigrams = F.filter(F.zip_with(F.slice(shapes, 1, F.greatest(F.size(shapes) - 1, F.lit(0))), after, lambda x, y: F.when((x != "") & (y != ""), F.concat(F.lit("BIGRAM:"), x, F.lit("->"), y))), lambda b: b.isNotNull())
    under = F.flatten(F.transform(F.filter("controls", lambda c: c != ""), lambda k: F.transform(F.slice(calls, 1, 16), lambda c: F.concat(F.lit("CTRL_CALL:"), k, F.lit("|CALL:"), c))))
    return F.array_distinct(F.concat(tag("STMT", F.filter(shapes, lambda s: s != "")), bigrams, tag("CALL", calls), tag("CALLEE", F.transform(calls, lambda c: F.substring_index(c, ".", -1))), under))


def shape_clusters(functions: DataFrame, policy: Policy, split_test: bool = True) -> DataFrame:
    """(cluster, signature_id, scope, enriched): functions of one language and signature shape, broad groups split or summarised.

    Groups of 40 and more that mix test and other code are split by that; groups without any declared type of over 500, and test
    groups of 30 and more, keep their equal bodies as groups of their own and the rest as one group that isn't compared.
    """
    b = policy.broad
    f = functions.select("language", "shape_hash", "canonical_shape", "signature_id", "is_test", "body_hash")
    sizes = f.groupBy("language", "shape_hash").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test")).filter("n > 1")
    f = f.join(sizes, ["language", "shape_hash"])
    mixed = F.lit(split_test) & (F.col("n") >= b.split_test) & F.col("n_test").between(1, F.col("n") - 1)
    f = f.withColumn("part", F.when(mixed & F.col("is_test"), "test").when(mixed, "source").otherwise(""))
    parts = f.groupBy("language", "shape_hash", "part").agg(F.count("*").alias("m"), F.count_if("is_test").alias("m_test")).filter("m > 1")
    f = f.drop("n", "n_test").join(parts, ["language", "shape_hash", "part"])
    unknown = (F.col("m") > b.unknown_members) & F.col("canonical_shape").contains("fn(UNKNOWN") & F.col("canonical_shape").contains(")->UNKNOWN")
    tests = F.lit(split_test) & (F.col("m") >= b.test_members) & (F.col("m") == F.col("m_test"))
    f = f.withColumn("broad", F.when(unknown, "broad_unknown_signature").when(tests, "broad_test_signature"))
    bodies = f.filter("broad is not null and body_hash <> ''").groupBy("language", "shape_hash", "part", "body_hash").agg(F.count("*").alias("copies")).filter("copies > 1")
    f = f.join(bodies, ["language", "shape_hash", "part", "body_hash"], "left")
    scope = F.when(F.col("broad").isNull(), "same_language").when(F.col("copies").isNotNull(), F.concat("broad", F.lit("_exact_body"))).otherwise(F.concat("broad", F.lit("_summary")))
    body = F.when(F.col("broad").isNotNull() & F.col("copies").isNotNull(), F.col("body_hash")).otherwise("")
    key = F.concat_ws("|", F.lit("1"), "language", "shape_hash", "part", body)
    out = f.select(key.alias("cluster"), "signature_id", scope.alias("scope"), ~scope.endswith("_summary"))
    out = out.toDF("cluster", "signature_id", "scope", "enriched")
    alone = out.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    return out.join(alone, "cluster", "left_semi")


def bucket_keys(members: DataFrame, policy: Policy) -> DataFrame:
    """(cluster, key, member, place) of compact functions: name, role and name, first word, role and first word, role and call, payload builders, body."""
    c = policy.candidates
    tokens = F.filter(F.split("normalized_symbol", " "), lambda t: t != "")
    target = F.substring_index(F.element_at(F.concat(F.filter("calls", lambda x: F.substring_index(x, "(args=", 1) != ""), F.array(F.lit(""))), 1), "(args=", 1)
    builds = F.startswith(F.element_at(F.concat(F.array(F.lit("")), F.col("statements")), -1), F.lit("RETURN:")) & F.exists("statements", lambda s: F.startswith(s, F.lit("ASSIGN:"))) & (target != "")
    key = lambda name, *cs: F.concat_ws("\x1f", F.lit(name), *cs)
    named = F.col("normalized_symbol") != ""
    first = F.element_at(F.concat(tokens, F.array(F.lit(""))), 1)
    keys = F.concat(
        F.array_compact(F.array(F.when(named, key("name", "normalized_symbol")), F.when(named, key("role_name", "role", "normalized_symbol")), F.when(F.size(tokens) > 0, key("prefix", first)), F.when(F.size(tokens) > 0, key("role_prefix", "role", first)), F.when(builds, key("payload", "role", target)), F.when(F.col("body_hash") != "", key("body", "body_hash")))),
        F.transform(F.filter(F.slice("calls", 1, c.call_keys), lambda x: x != ""), lambda x: F.concat_ws("\x1f", F.lit("role_call"), F.col("role"), x)),
    )
    compact = F.size("statements").between(1, c.max_statements) & (F.col("tree_node_count") <= c.max_tree_nodes) & ((F.col("body_hash") != "") | (F.size("calls") > 0))
    place = F.concat_ws("\x1f", "file", F.format_string("%09d", "start_line"), "symbol")
    small = members.filter(compact).select("cluster", F.explode(F.array_distinct(keys)).alias("key"), F.col("signature_id").alias("member"), place.alias("place"))
    large = members.filter(~compact & (F.size("statements") > 0) & (F.col("body_hash") != "")).select("cluster", key("large_body", "body_hash").alias("key"), F.col("signature_id").alias("member"), place.alias("place"))
    return small.union(large)


def shape_candidates(clusters: DataFrame, functions: DataFrame, policy: Policy) -> DataFrame:
    """Candidate pairs (cluster, a, b) inside shape clusters: shared buckets, the best so many of each cluster by estimated likeness."""
    members = clusters.filter("enriched").join(functions, "signature_id").withColumn("shingles", shingles())
    keys = staged(bucket_keys(members, policy))
    small, large = keys.filter(~F.startswith("key", F.lit("large_body"))), keys.filter(F.startswith("key", F.lit("large_body")))
    found = buckets.bucket_pairs(small, policy.candidates.bucket_members)
    side = lambda n, x: functions.select(F.col("signature_id").alias(n), shingles().alias(x), F.col("body_hash").alias(f"{x}_body"))
    both = found.join(side("a", "x"), "a").join(side("b", "y"), "b")
    estimate = F.when((F.col("x_body") != "") & (F.col("x_body") == F.col("y_body")), 2.0).otherwise(S.round4(S.jaccard(F.col("x"), F.col("y"))))
    best = buckets.best_candidates(both.withColumn("estimate", estimate), "estimate", policy.candidates.pairs_per_cluster)
    return best.select("cluster", "a", "b").union(buckets.bucket_pairs(large, policy.candidates.bucket_members)).distinct()


def wrapper_candidates(functions: DataFrame, policy: Policy) -> DataFrame:
    """Pairs of one-parameter functions with like returns and different parameter types, of which one may normalise its argument: a cluster for each pair."""
    c = policy.candidates
    one = functions.filter((F.size("parameters") == 1) & (F.array_join("statements", "\x1f") == "RETURN:ARG0"))
    keys = F.array_distinct(F.concat(F.transform(F.split("normalized_symbol", " "), lambda t: F.concat(F.lit("name:"), t)), F.transform("calls", lambda t: F.concat(F.lit("call:"), t))))
    flat = one.select(F.concat_ws("\x1f", "language", "role", "return_type").alias("cluster"), F.explode(keys).alias("key"), F.col("signature_id").alias("member"), F.concat_ws("\x1f", "file", F.format_string("%09d", "start_line"), "symbol").alias("place"))
    found = buckets.bucket_pairs(flat, c.wrapper_bucket_members)
    side = lambda n, x: one.select(F.col("signature_id").alias(n), F.col("parameters")[0].alias(x))
    differ = found.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("x <> y")
    return differ.select(F.concat_ws("|", F.lit("2"), "a", "b").alias("cluster"), "a", "b").distinct()


def relate(candidates: DataFrame, functions: DataFrame, features: DataFrame, policy: Policy) -> DataFrame:
    """Scored relations of candidate pairs, the strongest of each cluster."""
    full = functions.drop("source", "duplicate_blocks", "content_digest").join(features, "signature_id", "left")
    packed = full.select(F.col("signature_id").alias("_id"), F.struct(*full.columns).alias("_s"))
    l_side, r_side = packed.select(F.col("_id").alias("a"), F.col("_s").alias("l")), packed.select(F.col("_id").alias("b"), F.col("_s").alias("r"))
    return pairs.kept_pairs(pairs.score_pairs(candidates.join(l_side, "a").join(r_side, "b").drop("a", "b"), policy), policy.pairs.kept)


def content_items(functions: DataFrame) -> DataFrame:
    return functions.select(F.col("language_family").alias("group"), F.col("signature_id").alias("id"), shingles().alias("tokens"), F.col("body_hash").alias("body"), "is_test", F.size("statements").alias("n_statements"))


def content_clusters(functions: DataFrame, related: DataFrame, policy: Policy) -> DataFrame:
    """Pairs (cluster, a, b) of like content that no earlier stage has related, in components of bounded size."""
    c = policy.content
    items = staged(content_items(functions))
    indexed = items.filter((F.col("n_statements") >= c.min_statements) & (F.size("tokens") >= c.min_shingles))
    edges = content.content_edges(items, indexed, c.max_df, c.min_shared, c.min_jaccard, c.neighbours, "body", related, "is_test")
    bounded = graph.bounded_components(edges.select("a", "b", F.col("similarity").alias("weight")), c.component_members)
    return bounded.select(F.concat_ws("|", F.lit("3"), "component").alias("cluster"), "a", "b")


def analogous_shapes(functions: DataFrame) -> DataFrame:
    """Shapes that functions of several languages have: (shape_hash, languages, members); not compared further."""
    return functions.groupBy("shape_hash").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.count("*").alias("members")).filter(F.size("languages") > 1)


def shared_blocks(functions: DataFrame, related: DataFrame, policy: Policy) -> DataFrame:
    """Statement runs that functions share: (block, unit, start, length, start_line, end_line, members), a block for each set of functions."""
    b = policy.blocks
    units = staged(
        functions.filter((F.size("statement_keys") >= b.window) & (F.size("statement_keys") == F.size("statement_spans"))).select(
            F.concat_ws("|", "language_family", "is_test").alias("group"), F.col("signature_id").alias("unit"), F.col("statement_keys").alias("keys"), F.col("statement_spans").alias("spans"), F.when(F.col("statements")[0] == "EXPR", 1).otherwise(0).alias("first")
        )
    )
    found = blocks.windows(units, b.window, "first")
    runs = blocks.maximal_runs(units, blocks.seeds(found, blocks.rare_windows(found, b.max_window_df, b.min_distinct)), "first")
    known = related.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: units.select(F.col("unit").alias(n), F.col("spans").alias(f"{n}_spans"), F.col("keys").alias(f"{n}_keys"), (F.size("keys") - F.col("first")).alias(f"{n}_code"))
    runs = runs.join(known, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b")
    span = lambda n: F.element_at(f"{n}_spans", F.col(f"{n}_start") + F.col("length"))["end"] - F.element_at(f"{n}_spans", F.col(f"{n}_start") + 1)["start"] + 1
    runs = runs.filter((span("a") >= b.min_lines) & (span("b") >= b.min_lines) & ~((F.col("length") == F.col("a_code")) & (F.col("length") == F.col("b_code"))))
    run_key = F.sha2(F.array_join(F.slice("a_keys", F.col("a_start") + 1, F.col("length")), "\x1f"), 256)
    sides = runs.select(run_key.alias("run"), F.col("a").alias("unit"), F.col("a_start").alias("start"), "length").union(runs.select(run_key, F.col("b"), F.col("b_start"), F.col("length"))).distinct()
    sets = sides.groupBy("run").agg(F.array_sort(F.collect_set("unit")).alias("members"))
    placed = sides.join(sets, "run").withColumn("block", F.sha2(F.array_join("members", "|"), 256))
    kept = blocks.without_overlaps(placed)
    named = placed.select("block", "members").dropDuplicates(["block"])
    lines = units.select("unit", "spans")
    return kept.join(named, "block").join(lines, "unit").withColumns({"start_line": F.element_at("spans", F.col("start") + 1)["start"], "end_line": F.element_at("spans", F.col("start") + F.col("length"))["end"]}).drop("spans")


#: Least specificity of a structured literal and the preview length of full specificity; least support of a repeat and the members of full support; what mixed roles and several folders leave of an action's confidence.
SPECIFIC, PREVIEW_HIGH, SUPPORTED, MEMBERS_HIGH, MIXED_ROLES, SEVERAL_FOLDERS = 0.88, 120, 0.85, 4, 0.85, 0.82


def constant_clusters(constants: DataFrame) -> DataFrame:
    """Constants that repeat: identical (name and value), drifted (name, values that share half of the smallest), scattered (value, several names).

    confidence is that they belong together; action_confidence also weighs whose they are and how near they stand.
    """
    c = constants.withColumns({"place": F.concat_ws(":", "file", "start_line"), "folder": S.parent(F.col("file"))})

    def agg(kind: str, *by: str) -> DataFrame:
        return c.groupBy(*by).agg(
            F.lit(kind).alias("kind"), F.count("*").alias("members"), F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.collect_set("symbol")).alias("symbols"), F.count_distinct("literal_hash").alias("variants"),
            F.sum(F.col("end_line") - F.col("start_line") + 1).alias("line_span"), F.max(F.length("literal_preview")).alias("preview"), F.count_distinct("literal_kind").alias("kinds"), F.bool_and(F.col("role") == "source").alias("own"), F.count_distinct("folder").alias("folders"),
        )

    shown = ("kind", "members", "files", "places", "symbols", "variants", "line_span", "overlap", "preview", "kinds", "own", "folders")
    same = agg("identical", "normalized_symbol", "literal_hash").filter("members > 1").withColumn("overlap", F.lit(1.0))
    drift = agg("drifted", "normalized_symbol", "literal_kind").filter((F.col("variants") > 1) & (F.size("files") > 1))
    items = c.select("normalized_symbol", "literal_kind", "literal_hash", F.explode(F.array_distinct("literal_items")).alias("item")).distinct()
    by = ["normalized_symbol", "literal_kind"]
    smallest = items.groupBy(*by, "literal_hash").agg(F.count("*").alias("k")).groupBy(*by).agg(F.min("k").alias("smallest"))
    common = items.groupBy(*by, "item").agg(F.count("*").alias("k")).join(drift.select(*by, "variants"), by).filter("k = variants").groupBy(*by).agg(F.count("*").alias("common"))
    drift = drift.drop("kinds").withColumn("kinds", F.lit(1).cast("long")).join(smallest, by).join(common, by, "left").withColumn("overlap", F.coalesce("common", F.lit(0)) / F.col("smallest")).filter("overlap >= 0.5")
    scattered = agg("scattered", "literal_hash").filter(F.size("symbols") > 1).withColumn("overlap", F.lit(1.0))
    out = same.select(*shown).unionByName(drift.select(*shown)).unionByName(scattered.select(*shown))
    specific = F.greatest(F.lit(SPECIFIC), S.ramp_count(F.col("preview"), 1, PREVIEW_HIGH))
    support = F.greatest(F.lit(SUPPORTED), S.ramp_count(F.col("members"), 2, MEMBERS_HIGH))
    sure = S.round4(F.when(F.col("kinds") == 1, 1.0).otherwise(0.0) * F.col("overlap") * (1 - (1 - specific) * (1 - support)))
    out = out.withColumn("confidence", sure)
    action = S.round4(S.combine(F.col("confidence"), F.when(F.col("own"), 1.0).otherwise(MIXED_ROLES), F.when(F.col("folders") <= 1, 1.0).otherwise(SEVERAL_FOLDERS)))
    return out.withColumn("action_confidence", action).drop("preview", "kinds", "own", "folders")


NO_EVIDENCE = {
    "duplicate_pairs": 0, "relation_pairs": 0, "body_matches": 0, "blocks": 0, "constants": 0, "block_lines": 0, "lead_confidence": 0.0, "lead_relatedness": 0.0, "lead_refactorability": 0.0, "lead_tree": 0.0, "lead_stable": 0, "lead_holes": 0, "lead_hole_size": 0, "lead_cost": 0.0, "lead_risk": 0.0,
    "risks": 0, "max_body_lines": 0, "same_role_pairs": 0, "covered_members": 0, "editable_skeleton": False, "clean_clone": False, "semantic_shared": 0, "semantic_declarations": 0, "semantic_unresolved": 0, "semantic_ambiguous": 0, "semantic_divergent": 0,
    "interface_members": 0, "declaration_members": 0, "example_members": 0, "test_members": 0, "protocol_members": 0, "api_members": 0, "constructor_members": 0, "special_members": 0, "trivial_members": 0,
}


def filled(df: DataFrame) -> DataFrame:
    """A draft with every column of evidence."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in NO_EVIDENCE.items()} | {"extraction": F.lit("high")} | ({} if "basis" in df.columns else {"basis": F.array().cast("array<string>")}))


def member_metrics(members: DataFrame) -> DataFrame:
    """Per group (draft) the files, roles, sizes and role families of member rows (draft, and columns of functions)."""
    roles = lambda *names: F.count_if(F.arrays_overlap("semantic_roles", F.array(*map(F.lit, names))))
    ident = F.concat_ws("::", "file", "qualified", F.lit("function"))
    return members.groupBy("draft").agg(
        F.count("*").alias("member_count"), F.array_sort(F.collect_set("file")).alias("files"), F.collect_set("role").alias("file_roles"), F.array_sort(F.collect_set(ident)).alias("members"), F.array_sort(F.collect_set("symbol")).alias("symbols"),
        F.sum(F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)).alias("line_span"), F.max("body_line_count").alias("max_body_lines"), F.count_distinct("language").alias("languages"),
        roles(*vocab.INTERFACE_ROLES).alias("interface_members"), roles("overload_signature", "declaration_boundary").alias("declaration_members"), roles("example_code").alias("example_members"), roles("test_code").alias("test_members"), roles(*vocab.PROTOCOL_ROLES).alias("protocol_members"),
        roles(*vocab.API_ROLES).alias("api_members"), roles("constructor").alias("constructor_members"), roles("python_special_method", "custom_dunder_or_framework_hook").alias("special_members"), roles("trivial_body").alias("trivial_members"),
        (F.when(F.count_if(F.size("parameters") >= 4) > 0, 1).otherwise(0) + F.when(F.count_distinct("type_source") > 1, 1).otherwise(0) + F.when((F.count_if("is_test") > 0) & (F.count_if(~F.col("is_test")) > 0), 1).otherwise(0)).alias("risks"),
    )


def pair_metrics(rel: DataFrame, policy: Policy) -> DataFrame:
    """Per draft the lead pair's profile and counts over its relations (draft, and columns of scored pairs)."""
    p = policy.pairs
    lead = groups.lead_rows(rel, ["draft"], pairs.pair_order()).select("draft", F.col("confidence").alias("lead_confidence"), F.col("relatedness").alias("lead_relatedness"), F.col("refactorability").alias("lead_refactorability"), F.col("tree_score").alias("lead_tree"), F.col("stable").alias("lead_stable"), F.col("holes").alias("lead_holes"), F.col("max_hole").alias("lead_hole_size"), F.col("cost").alias("lead_cost"), F.col("risk").alias("lead_risk"), F.col("actions").alias("lead_actions"))
    duplicate = F.col("same_role") & (F.col("name_score") >= p.same_name) & (F.col("tree_score") >= p.same_tree) & F.col("kind").isin("body_identical", "body_parameterized")
    skeleton = F.col("kind").isin("same_skeleton_different_literals", "same_skeleton_different_callees") & (F.col("refactorability") >= p.refactor_high) & (F.col("cost") <= p.skeleton_cost)
    counts = rel.groupBy("draft").agg(
        F.count_if(F.col("kind") != "none").alias("relation_pairs"), F.count_if(duplicate).alias("duplicate_pairs"), F.count_if("body_match").alias("body_matches"), F.count_if("same_role").alias("same_role_pairs"), F.array_distinct(F.flatten(F.collect_set("basis"))).alias("basis"),
        F.bool_or(skeleton).alias("editable_skeleton"), F.bool_and(F.col("kind").isin("body_identical", "body_parameterized") | skeleton).alias("clean_clone"), F.array_distinct(F.collect_set("kind")).alias("kinds"),
    )
    covered = rel.select("draft", F.explode(F.array("l.signature_id", "r.signature_id")).alias("m")).groupBy("draft").agg(F.count_distinct("m").alias("covered_members"))
    acts = rel.select("draft", F.explode("actions").alias("x")).filter("x.status = 'recommended'").groupBy("draft").agg(F.max_by("x.action", F.struct("x.confidence", "x.action")).alias("requested_action"))
    stops = rel.select("draft", F.explode("actions").alias("x")).filter("x.action = 'do_not_refactor'").select("draft").distinct().withColumn("stop", F.lit(True))
    out = lead.join(counts, "draft").join(covered, "draft").join(acts, "draft", "left").join(stops, "draft", "left")
    wrapped = F.when(F.array_contains("kinds", "argument_normalization_wrapper"), F.array(F.lit("argument_normalization_wrapper"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"requested_action": F.coalesce("requested_action", F.when(F.col("stop"), "do_not_refactor"), F.lit("observe")), "evidence_kinds": F.concat(F.array(F.lit("signature_shape_cluster")), F.when(F.col("duplicate_pairs") > 0, F.array(F.lit("structural_duplicate"))).otherwise(F.array().cast("array<string>")), wrapped)}).drop("stop", "kinds", "lead_actions")


def promoted(rel: DataFrame) -> DataFrame:
    """Relations that deserve a draft of their own (draft set): clone pairs of one role, connected inside their cluster, if that is less than the whole cluster."""
    guarded = F.arrays_overlap(F.array_union("l.semantic_roles", "r.semantic_roles"), F.array(*map(F.lit, (*vocab.INTERFACE_ROLES, *vocab.PROTOCOL_ROLES, *vocab.API_ROLES, "example_code")))) & (
        (F.least("l.body_line_count", "r.body_line_count") <= 5) | (F.col("stable") < 2) | F.arrays_overlap(F.array_union("l.semantic_roles", "r.semantic_roles"), F.array(*map(F.lit, (*vocab.INTERFACE_ROLES, "example_code"))))
    )
    good = rel.filter(F.col("same_role") & ~guarded & (F.col("body_match") | (F.col("clone_type").isin("type_2_parameterized", "type_3_near_miss") & (F.col("confidence") >= 0.70))))
    node = lambda s: F.concat_ws("\x1e", "cluster", F.col(f"{s}.signature_id"))
    roots = graph.components(good.select(node("l").alias("a"), node("r").alias("b")))
    placed = good.withColumn("_n", node("l")).join(roots, F.col("_n") == F.col("node")).drop("_n", "node").withColumnRenamed("root", "part")
    count = placed.groupBy("cluster").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("clones"))
    every = rel.groupBy("cluster").agg(F.count("*").alias("relations"))
    apart = count.join(every, "cluster").filter("parts > 1 or relations > clones").select("cluster")
    return placed.join(apart, "cluster", "left_semi").withColumn("draft", F.concat(F.lit("promoted|"), "part")).drop("part")


def drafts(corpus: Corpus, clusters: DataFrame, rel: DataFrame, block_rows: DataFrame, policy: Policy) -> DataFrame:
    """All drafts: clusters, promoted clone groups, repeats inside a function, shared blocks and constants."""
    functions = corpus.functions
    columns = [c for c in functions.columns if c not in ("source", "statements")]
    f = functions.select(*columns)
    own = rel.withColumn("draft", F.concat(F.lit("cluster|"), "cluster"))
    part = promoted(rel)
    both = own.unionByName(part)
    cluster_members = clusters.select(F.concat(F.lit("cluster|"), "cluster").alias("draft"), "signature_id").union(
        rel.filter(~F.startswith("cluster", F.lit("1|"))).select(F.concat(F.lit("cluster|"), "cluster").alias("draft"), F.explode(F.array("l.signature_id", "r.signature_id")).alias("signature_id"))
    ).union(part.select("draft", F.explode(F.array("l.signature_id", "r.signature_id")).alias("signature_id"))).distinct()
    metrics = member_metrics(cluster_members.join(f, "signature_id"))
    signature = metrics.join(pair_metrics(both, policy), "draft", "left").withColumns({"target_type": F.lit("signature_shape"), "scope": F.lit("same_language"), "requested_action": F.coalesce("requested_action", F.lit("observe")), "evidence_kinds": F.coalesce("evidence_kinds", F.array(F.lit("signature_shape_cluster"))), "basis": F.coalesce("basis", F.array().cast("array<string>"))})
    inner = f.select("signature_id", F.explode("duplicate_blocks").alias("b"), *[c for c in columns if c not in ("signature_id", "duplicate_blocks")]).withColumn("draft", F.concat_ws("|", F.lit("inner"), "signature_id", "b.fingerprint"))
    inner_metrics = member_metrics(inner).join(inner.select("draft", F.col("b.line_count").alias("block_lines"), F.size("b.occurrences").alias("blocks")), "draft")
    inner_draft = inner_metrics.withColumns({"target_type": F.lit("intra_function_duplicate"), "scope": F.lit("same_language"), "requested_action": F.lit("extract_small_helper"), "evidence_kinds": F.array(F.lit("intra_function_duplicate"))})
    shared = block_rows.withColumnRenamed("unit", "signature_id").select(F.concat(F.lit("block|"), "block").alias("draft"), "signature_id", "length", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    size = shared.groupBy("draft").agg(F.max("lines").alias("block_lines"), F.max("length").alias("lead_stable"), F.lit(1).alias("blocks"))
    block_draft = member_metrics(shared.select("draft", "signature_id").distinct().join(f, "signature_id")).join(size, "draft").withColumns({"target_type": F.lit("shared_block"), "scope": F.lit("same_language"), "requested_action": F.lit("extract_small_helper"), "evidence_kinds": F.array(F.lit("shared_block"))})
    roles = corpus.files.select(F.col("path").alias("file"), "role")
    k = constant_clusters(corpus.constants).withColumn("draft", F.concat(F.lit("constant|"), "kind", F.lit("|"), F.array_join("places", ",")))
    k_roles = k.select("draft", F.explode("files").alias("file")).join(roles, "file").groupBy("draft").agg(F.collect_set("role").alias("file_roles"))
    constant = k.join(k_roles, "draft", "left").select(
        "draft", F.col("members").alias("member_count"), "files", F.coalesce("file_roles", F.array().cast("array<string>")).alias("file_roles"), F.col("places").alias("members"), "symbols", "line_span", F.lit(1).alias("constants"), F.lit("policy_constant").alias("target_type"), F.lit("same_language").alias("scope"),
        F.when(F.col("kind") == "identical", "introduce_abstraction").otherwise("record_shared_concern").alias("requested_action"), F.array(F.lit("policy_constant_duplicate")).alias("evidence_kinds"), F.when(F.col("kind") == "identical", 0.04).otherwise(0.35).alias("lead_risk"), F.lit(1).alias("relation_pairs"), F.col("members").alias("covered_members"),
    )
    shown = ["draft", "member_count", "files", "file_roles", "members", "symbols", "line_span", "target_type", "scope", "requested_action", "evidence_kinds", "basis", "extraction", *NO_EVIDENCE]
    out = [filled(d).select(*shown) for d in (signature, inner_draft, block_draft, constant)]
    union = out[0]
    for d in out[1:]:
        union = union.unionByName(d)
    title = F.concat(F.regexp_replace("target_type", "_", " "), F.lit(": "), F.array_join(F.slice("symbols", 1, 4), " / "), F.when(F.size("symbols") > 4, F.concat(F.lit(" +"), F.size("symbols") - 4)).otherwise(""))
    return union.withColumnRenamed("draft", "draft_id").withColumn("title", title)


@dataclass
class Analysis:
    corpus: Corpus
    clusters: DataFrame
    relations: DataFrame
    blocks: DataFrame
    findings: DataFrame


def analyze(spark: SparkSession, files: DataFrame, policy: Policy | None = None, split_test: bool = True) -> Analysis:
    """The whole analysis of described files (see sources.files.describe)."""
    policy = policy or Policy()
    corpus = extract(files)
    functions = corpus.functions
    clusters = staged(shape_clusters(functions, policy, split_test))
    first = staged(shape_candidates(clusters, functions, policy).union(wrapper_candidates(functions, policy)))
    wanted = first.select(F.col("a").alias("signature_id")).union(first.select("b")).distinct()
    features = staged(details(functions.join(wanted, "signature_id", "left_semi")))
    early = staged(relate(first, functions, features, policy))
    early = early.filter(~F.startswith("cluster", F.lit("2|")) | (F.col("kind") == "argument_normalization_wrapper"))
    emitted = early.select(F.col("l.signature_id").alias("a"), F.col("r.signature_id").alias("b"))
    second = staged(content_clusters(functions, emitted, policy))
    more = second.select(F.col("a").alias("signature_id")).union(second.select("b")).distinct().join(features.select("signature_id"), "signature_id", "left_anti")
    features = staged(features.union(details(functions.join(more, "signature_id", "left_semi"))))
    late = staged(relate(second, functions, features, policy))
    rel = early.unionByName(late)
    related = rel.select(F.col("l.signature_id").alias("a"), F.col("r.signature_id").alias("b"))
    block_rows = staged(shared_blocks(functions, related, policy))
    found = staged(assess.findings(drafts(corpus, clusters, rel, block_rows, policy), policy))
    return Analysis(corpus, clusters, rel, block_rows, found)


def completeness(corpus: Corpus) -> DataFrame:
    """One row: files by outcome and what that covers."""
    outcome = corpus.files.join(corpus.diagnostics.select(F.col("file").alias("path"), "diagnostic"), "path", "left")
    state = F.when(~F.col("selected"), "not_selected").when(F.startswith("diagnostic", F.lit("unsupported")), "unsupported").when(F.col("diagnostic").isNotNull(), "failed").otherwise("analysed")
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    one = outcome.withColumn("state", state).agg(F.count("*").alias("files"), n("analysed"), n("failed"), n("unsupported"), n("not_selected"))
    chosen = F.col("files") - F.col("not_selected")
    return one.withColumn("coverage", F.when(chosen == 0, "none").when(F.col("analysed") == chosen, "complete").when(F.col("analysed") / chosen >= 0.9, "nearly_complete").when(F.col("analysed") > 0, "partial").otherwise("none"))


def analyze_folder(spark: SparkSession, root: str, include=("**",), exclude=(), ignored=(), policy: Policy | None = None) -> Analysis:
    return analyze(spark, sources.describe(sources.raw_files(spark, root), include, exclude, ignored), policy)


def ordinals(clusters: DataFrame) -> DataFrame:
    """Clusters numbered in stage order: sigcl_000001 and on; one row for each cluster is ranked, by the range-partitioned rank."""
    each = clusters.select("cluster").distinct()
    return groups.ranked(each, [F.col("cluster")], "n").select("cluster", F.format_string("sigcl_%06d", "n").alias("cluster_id"))


__all__ = ["Analysis", "Corpus", "analyze", "analyze_folder", "completeness", "drafts", "extract", "ordinals"]
