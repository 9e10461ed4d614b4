"""Queries that run whole chains of jobs: feature tables, vectors, samples, files, models; and their SQL.

Given tables stand in for the domain's by renamed columns; see each query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode, explain, graphs, io, metrics, pairs, samples, targets, udfs
from .queries import COMBOS, MOLECULES, SETS, explained, line_span, line_tasks, molecules, table, whole_molecules


def kinase_features(spark, d) -> DataFrame:
    """Suppliers as proteins named after their nation, customers as kinases, orders as structures."""
    nation = table(spark, d, "nation")
    named = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    target = F.concat(F.lit(" "), F.initcap("n_name"), F.lit("("), F.col("s_name"), F.lit(")p"))
    proteins = named.select(target.alias("target_id"), F.col("s_name").alias("target_sequence"))
    overrides = named.where("s_suppkey % 7 = 0").select(target.alias("target_id"), F.lit("France").alias("kinase_name"))
    aliases = nation.where("n_nationkey % 5 = 0").select(targets.normalize_name(F.col("n_name")).alias("alias"), F.lit("GERMANY").alias("name"))
    people = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    family = F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment"))
    kinases = people.select(
        F.col("c_custkey").alias("pos"), targets.normalize_name(F.col("n_name")).alias("kinase_name"),
        F.when(F.col("c_custkey") % 3 > 0, "Human").otherwise("Mouse").alias("species"), F.col("c_custkey").cast("string").alias("kinase_ID"),
        family.alias("family"), F.col("c_mktsegment").alias("group"), F.col("n_name").alias("kinase_class"))
    text = F.col("o_orderpriority")
    structures = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("kinase_ID"), F.col("o_orderkey").cast("string").alias("structure_ID"),
        F.col("o_orderstatus").alias("pdb"), F.expr("repeat(o_orderpriority, 1 + cast(o_orderkey % 8 as int))").alias("pocket"),
        F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderstatus")).alias("DFG"), F.substring(text, 1, 1).alias("aC_helix"),
        F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 5).cast("string")).alias("Grich_rotation"),
        (F.col("o_orderkey") % 7).cast("double").alias("quality_score"), (F.col("o_orderkey") % 3).cast("double").alias("resolution"))
    return targets.feature_table(proteins, kinases, structures, overrides=overrides, aliases=aliases)


def feature_chain(spark, d):
    """The feature table, written and read as CSV: names, kinases, best structures, pockets, defaults."""
    path = io.shared_folder(spark, "features")
    io.write_features(kinase_features(spark, d), path)
    out = io.read_features(spark, path)
    rounded = {c: F.round(F.when(F.col(c) != "", F.col(c)).cast("double"), 6) for c in ("pocket_hydrophobicity", "pocket_charge")}
    return out.withColumns(rounded)


def donor_tables(spark, d):
    """Documents without labels take those of other tables' documents of the same text, in the tables' order, before their own."""
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id", "left")
    first, second = (rows.where(f"doc_id % 3 = {k}").withColumns({"toxic": F.col("toxic") + 10 * k, "text": F.upper("text")}) for k in (1, 2))
    shouted = rows.withColumn("text", F.upper("text")).where("doc_id % 2 = 0 OR quality IS NULL")
    return targets.fill_from_donors(shouted, [second, first], resolved="quality", sequence="text", ident="doc_id").select("doc_id", "quality", "toxic")


def customer_features(spark, d) -> DataFrame:
    number = F.floor("c_acctbal").cast("string")
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("target_id"), (F.col("c_custkey") % 2).cast("string").alias("has_structure"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(number).alias("pocket_hydrophobicity"), F.lit(" ").alias("pocket_charge"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise("1.5").alias("activation_loop_state"), F.col("c_mktsegment").alias("kinase_group"),
        F.col("c_nationkey").cast("string").alias("kinase_family"), F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 3).cast("string")).alias("kinase_subfamily"),
        F.lit("").alias("dfg_state"), F.substring("c_name", -1, 1).alias("ac_helix_state"))


def target_vectors(spark, d):
    """Orders with the feature vectors of their customers: slots that aren't 0."""
    features = customer_features(spark, d)
    vectors = encode.target_vector(features, encode.vocabularies(features))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("target_id"))
    out = encode.attach_targets(orders, vectors).select("o_orderkey", F.posexplode("protein_feat").alias("slot", "value"))
    return out.where("value <> 0").select("o_orderkey", "slot", F.col("value").cast("double").alias("value"))


def target_sequences(spark, d):
    """Strict codes of part names without the letter that has none, and the three code vectors of their types as pockets."""
    part = table(spark, d, "part")
    letters = F.regexp_replace(F.upper("p_name"), "[^A-IK-Z]", "")
    rows = part.select(F.col("p_partkey"), letters.alias("s"), F.upper("p_type").alias("klifs_85_residue_sequence"),
                       F.substring(F.upper("p_type"), 1, 1).alias("gatekeeper_residue"), F.substring(F.upper("p_type"), 2, 3).alias("hinge_residues"))
    found = rows.select("p_partkey", encode.sequence(F.col("s"), encode.SEQUENCE).alias("codes"), *encode.code_columns())
    return found.select("p_partkey", *[F.array_join(c, ",").alias(c) for c in ("codes", "pocket", "gatekeeper", "hinge")])


def atom_vectors(spark, d):
    """Atom vectors of orders as molecules, divided by their sums: the slots in use and their share."""
    atoms, bonds = molecules(spark, d)
    arcs, tasks = graphs.arcs(bonds), line_tasks(spark, d)
    flag, at = F.col("symbol"), F.col("atom_idx")
    rows = atoms.select(
        "mol_id", "atom_idx", F.when(flag == "A", "C").when(flag == "R", "Cl").otherwise("Xx").alias("symbol"), (at * 3 % 13).alias("num_hs"),
        at.alias("implicit_valence"), (at - 3).alias("formal_charge"), F.when(at % 3 == 0, "SP2").when(at % 3 == 1, "SP3").alias("hybridization"),
        (at % 2 == 0).alias("is_aromatic"), (F.col("weight") > 25).alias("in_ring"))
    family = F.element_at(F.array(*map(F.lit, ["Donor", "LumpedHydrophobe", "ZnBinder", "Hydrophobe", "NegIonizable"])), (at % 5 + 1).cast("int"))
    hits = rows.select("mol_id", "atom_idx", family.alias("family"))
    vectors = graphs.atom_vector(graphs.pharmacophore_flags(graphs.attached(rows, graphs.degree(rows, arcs, tasks), ["mol_id", "atom_idx"], tasks=tasks), hits, tasks))
    share = graphs.l1_normalize(F.transform("features", lambda x: x.cast("double")))
    used = vectors.select("mol_id", "atom_idx", F.filter(F.transform(share, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: e["x"] > 0).alias("v"))
    return used.select("mol_id", "atom_idx", F.array_join(F.transform("v", lambda e: e["i"].cast("string")), ",").alias("slots"), F.round(F.col("v")[0]["x"], 6).alias("share"))


def pair_graphs(spark, d):
    """Part names as ligands, split to words by a user's parser once each, and attached to order lines of two data sets."""
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("compound_iso_smiles"))
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    ligands = graphs.distinct_ligands([lines.where("l_linenumber < 4"), lines.where("l_linenumber >= 4")])

    def parse(name: str) -> list[tuple]:
        return [(i, word) for i, word in enumerate(name.split(" "))]

    atoms = udfs.expand_distinct(ligands, "compound_iso_smiles", parse, "compound_iso_smiles string, atom_idx int, symbol string")
    words = F.sort_array(F.collect_list(F.struct("atom_idx", "symbol")))
    found = atoms.groupBy("compound_iso_smiles").agg(F.count(F.lit(1)).alias("n_atoms"), F.array_join(words["symbol"], "|").alias("symbols"))
    out = graphs.attach_graphs(lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "compound_iso_smiles"), found)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", "n_atoms", "symbols")


def sequence_sets(spark, d):
    """Distinct texts of each language, one after the other: a text in two languages counts twice."""
    docs = table(spark, d, "documents").select("lang", F.col("source").alias("target_sequence"))
    parts = [docs.where(F.col("lang") == lang) for lang in ("de", "en", "es", "fr")]
    return pairs.all_sequences(parts).groupBy("target_sequence").agg(F.count(F.lit(1)).alias("n"))


def model_scores(spark, d):
    """All five metrics by return flag."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("f"))
    found = metrics.evaluate(rows, ["l_returnflag"])
    return found.select("l_returnflag", F.round("rmse", 4).alias("rmse"), F.round(F.col("mse") / 1e6, 4).alias("mse_m"), *[F.round(c, 6).alias(c) for c in ("pearson", "spearman", "ci")])


def validation_choice(spark, d):
    """Groups of users as models, days as epochs, event types as splits, each day's greatest value as its error."""
    split = F.when(F.col("event_type").isin("view", "click"), "val").otherwise("test")
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("model"), split.alias("split"), F.dayofyear("ts").alias("epoch")).agg(F.max("value").alias("mse"))
    return metrics.select_by_validation(rows, ["model"]).select("model", "epoch", "mse")


def full_scores(spark, d):
    """A user's model over whole orders, and over the odd lines of each, from one copy of an order's features."""
    molecules = io.cut(whole_molecules(spark, d).select("mol_id", "a", "adj"), "molecules")
    full = molecules.select(F.col("mol_id").alias("sample_id"), F.transform("a", lambda x: F.array(x["weight"], x["atom_idx"].cast("double"))).alias("features"), F.col("a.atom_idx").alias("ids"))
    adj = molecules.select("mol_id", "adj")
    score = lambda rows: udfs.score_masked(rows, full, lambda: lambda batch: [(x["features"][:, 0] * x["features"][:, 1]).sum() + x["mask"].sum() / 100 for x in batch], ids="ids")
    whole = explain.full_predictions(adj.select(F.col("mol_id").alias("sample_id"), "mol_id"), adj, score)
    odd = full.select("sample_id", F.filter("ids", lambda i: i % 2 > 0).alias("atoms"))
    return whole.join(io.large(score(odd)), "sample_id").select(F.col("sample_id").alias("mol_id"), F.round("full_prediction", 4).alias("whole"), F.round("prediction", 4).alias("odd"))


def embedding_passing(spark, d):
    """Embeddings as atoms of molecules of eight in a row: neighbour sums of whole 64-wide vectors, then each molecule's mean."""
    nodes = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("mol_id"), (F.col("vec_id") % 8).cast("int").alias("atom_idx"), "embedding")
    nodes = nodes.select("mol_id", "atom_idx", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    bonds = nodes.where("atom_idx > 0").select("mol_id", (F.col("atom_idx") - 1).alias("a"), F.col("atom_idx").alias("b"))
    sums = graphs.neighbor_sum(nodes, graphs.arcs(bonds), 0.5)
    out = graphs.pool(sums, ["mol_id"], "features", "max_mean")
    return out.select("mol_id", F.posexplode("features").alias("at", "x")).select("mol_id", "at", F.round("x", 5).alias("x"))


def top_explanations(spark, d):
    """The three first explanations of each order, written and read as CSV: their rank, size and difference."""
    path = io.shared_folder(spark, "explanations")
    found = explain.output_columns(explain.listed(explained(spark, d, k=3)))
    columns = ["sample_id", "mol_id", "full_prediction", "components", "num_components", "size", "prediction", "difference", "rank", "atom_indices"]
    io.write_explanations(found.select(*columns), path)
    numbers = "num_components int, size int, prediction double, difference double, rank int"
    text = spark.read.schema(f"sample_id long, mol_id long, full_prediction double, components string, {numbers}, atom_indices string").csv(path, header=True)
    sizes = F.size(F.from_json("atom_indices", "array<int>"))
    return text.select("mol_id", "rank", sizes.alias("size"), F.round("difference", 6).alias("difference"))


def explanation_table(spark, d):
    """All explanations of orders as a table of 17 columns, written and read as CSV; sets are named by their line numbers."""
    path = io.shared_folder(spark, "explanations")
    letters = F.array_join(F.col("a.symbol"), "")
    ranged = line_span(spark, d) <= explain.WHOLE  # no order is joined: all are explained where their lines meet
    found = explain.listed(explained(spark, d, "symbol", ranged=ranged).withColumn("full_smiles", letters).drop("a"))
    dots = lambda sets: F.transform(sets, lambda s: F.array_join(F.transform(s, lambda a: a.cast("string")), "."))
    io.write_explanations(explain.explanation_table(found, None, dataset="orders", model_name="share", fragments=dots, ranged=ranged), path)
    kinds = {"sample_index": "long"} | dict.fromkeys(["num_components", "size", "max_subgraph_size", "max_combination_size", "max_total_atoms"], "int")
    kinds |= dict.fromkeys(["full_prediction", "fragment_prediction", "difference", "epsilon"], "double")
    out = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in explain.TABLE)).csv(path, **io.CSV)
    parts = F.from_json("components", "array<array<int>>")
    return out.withColumns({
        **{c: F.round(c, 6) for c in ("full_prediction", "fragment_prediction", "difference")},
        "components": F.to_json(F.sort_array(F.flatten(parts))), "component_smiles": F.size(F.from_json("component_smiles", "array<string>")),
    })


def supplier_features(spark, d) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    letter = F.substring(F.lit("ACDEFGHIK"), (F.col("s_suppkey") % 9 + 1).cast("int"), F.lit(1))
    name, blank = F.regexp_replace(F.upper("n_name"), "[^A-Z]", ""), F.lit("")
    return rows.select(
        F.col("s_suppkey").alias("target_id"), F.concat(F.regexp_replace(F.upper("s_name"), "[^A-IK-Z]", ""), letter).alias("target_sequence"),
        (F.col("s_suppkey") % 2).cast("string").alias("has_structure"), F.floor("s_acctbal").cast("string").alias("pocket_hydrophobicity"),
        blank.alias("pocket_charge"), blank.alias("activation_loop_state"), F.col("n_name").alias("kinase_group"), F.col("s_nationkey").cast("string").alias("kinase_family"),
        blank.alias("kinase_subfamily"), blank.alias("dfg_state"), blank.alias("ac_helix_state"),
        F.concat(name, letter).alias("klifs_85_residue_sequence"), letter.alias("gatekeeper_residue"), F.substring(name, 2, 3).alias("hinge_residues"))


def order_vectors(spark, d) -> DataFrame:
    """Orders as molecules with the eight slots of their vector; order columns stand in for descriptors."""
    key = F.col("o_orderkey")
    given = table(spark, d, "orders").select(
        key.alias("mol_id"), ((key % 7) / 2).alias("logp"), F.col("o_totalprice").alias("tpsa"), (F.col("o_custkey") % 5).alias("rotatable"),
        F.when(key % 3 > 0, key % 3).alias("hbd"), F.length("o_orderpriority").alias("hba"))
    return graphs.molecule_vector(graphs.whole_summary(whole_molecules(spark, d)), given)


def molecule_vectors(spark, d):
    """The eight slots of orders as molecules; a number that is missing is null here."""
    slots = [F.round(F.nanvl(F.col("mol_features")[i], F.lit(None)), 3).alias(c) for i, c in enumerate(graphs.MOLECULE)]
    return order_vectors(spark, d).select("mol_id", *slots)


def model_samples(spark, d):
    """Orders as molecules and suppliers as targets, stored once each, and joined to whole samples when read."""
    nodes = F.transform("a", lambda x: F.struct(x["atom_idx"].alias("atom_idx"), F.array(x["weight"].cast("double"), x["atom_idx"].cast("double")).alias("features")))
    whole = whole_molecules(spark, d).select("mol_id", nodes.alias("a"), "adj")
    features = supplier_features(spark, d)
    both = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("y"))
    rows = both.select(
        (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("sample_id"), F.concat(F.lit("set"), F.col("l_suppkey") % 2).alias("dataset"),
        F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("split"), F.col("l_orderkey").alias("mol_id"), F.col("l_suppkey").alias("target_id"), "y")
    path = io.shared_folder(spark, "samples")
    stored = samples.whole_molecule_table(whole, order_vectors(spark, d)), samples.target_table(features, encode.vocabularies(features))
    samples.write(rows, *stored, path, buckets=max(samples.BUCKETS, line_tasks(spark, d)))
    codes = lambda c: F.array_join(F.transform(F.filter(c, lambda x: x != 0), lambda x: x.cast("string")), ",")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    edges = F.zip_with(F.col("edge_index")[0], F.col("edge_index")[1], lambda a, b: (a * 31 + b).cast("double"))
    used = F.filter(F.transform("protein_feat", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    of_molecules = {
        "c_size": F.col("c_size"), "x": total(F.transform("features", lambda v: v[0] * v[1])), "edges": total(edges),
        "tpsa": F.round(F.col("mol_features")[2], 3), "rings": F.col("mol_features")[7]}
    of_targets = {
        "target": codes("target"), "slots": F.array_join(F.transform(used, lambda i: i.cast("string")), ","), "second": F.col("protein_feat")[1].cast("double"),
        "pocket": codes("klifs_pocket"), "gatekeeper": codes("gatekeeper"), "hinge": codes("hinge")}
    return samples.read(spark, path, molecules=of_molecules, targets=of_targets)


def matrix_csv(spark, d):
    """Embeddings stored as CSV lines of a matrix, read back and melted."""
    path = io.shared_folder(spark, "matrix")
    values = F.transform("embedding", lambda x: F.when(x >= 0, x.cast("double")))
    io.write_matrix(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), values.alias("values")), path)
    return pairs.melt_matrix(io.read_matrix(spark, path, "csv")).select("row_idx", "col_idx", "value")


def explanation_atoms(spark, d):
    """How many of an order's explanations an order line is in, with the order's price (optional fields that it lacks are left out)."""
    found = explained(spark, d, "symbol", "weight", "price")
    price = F.when(F.exists("a", lambda x: x["price"].isNotNull()), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["price"], F.lit(0))))
    lines = F.transform("a", lambda x: F.struct(x["atom_idx"].alias("atom_idx"), x["symbol"].alias("symbol"), (x["weight"] > 25).alias("is_aromatic"), F.lit(True).alias("in_ring")))
    rows = explain.described(found.select("mol_id", lines.alias("a"), "found", price.alias("price")))
    return rows.select("mol_id", "atom_idx", "symbol", "is_aromatic", "n", "price")


def masked_samples(spark, d):
    """Whole masked samples of orders' even lines: features, mask, and the molecule's vector."""
    atoms, _ = molecules(spark, d)
    lists = F.sort_array(F.collect_list(F.struct("atom_idx", "weight")))
    rows = atoms.groupBy("mol_id").agg(lists.alias("a"))
    samples = rows.select(F.col("mol_id").alias("sample_id"), F.transform("a", lambda x: F.array(x["weight"], F.lit(1.0))).alias("features"), F.array(F.lit(7.0), F.size("a").cast("double")).alias("mol_features"), F.size("a").alias("n_atoms"))
    even = F.filter(F.transform("a", lambda x, i: F.when(x["atom_idx"] % 2 == 0, i)), lambda i: i.isNotNull())
    out = explain.masked_sample(rows.select(F.col("mol_id").alias("sample_id"), even.alias("atoms")), samples)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    parts = [total(F.transform("features", lambda v: v[0])), total(F.transform("features", lambda v: v[1]))]
    mask = F.array_join(F.transform("mask", lambda x: x.cast("int").cast("string")), "")
    return out.select(F.col("sample_id").alias("mol_id"), "n_atoms", parts[0].alias("weight"), parts[1].alias("ones"), mask.alias("mask"), total(F.col("mol_features")).alias("rest"))


def model_predictions(spark, d):
    """A user's model over order lines in batches."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return udfs.score(lines, lambda: lambda part: part["l_quantity"].to_numpy() * 2.0 + 1.0)


def component_counts(spark, d):
    """Orders as molecules whose lines are bonded by return flag alone: the least line of each line's part."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").alias("atom_idx")).agg(F.min("l_returnflag").alias("symbol"))
    ends = lines.alias("x").join(lines.alias("y"), (F.col("x.mol_id") == F.col("y.mol_id")) & (F.col("x.symbol") == F.col("y.symbol")) & (F.col("x.atom_idx") < F.col("y.atom_idx")))
    bonds = ends.select(F.col("x.mol_id").alias("mol_id"), F.col("x.atom_idx").alias("a"), F.col("y.atom_idx").alias("b"))
    return graphs.components(graphs.adjacency(lines, graphs.arcs(bonds)))


def pool_kinds(spark, d):
    rows = table(spark, d, "embeddings").select("label", "embedding")
    parts = [graphs.pool(rows, ["label"], "embedding", how).select("label", F.lit(how).alias("how"), F.posexplode("embedding").alias("place", "x")) for how in ("sum", "max", "mean")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("label", "how", "place", F.round("x", 5).alias("x"))


def masked_passing(spark, d):
    """Neighbour sums of two features, even lines masked before and after."""
    atoms, bonds = molecules(spark, d)
    nodes = atoms.select("mol_id", "atom_idx", F.array("weight", F.lit(1.0)).alias("features"), (F.col("atom_idx") % 2).alias("keep"))
    out = graphs.neighbor_sum(nodes, graphs.arcs(bonds), 0.5, "keep", line_tasks(spark, d))
    return out.select("mol_id", "atom_idx", F.round(F.col("features")[0], 6).alias("weight"), F.col("features")[1].alias("ones"))


def matrix_cells(spark, d):
    """Embeddings stored as an affinity matrix, read back and melted."""
    path = io.shared_folder(spark, "matrix")
    values = F.transform("embedding", lambda x: F.when(x >= 0, x.cast("double")))
    io.write_samples(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), values.alias("values")), path)
    return pairs.melt_matrix(io.read_matrix(spark, path)).select("row_idx", "col_idx", "value")


def pair_files(spark, d):
    """Labelled pairs written and read as CSV: a second write leaves them, a forced one replaces them."""
    path = io.shared_folder(spark, "pairs")
    rows = table(spark, d, "orders").select(F.concat(F.lit("C,"), F.col("o_orderkey").cast("string")).alias("compound_iso_smiles"), F.col("o_orderstatus").alias("target_id"), F.col("o_orderpriority").alias("target_sequence"), F.col("o_totalprice").alias("affinity"))
    io.write_pairs(rows.where("target_id = 'F'"), path)
    io.write_pairs(rows.limit(0), path)
    kept = io.cut(io.read_pairs(spark, path).withColumn("step", F.lit(1)))
    io.write_pairs(rows, path, force=True)
    return kept.unionByName(io.read_pairs(spark, path).withColumn("step", F.lit(2)))


def dictionary_files(spark, d):
    """Nations as a JSON dictionary of strings in the order of their keys, and each region's nations as folds."""
    names, folds = io.shared_folder(spark, "names"), io.shared_folder(spark, "folds")
    nation = table(spark, d, "nation")
    entries = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    pairs_of = F.transform(entries, lambda e: F.concat(F.lit('"k'), e["n_nationkey"].cast("string"), F.lit('": '), F.lit('"'), e["n_name"], F.lit('"')))
    nation.agg(F.concat(F.lit("{"), F.array_join(pairs_of, ", "), F.lit("}")).alias("value")).coalesce(1).write.text(names)
    lists = nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("x"))
    lists.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n_regionkey", "x"))), lambda r: r["x"])).alias("value")).coalesce(1).write.text(folds)
    read = io.read_json_dict(spark, f"{names}/*.txt", "ligand_id", "smiles")
    return read.join(io.read_folds(spark, f"{folds}/*.txt", "train"), F.col("row_idx") == F.col("ordinal")).select("row_idx", "ligand_id", "smiles", "split", "fold")


POCKET = r"""
letters AS (SELECT *, regexp_replace(p, '[^\p{L}]', '', 'g') AS s FROM pockets),
counted AS (SELECT *, length(s) AS n FROM letters),
summed AS (
  SELECT *,
    array_to_string(list_transform(list_sort(list_distinct(list_filter(string_split(s, ''), lambda c: c <> ''))),
      lambda c: c || ':' || CAST(n - length(replace(s, c, '')) AS VARCHAR)), ';') AS composition,
    round(CASE WHEN n > 0 THEN (n - length(regexp_replace(s, '[AVLIMFWYPCG]', '', 'g'))) / n ELSE 0 END, 6) AS share,
    round(CASE WHEN n > 0 THEN (length(regexp_replace(s, '[DE]', '', 'g')) - length(regexp_replace(s, '[KRH]', '', 'g'))) / n ELSE 0 END, 6) AS charge,
    CASE WHEN length(p) >= 48 THEN substring(p, 45, 1) ELSE '' END AS gate, CASE WHEN length(p) >= 48 THEN substring(p, 46, 3) ELSE '' END AS hinge
  FROM counted)"""
SPLIT = "CASE WHEN event_type IN ('view', 'click') THEN 'val' ELSE 'test' END"
SUFFICIENT = f"""{SETS % 8}{COMBOS},
unions AS (SELECT m, mask, n, min(parts) AS parts FROM combos GROUP BY 1, 2, 3),
totals AS (SELECT m, sum(w) AS total FROM atoms GROUP BY m),
scored AS (
  SELECT u.m, u.mask, u.n, u.parts, sum(w) / any_value(total) AS p
  FROM unions u JOIN atoms a ON u.m = a.m AND (u.mask >> a.i) & 1 = 1 JOIN totals t ON u.m = t.m GROUP BY 1, 2, 3, 4),
enough AS (SELECT *, abs(1.0::DOUBLE - p) AS diff FROM scored WHERE abs(1.0::DOUBLE - p) <= 0.25),
least_sets AS (SELECT * FROM enough s WHERE NOT EXISTS (SELECT 1 FROM enough o WHERE o.m = s.m AND o.n < s.n AND o.mask & s.mask = o.mask))"""

SQL = {
    "feature_chain": f"""
WITH named AS (
  SELECT s_suppkey, s_name, ' ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || '(' || s_name || ')p' AS target_id,
    upper(regexp_replace(n_name, '\\s+', '', 'g')) AS key
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
aliases AS (SELECT upper(regexp_replace(n_name, '\\s+', '', 'g')) AS alias FROM nation WHERE n_nationkey % 5 = 0),
keyed AS (
  SELECT n.*, CASE WHEN s_suppkey % 7 = 0 THEN 'FRANCE' WHEN alias IS NOT NULL THEN 'GERMANY' ELSE key END AS k
  FROM named n LEFT JOIN aliases ON key = alias),
kinases AS (
  SELECT upper(regexp_replace(n_name, '\\s+', '', 'g')) AS k, c_custkey, c_mktsegment, n_name,
    row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS r
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 > 0),
structures AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 7 END DESC,
    CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_orderkey % 3 END, o_orderkey) AS r
  FROM orders),
pockets AS (
  SELECT keyed.target_id, keyed.s_name, x.c_custkey, x.c_mktsegment, x.n_name, o.o_orderkey, o.o_orderstatus, o.o_orderpriority,
    replace(coalesce(repeat(o.o_orderpriority, CAST(1 + o.o_orderkey % 8 AS INTEGER)), ''), '-', '_') AS p
  FROM keyed LEFT JOIN kinases x ON keyed.k = x.k AND x.r = 1 LEFT JOIN structures o ON o.o_custkey = x.c_custkey AND o.r = 1),
{POCKET}
SELECT target_id, s_name AS target_sequence, coalesce(c_mktsegment, '') AS kinase_group,
  CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END AS kinase_family, coalesce(n_name, '') AS kinase_subfamily,
  coalesce(CAST(c_custkey AS VARCHAR), '') AS klifs_kinase_id, coalesce(CAST(o_orderkey AS VARCHAR), '') AS best_structure_klifs_id,
  coalesce(o_orderstatus, '') AS best_structure_pdb_id, CASE WHEN o_orderkey IS NULL THEN '0' ELSE '1' END AS has_structure,
  p AS klifs_85_residue_sequence, gate AS gatekeeper_residue, hinge AS hinge_residues, composition AS pocket_residue_composition,
  CASE WHEN o_orderkey IS NOT NULL THEN share END AS pocket_hydrophobicity, CASE WHEN o_orderkey IS NOT NULL THEN charge END AS pocket_charge,
  CASE WHEN o_orderkey % 2 > 0 THEN o_orderstatus ELSE '' END AS dfg_state, coalesce(substr(o_orderpriority, 1, 1), '') AS ac_helix_state,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 5 AS VARCHAR) ELSE '' END AS activation_loop_state
FROM summed""",
    "donor_tables": """
WITH r AS (SELECT d.doc_id, upper(d.text) AS text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
own AS (SELECT * FROM r WHERE doc_id % 2 = 0 OR quality IS NULL),
pool AS (
  SELECT 0 AS k, doc_id, text, quality, toxic + 20 AS toxic FROM r WHERE doc_id % 3 = 2
  UNION ALL SELECT 1, doc_id, text, quality, toxic + 10 FROM r WHERE doc_id % 3 = 1 UNION ALL SELECT 2, * FROM own),
f AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY k, doc_id) AS n FROM pool WHERE quality IS NOT NULL AND trim(text) <> '') WHERE n = 1)
SELECT own.doc_id, coalesce(own.quality, f.quality) AS quality,
  CASE WHEN own.quality IS NULL AND f.text IS NOT NULL THEN f.toxic ELSE own.toxic END AS toxic
FROM own LEFT JOIN f ON own.text = f.text""",
    "full_scores": """
WITH a AS (SELECT l_orderkey AS m, l_linenumber AS i, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
SELECT m AS mol_id, round(sum(w * i) + count(*) / 100, 4) AS whole,
  round(coalesce(sum(w * i) FILTER (i % 2 = 1), 0) + count(*) FILTER (i % 2 = 1) / 100, 4) AS odd
FROM a GROUP BY m""",
    "embedding_passing": """
WITH c AS (
  SELECT vec_id // 8 AS m, vec_id % 8 AS i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
s AS (
  SELECT x.m, x.i, x.k, 1.5::DOUBLE * x.v + coalesce(p.v, 0) + coalesce(n.v, 0) AS v
  FROM c x LEFT JOIN c p ON p.m = x.m AND p.k = x.k AND p.i = x.i - 1 LEFT JOIN c n ON n.m = x.m AND n.k = x.k AND n.i = x.i + 1),
w AS (SELECT max(k) + 1 AS w FROM c)
SELECT m AS mol_id, CAST(k AS INTEGER) AS at, round(max(v), 5) AS x FROM s GROUP BY 1, 2
UNION ALL SELECT m, CAST(k + any_value(w) AS INTEGER), round(avg(v), 5) FROM s, w GROUP BY m, k""",
    "target_vectors": """
WITH c AS (
  SELECT c_custkey, c_acctbal, [coalesce(c_mktsegment, ''), CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 3 AS VARCHAR) ELSE '' END,
    '', right(c_name, 1)] AS words
  FROM customer),
w AS (SELECT c_custkey, unnest(words) AS word, unnest([1, 2, 3, 4, 5]) AS k FROM c),
slots AS (SELECT k, word, row_number() OVER (ORDER BY k, word) + 3 AS slot FROM (SELECT DISTINCT k, word FROM w)),
cells AS (
  SELECT c_custkey, slot, 1.0::DOUBLE AS value FROM w JOIN slots USING (k, word)
  UNION ALL SELECT c_custkey, 0, c_custkey % 2 FROM c
  UNION ALL SELECT c_custkey, 1, CASE WHEN c_acctbal < 0 THEN 0 ELSE floor(c_acctbal) END FROM c
  UNION ALL SELECT c_custkey, 3, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1.5 END FROM c)
SELECT o_orderkey, CAST(slot AS INTEGER) AS slot, value FROM orders JOIN cells ON o_custkey = c_custkey WHERE value <> 0""",
    "target_sequences": """
WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-IK-Z]', '', 'g') AS s, upper(p_type) AS t FROM part)
SELECT p_partkey,
  array_to_string(list_transform(range(1, 1001), lambda i: CASE WHEN i <= length(s) THEN instr('ABCDEFGHIKLMNOPQRSTUVWXYZ', substring(s, CAST(i AS INTEGER), 1)) ELSE 0 END), ',') AS codes,
  array_to_string(list_transform(range(1, 86), lambda i: CASE WHEN i <= length(t) THEN instr('ABCDEFGHIKLMNOPQRSTUVWXYZ', substring(t, CAST(i AS INTEGER), 1)) ELSE 0 END), ',') AS pocket,
  CAST(instr('ABCDEFGHIKLMNOPQRSTUVWXYZ', substring(t, 1, 1)) AS VARCHAR) AS gatekeeper,
  array_to_string(list_transform(range(2, 5), lambda i: CASE WHEN i <= length(t) THEN instr('ABCDEFGHIKLMNOPQRSTUVWXYZ', substring(t, CAST(i AS INTEGER), 1)) ELSE 0 END), ',') AS hinge
FROM p""",
    "atom_vectors": f"""
WITH {MOLECULES},
deg AS (SELECT atoms.m, atoms.i, s, w, count(arcs.a) AS d FROM atoms LEFT JOIN arcs ON atoms.m = arcs.m AND atoms.i = arcs.a GROUP BY 1, 2, 3, 4),
v AS (
  SELECT m, i, list_filter([
    CASE s WHEN 'A' THEN 0 WHEN 'R' THEN 7 ELSE 43 END, 44 + d, 55 + least(i * 3 % 13, 10), 66 + least(i, 10),
    CASE WHEN i - 3 BETWEEN -2 AND 2 THEN 77 + i - 1 ELSE 82 END, CASE i % 3 WHEN 0 THEN 84 WHEN 1 THEN 85 ELSE 88 END,
    CASE WHEN i % 2 = 0 THEN 89 END, CASE WHEN w > 25 THEN 90 END, CASE WHEN s <> 'A' THEN 91 END, CASE WHEN s = 'R' THEN 92 END,
    CASE WHEN i % 5 = 0 THEN 93 END, CASE WHEN i % 5 IN (1, 3) THEN 95 END, CASE WHEN i % 5 = 4 THEN 98 END], lambda x: x IS NOT NULL) AS slots
  FROM deg)
SELECT m AS mol_id, i AS atom_idx, array_to_string(slots, ',') AS slots, round(1.0::DOUBLE / len(slots), 6) AS share FROM v""",
    "pair_graphs": """
SELECT l_orderkey, l_linenumber, l_extendedprice, len(string_split(p_name, ' ')) AS n_atoms, array_to_string(string_split(p_name, ' '), '|') AS symbols
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sequence_sets": """
SELECT source AS target_sequence, count(DISTINCT lang) AS n FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY source""",
    "model_scores": """
WITH r AS (
  SELECT l_returnflag AS g, l_extendedprice AS y, 1000 * l_quantity AS f,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS b
  FROM lineitem),
cells AS (SELECT g, y, f, count(*) AS n FROM r GROUP BY 1, 2, 3),
grid AS (
  SELECT ys.g, ys.y, fs.f, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT g, y FROM r) ys JOIN (SELECT DISTINCT g, f FROM r) fs ON ys.g = fs.g LEFT JOIN cells c ON c.g = ys.g AND c.y = ys.y AND c.f = fs.f),
below AS (SELECT g, y, f, n, coalesce(sum(n) OVER (PARTITION BY g, f ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM grid),
less AS (
  SELECT g, n, b, coalesce(sum(b) OVER (PARTITION BY g, y ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower,
    sum(b) OVER (PARTITION BY g, y) AS every
  FROM below),
ci AS (SELECT g, (sum(n * lower) + 0.5::DOUBLE * sum(n * b)) / sum(n * every) AS ci FROM less GROUP BY g)
SELECT r.g AS l_returnflag, round(sqrt(avg(power(y - f, 2))), 4) AS rmse, round(avg(power(y - f, 2)) / 1e6, 4) AS mse_m, round(corr(y, f), 6) AS pearson,
  round(corr(a, b), 6) AS spearman, round(any_value(ci), 6) AS ci
FROM r JOIN ci ON r.g = ci.g GROUP BY r.g""",
    "validation_choice": f"""
WITH e AS (SELECT user_id % 50 AS model, {SPLIT} AS split, CAST(dayofyear(ts) AS INTEGER) AS epoch, max(value) AS mse FROM events GROUP BY 1, 2, 3),
v AS (
  SELECT *, least(coalesce(min(mse) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000), 1000) AS best
  FROM e WHERE split = 'val'),
chosen AS (SELECT model, max(epoch) AS epoch FROM v WHERE mse < best GROUP BY model)
SELECT model, epoch, mse FROM e JOIN chosen USING (model, epoch) WHERE split = 'test'""",
    "top_explanations": f"""
WITH RECURSIVE {SUFFICIENT},
firsts AS (SELECT m, n, diff, CAST(row_number() OVER (PARTITION BY m ORDER BY n, round(diff, 9)) AS INTEGER) AS k FROM least_sets)
SELECT m AS mol_id, k AS rank, n AS size, round(diff, 6) AS difference FROM firsts WHERE k <= 3""",
    "explanation_table": f"""
WITH RECURSIVE {SUFFICIENT},
texts AS (SELECT m, string_agg(s, '' ORDER BY i) AS t FROM atoms GROUP BY m),
named AS (SELECT *, list_filter(range(1, 60), lambda i: (mask >> i) & 1 = 1) AS a FROM least_sets)
SELECT m AS sample_index, t AS full_smiles, array_to_string(a, '.') AS fragment_smiles, '[' || array_to_string(a, ',') || ']' AS atom_indices,
  parts AS num_components, '[' || array_to_string(a, ',') || ']' AS components, n AS size, 1.0::DOUBLE AS full_prediction,
  round(p, 6) AS fragment_prediction, round(diff, 6) AS difference, 0.25::DOUBLE AS epsilon, 8 AS max_subgraph_size, 'orders' AS dataset,
  'share' AS model_name, 2 AS max_combination_size, 8 AS max_total_atoms, parts AS component_smiles
FROM named JOIN texts USING (m)""",
    "molecule_vectors": f"""
WITH {MOLECULES},
c AS (SELECT m, count(*) AS n, round(sum(ascii(s) + 1.008::DOUBLE), 3) AS weight, count(*) FILTER (s NOT IN ('C', 'H')) AS hetero FROM atoms GROUP BY m),
b AS (SELECT m, count(*) AS n FROM bonds GROUP BY m)
SELECT c.m AS mol_id, weight, round((c.m % 7) / 2.0::DOUBLE, 3) AS logp, round(o_totalprice, 3) AS tpsa, (o_custkey % 5)::DOUBLE AS rotatable,
  CASE WHEN c.m % 3 > 0 THEN (c.m % 3)::DOUBLE END AS hbd, length(o_orderpriority)::DOUBLE AS hba, hetero::DOUBLE AS heteroatoms,
  (coalesce(b.n, 0) - c.n + 1)::DOUBLE AS rings
FROM c JOIN orders ON o_orderkey = c.m LEFT JOIN b ON c.m = b.m""",
    "model_samples": f"""
WITH {MOLECULES},
x AS (SELECT m, CAST(count(*) AS INTEGER) AS n, sum(w * i) AS x FROM atoms GROUP BY m),
e AS (
  SELECT arcs.m, CAST(sum(31 * (p.k - 1) + q.k - 1) AS DOUBLE) AS edges, count(*) // 2 AS n
  FROM arcs JOIN placed p ON arcs.m = p.m AND arcs.a = p.i JOIN placed q ON arcs.m = q.m AND arcs.b = q.i GROUP BY 1),
f AS (
  SELECT s_suppkey, floor(s_acctbal)::DOUBLE AS second, substring('ACDEFGHIK', CAST(s_suppkey % 9 + 1 AS INTEGER), 1) AS letter,
    regexp_replace(upper(s_name), '[^A-IK-Z]', '', 'g') AS s, regexp_replace(upper(n_name), '[^A-Z]', '', 'g') AS p,
    dense_rank() OVER (ORDER BY n_name) + 3 AS a, dense_rank() OVER (ORDER BY CAST(s_nationkey AS VARCHAR)) + 3 AS b
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (
  SELECT *, max(a) OVER () - 3 AS na, max(b) OVER () - 3 AS nb,
    list_transform([s || letter, p || letter, letter, substring(p, 2, 3)],
      lambda v: array_to_string(list_transform(string_split(v, ''), lambda c: instr('ABCDEFGHIKLMNOPQRSTUVWXYZ', c)), ',')) AS v
  FROM f),
r AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey * 100000 + l_suppkey AS sample_id, 'set' || l_suppkey % 2 AS dataset, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  l_orderkey AS mol_id, l_suppkey AS target_id, y, x.n AS c_size, x.x, coalesce(edges, 0) AS edges, round(o_totalprice, 3) AS tpsa,
  (coalesce(e.n, 0) - x.n + 1)::DOUBLE AS rings, v[1] AS target,
  array_to_string(list_filter([CASE WHEN l_suppkey % 2 = 1 THEN 0 END, CASE WHEN second <> 0 THEN 1 END, a, na + b, na + nb + 4, na + nb + 5, na + nb + 6],
    lambda k: k IS NOT NULL), ',') AS slots,
  second, v[2] AS pocket, v[3] AS gatekeeper, v[4] AS hinge
FROM r JOIN x ON x.m = l_orderkey LEFT JOIN e ON e.m = l_orderkey JOIN orders ON o_orderkey = l_orderkey JOIN t ON s_suppkey = l_suppkey""",
    "matrix_csv": """
WITH c AS (SELECT vec_id AS row_idx, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col_idx FROM embeddings)
SELECT row_idx, col_idx, CAST(v AS DOUBLE) AS value FROM c WHERE v >= 0""",
    "explanation_atoms": f"""
WITH RECURSIVE {SUFFICIENT},
prices AS (SELECT l_orderkey AS m, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS price FROM lineitem GROUP BY 1)
SELECT a.m AS mol_id, a.i AS atom_idx, a.s AS symbol, a.w > 25 AS is_aromatic, count(*) AS n, any_value(price) AS price
FROM least_sets x JOIN atoms a ON x.m = a.m AND (x.mask >> a.i) & 1 = 1 JOIN prices p ON p.m = a.m GROUP BY 1, 2, 3, 4""",
    "masked_samples": """
WITH atoms AS (SELECT l_orderkey AS m, l_linenumber AS i, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
SELECT m AS mol_id, CAST(count(*) AS INTEGER) AS n_atoms, coalesce(sum(w) FILTER (i % 2 = 0), 0)::DOUBLE AS weight,
  CAST(count(*) FILTER (i % 2 = 0) AS DOUBLE) AS ones, string_agg(CASE WHEN i % 2 = 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS mask, 0.0::DOUBLE AS rest
FROM atoms GROUP BY m""",
    "model_predictions": "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_quantity * 2.0::DOUBLE + 1.0 AS prediction FROM lineitem",
    "component_counts": """
WITH atoms AS (SELECT l_orderkey AS m, l_linenumber AS i, min(l_returnflag) AS s FROM lineitem GROUP BY 1, 2)
SELECT m AS mol_id, i AS atom_idx, min(i) OVER (PARTITION BY m, s) AS component FROM atoms""",
    "pool_kinds": """
WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS place FROM embeddings)
SELECT label, 'sum' AS how, place, round(sum(v), 5) AS x FROM c GROUP BY label, place
UNION ALL SELECT label, 'max', place, round(max(v), 5) FROM c GROUP BY label, place
UNION ALL SELECT label, 'mean', place, round(avg(v), 5) FROM c GROUP BY label, place""",
    "masked_passing": f"""
WITH {MOLECULES}
SELECT x.m AS mol_id, x.i AS atom_idx, round(x.i % 2 * (1.5 * any_value(x.w) + coalesce(sum(y.w * (y.i % 2)), 0)), 6) AS weight,
  CAST(x.i % 2 * (1.5 + coalesce(sum(y.i % 2), 0)) AS DOUBLE) AS ones
FROM atoms x LEFT JOIN arcs ON arcs.m = x.m AND arcs.a = x.i LEFT JOIN atoms y ON y.m = arcs.m AND y.i = arcs.b GROUP BY 1, 2""",
    "matrix_cells": """
WITH c AS (SELECT vec_id AS row_idx, unnest(embedding) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col_idx FROM embeddings)
SELECT row_idx, col_idx, CAST(v AS DOUBLE) AS value FROM c WHERE v >= 0""",
    "pair_files": """
SELECT 'C,' || o_orderkey AS compound_iso_smiles, o_orderstatus AS target_id, o_orderpriority AS target_sequence, o_totalprice AS affinity, 1 AS step
FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'C,' || o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, 2 FROM orders""",
    "dictionary_files": """
SELECT CAST(n_nationkey AS BIGINT) AS row_idx, 'k' || n_nationkey AS ligand_id, n_name AS smiles, 'train' AS split,
  CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS INTEGER) AS fold
FROM nation""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
