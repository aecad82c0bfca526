"""The registered queries: each operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chain import PosteriorChain
from ..functions.columns import all_present, count_swaps, file_number, fill_missing_indices, sort_by_number
from ..operators.assignment import assign, cost_matrix, create_compute_cost_matrix, log_density
from ..operators.fits import (
    NormalFit,
    create_parametric_fit,
    find_prob_in_model,
    mv_normal_estimate,
    mv_normal_fit,
    uni_normal_fit_single_parameter,
    update_parametric_fit_and_prob_in_model,
)
from ..operators.moments import labelled_entries
from ..operators.entry_fits import robust_estimate
from ..operators.models import LabelModel, mv_normal_model, robust_model, uni_normal_model
from ..operators.relabel import (
    create_relabel_samples,
    relabel_mv_normal,
    relabel_posterior_chain_one_iteration,
    relabel_samples_one_iteration,
    relabel_univariate_normal,
    trace_frame,
)
from ..sources.text import (
    decode_fixed,
    decode_product_space,
    load_samples,
    load_samples_by_dimension,
    load_samples_fixed_num_sources,
    load_samples_product_space,
)
from ..storage import checkpoint_root, stage
from .catalog import catalog_summary, make_catalog_mv_normal
from .table_chains import (
    amount_chain,
    discounted_chain,
    embedding_chain,
    hundredths,
    line_number_chain,
    line_status_chain,
    part_chain,
    return_flag_chain,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


def rounded(column: Column | str, name: str) -> Column:
    return F.round(column, DIGITS).alias(name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its scheme: also a folder without one is shared, as a mount."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    shared = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def per_slot(spark: SparkSession, columns: dict[str, Sequence[float]]) -> DataFrame:
    """One row per slot from driver-held vectors."""
    rows = [(i, *[float(v) for v in row]) for i, row in enumerate(zip(*columns.values()))]
    schema = ", ".join(["slot int", *[f"{name} double" for name in columns]])
    return spark.createDataFrame(rows, schema).select("slot", *[rounded(n, n) for n in columns])


def fit_columns(fit: NormalFit) -> dict[str, Sequence[float]]:
    width = fit.mean.shape[1]
    means = {f"m{i}": fit.mean[:, i] for i in range(width)}
    return means | {f"c{i}{j}": fit.cov[:, i, j] for i in range(width) for j in range(i, width)}


# ---- data model and reshapes --------------------------------------------------------------


def chain_long(spark, sf_dir):
    return line_number_chain(spark, sf_dir).long_columns()


def chain_wide_flat(spark, sf_dir):
    chain = line_number_chain(spark, sf_dir)
    cells = [F.get(F.get("entries", s), p).alias(f"s{s}p{p}") for s in range(7) for p in range(3)]
    return chain.frame.select("sample_id", *cells)


def chain_shape(spark, sf_dir):
    chain = line_number_chain(spark, sf_dir)
    return chain.frame.agg(F.count("*").alias("samples"), F.max(F.size("entries")).alias("sources"),
                           F.max(F.size(F.get("entries", 0))).alias("params"))


def burn_thin(spark, sf_dir):
    return line_number_chain(spark, sf_dir).get_chain(burn=100, thin=3).long_columns()


def expand_slots(spark, sf_dir):
    return line_number_chain(spark, sf_dir).expand_chain(9).long_columns()


def slot_projection(spark, sf_dir):
    return line_number_chain(spark, sf_dir).values(slot=2, param=1)


def complete_rows(spark, sf_dir):
    entries = discounted_chain(spark, sf_dir).long_columns()
    return entries.where(all_present(["p0", "p1"]))


def parameter_rows(spark, sf_dir):
    return discounted_chain(spark, sf_dir).long_columns().where("p1 IS NOT NULL").select("sample_id", "slot", "p1")


def randomize_entries(spark, sf_dir):
    return line_number_chain(spark, sf_dir).randomize_entries(seed=7).long_columns()


def reorder_entries(spark, sf_dir):
    chain = line_number_chain(spark, sf_dir)
    reverse = F.array(*[F.lit(6 - s) for s in range(7)])
    return chain.reorder(reverse).long_columns()


# ---- fits ---------------------------------------------------------------------------------


def inclusion_prob(spark, sf_dir):
    return per_slot(spark, {"prob": find_prob_in_model(line_number_chain(spark, sf_dir))})


def inclusion_prob_narrow(spark, sf_dir):
    return per_slot(spark, {"prob": find_prob_in_model(line_number_chain(spark, sf_dir), 3)})


def inclusion_prob_expanded(spark, sf_dir):
    return per_slot(spark, {"prob": find_prob_in_model(line_number_chain(spark, sf_dir).expand_chain(9))})


def uni_fit(spark, sf_dir):
    fit = uni_normal_fit_single_parameter(line_number_chain(spark, sf_dir), 7, 1)
    return per_slot(spark, {"mean": fit.mean[:, 0], "std": fit.std})


def uni_fit_fallback(spark, sf_dir):
    fit = uni_normal_fit_single_parameter(line_number_chain(spark, sf_dir).expand_chain(9), 9, 1)
    return per_slot(spark, {"mean": fit.mean[:, 0], "std": fit.std})


def mv_fit(spark, sf_dir):
    return per_slot(spark, fit_columns(mv_normal_fit(line_number_chain(spark, sf_dir), 7)))


def mv_fit_fallback(spark, sf_dir):
    return per_slot(spark, fit_columns(mv_normal_fit(line_number_chain(spark, sf_dir).expand_chain(9), 9)))


def mv_fit_partial(spark, sf_dir):
    return per_slot(spark, fit_columns(mv_normal_fit(discounted_chain(spark, sf_dir), 3)))


def mv_fit_wide(spark, sf_dir):
    return per_slot(spark, fit_columns(mv_normal_fit(embedding_chain(spark, sf_dir), 10)))


def fit_and_prob(spark, sf_dir):
    chain = discounted_chain(spark, sf_dir)
    fit, prob = update_parametric_fit_and_prob_in_model(chain, 3, create_parametric_fit(mv_normal_estimate))
    return per_slot(spark, fit_columns(fit) | {"prob": prob})


def robust_fit(spark, sf_dir):
    """Medians and scales from the entries themselves; two slots have none and take those of all."""
    fit = create_parametric_fit(robust_estimate)(line_number_chain(spark, sf_dir).expand_chain(9), 9)
    return per_slot(spark, {f"{name}{i}": values[:, i] for i in range(3) for name, values in (("m", fit.location), ("s", fit.scale))})


# ---- densities and scores -----------------------------------------------------------------


def fitted(chain: PosteriorChain, model: LabelModel):
    fit = create_parametric_fit(model.estimator, model.single_parameter)
    return update_parametric_fit_and_prob_in_model(chain, chain.num_sources, fit)


def density_query(chain_of, model: LabelModel) -> Query:
    def query(spark, sf_dir):
        chain = chain_of(spark, sf_dir).staged()
        fit, _ = fitted(chain, model)
        return log_density(chain, fit, model).select("sample_id", "label", "slot", rounded("logpdf", "logpdf"))

    return query


def cost_query(chain_of, model: LabelModel) -> Query:
    def query(spark, sf_dir):
        chain = chain_of(spark, sf_dir).staged()
        fit, prob = fitted(chain, model)
        return cost_matrix(chain, fit, prob, model).select("sample_id", "label", "slot", rounded("score", "score"))

    return query


# ---- assignment and relabeling ------------------------------------------------------------


def assignment_query(chain_of, model: LabelModel) -> Query:
    """``sample_id, slot, label, score`` of the entries that are there."""

    def query(spark, sf_dir):
        chain = chain_of(spark, sf_dir).staged()
        assigned = assign(chain, *fitted(chain, model), model)
        rows = labelled_entries(assigned, chain.num_sources, [0])
        rows = rows.withColumnRenamed("source", "slot")
        return rows.where("score IS NOT NULL").select("sample_id", "slot", "label", rounded("score", "score"))

    return query


def relabel_once(spark, sf_dir):
    chain = return_flag_chain(spark, sf_dir).staged()
    model = mv_normal_model()
    return relabel_samples_one_iteration(chain, *fitted(chain, model), model)[0].long_columns()


def mean_cost(spark, sf_dir):
    chain = return_flag_chain(spark, sf_dir).staged()
    model = mv_normal_model()
    cost = relabel_samples_one_iteration(chain, *fitted(chain, model), model)[1]
    return cost.select(rounded("mean_cost", "mean_cost"))


def relabel_uni_k3(spark, sf_dir):
    chain = return_flag_chain(spark, sf_dir)
    return relabel_univariate_normal(chain, num_iterations=3, init_parameter_index=1).long_columns()


def relabel_mv_k3(spark, sf_dir):
    return relabel_mv_normal(return_flag_chain(spark, sf_dir), num_iterations=3).long_columns()


def relabel_mv_trace(spark, sf_dir):
    result = relabel_mv_normal(return_flag_chain(spark, sf_dir), num_iterations=3)
    trace = trace_frame(spark, result)
    return trace.select("iteration", rounded("cost", "cost"),
                        *[rounded(F.get("prob_in_model", s), f"prob{s}") for s in range(3)])


def relabel_robust_k3(spark, sf_dir):
    """Three steps of a model that is fitted to the entries of the current layout."""
    return create_relabel_samples(robust_model())(return_flag_chain(spark, sf_dir), num_iterations=3).long_columns()


def flag_catalog(spark, sf_dir) -> PosteriorChain:
    return make_catalog_mv_normal(return_flag_chain(spark, sf_dir), 3, num_iterations=3,
                                  init_num_iterations=2, initialization_param_index=1, shuffle_seed=7)


def flag_catalog_k5(spark, sf_dir):
    """Three slots after two steps on one parameter and three on all."""
    return flag_catalog(spark, sf_dir).long_columns()


def status_catalog(spark, sf_dir) -> PosteriorChain:
    """Two slots, until nothing moves."""
    return make_catalog_mv_normal(line_status_chain(spark, sf_dir), 2, initialization_param_index=1, shuffle_seed=7)


def make_catalog(spark, sf_dir):
    return status_catalog(spark, sf_dir).long_columns()


def source_track(spark, sf_dir):
    """The second parameter of one catalog source over the samples."""
    return status_catalog(spark, sf_dir).values(slot=1, param=1)


def sources_by_presence(spark, sf_dir):
    """The catalog's inclusion probabilities from the highest to the lowest."""
    ranked = sorted(status_catalog(spark, sf_dir).prob_in_model, reverse=True)
    return per_slot(spark, {"prob": ranked}).withColumnRenamed("slot", "place")


def catalog_of_line_numbers(spark, sf_dir):
    """The wide case: seven slots of three parameters, shuffled, initialised and aligned."""
    catalog = make_catalog_mv_normal(line_number_chain(spark, sf_dir), 7, num_iterations=3,
                                     init_num_iterations=2, initialization_param_index=1, shuffle_seed=7)
    return catalog_summary(catalog).select(
        "slot", *[rounded(c, c) for c in ("presence", "mean_p0", "mean_p1", "mean_p2")])


def line_number_sources(spark, sf_dir):
    """The seven-slot catalog with the usual budgets, until nothing moves, and after how many steps of each kind."""
    return settled_summary(make_catalog_mv_normal(line_number_chain(spark, sf_dir), 7, initialization_param_index=1, shuffle_seed=7))


def settled_summary(catalog: PosteriorChain) -> DataFrame:
    numbers = [step.iteration for step in catalog.trace]
    second = max(i for i, number in enumerate(numbers) if number == 1)
    summary = catalog_summary(catalog).select("slot", *[rounded(c, c) for c in ("presence", "mean_p0", "mean_p1")])
    return summary.withColumns({"uni_steps": F.lit(second), "mv_steps": F.lit(len(numbers) - second)})


def catalog_to_fixed_layout(spark, sf_dir):
    """The sources of a catalog whose layout has stopped changing, and after how many steps of each kind."""
    return settled_summary(status_catalog(spark, sf_dir))


def catalog_of_amounts(spark, sf_dir):
    """Three slots with some entries missing, until nothing moves, and after how many steps of each kind."""
    return settled_summary(make_catalog_mv_normal(amount_chain(spark, sf_dir), 3, initialization_param_index=0, shuffle_seed=7))


# ---- files --------------------------------------------------------------------------------


def order_vectors(spark: SparkSession, sf_dir: str, metadata: int) -> DataFrame:
    """``sample_id, values``: three sources of two parameters per order, then metadata columns.

    The first metadata column is the number of active sources minus one.
    """
    price, customer = hundredths("o_totalprice") / 100.0, F.col("o_custkey").cast("double")
    extra = F.when(F.col("o_orderstatus") == "P", 0.0).when(F.col("o_orderstatus") == "F", 1.0).otherwise(2.0)
    data = [price, customer, price * 2, customer + 1, price * 4, customer + 2, extra]
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.array(*data, *[F.lit(0.0)] * (metadata - 1)).alias("values"))


def write_lines(rows: DataFrame, order_by: list[str], path: str, written: bool = False) -> None:
    """Text lines whose order over the part files is ``order_by``; rows that are not ``written`` are written first."""
    ordered = (rows if written else stage(rows)).repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered.select(F.concat_ws(" ", F.col("values").cast("array<string>"))).write.text(path)


def product_space_decode(spark, sf_dir):
    return decode_product_space(order_vectors(spark, sf_dir, 5), 2).long_columns()


def fixed_decode(spark, sf_dir):
    return decode_fixed(order_vectors(spark, sf_dir, 4), 10, 2).long_columns()


def product_space_text(spark, sf_dir):
    path = scratch(spark, "product-space")
    write_lines(order_vectors(spark, sf_dir, 5), ["sample_id"], path)
    return load_samples_product_space(spark, path, 2).long_columns()


def fixed_text(spark, sf_dir):
    path = scratch(spark, "fixed")
    write_lines(order_vectors(spark, sf_dir, 4), ["sample_id"], path)
    return load_samples_fixed_num_sources(spark, path, 2, burn=10, thin=4).long_columns()


def write_dimension_files(spark: SparkSession, packed: DataFrame, widest: int) -> str:
    """One folder of text per number of sources, from ``sample_id, sources, slot, values``."""
    # Sorted by width, every file of the table is read for its own pages only, not all of it for each width.
    folder, packed = scratch(spark, "dimensions"), stage(packed.sortWithinPartitions("sources"))
    for sources in range(1, widest + 1):
        write_lines(packed.where(F.col("sources") == sources), ["sample_id", "slot"],
                    f"{folder}/dimension_chain.dat.{sources}", written=True)
    return folder


def dimension_stack(spark, sf_dir):
    """Orders with k distinct line numbers go to the file with suffix k, and are stacked again."""
    present = F.filter("entries", lambda e: F.get(e, 0).isNotNull())
    packed = line_number_chain(spark, sf_dir).staged().frame.select(
        "sample_id", F.size(present).alias("sources"), F.posexplode(present).alias("slot", "values"))
    folder = write_dimension_files(spark, packed, 7)
    return load_samples_by_dimension(spark, folder, burn=5, thin=2, num_params_per_source=3).long_columns()


def load_product_space(spark, sf_dir):
    """The layout told by the column count; missing entries filled."""
    path = scratch(spark, "product-space")
    write_lines(order_vectors(spark, sf_dir, 5), ["sample_id"], path)
    return load_samples(spark, path, 2, fill_value=-1.0, burn=10, thin=4).long_columns()


def load_fixed(spark, sf_dir):
    """Two sources of three parameters, which only the fixed layout fits."""
    path = scratch(spark, "fixed")
    write_lines(order_vectors(spark, sf_dir, 4), ["sample_id"], path)
    return load_samples(spark, path, 3, burn=10, thin=4).long_columns()


def load_dimension_folder(spark, sf_dir):
    """Sources of eight parameters; widths of up to eight samples left out, missing entries filled.

    Sample = part, source = one of its order lines; parts with more lines have a higher width.
    """
    cents = [hundredths(c) / 100.0 for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    values = [*cents, F.col("l_linenumber") + 0.0, F.col("l_suppkey") + 0.0, F.col("l_orderkey") + 0.0, F.col("l_partkey") + 0.0]
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.sort_array(F.collect_list(F.array(*values))).alias("all"))
    packed = lines.select("sample_id", F.size("all").alias("sources"), F.posexplode("all").alias("slot", "values"))
    widest = packed.agg(F.max("sources")).first()[0] or 0
    folder = write_dimension_files(spark, packed, widest)
    return load_samples(spark, folder, 8, fill_value=-1.0, burn=3, thin=2, remove_low_numbers=True).long_columns()


def relabel_chain_once(spark, sf_dir):
    """One step on the chain object: the new order, with the cost it recorded."""
    chain = return_flag_chain(spark, sf_dir).staged()
    model = mv_normal_model()
    step = relabel_posterior_chain_one_iteration(chain, *fitted(chain, model), model)
    return step.long_columns().withColumn("cost", F.round(F.lit(step.cost_by_width[3]), DIGITS))


def cost_matrix_narrow(spark, sf_dir):
    """The scores of one distribution, by a function made for its model."""
    chain = discounted_chain(spark, sf_dir).staged()
    model = mv_normal_model()
    scores = create_compute_cost_matrix(model)(chain, *fitted(chain, model), 1)
    return scores.select("sample_id", "label", "slot", rounded("score", "score"))


def feather_roundtrip(spark, sf_dir):
    path = scratch(spark, "feather")
    line_number_chain(spark, sf_dir).to_feather(path)
    return PosteriorChain.read_feather(spark, path).long_columns()


def parquet_roundtrip(spark, sf_dir):
    path = scratch(spark, "parquet")
    line_number_chain(spark, sf_dir).to_parquet(path)
    return PosteriorChain.read_parquet(spark, path).long_columns()


# ---- index helpers ------------------------------------------------------------------------


def fill_missing_indices_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id"))
    given = lines.agg(F.sort_array(F.collect_set(F.col("l_linenumber") - 1)).alias("given"))
    filled = fill_missing_indices(7, F.col("given"))
    return given.select("sample_id", F.array_join(filled.cast("array<string>"), ",").alias("filled"))


def count_swaps_query(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", count_swaps(F.col("embedding")).alias("swaps"))


def sort_by_number_query(spark, sf_dir):
    name = F.concat(F.lit("chain.dat."), F.col("p_partkey"))
    files = sort_by_number(table(spark, sf_dir, "part").select(name.alias("file")), "file")
    return files.select("file", file_number(F.col("file")).alias("number"))


QUERIES: dict[str, Query] = {
    "chain_long": chain_long,
    "chain_wide_flat": chain_wide_flat,
    "chain_shape": chain_shape,
    "burn_thin": burn_thin,
    "expand_slots": expand_slots,
    "slot_projection": slot_projection,
    "complete_rows": complete_rows,
    "parameter_rows": parameter_rows,
    "randomize_entries": randomize_entries,
    "reorder_entries": reorder_entries,
    "inclusion_prob": inclusion_prob,
    "inclusion_prob_narrow": inclusion_prob_narrow,
    "inclusion_prob_expanded": inclusion_prob_expanded,
    "uni_fit": uni_fit,
    "uni_fit_fallback": uni_fit_fallback,
    "mv_fit": mv_fit,
    "mv_fit_fallback": mv_fit_fallback,
    "mv_fit_partial": mv_fit_partial,
    "mv_fit_wide": mv_fit_wide,
    "fit_and_prob": fit_and_prob,
    "uni_logpdf": density_query(return_flag_chain, uni_normal_model(1)),
    "mv_logpdf": density_query(return_flag_chain, mv_normal_model()),
    "mv_logpdf_partial": density_query(discounted_chain, mv_normal_model()),
    "mv_logpdf_wide": density_query(embedding_chain, mv_normal_model()),
    "uni_cost_matrix": cost_query(return_flag_chain, uni_normal_model(1)),
    "mv_cost_matrix": cost_query(return_flag_chain, mv_normal_model()),
    "mv_cost_matrix_s7": cost_query(line_number_chain, mv_normal_model()),
    "assign_s2": assignment_query(line_status_chain, mv_normal_model()),
    "assign_s3": assignment_query(return_flag_chain, mv_normal_model()),
    "assign_s3_uni": assignment_query(return_flag_chain, uni_normal_model(1)),
    "assign_s7": assignment_query(line_number_chain, mv_normal_model()),
    "assign_s10": assignment_query(part_chain, mv_normal_model()),
    "relabel_once": relabel_once,
    "mean_cost": mean_cost,
    "relabel_uni_k3": relabel_uni_k3,
    "relabel_mv_k3": relabel_mv_k3,
    "relabel_mv_trace": relabel_mv_trace,
    "robust_fit": robust_fit,
    "assign_s7_robust": assignment_query(line_number_chain, robust_model()),
    "relabel_robust_k3": relabel_robust_k3,
    "flag_catalog_k5": flag_catalog_k5,
    "make_catalog": make_catalog,
    "source_track": source_track,
    "sources_by_presence": sources_by_presence,
    "catalog_of_line_numbers": catalog_of_line_numbers,
    "line_number_sources": line_number_sources,
    "catalog_to_fixed_layout": catalog_to_fixed_layout,
    "catalog_of_amounts": catalog_of_amounts,
    "product_space_decode": product_space_decode,
    "fixed_decode": fixed_decode,
    "product_space_text": product_space_text,
    "fixed_text": fixed_text,
    "dimension_stack": dimension_stack,
    "load_product_space": load_product_space,
    "load_fixed": load_fixed,
    "load_dimension_folder": load_dimension_folder,
    "relabel_chain_once": relabel_chain_once,
    "cost_matrix_narrow": cost_matrix_narrow,
    "feather_roundtrip": feather_roundtrip,
    "parquet_roundtrip": parquet_roundtrip,
    "fill_missing_indices": fill_missing_indices_query,
    "count_swaps": count_swaps_query,
    "sort_by_number": sort_by_number_query,
}
