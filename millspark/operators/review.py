"""Review history: corrections, approvals and selections folded into current state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.functions.keyed import latest_by, row_position

# --- fixed values: fields a person may enter, and allowed approval changes ---
MANUAL_FIELDS = (
    "coiled", "rolling", "width_mm", "thickness_mm", "coated", "coating.metal", "coating.process", "coating.superior_g_m2", "coating.inferior_g_m2",
    "mechanical_properties.yield_strength_mpa", "pickled", "pattern_in_relief", "porcelain_exposed_parts", "pipeline_steel", "high_speed_steel",
    "tool_steel", "stainless_series", "form",
)
TRANSITIONS = {
    "draft": ("draft", "needs_review", "approved", "rejected"), "needs_review": ("draft", "approved", "rejected"),
    "rejected": ("draft", "needs_review", "approved"), "approved": ("rejected",),
}
BOOLEAN_FIELDS = ("coiled", "coated", "pickled", "pattern_in_relief", "porcelain_exposed_parts", "pipeline_steel", "high_speed_steel", "tool_steel")
NUMERIC_FIELDS = ("width_mm", "thickness_mm", "mechanical_properties.yield_strength_mpa", "coating.superior_g_m2", "coating.inferior_g_m2")


def validate_values(observations: DataFrame, value: str = "value_text") -> DataFrame:
    """Adds value_error for values a field does not admit; null is always admitted."""
    path, text = F.col("field_path"), F.col(value)
    number = text.try_cast("double")
    chemical = path.startswith("composition_pct.")
    numeric = path.isin(*NUMERIC_FIELDS) | chemical
    error = (F.when(text.isNull(), None)
             .when(path.isin(*BOOLEAN_FIELDS), F.when(~text.isin("true", "false"), "boolean_required"))
             .when(path == "rolling", F.when(~text.isin("hot", "cold"), "rolling_required"))
             .when(path == "stainless_series", F.when(~text.isin("200", "300", "400", "other"), "series_required"))
             .when(numeric, F.when(number.isNull(), "number_required").when(F.isnan(number) | (F.abs(number) == float("inf")), "finite_required")
                   .when(number < 0, "negative").when(chemical & (number > 100), "over_100")))
    return observations.withColumn("value_error", error)


def manual_field_allowed(path: Column) -> Column:
    return path.isin(*MANUAL_FIELDS) | path.rlike(r"^composition_pct\.[A-Za-z][A-Za-z0-9_]{0,49}$")


def apply_corrections(observations: DataFrame, log: DataFrame) -> DataFrame:
    """Observations after a log of corrections: corrected ones stop being current, replacements are appended.

    Only the first correction of a current observation counts, as later ones meet a superseded row.
    """
    first = log.groupBy("previous_observation_id").agg(F.min_by(F.struct("replacement_id", "normalized_value"), "replacement_id").alias("c"))
    hit = observations.join(first, observations["observation_id"] == first["previous_observation_id"], "left")
    applied = F.col("is_current") & F.col("c").isNotNull()
    columns = ["observation_id", "product_id", "field_path", "normalized_value", "confidence", "source_text", "supersedes_id", "is_current"]
    old = hit.withColumn("is_current", F.col("is_current") & ~F.coalesce(applied, F.lit(False))).select(*columns)
    new = hit.filter(applied).select(
        F.col("c.replacement_id").alias("observation_id"), "product_id", "field_path", F.col("c.normalized_value").alias("normalized_value"),
        F.lit(1.0).cast(dict(observations.dtypes)["confidence"]).alias("confidence"), F.lit("correccion_manual").alias("source_text"),
        F.col("observation_id").alias("supersedes_id"), F.lit(True).alias("is_current"))
    return old.unionByName(new)


def accept_manual(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Adds decision to manual observations: accepted, or why not."""
    scope = ["product_id", "heat_id", "field_path"]
    existing = current.filter("is_current").select(*scope).distinct().withColumn("_exists", F.lit(True))
    on = [rows[c].eqNullSafe(existing[c]) for c in scope]
    df = rows.join(existing, on, "left").select(rows["*"], existing["_exists"])
    return df.withColumn("decision", F.when(~manual_field_allowed(F.col("field_path")), "manual_field_not_allowed").when(
        F.col("product_id").isNull() & F.col("heat_id").isNull(), "observation_scope_required").when(F.col("_exists"), "observation_already_exists").otherwise("accepted")).drop("_exists")


def accept_proposals(observations: DataFrame) -> DataFrame:
    """Adds outcome of accepting a verification proposal: only a discrepancy replaces the value, with its cited source."""
    ok = F.col("verification_status") == "discrepancy"
    return observations.withColumns({
        "outcome": F.when(ok, "replaced").otherwise("verification_unavailable"),
        "accepted_value": F.when(ok, F.col("proposed_value")), "accepted_source": F.when(ok, F.concat_ws(" | ", "proposed_source", "proposed_header"))})


CHUNK = 4096


def replay_approvals(events: DataFrame, initial: str = "needs_review") -> DataFrame:
    """Events with the status before each and whether the change was allowed; a refused event changes nothing.

    Each run's events are cut into chunks of at most ``CHUNK``. A chunk first tells which status it ends in for each
    of the four it may start in; those small summaries give every chunk its start, and then each chunk is replayed.
    """
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    move = lambda status, e: F.when(F.array_contains(F.element_at(allowed, status), e["to_status"]), e["to_status"]).otherwise(status)
    placed = row_position(events, ["run_id"], ["event_id"], "_at").withColumn("_chunk", F.floor((F.col("_at") - 1) / CHUNK))
    chunks = placed.groupBy("run_id", "certificate_id", "_chunk").agg(F.array_sort(F.collect_list(F.struct("event_id", "to_status"))).alias("e"))
    ends = F.create_map(*[x for s in TRANSITIONS for x in (F.lit(s), F.aggregate("e", F.lit(s), move))])
    chain = chunks.select("run_id", "_chunk", ends.alias("ends")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("_chunk", F.map_entries("ends").alias("ends")))).alias("c"))
    begin = F.struct(F.lit(initial).alias("status"), F.array().cast("array<struct<_chunk:bigint,start:string>>").alias("starts"))
    walk = lambda acc, c: F.struct(F.element_at(F.map_from_entries(c["ends"]), acc["status"]).alias("status"), F.concat(acc["starts"], F.array(F.struct(
        c["_chunk"].cast("bigint").alias("_chunk"), acc["status"].alias("start")))).alias("starts"))
    starts = chain.select("run_id", F.explode(F.aggregate("c", begin, walk, lambda acc: acc["starts"])).alias("s")).select("run_id", "s._chunk", "s.start")
    def step(acc: Column, e: Column) -> Column:
        valid = F.array_contains(F.element_at(allowed, acc["status"]), e["to_status"])
        return F.struct(F.when(valid, e["to_status"]).otherwise(acc["status"]).alias("status"), F.concat(acc["done"], F.array(F.struct(
            e["event_id"].alias("event_id"), acc["status"].alias("from_status"), e["to_status"].alias("to_status"), valid.alias("valid")))).alias("done"))
    done = F.array().cast("array<struct<event_id:bigint,from_status:string,to_status:string,valid:boolean>>").alias("done")
    replayed = F.aggregate("e", F.struct(F.col("start").alias("status"), done), step, lambda acc: acc["done"])
    return chunks.join(starts, ["run_id", "_chunk"]).select("run_id", "certificate_id", F.explode(replayed).alias("x")).select("run_id", "certificate_id", "x.*")


def status_after_replay(replayed: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of each certificate: that of its latest run after the last allowed event."""
    newest = runs.groupBy("certificate_id").agg(F.max("run_id").alias("run_id"))
    last = latest_by(replayed.filter("valid").select("run_id", "event_id", "to_status"), ["run_id"], ["event_id"])
    return newest.join(last, "run_id", "left").select("certificate_id", "run_id", F.coalesce("to_status", F.lit("needs_review")).alias("status"))


def blocking_candidates(candidates: DataFrame, factors: DataFrame) -> DataFrame:
    bad = factors.filter("required_for_selection and outcome in ('not_matched', 'conflict')").select("candidate_id")
    flagged = candidates.filter("has_conflicts").select("candidate_id")
    return bad.union(flagged).distinct()


def approval_eligibility(runs: DataFrame, products: DataFrame, heats: DataFrame, results: DataFrame, selections: DataFrame, current: DataFrame, blocked: DataFrame) -> DataFrame:
    """Per run: reasons that forbid approval, from its rolls, heats, results and chosen options.

    The rolls of the certificate and those with a result are compared as sets: a missing, foreign or doubled roll differs.
    """
    expected = runs.select("run_id", "certificate_id").join(products.select("certificate_id", "product_id"), "certificate_id").select("run_id", "product_id", F.lit(1).alias("_want"))
    held = results.groupBy("run_id", "product_id").agg(F.count("*").alias("_held"))
    p = expected.join(held, ["run_id", "product_id"], "full_outer").groupBy("run_id").agg(F.count_if(F.expr("_want is null or coalesce(_held, 0) <> 1")).alias("n_differ"))
    bare = heats.join(products.select("heat_id").distinct(), "heat_id", "left_anti").groupBy("certificate_id").agg(F.count("*").alias("bare_heats"))
    chosen = selections.select("result_id").distinct().withColumn("_s", F.lit(1))
    bad = current.join(blocked, "candidate_id", "left_semi").select("result_id").distinct().withColumn("_b", F.lit(1))
    r = results.join(chosen, "result_id", "left").join(bad, "result_id", "left").groupBy("run_id").agg(
        F.count("*").alias("n_results"), F.count_if(F.col("_s").isNull()).alias("unselected"),
        F.count_if(F.expr("outcome <> 'classified' or fraction is null or nico is null")).alias("unresolved"), F.count_if(F.col("_b").isNotNull()).alias("blocked"))
    df = runs.select("run_id", "certificate_id").join(r, "run_id", "left").join(p, "run_id", "left").join(bare, "certificate_id", "left").fillna(0)
    return df.withColumn("reasons", F.expr("""array_join(array_compact(array(if(n_results = 0, 'no_results', null), if(n_differ > 0, 'products_differ', null),
        if(bare_heats > 0, 'heat_without_product', null), if(unselected > 0, 'selection_missing', null), if(unresolved > 0, 'unresolved_result', null), if(blocked > 0, 'blocked_option', null))), ',')""")).withColumn("eligible", F.col("reasons") == "")


def selection_eligibility(candidates: DataFrame, blocked: DataFrame) -> DataFrame:
    """Adds decision per candidate: blocked, or suggestions that are not one to three with ranks in a row."""
    groups = candidates.filter("not manual").groupBy("result_id").agg(F.count("*").alias("_n"), F.min("rank").alias("_lo"), F.max("rank").alias("_hi"), F.countDistinct("rank").alias("_d"))
    flags = blocked.withColumn("_blocked", F.lit(True))
    df = candidates.join(groups, "result_id", "left").join(flags, "candidate_id", "left")
    ordered = F.coalesce(F.expr("_n between 1 and 3 and _lo = 1 and _hi = _n and _d = _n"), F.lit(False))
    return df.withColumn("decision", F.when(F.col("_blocked"), "candidate_has_conflicts").when(~F.col("manual") & ~ordered, "valid_candidates_required").otherwise("selectable")).drop("_n", "_lo", "_hi", "_d", "_blocked")


def fold_selections(results: DataFrame, current: DataFrame, cleared: DataFrame, candidates: DataFrame) -> DataFrame:
    """Results after the selections: the chosen option's code, or no code where a selection was withdrawn."""
    picked = current.select("result_id", "candidate_id").join(candidates.select("candidate_id", F.col("fraction").alias("_f"), F.col("nico").alias("_n")), "candidate_id").drop("candidate_id")
    gone = cleared.select("result_id").distinct().withColumn("_gone", F.lit(True))
    df = results.join(picked, "result_id", "left").join(gone, "result_id", "left")
    return df.withColumns({
        "fraction": F.when(F.col("_gone"), None).otherwise(F.coalesce("_f", "fraction")), "nico": F.when(F.col("_gone"), None).otherwise(F.coalesce("_n", "nico")),
        "outcome": F.when(F.col("_gone"), "needs_review").when(F.col("_f").isNotNull(), "classified").otherwise(F.col("outcome"))}).drop("_f", "_n", "_gone")


def manual_candidates(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per requested (result, code): an existing pair is reused, a malformed one is refused, new ones follow the last rank.

    New pairs of one result are numbered by code, so that no two share a rank; a pair asked for twice is added once.
    """
    pair = ["result_id", "fraction", "nico"]
    top = candidates.groupBy("result_id").agg(F.max("rank").alias("_top"))
    pairs = candidates.groupBy(*pair).agg(F.min("rank").alias("_same"))
    df = requests.dropDuplicates(pair).join(pairs, pair, "left").join(top, "result_id", "left")
    valid = F.coalesce(F.col("fraction").rlike("^[0-9]{8}$") & F.col("nico").rlike("^[0-9]{2}$"), F.lit(False))
    df = df.withColumn("decision", F.when(~valid, "invalid_tariff_code").when(F.col("_same").isNotNull(), "existing").otherwise("added"))
    place = F.row_number().over(Window.partitionBy("result_id", "decision").orderBy("fraction", "nico"))
    rank = F.when(F.col("decision") == "existing", F.col("_same")).when(F.col("decision") == "added", F.coalesce("_top", F.lit(0)) + place)
    return df.withColumn("rank", rank).drop("_same", "_top")


def archived_flags(events: DataFrame) -> DataFrame:
    return latest_by(events.select("document_id", "archived", "event_id"), ["document_id"], ["event_id"]).select("document_id", "archived")


def pending_review(runs: DataFrame, products: DataFrame, heats: DataFrame, results: DataFrame, selections: DataFrame) -> DataFrame:
    """What is still open per run: (run_id, kind, id) of rolls without a result, heats without a roll, results without a choice."""
    expected = runs.select("run_id", "certificate_id").join(products.select("certificate_id", "product_id"), "certificate_id")
    rolls = expected.join(results.select("run_id", "product_id"), ["run_id", "product_id"], "left_anti").select("run_id", F.lit("product_without_result").alias("kind"), F.col("product_id").alias("id"))
    bare = heats.join(products.select("heat_id").distinct(), "heat_id", "left_anti").select("certificate_id", "heat_id")
    empty = runs.select("run_id", "certificate_id").join(bare, "certificate_id").select("run_id", F.lit("heat_without_product").alias("kind"), F.col("heat_id").alias("id"))
    open_results = results.join(selections.select("result_id").distinct(), "result_id", "left_anti").select("run_id", F.lit("result_without_choice").alias("kind"), F.col("result_id").alias("id"))
    return rolls.unionByName(empty).unionByName(open_results)


def audit_constraints(certificates: DataFrame, heats: DataFrame, products: DataFrame, results: DataFrame, candidates: DataFrame, compositions: DataFrame) -> DataFrame:
    """(table, rule, id) of rows that break a declared check."""
    def broken(df: DataFrame, table: str, rule: str, condition: str, key: str) -> DataFrame:
        return df.filter(condition).select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))
    def repeated(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
        return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(
            F.lit(table).alias("table_name"), F.lit("unique").alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("id"))
    def orphan(df: DataFrame, table: str, parent: DataFrame, key: str, id_column: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti").select(
            F.lit(table).alias("table_name"), F.lit("foreign_key").alias("rule"), F.col(id_column).cast("string").alias("id"))
    parts = [
        broken(results, "results", "fraction_format", "not fraction rlike '^[0-9]{8}$'", "result_id"), broken(results, "results", "nico_format", "not nico rlike '^[0-9]{2}$'", "result_id"),
        broken(results, "results", "outcome_domain", "outcome not in ('classified', 'needs_review', 'out_of_scope')", "result_id"),
        broken(candidates, "candidates", "rank_positive", "rank < 1", "candidate_id"),
        broken(certificates, "certificates", "approval_domain", "approval_status not in ('draft', 'needs_review', 'approved', 'rejected')", "certificate_id"),
        broken(compositions, "compositions", "percentage_range", "percentage < 0 or percentage > 100", "heat_id"),
        broken(compositions, "compositions", "one_scope", "(heat_id is null) = (product_id is null)", "heat_id"),
        repeated(products, "products", ["certificate_id", "product_identifier"]), repeated(heats, "heats", ["certificate_id", "heat_no"]),
        repeated(candidates, "candidates", ["result_id", "rank"]), repeated(candidates, "candidates", ["result_id", "fraction", "nico"]),
        repeated(results, "results", ["run_id", "product_id"]), orphan(products, "products", heats, "heat_id", "product_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
