"""History search, current state from logs, evidence and audit joins (F*, J*, W*, T*, U*, A11 to A17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.session import staged
from millspark.functions.keyed import exact_rank_values, first_by, latest_by, order_key, previous_row, row_position


def contains_text(column: str, wanted: str) -> Column:
    """Case-insensitive substring; wildcards have no meaning."""
    return F.contains(F.lower(F.col(column)), F.lit(wanted.strip().lower()))


# ---- current state ---------------------------------------------------------------------------------------

def latest_runs(runs: DataFrame, by: str = "id") -> DataFrame:
    """Latest run of each certificate: by "id" (reports) or by "created_at" and then id (search)."""
    return latest_by(runs, ["certificate_id"], ["run_id"] if by == "id" else ["created_at", "run_id"])


def parent_runs(runs: DataFrame) -> DataFrame:
    """Adds chained_parent_id, the previous run of the certificate."""
    out = previous_row(runs, ["certificate_id"], ["run_id"], ["run_id"], alias="_p")
    return out.withColumn("chained_parent_id", F.col("_p.run_id")).drop("_p")


def chain_revisions(certificates: DataFrame) -> DataFrame:
    """Adds revision_number and supersedes_id per (manufacturer, certificate number); unnumbered ones stay first."""
    keys = ["manufacturer_id", "certificate_no"]
    complete = F.expr("manufacturer_id is not null and certificate_no is not null")
    chained = previous_row(certificates.filter(complete), keys, ["certificate_id"], ["certificate_id"], alias="_p")
    numbered = row_position(chained, keys, ["certificate_id"], "revision_number").withColumn("supersedes_id", F.col("_p.certificate_id")).drop("_p")
    rest = certificates.filter(~complete).withColumns({"revision_number": F.lit(1).cast("bigint"), "supersedes_id": F.lit(None).cast("bigint")})
    return numbered.unionByName(rest)


def selection_states(selections: DataFrame, result: str = "result_id", order: Sequence[str] = ("selection_id",)) -> DataFrame:
    """Per result: ``active``, its newest selection that no other supersedes (a struct, or null), and ``cleared``, whether one was.

    A selection and the mark of the one it supersedes are rows of one grouping within their result, so that selections which
    are already together by result (after a join) are not moved again; in others a result is spread over its selections.
    """
    rest = [c for c in selections.columns if c != result]
    mark = F.struct(F.col("supersedes_selection_id").alias("id"), F.lit(None).alias("row"), F.lit(True).alias("replaced"))
    own = F.struct(F.col("selection_id").alias("id"), F.struct(*rest).alias("row"), F.lit(False).alias("replaced"))
    marks = selections.filter(F.col(result).isNotNull()).select(result, F.inline(F.when(F.col("supersedes_selection_id").isNull(), F.array(own)).otherwise(F.array(own, mark))))
    key = lambda column: order_key(*[F.col(f"{column}.{c}") for c in order])
    single = marks.groupBy(result, "id").agg(F.max_by("row", F.when(F.col("row").isNotNull(), key("row"))).alias("row"), F.max("row.selection_cleared").alias("_cleared"), F.max("replaced").alias("replaced"))
    standing = F.when(F.col("row").isNotNull() & ~F.col("replaced"), key("row"))
    return single.groupBy(result).agg(F.max_by("row", standing).alias("active"), F.coalesce(F.max("_cleared"), F.lit(False)).alias("cleared"))


def current_selections(selections: DataFrame, result: str = "result_id", order: Sequence[str] = ("selection_id",)) -> DataFrame:
    """Newest selection of each result that no other supersedes; none where the selection was cleared."""
    return selection_states(selections, result, order).filter("active is not null and not cleared").select(result, "active.*").select(selections.columns)


def latest_approvals(events: DataFrame) -> DataFrame:
    return latest_by(events, ["run_id"], ["event_id"])


def best_evidence(observations: DataFrame) -> DataFrame:
    """Best observation per roll and field: a page first, then a box, then roll scope, then the newest."""
    return latest_by(observations, ["roll_id", "field_path"], [
        F.col("page_number").isNotNull(), F.col("has_box"), F.col("product_id").isNotNull(), "observation_id"])


def first_evidence(products: DataFrame, observations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """First evidence of each roll, else the first of its heat that names no roll; columns of the roll in ``keep`` go along."""
    own = observations.filter("product_id is not null").groupBy("product_id").agg(F.min("observation_id").alias("own"))
    heat = observations.filter("product_id is null and heat_id is not null").groupBy("heat_id").agg(F.min("observation_id").alias("shared"))
    return products.select("product_id", "heat_id", *keep).join(own, "product_id", "left").join(heat, "heat_id", "left").select(
        "product_id", F.coalesce("own", "shared").alias("evidence_id"), *keep)


def scope_rows(products: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows each roll sees: its own and those of its heat without a roll; per key the roll's own wins, then the newest.

    Heat rows are reduced to one per (heat, key) before they meet the rolls of the heat.
    """
    value = [c for c in rows.columns if c not in ("product_id", "heat_id", key)]
    own = rows.filter("product_id is not null").groupBy("product_id", key).agg(F.max_by(F.struct(*value), F.col(order)).alias("own"))
    heat = rows.filter("product_id is null").groupBy("heat_id", key).agg(F.max_by(F.struct(*value), F.col(order)).alias("shared"))
    seen = products.select("product_id", "heat_id").join(heat, "heat_id").select("product_id", key, "shared")
    both = own.join(seen, ["product_id", key], "full_outer").join(products.select("product_id"), "product_id", "left_semi")
    return both.select("product_id", key, F.when(F.col("own").isNotNull(), F.struct(F.lit("product").alias("scope"), *[F.col(f"own.{c}") for c in value])).otherwise(
        F.struct(F.lit("heat").alias("scope"), *[F.col(f"shared.{c}") for c in value])).alias("row")).select("product_id", key, "row.*")


def overlay_observations(products: DataFrame, compositions: DataFrame, observations: DataFrame, columns: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Current observations over stored values; a present null overrides too. Element rows that are new are added.

    A roll sees its own observations and those of its heat that name no roll; per field its own win, then the newest.
    """
    current = observations.filter("is_current").select("product_id", "heat_id", "field_path", "normalized_value", "observation_id")
    newest = scope_rows(products, current, "field_path", "observation_id")
    fields = list(columns)
    wide = newest.filter(F.col("field_path").isin(fields)).groupBy("product_id").agg(*[
        F.max(F.when(F.col("field_path") == f, F.struct("normalized_value"))).alias(f"_o{i}") for i, f in enumerate(fields)])
    df = products.join(wide, "product_id", "left")
    for i, (field, column) in enumerate(columns.items()):
        df = df.withColumn(column, F.when(F.col(f"_o{i}").isNotNull(), F.col(f"_o{i}.normalized_value")).otherwise(F.col(column)).cast(dict(products.dtypes)[column]))
    df = df.select(products.columns)
    elements = newest.filter(F.col("field_path").startswith("composition_pct.")).select(
        "product_id", F.substring_index("field_path", ".", -1).alias("element"), F.struct(F.col("normalized_value").cast("decimal(18,8)").alias("value")).alias("_o"))
    chem = compositions.select("product_id", "element", "percentage").join(elements, ["product_id", "element"], "full_outer").select(
        "product_id", "element", F.when(F.col("_o").isNotNull(), F.col("_o.value")).otherwise(F.col("percentage")).alias("percentage"))
    return df, chem


# ---- search and pages ------------------------------------------------------------------------------------

def search_certificates(certificates: DataFrame, manufacturers: DataFrame, heats: DataFrame, products: DataFrame, runs: DataFrame, results: DataFrame, *,
                        certificate: str | None = None, manufacturer: str | None = None, heat: str | None = None, roll: str | None = None,
                        fraction: str | None = None, nico: str | None = None, approval_status: str | None = None, processing_status: str | None = None,
                        date_from: str | None = None, date_to: str | None = None, date_basis: str = "certificate") -> DataFrame:
    """Certificates that meet every given condition, with sort_date. Roll conditions hold on one and the same roll."""
    df = certificates.filter("not archived").join(manufacturers.select("manufacturer_id", F.col("name").alias("manufacturer")), "manufacturer_id", "left")
    if certificate:
        number = certificate.strip()
        text = F.col("certificate_id").cast("string")
        match = contains_text("certificate_no", number) | (F.lower(F.concat(F.lit("Acta #"), text)) == number.lower()) | (text == number)
        if "original_name" in df.columns:
            match = match | contains_text("original_name", number)
        df = df.filter(match)
    if manufacturer:
        df = df.filter(contains_text("manufacturer", manufacturer))
    if approval_status:
        df = df.filter(F.col("approval_status") == approval_status)
    if processing_status:
        df = df.filter(F.col("processing_status") == processing_status)
    uploaded = F.col("uploaded_at").cast("date")
    basis = uploaded if date_basis == "uploaded" else F.col("certificate_date")
    if date_from:
        df = df.filter(basis >= F.lit(date_from).cast("date"))
    if date_to:
        df = df.filter(basis <= F.lit(date_to).cast("date"))
    if roll or fraction or nico:
        rolls = products.select("product_id", "certificate_id", "heat_no", "product_identifier")
        if heat:
            rolls = rolls.filter(contains_text("heat_no", heat))
        if roll:
            rolls = rolls.filter(contains_text("product_identifier", roll))
        if fraction or nico:
            newest = latest_runs(runs, "created_at").select("run_id")
            hits = results.join(newest, "run_id", "left_semi")
            if fraction:
                hits = hits.filter(F.col("fraction").startswith(fraction.strip().replace(".", "").replace("-", "")))
            if nico:
                hits = hits.filter(F.col("nico") == nico.strip())
            rolls = rolls.join(hits.select("product_id"), "product_id", "left_semi")
        df = df.join(rolls.select("certificate_id"), "certificate_id", "left_semi")
    elif heat:
        df = df.join(heats.filter(contains_text("heat_no", heat)).select("certificate_id"), "certificate_id", "left_semi")
    return df.withColumn("sort_date", uploaded if date_basis == "uploaded" else F.coalesce("certificate_date", uploaded))


def search_heats(heats: DataFrame, certificates: DataFrame, manufacturers: DataFrame, *, heat: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Heats with their certificate; dates compare with the upload date where the certificate has none."""
    df = heats.select("heat_id", "certificate_id", "heat_no").join(certificates, "certificate_id").join(
        manufacturers.select("manufacturer_id", F.col("name").alias("manufacturer")), "manufacturer_id", "left")
    df = df.withColumn("sort_date", F.coalesce("certificate_date", F.col("uploaded_at").cast("date")))
    for wanted, keep in ((heat, lambda: contains_text("heat_no", heat)), (date_from, lambda: F.col("sort_date") >= F.lit(date_from).cast("date")), (date_to, lambda: F.col("sort_date") <= F.lit(date_to).cast("date"))):
        if wanted:
            df = df.filter(keep())
    return df


def search_products(products: DataFrame, certificates: DataFrame, heats: DataFrame, runs: DataFrame, results: DataFrame, *, roll: str | None = None, fraction: str | None = None, nico: str | None = None) -> DataFrame:
    """Rolls with certificate and heat; a code condition asks for any approved run, unlike the certificate search."""
    df = products.join(certificates.select("certificate_id", "certificate_no", "certificate_date", "uploaded_at"), "certificate_id").join(
        heats.select("heat_id", F.col("standard").alias("heat_standard")), "heat_id", "left")
    if roll:
        df = df.filter(contains_text("product_identifier", roll))
    if fraction or nico:
        hits = results.join(runs.filter("approval_status = 'approved'").select("run_id"), "run_id", "left_semi")
        if fraction:
            hits = hits.filter(F.col("fraction").startswith(fraction.strip().replace(".", "").replace("-", "")))
        if nico:
            hits = hits.filter(F.col("nico") == nico.strip())
        df = df.join(hits.select("product_id"), "product_id", "left_semi")
    return df.withColumn("sort_date", F.coalesce("certificate_date", F.col("uploaded_at").cast("date")))


def page_after(df: DataFrame, date: str, key: str, size: int, after: tuple[str, int] | None = None) -> DataFrame:
    """One page, newest first, after a (date, id) cursor; has_more tells whether another page follows."""
    if after:
        df = df.filter(F.struct(F.col(date), F.col(key)) < F.struct(F.lit(after[0]).cast("date"), F.lit(after[1]).cast("bigint")))
    ahead = df.orderBy(F.col(date).desc(), F.col(key).desc()).limit(size + 1)
    place = F.row_number().over(Window.orderBy(F.col(date).desc(), F.col(key).desc()))  # at most size + 1 rows
    return ahead.withColumn("place", place).withColumn("has_more", F.max("place").over(Window.partitionBy()) > size).filter(F.col("place") <= size)


# ---- joins, checks, summaries ----------------------------------------------------------------------------

def missing_results(products: DataFrame, results: DataFrame) -> DataFrame:
    return products.join(results.select("product_id"), "product_id", "left_anti")


def set_equality(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: members only on the left, only on the right, and whether both sets are equal."""
    a = left.select(group, key).distinct().withColumn("_a", F.lit(1))
    b = right.select(group, key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, [group, key], "full_outer").groupBy(group).agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right")).withColumn(
        "equal", F.expr("only_left = 0 and only_right = 0"))


def run_detail(results: DataFrame, candidates: DataFrame, factors: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Results with nested candidates and factors; with ``links`` also how many cite each factor, as ``evidence``.

    Candidates per result and factors per candidate are few. Counting moves every factor once more, so it is done on request only.
    """
    shown = ["sequence", "rule_code", "outcome"]
    if links is not None:
        counts = links.groupBy("factor_id").agg(F.count("*").alias("evidence"))
        factors = factors.join(counts, "factor_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
        shown.append("evidence")
    f = factors.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("factors"))
    c = candidates.join(f, "candidate_id", "left").groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("rank", "fraction", "nico", "factors"))).alias("candidates"))
    return results.join(c, "result_id", "left")


def resolve_evidence(links: DataFrame, observations: DataFrame, certificates: DataFrame) -> DataFrame:
    """Evidence links with their observation and certificate, and where to show it: focus, full_page or original_file."""
    df = links.join(observations, "observation_id").join(certificates.select("certificate_id", "document_id"), "certificate_id")
    return df.withColumn("view", F.when(F.col("page_number").isNull(), "original_file").when(F.col("has_box"), "focus").otherwise("full_page"))


def rule_references(steps: DataFrame, catalog: DataFrame, alloy_evidence: DataFrame) -> DataFrame:
    """Steps with catalogue page and code; alloy rules with the union of their element boxes and their texts."""
    single = catalog.groupBy("code").agg(F.count("*").alias("_n"), F.first("page").alias("page")).filter("_n = 1").select("code", "page")
    df = steps.withColumn("code", F.concat("fraction", F.coalesce("nico", F.lit(""))))
    df = df.join(single, "code", "left")
    boxes = df.select("step_id", F.explode("elements").alias("element")).join(alloy_evidence, "element").groupBy("step_id").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("text"))
    return df.join(boxes, "step_id", "left")


def rules_by_observation(links: DataFrame, factors: DataFrame) -> DataFrame:
    """Distinct rules that cite each observation. Rules are few; they are made distinct before they are listed."""
    pairs = links.join(factors.select("factor_id", "rule_code"), "factor_id").select("observation_id", "rule_code").distinct()
    return pairs.groupBy("observation_id").agg(F.array_join(F.array_sort(F.collect_list("rule_code")), "; ").alias("rules"))


def report_summary(certificates: DataFrame, heats: DataFrame, products: DataFrame, results: DataFrame, selections: DataFrame, runs: DataFrame, manufacturers: DataFrame) -> DataFrame:
    """Summary lines (concept, detail). Makers are one line each instead of one unbounded cell."""
    spark = certificates.sparkSession
    def line(df: DataFrame, concept: str, condition: str | None = None) -> DataFrame:
        return (df.filter(condition) if condition else df).agg(F.count("*").cast("string").alias("detail")).select(F.lit(concept).alias("concept"), "detail")
    parts = [line(certificates, "Actas incluidas"), line(heats, "Batches incluidos"), line(products, "Coladas incluidas"),
             line(results, "Clasificaciones incluidas"), line(selections, "Selecciones registradas"),
             line(certificates, "Actas aprobadas", "approval_status = 'approved'"), line(runs, "Ejecuciones aprobadas", "approval_status = 'approved'")]
    makers = certificates.join(manufacturers.select("manufacturer_id", "name"), "manufacturer_id", "left").select(
        F.lit("Proveedor / fabricante").alias("concept"), F.coalesce("name", F.lit("No disponible")).alias("detail")).distinct()
    out = makers
    for part in parts:
        out = out.unionByName(part)
    return out


def run_summary(results: DataFrame) -> DataFrame:
    """Per run: classified rolls, all rolls, and whether the run is complete."""
    return results.groupBy("run_id").agg(F.count_if(F.col("outcome") == "classified").alias("classified"), F.count("*").alias("total")).withColumn(
        "complete", F.col("classified") == F.col("total"))


def latency_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Sample count, median, nearest-rank p95 and maximum per group, exact and without sorting a group in one task."""
    n = F.col("n")
    df = exact_rank_values(samples, group, value, {
        "low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.ceil(n * 95 / 100), "maximum": n})
    return df.select(group, "n", ((F.col("low") + F.col("high")) * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(28,9)").alias("median"), "p95", "maximum")


def next_sequence(df: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*group).agg((F.max(column) + 1).alias("next_value"))


def format_activation(tests: DataFrame, anchors: DataFrame) -> DataFrame:
    """Template versions with at least two anchors and three distinct documents with reviewed successful tests."""
    good = tests.filter("reviewed and status = 'success'").groupBy("version_id").agg(F.countDistinct("document_id").alias("documents"))
    marks = anchors.groupBy("version_id").agg(F.countDistinct("anchor_text").alias("anchors"))
    return marks.join(good, "version_id", "left").fillna(0, ["documents"]).withColumn("eligible", F.expr("anchors >= 2 and documents >= 3"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def retention_plan(log: DataFrame, keep: Mapping[str, int]) -> DataFrame:
    """Keep or expire per backup. The kept ones are a fixed number per kind; ranking stops there on the map side."""
    limits = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in keep.items() for x in pair]), F.col("kind")), F.lit(0))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("created_at").desc(), F.col("backup_id").desc()))
    kept = log.withColumn("_n", place).filter(F.col("_n") <= max(keep.values())).filter(F.col("_n") <= limits).select("backup_id", F.lit("keep").alias("_keep"))
    return log.join(F.broadcast(kept), "backup_id", "left").withColumn("decision", F.coalesce("_keep", F.lit("expire"))).drop("_keep")


def resolve_scope(certificates: DataFrame, by_certificate: DataFrame, by_heat: DataFrame, by_run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct requested certificates that exist, and the requested ids that do not."""
    wanted = by_certificate.select("certificate_id").union(by_heat.select("certificate_id")).union(by_run.select("certificate_id")).distinct()
    known = certificates.select("certificate_id")
    return wanted.join(known, "certificate_id", "left_semi"), wanted.join(known, "certificate_id", "left_anti")


def diff_rule_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified rules between two versions; removal and modification are breaking."""
    a = old.select("rule", F.col("definition").alias("old_definition"))
    b = new.select("rule", F.col("definition").alias("new_definition"))
    df = a.join(b, "rule", "full_outer").withColumn("change", F.when(F.col("old_definition").isNull(), "added").when(F.col("new_definition").isNull(), "removed").when(
        F.col("old_definition") != F.col("new_definition"), "modified"))
    return df.filter("change is not null").withColumn("breaking", F.col("change") != "added")


def within_scope(rows: DataFrame, certificates: DataFrame, heats: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of the certificates in scope: by the roll a row names, else by its heat, else by its certificate.

    Those of ``product_id, heat_id, certificate_id`` that ``rows`` lacks are added as null; a row without any is out of scope.
    """
    links = ("product_id", "heat_id", "certificate_id")
    rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in links if c not in rows.columns})
    kinds = (("product_id", products, "product_id is not null"), ("heat_id", heats, "product_id is null and heat_id is not null"),
             ("certificate_id", certificates, "product_id is null and heat_id is null"))
    parts = [rows.filter(own).join(scope.select(key), key, "left_semi").select(rows.columns) for key, scope, own in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def deletion_scope(certificates: DataFrame, heats: DataFrame, products: DataFrame, observations: DataFrame, ids: DataFrame, related: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(table, id) of everything reachable from the given certificates; a file other certificates use stays.

    ``related`` holds the tables of the classification chain and the logs that there are: runs, results, candidates, factors,
    steps, links (of a factor, step or observation), selections, approvals, corrections. Others are not looked at.
    """
    doomed = certificates.join(ids, "certificate_id", "left_semi")
    h = heats.join(ids, "certificate_id", "left_semi")
    p = products.join(ids, "certificate_id", "left_semi")
    found = {"certificates": doomed.select("certificate_id"), "heats": h.select("heat_id"), "products": p.select("product_id"),
             "observations": within_scope(observations, doomed, h, p).select("observation_id")}
    survivors = certificates.join(ids, "certificate_id", "left_anti").select("stored_file_id")
    found["files"] = doomed.select("stored_file_id").distinct().join(survivors, "stored_file_id", "left_anti")
    related = related or {}
    if "corrections" in related:
        found["corrections"] = within_scope(related["corrections"], doomed, h, p).select("correction_id")
    # Parents stand before their children; those that children are looked up in are written, so that the chain is followed once.
    for name, id_column, parent in (("runs", "run_id", "certificates"), ("results", "result_id", "runs"), ("candidates", "candidate_id", "results"), ("factors", "factor_id", "candidates"),
                                    ("steps", "step_id", "results"), ("selections", "selection_id", "results"), ("approvals", "event_id", "runs")):
        if name in related:
            rows = related[name].join(found[parent], found[parent].columns[0], "left_semi").select(id_column)
            found[name] = staged(rows) if name in ("runs", "results", "candidates", "factors", "steps") else rows
    if "links" in related:
        links = related["links"]
        parts = [links.join(found[parent], found[parent].columns[0], "left_semi").select("link_id") for parent in ("factors", "steps", "observations")
                 if parent in found and found[parent].columns[0] in links.columns]
        found["links"] = reduce(DataFrame.union, parts).distinct()
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("table_name"), F.col(rows.columns[0]).alias("id")) for name, rows in found.items()])


# Table, its key, and each column that refers to another table. Parents stand before their children.
REFERENCES = (
    ("documents", "document_id", (("document_id", "certificates"),)), ("heats", "heat_id", (("certificate_id", "certificates"),)), ("products", "product_id", (("certificate_id", "certificates"), ("heat_id", "heats"))),
    ("observations", "observation_id", (("certificate_id", "certificates"), ("heat_id", "heats"), ("product_id", "products"))), ("compositions", "composition_id", (("heat_id", "heats"), ("product_id", "products"))),
    ("extraction_runs", "extraction_run_id", (("document_id", "documents"),)), ("runs", "run_id", (("certificate_id", "certificates"),)), ("results", "result_id", (("run_id", "runs"),)),
    ("candidates", "candidate_id", (("result_id", "results"),)), ("factors", "factor_id", (("candidate_id", "candidates"),)), ("steps", "step_id", (("result_id", "results"),)),
    ("links", "link_id", (("factor_id", "factors"), ("step_id", "steps"), ("observation_id", "observations"))), ("selections", "selection_id", (("result_id", "results"),)), ("approvals", "event_id", (("run_id", "runs"),)),
    ("corrections", "correction_id", (("observation_id", "observations"),)), ("export_scopes", "export_id", (("certificate_id", "certificates"), ("heat_id", "heats"), ("run_id", "runs"))),
    ("exports", "export_id", (("export_id", "export_scopes"), ("run_id", "runs"))), ("jobs", "job_id", (("document_id", "documents"), ("export_id", "exports"))),
)


def reachable(roots: DataFrame, tables: Mapping[str, DataFrame], references: Sequence[tuple[str, str, Sequence[tuple[str, str]]]] = REFERENCES) -> dict[str, DataFrame]:
    """Keys of every row that refers to a root row, directly or through others, by the graph of references.

    ``roots`` holds whole certificate rows. A document is reached from its certificate, the other way round than the rest,
    so ``certificates`` counts as found with all its columns. A table or column that is absent is passed over; a row with
    several references is reached by any. The loop runs over the schema, not over data.
    """
    found = {"certificates": roots}
    for name, key, parents in references:
        if name not in tables:
            continue
        rows = tables[name]
        parts = [rows.join(found[parent].select(column).filter(F.col(column).isNotNull()).distinct(), column, "left_semi").select(key)
                 for column, parent in parents if parent in found and column in rows.columns and column in found[parent].columns]
        if parts:
            found[name] = staged(reduce(DataFrame.unionByName, parts).distinct())
    return found


def deletion_closure(certificates: DataFrame, ids: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, id) of all rows that go with the given certificates; a file stays while another document or export uses it.

    A running job or export of the closure is listed once more under ``in_use``: nothing may be deleted then.
    """
    roots = certificates.join(ids, "certificate_id", "left_semi")
    found = reachable(roots, tables)
    users = [tables[name].select("stored_file_id", F.col(key).alias("id"), F.lit(name).alias("name")) for name, key in (("documents", "document_id"), ("exports", "export_id")) if name in tables and "stored_file_id" in tables[name].columns]
    parts = [rows.select(F.lit(name).alias("table_name"), F.col(rows.columns[0] if name != "certificates" else "certificate_id").alias("id")) for name, rows in found.items() if name != "export_scopes"]
    if users:
        gone = reduce(DataFrame.unionByName, [found[name].select(F.col(key).alias("id"), F.lit(name).alias("name")) for name, key in (("documents", "document_id"), ("exports", "export_id")) if name in found])
        uses = reduce(DataFrame.unionByName, users).filter("stored_file_id is not null").join(gone.withColumn("gone", F.lit(1)), ["name", "id"], "left")
        free = uses.groupBy("stored_file_id").agg(F.count_if(F.col("gone").isNull()).alias("left")).filter(F.col("left") == 0)
        parts.append(free.select(F.lit("files").alias("table_name"), F.col("stored_file_id").alias("id")))
    for name, key in (("jobs", "job_id"), ("exports", "export_id")):
        if name in found and "status" in tables[name].columns:
            running = tables[name].filter("status = 'running'").join(found[name], key, "left_semi")
            parts.append(running.select(F.lit("in_use").alias("table_name"), F.col(key).alias("id")))
    return reduce(DataFrame.unionByName, parts)


def volume_rows(certificates: DataFrame, heats: int) -> DataFrame:
    """``heats`` numbered heats for every given certificate; ids follow the certificate's."""
    numbered = certificates.select("certificate_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(heats).cast("bigint"))).alias("heat_number"))
    return numbered.withColumn("heat_id", F.col("certificate_id") * heats + F.col("heat_number"))
