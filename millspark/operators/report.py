"""The eight outputs of the audit report and its scope gate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from millspark.functions.keyed import latest_by
from millspark.operators import history as h
from millspark.operators.history import within_scope

# --- fixed values: texts of the report ---
NOTICE = "DEMOSTRACIÓN — SIN VALIDEZ ADUANERA"
QUERY_NOTICE = "REPORTE DE CONSULTA — VER ESTADOS DE APROBACIÓN — "
KINDS = {True: "Oficial (sólo expedientes aprobados)", False: "Consulta (estados actuales)"}
READING = "Elegir fracción y NICO no implica aprobación. Sin clasificación se muestra como pendiente. Los datos ausentes permanecen vacíos; no equivalen a cero."
APPROVALS = {"draft": "Borrador", "needs_review": "Pendiente de aprobación", "approved": "Aprobado", "rejected": "Rechazado"}
# Key factors that the classification sheet shows per result.
SHOWN_FACTORS = 4


def _optional(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)


def summary_sheet(summary: DataFrame, runs: DataFrame, official: bool) -> DataFrame:
    """The counted lines after the notice, the kind of report, how to read it, and one line per run."""
    lines = [("Aviso Legal", NOTICE if official else QUERY_NOTICE + NOTICE), ("Tipo de Reporte", KINDS[official]), ("Lectura de estados", READING)]
    fixed = summary.sparkSession.createDataFrame(lines, "concept string, detail string")
    return fixed.unionByName(summary).unionByName(runs.select(F.lit("Ejecución de clasificación").alias("concept"), F.col("run_id").cast("string").alias("detail")))


def check_report_scope(certificates: DataFrame, runs: DataFrame, wanted: DataFrame, official: bool, wanted_runs: DataFrame | None = None) -> DataFrame:
    """(certificate_id, reason) of what keeps the report from being written; empty when it may be.

    An official report needs approved certificates and, for each, its latest run approved; with ``wanted_runs`` (run_id)
    the requested runs of the certificate count instead, and all of them have to be approved.
    """
    rejects = wanted.join(certificates.select("certificate_id"), "certificate_id", "left_anti").select("certificate_id", F.lit("unknown_certificate").alias("reason"))
    if not official:
        return rejects
    scope = certificates.join(wanted, "certificate_id", "left_semi")
    used = h.latest_runs(runs) if wanted_runs is None else runs.join(wanted_runs.select("run_id").distinct(), "run_id", "left_semi")
    states = used.groupBy("certificate_id").agg(F.count_if(~F.coalesce(F.col("approval_status") == "approved", F.lit(False))).alias("open"), F.lit(True).alias("present"))
    df = scope.join(states, "certificate_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("approval_status") != "approved", "certificate_not_approved"), F.when(F.col("present").isNull(), "run_missing"),
                                      F.when(F.col("open") > 0, "run_not_approved")))
    return rejects.unionByName(df.select("certificate_id", F.explode(reasons).alias("reason")))


def check_requested_items(wanted: DataFrame, heats: DataFrame, runs: DataFrame, wanted_heats: DataFrame, wanted_runs: DataFrame) -> DataFrame:
    """(kind, id) of requested heats and runs that belong to none of the wanted certificates."""
    def outside(rows: DataFrame, asked: DataFrame, key: str, kind: str) -> DataFrame:
        known = rows.join(wanted, "certificate_id", "left_semi").select(key)
        return asked.select(key).distinct().join(known, key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return outside(heats, wanted_heats, "heat_id", "heat").unionByName(outside(runs, wanted_runs, "run_id", "run"))


def classification_sheet(products: DataFrame, results: DataFrame, runs: DataFrame, candidates: DataFrame, factors: DataFrame, selections: DataFrame, evidence: DataFrame, rule_sets: DataFrame | None = None) -> DataFrame:
    """One row per result of the given runs, and one per roll without any. Columns that the inputs lack stay empty."""
    versions = runs.select("run_id", F.col("approval_status").alias("run_status"), _optional(runs, "rule_set_id", "bigint").alias("rule_set_id"))
    if rule_sets is not None:
        versions = versions.join(rule_sets.select("rule_set_id", F.col("version").alias("rule_version")), "rule_set_id", "left")
    rows = results.join(versions, "run_id")
    chosen = h.current_selections(selections).select("result_id", F.col("candidate_id").alias("chosen_id"), F.col("person_name").alias("chosen_by"), _optional(selections, "reason").alias("chosen_reason"),
                                                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("chosen_at"))
    # Candidates of a result are few; all are kept, as a person may choose any of them.
    code = F.concat_ws("-", "fraction", "nico")
    option = F.struct("rank", "candidate_id", "fraction", "nico", _optional(candidates, "description").alias("description"))
    options = candidates.groupBy("result_id").agg(F.array_sort(F.collect_list(option)).alias("options")).withColumn(
        "options", F.transform("options", lambda x: x.withField("code", F.concat_ws("-", x["fraction"], x["nico"]))))
    df = rows.join(options, "result_id", "left").join(chosen, "result_id", "left")
    df = df.withColumn("active_id", F.coalesce("chosen_id", F.expr("get(filter(options, x -> x.rank = 1), 0).candidate_id")))
    # Ranked in place of read by number: sequences may have gaps. Only factors of shown candidates are ordered.
    cited = factors.join(df.select(F.col("active_id").alias("candidate_id")).distinct(), "candidate_id", "left_semi")
    order = F.row_number().over(Window.partitionBy("candidate_id").orderBy("sequence", "rule_code"))
    named = cited.withColumn("_n", order).filter(F.col("_n") <= SHOWN_FACTORS).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.concat_ws(": ", "rule_code", "outcome").alias("text")))).alias("f"))
    df = df.join(named.withColumnRenamed("candidate_id", "active_id"), "active_id", "left")
    others = F.expr("filter(options, x -> not (x.candidate_id <=> active_id))")
    picked = F.expr("get(filter(options, x -> x.candidate_id = chosen_id), 0)")
    resolved = F.expr("outcome = 'classified' and fraction is not null and nico is not null")
    by_person = F.col("chosen_id").isNotNull()
    labels = F.create_map(*[F.lit(x) for pair in APPROVALS.items() for x in pair])
    missing = F.array_join(F.col("missing_fields"), ", ") if "missing_fields" in results.columns else F.lit(None).cast("string")
    sheet = df.select(
        "result_id", "run_id", "product_id",
        F.when(by_person, F.coalesce(picked["code"], F.when(F.expr("fraction is not null and nico is not null"), code), F.lit("Seleccionado"))).when(resolved, code).otherwise("Pendiente de selección").alias("candidato_elegido"),
        F.coalesce(F.get(others, F.lit(0))["code"], F.lit("—")).alias("alternativa_2"), F.coalesce(F.get(others, F.lit(1))["code"], F.lit("—")).alias("alternativa_3"),
        F.when(by_person, F.col("chosen_by")).when(resolved, "Motor determinista").otherwise("—").alias("seleccionado_por"),
        F.when(by_person, F.col("chosen_reason")).when(resolved & (F.col("run_status") == "approved"), "Resolución unívoca aprobada").when(resolved, "Resolución unívoca pendiente de aprobación").otherwise("Pendiente de revisión documental").alias("motivo_seleccion"),
        F.when(by_person, F.col("chosen_at")).when(resolved, F.coalesce(_optional(results, "result_created_at"), F.lit("—"))).otherwise("—").alias("fecha_seleccion"),
        F.coalesce(F.expr("array_join(transform(f, x -> x.text), '; ')"), F.lit("Reglas de partida y subpartida")).alias("factores_clave"),
        F.col("outcome").alias("resultado"), F.coalesce(F.nullif(missing, F.lit("")), F.lit("Ninguno")).alias("faltantes"), F.col("run_status").alias("estado_ejecucion"),
        F.coalesce(F.col("rule_version") if rule_sets is not None else F.lit(None), F.lit("—")).alias("reglas_version"),
        F.coalesce(picked["fraction"], F.col("fraction")).alias("fraccion"), F.when(picked.isNotNull(), picked["nico"]).otherwise(F.col("nico")).alias("nico"),
        F.coalesce(F.element_at(labels, F.col("run_status")), F.col("run_status")).alias("aprobacion"), _optional(results, "description").alias("descripcion"), _optional(results, "details").alias("detalles"),
        F.array_join(F.transform("options", lambda x: F.concat(x["code"], F.lit(": "), F.coalesce(x["description"], F.lit("")))), "; ").alias("todos_los_candidatos"))
    pending = h.missing_results(products, rows).select("product_id", F.lit("Sin clasificación").alias("candidato_elegido"), F.lit("Pendiente de clasificación").alias("estado_ejecucion"), F.lit("Pendiente de clasificación").alias("aprobacion"))
    sheet = sheet.unionByName(pending, allowMissingColumns=True)
    known = evidence.select("product_id", F.col("evidence_id").isNotNull().alias("_e"), *[F.col(c).alias("rollo_identificador") for c in evidence.columns if c == "product_identifier"])
    return sheet.join(known, "product_id", "left").withColumn("evidencia", F.when(F.coalesce("_e", F.lit(False)), "Ver evidencia").otherwise("Sin evidencia")).drop("_e")


def audit_timeline(selections: DataFrame, approvals: DataFrame, corrections: DataFrame, results: DataFrame | None = None, runs: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Selections, approvals and corrections as one list with their validity, detail, person, reason and station.

    With results, runs and candidates each event also names its certificate, run and roll, and a selection its code.
    """
    states = h.selection_states(selections.select("result_id", "selection_id", "supersedes_selection_id", "selection_cleared")).select(
        "result_id", F.col("cleared").alias("_gone"), F.when(~F.col("cleared"), F.col("active.selection_id")).alias("_active_id"))
    s = selections.join(states, "result_id", "left").withColumn("_active", F.col("selection_id") == F.col("_active_id"))
    owners = None if runs is None else runs.select("run_id", F.col("certificate_id").alias("_certificate"))
    if results is not None:
        # Results meet their runs first: they are fewer and narrower than the selections.
        placed = results.select("result_id", "run_id", "product_id")
        s = s.join(placed if owners is None else placed.join(owners, "run_id", "left"), "result_id", "left")
    if candidates is not None:
        s = s.join(candidates.select("candidate_id", F.concat_ws("-", "fraction", "nico").alias("_code")), "candidate_id", "left")
    code = F.coalesce(_optional(s, "_code"), F.concat(F.lit("candidato-"), _optional(s, "candidate_id")))
    replaced = F.coalesce(F.concat(F.lit(" (Reemplaza selección #"), F.col("supersedes_selection_id").cast("string"), F.lit(")")), F.lit(""))
    if owners is not None:
        s = s.join(owners, "run_id", "left") if results is None and "run_id" in s.columns else s
        approvals = approvals.join(owners, "run_id", "left")

    def event(df: DataFrame, kind: str, key: str, validity: Column, detail: Column, certificate: str = "_certificate", roll: bool = True) -> DataFrame:
        return df.select(
            F.lit(kind).alias("tipo_evento"), F.col(key).alias("id_evento"), _optional(df, certificate, "bigint").alias("certificate_id"), _optional(df, "run_id", "bigint").alias("run_id"),
            (_optional(df, "product_id", "bigint") if roll else F.lit(None).cast("bigint")).alias("product_id"), detail.alias("detalle"), _optional(df, "person_name").alias("persona"), _optional(df, "reason").alias("motivo"),
            _optional(df, "workstation_name").alias("estacion"), "created_at", validity.alias("vigencia"))

    newest = approvals.groupBy("run_id").agg(F.max("event_id").alias("_newest"))
    a = approvals.join(newest, "run_id")
    arrow = F.concat(F.lit("Cambio de estado: "), F.coalesce(_optional(a, "from_status"), F.lit("")), F.lit(" -> "), F.coalesce(_optional(a, "to_status"), F.lit("")))
    fixed = F.concat(F.lit("Corrección obs "), F.coalesce(_optional(corrections, "previous_observation_id"), F.lit("")), F.lit(" -> "), F.coalesce(_optional(corrections, "replacement_observation_id"), F.lit("")))
    parts = [
        event(s, "SELECCION_CANDIDATO", "selection_id", F.when(F.col("_active"), "Vigente").when(F.col("_gone"), "Retirada").otherwise("Reemplazada"), F.concat(F.lit("Seleccionó "), code, replaced)),
        event(a, "APROBACION_ESTADO", "event_id", F.when(F.col("event_id") == F.col("_newest"), "Vigente").otherwise("Reemplazada"), arrow, roll=False),
        event(corrections, "CORRECCION_DATO", "correction_id", F.when(F.col("replacement_is_current"), "Vigente").otherwise("Reemplazada"), fixed, "certificate_id", False)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def composition_sheet(compositions: DataFrame, products: DataFrame, heats: DataFrame, certificates: DataFrame) -> DataFrame:
    """Element rows in scope with their heat number, through the heat or through the roll's heat.

    As in ``within_scope`` a row belongs to the roll it names, else to its heat, else to its certificate. Each kind meets its
    own table only, so that rows without a roll are not gathered under a null key.
    """
    rows = compositions.withColumns({c: F.lit(None).cast("bigint") for c in ("product_id", "heat_id", "certificate_id") if c not in compositions.columns})
    of = lambda kind, *more: rows.filter(kind).select("product_id", "heat_id", "element", "percentage", *more)
    numbers = heats.select("heat_id", F.col("heat_no").alias("colada"))
    rolls = of("product_id is not null").join(products.select("product_id", F.col("heat_id").alias("_ph"), F.col("product_identifier").alias("serie_rollo")), "product_id")
    rolls = rolls.withColumn("_heat", F.coalesce("heat_id", "_ph")).join(numbers.withColumnRenamed("heat_id", "_heat"), "_heat", "left")
    own = of("product_id is null and heat_id is not null").join(numbers, "heat_id")
    rest = of("product_id is null and heat_id is null", "certificate_id").join(certificates.select("certificate_id"), "certificate_id", "left_semi")
    sheet = ("heat_id", "product_id", "element", "percentage")
    return rolls.select(*sheet, "colada", "serie_rollo").unionByName(own.select(*sheet, "colada"), allowMissingColumns=True).unionByName(rest.select(*sheet), allowMissingColumns=True)


def evidence_sheet(observations: DataFrame, links: DataFrame, factors: DataFrame) -> DataFrame:
    rules = h.rules_by_observation(links, factors)
    return observations.join(rules, "observation_id", "left").withColumn("regla_factor", F.coalesce("rules", F.lit(""))).drop("rules")


def report_tables(t: Mapping[str, DataFrame], official: bool = False) -> dict[str, DataFrame]:
    """Name to table, for the certificates in ``t["certificates"]``; every other input is cut to that scope first.

    Optional ``wanted_heats`` (heat_id) keep rolls, results and rows of those heats only, and ``wanted_runs`` (run_id) take
    the place of the latest runs.
    """
    scope = t["certificates"].select("certificate_id")
    within = lambda df: df.join(scope, "certificate_id", "left_semi")
    heats, products, runs = within(t["heats"]), within(t["products"]), within(t["runs"])
    if "wanted_heats" in t:
        asked = t["wanted_heats"].select("heat_id").distinct()
        heats, products = heats.join(asked, "heat_id", "left_semi"), products.join(asked, "heat_id", "left_semi")
    if "wanted_runs" in t:
        runs = runs.join(t["wanted_runs"].select("run_id").distinct(), "run_id", "left_semi")
    used = runs if "wanted_runs" in t else h.latest_runs(runs)
    results = t["results"].join(used.select("run_id"), "run_id", "left_semi")
    if "wanted_heats" in t:
        results = results.join(products.select("product_id"), "product_id", "left_semi")
    linked = lambda df: within_scope(df, scope, heats, products)
    observations = linked(t["observations"])
    selections = t["selections"].join(results.select("result_id"), "result_id", "left_semi")
    makers = t["manufacturers"]
    return {
        "Resumen": summary_sheet(h.report_summary(t["certificates"], heats, products, results, selections, used, makers), used, official),
        "Actas": t["certificates"].join(makers.select("manufacturer_id", F.col("name").alias("fabricante")), "manufacturer_id", "left"),
        "Batches": heats, "Coladas": products,
        "Composición": composition_sheet(t["compositions"], products, heats, scope),
        "Evidencia": evidence_sheet(observations, t["links"], t["factors"]),
        "Clasificación": classification_sheet(products, results, used, t["candidates"], t["factors"], selections, h.first_evidence(products, observations, [c for c in products.columns if c == "product_identifier"]), t.get("rule_sets")),
        "Auditoría": audit_timeline(selections, t["approvals"].join(runs.select("run_id"), "run_id", "left_semi"), linked(t["corrections"]), results, runs, t["candidates"]),
    }


def write_report(tables: Mapping[str, DataFrame], path: str, partition_by: Mapping[str, str] | None = None) -> DataFrame:
    """Write each table as parquet, read it back and compare row counts: (table_name, written, read)."""
    out = None
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        key = (partition_by or {}).get(name)
        (writer.partitionBy(key) if key else writer).parquet(f"{path}/{name}")
        back = df.sparkSession.read.parquet(f"{path}/{name}").agg(F.count("*").alias("read"))
        line = df.agg(F.count("*").alias("written")).select(F.lit(name).alias("table_name"), "written", back.select("read").scalar().alias("read"))
        out = line if out is None else out.unionByName(line)
    return out
