"""Fixture views over the driver tables; the same text runs in Spark SQL and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["fx_product_rows"] = """
SELECT l_orderkey*10+l_linenumber AS product_id, l_orderkey AS certificate_id, l_orderkey*10 + l_suppkey%3 AS heat_id,
 concat('H', CAST(l_orderkey*10 + l_suppkey%3 AS VARCHAR(20))) AS heat_no, concat('COIL-', CAST(l_orderkey*10+l_linenumber AS VARCHAR(20))) AS product_identifier,
 CASE WHEN l_partkey%29=0 THEN 'bar' ELSE 'flat_rolled' END AS form,
 CASE WHEN l_partkey%23=0 THEN NULL ELSE l_linestatus='F' END AS coiled,
 CASE l_returnflag WHEN 'A' THEN 'hot' WHEN 'N' THEN 'cold' ELSE NULL END AS rolling,
 CASE WHEN l_partkey%19=0 THEN NULL ELSE CAST(100*(1+l_partkey%15) AS DECIMAL(18,6)) END AS width_mm,
 CASE WHEN l_partkey%17=0 THEN NULL ELSE CAST(CAST(CAST(l_quantity AS INT) AS DECIMAL(9,2))*CAST(0.25 AS DECIMAL(9,2)) AS DECIMAL(18,6)) END AS thickness_mm,
 CASE l_partkey%4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS coated,
 CASE WHEN l_partkey%4=0 THEN CASE l_suppkey%5 WHEN 0 THEN 'Zn' WHEN 1 THEN 'Sn' WHEN 2 THEN 'Al-Zn' WHEN 3 THEN 'Pb' ELSE NULL END END AS coating_metal,
 CASE WHEN l_partkey%4=0 AND l_suppkey%5=0 THEN CASE l_orderkey%3 WHEN 0 THEN 'electrolytic' WHEN 1 THEN 'hot_dip' ELSE NULL END END AS coating_process,
 CASE l_orderkey%5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS coating_both_sides,
 CASE WHEN l_partkey%11=0 THEN NULL ELSE CAST(200+(l_partkey*7)%250 AS DECIMAL(18,6)) END AS yield_strength_mpa,
 CASE l_suppkey%3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS pickled,
 CASE l_orderkey%4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS pattern_in_relief,
 CASE l_orderkey%6 WHEN 0 THEN '200' WHEN 1 THEN '300' WHEN 2 THEN '400' WHEN 3 THEN 'other' ELSE NULL END AS stainless_series,
 CASE l_orderkey%3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS porcelain_exposed_parts,
 CASE l_partkey%3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS pipeline_steel,
 CASE l_suppkey%4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS tool_steel,
 CASE l_suppkey%6 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS high_speed_steel,
 CAST(CAST(l_quantity AS INT)*100 AS DECIMAL(18,6)) AS weight_kg,
 row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) AS row_no
FROM lineitem
"""

VIEWS["fx_products"] = """
SELECT * FROM fx_product_rows WHERE row_no = 1
"""

VIEWS["fx_certificates"] = """
SELECT o_orderkey AS certificate_id, o_custkey AS document_id, o_custkey % 40 AS stored_file_id,
 CASE WHEN o_orderkey%31=0 THEN NULL ELSE o_custkey%10 END AS manufacturer_id,
 CASE WHEN o_orderkey%37=0 THEN NULL ELSE concat('C-', CAST(o_orderkey%500 AS VARCHAR(20))) END AS certificate_no,
 CASE WHEN o_orderkey%7=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS certificate_date,
 o_orderdate AS uploaded_at,
 CASE WHEN o_orderkey%41=0 THEN NULL ELSE o_orderpriority END AS standard,
 CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'needs_review' ELSE 'draft' END AS approval_status,
 CASE o_orderkey%5 WHEN 0 THEN 'needs_review' ELSE 'succeeded' END AS processing_status,
 o_orderkey%13=0 AS archived
FROM orders
"""

VIEWS["fx_manufacturers"] = """
SELECT s_suppkey AS manufacturer_id, s_name AS name, lower(s_name) AS normalized_name FROM supplier
"""

VIEWS["fx_heats"] = """
SELECT DISTINCT heat_id, certificate_id, heat_no, concat('STD-', CAST(heat_id%3 AS VARCHAR(5))) AS standard FROM fx_product_rows
"""

VIEWS["fx_thresholds"] = """
SELECT element, idx, CAST(threshold AS DECIMAL(18,8)) AS threshold FROM (VALUES ('Al_total',1,0.3),('B',2,0.0008),('Cr',3,0.3),('Co',4,0.3),('Cu',5,0.4),('Pb',6,0.4),('Mn',7,1.65),('Mo',8,0.08),('Ni',9,0.3),('Nb',10,0.06),('Si',11,0.6),('Ti',12,0.05),('W',13,0.3),('V',14,0.1),('Zr',15,0.05),('OtherIndividual',16,0.1)) AS v(element,idx,threshold)
"""

VIEWS["fx_compositions"] = """
SELECT heat_id, element, CASE WHEN heat_id%7=0 AND element='W' THEN NULL
 WHEN heat_id%5=0 AND element='Cr' THEN CAST(18.2 AS DECIMAL(18,8))
 ELSE CAST(CAST((heat_id*idx*7)%(CASE WHEN heat_id%3=0 THEN 120 ELSE 99 END) AS DECIMAL(9,0))*CAST(threshold/100 AS DECIMAL(9,8)) AS DECIMAL(18,8)) END AS percentage
FROM (SELECT DISTINCT heat_id FROM fx_products) h CROSS JOIN fx_thresholds t
UNION ALL
SELECT DISTINCT heat_id, 'C' AS element, CASE WHEN heat_id%13=0 THEN NULL WHEN heat_id%97=0 THEN CAST(2.5 AS DECIMAL(18,8))
 ELSE CAST(CAST(heat_id%60 AS DECIMAL(9,0))*CAST(0.01 AS DECIMAL(9,2)) AS DECIMAL(18,8)) END AS percentage
FROM fx_products
"""

VIEWS["fx_observations"] = """
SELECT observation_id, product_id, field_path, normalized_value, observed_at, confidence, unit, page_number,
 lag(observation_id) OVER (PARTITION BY product_id, field_path ORDER BY observed_at, observation_id) AS supersedes_id,
 lead(observation_id) OVER (PARTITION BY product_id, field_path ORDER BY observed_at, observation_id) IS NULL AS is_current
FROM (SELECT event_id AS observation_id, user_id*10 + 1 + event_id%3 AS product_id,
 CASE event_type WHEN 'click' THEN 'thickness_mm' WHEN 'view' THEN 'width_mm' WHEN 'purchase' THEN 'composition_pct.Mn' WHEN 'error' THEN 'composition_pct.C' ELSE 'mechanical_properties.yield_strength_mpa' END AS field_path,
 CAST(value AS DECIMAL(18,2)) AS normalized_value, ts AS observed_at,
 CASE WHEN event_id%9=0 THEN NULL ELSE CAST(CAST(event_id*7%100 AS DECIMAL(9,2))*CAST(0.01 AS DECIMAL(9,2)) AS DECIMAL(9,4)) END AS confidence,
 CASE event_id%6 WHEN 0 THEN 'in' WHEN 1 THEN NULL WHEN 2 THEN '%' ELSE 'mm' END AS unit,
 CASE WHEN event_id%4=0 THEN NULL ELSE 1+event_id%3 END AS page_number
 FROM events) e
"""

VIEWS["fx_raw_rows"] = """
SELECT certificate_id, product_id, heat_id,
 row_number() OVER (PARTITION BY certificate_id ORDER BY product_id) AS row_pos,
 CASE WHEN product_id%4=1 THEN '"' WHEN product_id%9=0 THEN NULL ELSE CAST(width_mm AS VARCHAR(30)) END AS width_raw,
 CASE WHEN product_id%5=2 THEN '"' ELSE CAST(product_id%60 AS VARCHAR(10)) END AS c_raw,
 CASE product_id%4 WHEN 0 THEN 'C 10^-4' WHEN 1 THEN 'C (%)' WHEN 2 THEN 'C x10^3' ELSE 'C ppm' END AS c_header,
 CASE product_id%5 WHEN 0 THEN '1 1/2 in' WHEN 1 THEN '12,5 mm' WHEN 2 THEN '0.9' WHEN 3 THEN '2 cm' ELSE '3 furlongs' END AS thickness_raw,
 CASE product_id%3 WHEN 0 THEN 'COIL' WHEN 1 THEN '6.0' ELSE NULL END AS length_raw
FROM fx_products
"""

VIEWS["fx_runs"] = """
SELECT certificate_id*10+k AS run_id, certificate_id, CASE WHEN k>0 THEN certificate_id*10+k-1 END AS parent_run_id,
 CASE WHEN k=0 THEN 'rejected' WHEN certificate_id%2=0 THEN 'approved' ELSE 'needs_review' END AS approval_status
FROM fx_certificates CROSS JOIN (VALUES (0),(1),(2)) AS v(k) WHERE k <= certificate_id%3
"""

VIEWS["fx_selections"] = """
SELECT observation_id AS selection_id, product_id AS result_id, observation_id%3+1 AS candidate_rank,
 lag(observation_id) OVER (PARTITION BY product_id ORDER BY observed_at, observation_id) AS supersedes_selection_id,
 observed_at AS created_at, product_id%11=0 AS selection_cleared
FROM fx_observations
"""

VIEWS["fx_job_log"] = """
SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'running' WHEN 'view' THEN 'queued' ELSE 'succeeded' END AS status,
 event_id%4 AS attempts, 3 AS max_attempts, CASE WHEN event_id%10=0 THEN NULL ELSE ts END AS heartbeat_at
FROM events
"""

VIEWS["fx_documents_text"] = """
SELECT doc_id, concat(CASE doc_id%4 WHEN 0 THEN 'MILL TEST CERTIFICATE ' WHEN 1 THEN 'Certificado de molino ' ELSE '' END,
 CASE doc_id%3 WHEN 0 THEN 'HEAT NO 123 COIL NO 456 ' WHEN 1 THEN 'Colada 77 ' ELSE '' END,
 CASE doc_id%5 WHEN 0 THEN 'Chemical Composition ' WHEN 1 THEN 'ladle analysis ' ELSE '' END,
 CASE doc_id%2 WHEN 0 THEN 'Thickness Width Weight ' ELSE '' END, coalesce(text, '')) AS text
FROM documents
"""

VIEWS["fx_blocks"] = """
SELECT certificate_id AS doc_id, 1 AS page, row_pos*10+c AS block_id,
 CASE c WHEN 0 THEN CAST(product_id AS VARCHAR(20)) WHEN 1 THEN width_raw ELSE c_raw END AS text,
 CAST(100*c AS DOUBLE) AS x0, CAST(100*c+60 AS DOUBLE) AS x1, CAST(100+20*row_pos AS DOUBLE) AS top, CAST(112+20*row_pos AS DOUBLE) AS bottom
FROM fx_raw_rows CROSS JOIN (VALUES (0),(1),(2)) AS v(c)
"""

VIEWS["fx_catalog"] = """
SELECT fraction, nico, concat(fraction, nico) AS code FROM (VALUES ('72091601','01'),('72091601','99'),('72091701','01'),('72091701','99'),('72091801','01'),('72091801','99'),('72091504','01'),('72091504','02'),('72091504','03'),('72091504','99'),('72083901','01'),('72083901','99'),('72103002','01'),('72103002','99'),('72104999','01'),('72104999','02'),('72104999','99'),('72106101','00'),('72102001','00'),('72101101','00'),('72193502','01'),('72193502','01'),('72255091','01'),('72255091','02'),('72255091','99')) AS v(fraction,nico)
"""
# Facts of a roll beyond the certificate columns, so that every rule branch has rows.
VIEWS["fx_facts"] = """
SELECT product_id, certificate_id, heat_id, heat_no, form, coiled, rolling, width_mm, thickness_mm, coated, coating_metal,
 coating_process, coating_both_sides, yield_strength_mpa, pickled, pattern_in_relief, porcelain_exposed_parts,
 pipeline_steel, high_speed_steel, tool_steel, stainless_series,
 CASE WHEN product_id%29=1 THEN true WHEN product_id%29=2 THEN NULL ELSE false END AS grain_oriented,
 CASE WHEN product_id%23=1 THEN true WHEN product_id%23=2 THEN NULL ELSE false END AS magnetic_silicon,
 CASE product_id%7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS rolled_four_faces,
 CASE product_id%31 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS clad,
 CASE WHEN product_id%3=0 THEN NULL ELSE CAST(product_id%5 AS DECIMAL(18,6)) END AS magnetic_loss_w_per_kg,
 CASE WHEN product_id%4=0 THEN NULL ELSE CAST(1 AS DECIMAL(18,6)) END AS magnetic_induction_tesla,
 CASE WHEN product_id%5=0 THEN NULL ELSE CAST(product_id%40 AS DECIMAL(18,6)) END AS secondary_reduction_ratio,
 CASE product_id%5 WHEN 1 THEN NULL WHEN 2 THEN true ELSE false END AS can_body_end_use,
 CASE WHEN product_id%3=1 THEN NULL ELSE 'deep' END AS deep_drawing_class,
 CASE WHEN product_id%2=0 THEN NULL ELSE CAST(12 AS DECIMAL(18,6)) END AS cladding_weight_percentage
FROM fx_products
"""


# Stored layer of the facts as a certificate declares it, and current and stale observations of every fact, of rolls and of heats.
VIEWS["fx_stored_rolls"] = """
SELECT f.*, CASE WHEN pickled THEN 'Oiled,Pickled' WHEN NOT pickled THEN 'Sin Decapar' WHEN product_id%2=0 THEN 'oiled' END AS condition_text,
 CAST(CASE WHEN coating_both_sides THEN 60 WHEN NOT coating_both_sides THEN 0 WHEN product_id%2=0 THEN 30 END AS DECIMAL(18,6)) AS coating_superior_g_m2,
 CAST(CASE WHEN coating_both_sides THEN 55 WHEN NOT coating_both_sides AND product_id%2=0 THEN 40 END AS DECIMAL(18,6)) AS coating_inferior_g_m2
FROM fx_facts f
"""
VIEWS["fx_fact_observations"] = """
SELECT product_id*4 + k AS observation_id, CASE WHEN k=1 THEN NULL ELSE product_id END AS product_id, heat_id, m%11 <> 0 AS is_current, CASE n
  WHEN 0 THEN 'form'
  WHEN 1 THEN 'coiled'
  WHEN 2 THEN 'rolling'
  WHEN 3 THEN 'width_mm'
  WHEN 4 THEN 'thickness_mm'
  WHEN 5 THEN 'coated'
  WHEN 6 THEN 'coating.metal'
  WHEN 7 THEN 'coating.process'
  WHEN 8 THEN 'coating.superior_g_m2'
  WHEN 9 THEN 'coating.inferior_g_m2'
  WHEN 10 THEN 'mechanical_properties.yield_strength_mpa'
  WHEN 11 THEN 'pickled'
  WHEN 12 THEN 'pattern_in_relief'
  WHEN 13 THEN 'porcelain_exposed_parts'
  WHEN 14 THEN 'pipeline_steel'
  WHEN 15 THEN 'high_speed_steel'
  WHEN 16 THEN 'tool_steel'
  WHEN 17 THEN 'grain_oriented'
  WHEN 18 THEN 'magnetic_silicon'
  WHEN 19 THEN 'stainless_series'
  WHEN 20 THEN 'rolled_four_faces'
  WHEN 21 THEN 'clad'
  WHEN 22 THEN 'temper'
  WHEN 23 THEN 'magnetic_loss_w_per_kg'
  WHEN 24 THEN 'magnetic_induction_tesla'
  WHEN 25 THEN 'secondary_reduction_ratio'
  WHEN 26 THEN 'can_body_end_use'
  WHEN 27 THEN 'deep_drawing_class'
  WHEN 28 THEN 'cladding_weight_percentage'
  WHEN 29 THEN 'composition_pct.C'
  WHEN 30 THEN 'composition_pct.Cr'
  WHEN 31 THEN 'composition_pct.Mn'
  WHEN 32 THEN 'composition_pct.B'
  WHEN 33 THEN 'composition_pct.W'
  WHEN 34 THEN 'composition_pct.Si' END AS field_path,
 CASE n
  WHEN 0 THEN CASE WHEN m%4=0 THEN 'bar' ELSE 'flat_rolled' END
  WHEN 1 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 2 THEN CASE m%3 WHEN 0 THEN 'hot' WHEN 1 THEN 'cold' END
  WHEN 3 THEN CASE WHEN m%9=0 THEN 'n/a' ELSE concat(CAST(m%1800 AS VARCHAR(20)), '.5') END
  WHEN 4 THEN CASE WHEN m%7<>0 THEN concat(CAST(m%12 AS VARCHAR(20)), '.25') END
  WHEN 5 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 6 THEN CASE m%4 WHEN 0 THEN 'Zn' WHEN 1 THEN 'Sn' WHEN 2 THEN 'Al-Zn' END
  WHEN 7 THEN CASE m%3 WHEN 0 THEN 'electrolytic' WHEN 1 THEN 'hot_dip' END
  WHEN 8 THEN CASE m%3 WHEN 0 THEN '0' WHEN 1 THEN '60' END
  WHEN 9 THEN CASE m%4 WHEN 0 THEN '0' WHEN 1 THEN '45.5' END
  WHEN 10 THEN CASE m%4 WHEN 0 THEN '355' WHEN 1 THEN '300.5' WHEN 2 THEN '275' END
  WHEN 11 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 12 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 13 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 14 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 15 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 16 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 17 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 18 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 19 THEN CASE m%5 WHEN 0 THEN '200' WHEN 1 THEN '300' WHEN 2 THEN '400' WHEN 3 THEN 'other' END
  WHEN 20 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 21 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 22 THEN CASE WHEN m%2=0 THEN 'full_hard' END
  WHEN 23 THEN CASE WHEN m%2=0 THEN '1.5' END
  WHEN 24 THEN CASE WHEN m%3=0 THEN '1.8' END
  WHEN 25 THEN CASE WHEN m%3<>0 THEN '33.3' END
  WHEN 26 THEN CASE WHEN m%3=0 THEN 'true' WHEN m%3=1 THEN 'false' END
  WHEN 27 THEN CASE WHEN m%2=0 THEN 'extra' END
  WHEN 28 THEN CASE WHEN m%2=0 THEN '8' END
  WHEN 29 THEN CASE m%4 WHEN 0 THEN '0.05' WHEN 1 THEN '0.3' WHEN 2 THEN '2.1' END
  WHEN 30 THEN CASE m%3 WHEN 0 THEN '0' WHEN 1 THEN '18.2' END
  WHEN 31 THEN CASE m%3 WHEN 0 THEN '0.2' WHEN 1 THEN '1.7' END
  WHEN 32 THEN CASE m%3 WHEN 0 THEN '0' WHEN 1 THEN '0.001' ELSE 'tr' END
  WHEN 33 THEN CASE WHEN m%2=0 THEN '0' END
  WHEN 34 THEN '0.1' END AS value
FROM (SELECT product_id, heat_id, v.k, CAST(floor(product_id/3)*7 + v.k AS BIGINT) AS m, (product_id*5 + v.k*17)%35 AS n FROM fx_products CROSS JOIN (VALUES (0),(1),(2)) AS v(k)
 WHERE (v.k=0 AND product_id%3=0) OR (v.k=1 AND product_id%4=1) OR (v.k=2 AND product_id%6=0)) x
"""
# A fifth of the rolls have chemistry of their own, for two elements.
VIEWS["fx_scoped_compositions"] = """
SELECT heat_id, CAST(NULL AS BIGINT) AS product_id, element, percentage FROM fx_compositions
UNION ALL SELECT heat_id, product_id, 'Mn', CAST(product_id%200 * 0.01 AS DECIMAL(18,8)) FROM fx_products WHERE product_id%5=2
UNION ALL SELECT heat_id, product_id, 'C', CASE WHEN product_id%15=2 THEN NULL ELSE CAST(product_id%130 * 0.01 AS DECIMAL(18,8)) END FROM fx_products WHERE product_id%5=2
"""


# ---- further inputs derived from the driver tables ----
VIEWS["fx_header_cells"] = """
SELECT p_partkey AS cell_id, concat(CASE WHEN p_partkey%7=3 THEN concat(p_brand, ' ') ELSE '' END, CASE p_partkey%31 WHEN 0 THEN 'Coil No.' WHEN 1 THEN 'HEAT NO' WHEN 2 THEN 'Número de Colada' WHEN 3 THEN 'Thickness (mm)'
 WHEN 4 THEN 'Espesor' WHEN 5 THEN 'Width mm' WHEN 6 THEN 'C x10^4' WHEN 7 THEN 'Mn 10^-3' WHEN 8 THEN 'Si (%)' WHEN 9 THEN 'P ppm' WHEN 10 THEN 'Al 10⁻³' WHEN 11 THEN 'Soluble Al' WHEN 12 THEN 'Yield Strength MPa'
 WHEN 13 THEN 'Límite Elástico' WHEN 14 THEN 'TENSILE STRENGTH' WHEN 15 THEN 'Elongation %' WHEN 16 THEN 'Net Weight' WHEN 17 THEN 'Peso Bruto' WHEN 18 THEN 'Remarks' WHEN 19 THEN 'Hardness HRB' WHEN 20 THEN 'Length'
 WHEN 21 THEN 'Cr *1000' WHEN 22 THEN 'Ni x100' WHEN 23 THEN 'B /10000' WHEN 24 THEN 'Qty' WHEN 25 THEN 'Cobre' WHEN 26 THEN 'Placa' WHEN 27 THEN 'Chemical Composition' WHEN 28 THEN 'Customer' WHEN 29 THEN 'ROLLNO' ELSE p_name END,
 CASE WHEN p_partkey%5=4 THEN ' Nominal' ELSE '' END) AS header
FROM part
"""
VIEWS["fx_value_cells"] = """
SELECT o_orderkey AS cell_id, CASE o_orderkey%12 WHEN 0 THEN '-4' WHEN 1 THEN '10^-4' WHEN 2 THEN '10(-3)' WHEN 3 THEN '10⁻²' WHEN 4 THEN '10 ^ -4' WHEN 5 THEN 'x10' WHEN 6 THEN '10^(-2)' WHEN 7 THEN '10⁻⁴' WHEN 8 THEN '0' WHEN 9 THEN '10-3' ELSE '1e-4' END AS power_text,
 CASE o_orderkey%10 WHEN 0 THEN '1.234,56' WHEN 1 THEN '1,234.56' WHEN 2 THEN '0,123' WHEN 3 THEN '12,5' WHEN 4 THEN '1,234,567' WHEN 5 THEN 'n/a' WHEN 6 THEN ' 42 ' WHEN 7 THEN '1.5' ELSE CAST(o_custkey AS VARCHAR(20)) END AS number_text,
 CASE o_orderkey%13 WHEN 0 THEN '1 1/2 in' WHEN 1 THEN '12,5 mm' WHEN 2 THEN '3/4"' WHEN 3 THEN '2 cm' WHEN 4 THEN '3 furlongs' WHEN 5 THEN '1.2 m' WHEN 6 THEN '6 pies' WHEN 7 THEN '.75' WHEN 8 THEN '25 pulgadas' WHEN 9 THEN 'abc' WHEN 10 THEN '5 ft' ELSE CAST(o_custkey%3000 AS VARCHAR(20)) END AS size_text,
 CASE o_orderkey%4 WHEN 0 THEN 'Thickness (in)' WHEN 1 THEN 'Width cm' WHEN 2 THEN 'Espesor milímetros' ELSE '' END AS size_header,
 CASE o_orderkey%8 WHEN 0 THEN '1.2x1200xC' WHEN 1 THEN '2,5X1000' WHEN 2 THEN '3*1500*6' WHEN 3 THEN '1 in x 40 in' WHEN 4 THEN '0.8 × 914 × COIL' WHEN 5 THEN '1200' WHEN 6 THEN '2x1000x2500' ELSE '4 x abc' END AS tuple_text,
 CASE o_orderkey%9 WHEN 0 THEN '20240131' WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024/3/5' WHEN 3 THEN 'Mar. 7, 2023' WHEN 4 THEN 'about 2024-01-01' WHEN 5 THEN 'Dec 24 2022' WHEN 6 THEN '31-01-2024' WHEN 7 THEN NULL ELSE '2023-11-09' END AS date_text,
 CASE o_orderkey%6 WHEN 0 THEN '>=355' WHEN 1 THEN '≤ 400' WHEN 2 THEN '≧275.5' WHEN 3 THEN '310' WHEN 4 THEN 'min 355' ELSE '<  250' END AS bound_text,
 CASE o_orderkey%5 WHEN 0 THEN 'SAE 1010' WHEN 1 THEN 'sae  1035' WHEN 2 THEN 'ASTM A1008' ELSE NULL END AS standard_text,
 concat('  Mill   Works ', CAST(o_custkey%50 AS VARCHAR(20)), ' S.A. ') AS maker_text,
 CASE o_orderkey%4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE o_custkey%60 END AS superior, CASE o_orderkey%3 WHEN 0 THEN NULL ELSE o_custkey%7 END AS inferior,
 CASE o_orderkey%5 WHEN 0 THEN 'Pickled' WHEN 1 THEN 'UNPICKLED,oiled' WHEN 2 THEN 'oiled' WHEN 3 THEN 'decapado' ELSE NULL END AS condition_text,
 CASE o_orderkey%4 WHEN 0 THEN 'day' WHEN 1 THEN 'week' WHEN 2 THEN 'month' ELSE 'all' END AS preset, CAST(o_orderdate AS DATE) AS today
FROM orders
"""
VIEWS["fx_boxes"] = """
SELECT l_orderkey*10+l_linenumber AS box_id, CAST(l_partkey%900 AS DOUBLE) AS x0, CAST(l_partkey%900+l_suppkey%200+1 AS DOUBLE) AS x1, CAST(l_suppkey%700 AS DOUBLE) AS top, CAST(l_suppkey%700+l_partkey%90+1 AS DOUBLE) AS bottom,
 CAST(1000 AS DOUBLE) AS image_width, CAST(800 AS DOUBLE) AS image_height, CAST(612 AS DOUBLE) AS page_width, CAST(792 AS DOUBLE) AS page_height, CAST((l_orderkey%4)*90 AS INT) AS rotation FROM lineitem
"""

VIEWS["fx_scoped_rows"] = """
SELECT certificate_id, product_id, row_pos, (row_pos-1)//3 AS table_scope, CASE WHEN product_id%7=3 THEN '同上' WHEN product_id%11=5 THEN NULL ELSE CAST(heat_id AS VARCHAR(20)) END AS heat_no, width_raw, c_raw FROM fx_raw_rows
""".replace("(row_pos-1)//3", "CAST(floor((row_pos-1)/3.0) AS INT)")
VIEWS["fx_roll_rows"] = """
SELECT product_id, certificate_id, heat_id, heat_no, CASE WHEN product_id%97=0 THEN '' ELSE product_identifier END AS product_identifier, CAST(CASE WHEN product_id%101=0 THEN -1 WHEN product_id%7=0 THEN 0 ELSE product_id%4+1 END AS INT) AS quantity,
 CASE WHEN product_id%53=0 THEN NULL ELSE weight_kg END AS weight_kg, weight_kg AS net_weight_kg, CAST(weight_kg+50 AS DECIMAL(18,6)) AS gross_weight_kg, rolling, width_mm FROM fx_product_rows
"""
VIEWS["fx_declared_totals"] = """
SELECT certificate_id, CASE WHEN certificate_id%6=0 THEN NULL ELSE CAST(sum(quantity) AS BIGINT) + CASE WHEN certificate_id%5=0 THEN 1 ELSE 0 END END AS total_pieces,
 CASE WHEN certificate_id%4=0 THEN NULL ELSE CAST(sum(weight_kg) AS DECIMAL(18,6)) END AS total_weight_kg, CAST(sum(net_weight_kg) AS DECIMAL(18,6)) AS total_net_weight_kg,
 CAST(sum(gross_weight_kg) + CASE WHEN certificate_id%9=0 THEN 1 ELSE 0 END AS DECIMAL(18,6)) AS total_gross_weight_kg FROM fx_roll_rows GROUP BY certificate_id
"""
VIEWS["fx_declared_subtotals"] = """
SELECT certificate_id, 'heat_no' AS match_field, CASE WHEN heat_id%13=0 THEN 'H0' ELSE heat_no END AS match_value, CAST(sum(quantity) AS BIGINT) + CASE WHEN heat_id%5=0 THEN 1 ELSE 0 END AS total_pieces,
 CASE WHEN heat_id%4=0 THEN NULL ELSE CAST(sum(weight_kg) + CASE WHEN heat_id%7=0 THEN 1 ELSE 0 END AS DECIMAL(18,6)) END AS total_weight_kg FROM fx_roll_rows GROUP BY certificate_id, heat_id, heat_no
"""
VIEWS["fx_roll_compositions"] = """
SELECT p.product_id, p.heat_id, CASE WHEN p.heat_id%17=0 THEN 'UNKNOWN' ELSE p.heat_no END AS heat_no, v.element, CAST(CASE WHEN p.heat_id%3=0 THEN p.heat_id%90 ELSE p.product_id%90 END * v.k * 0.001 AS DECIMAL(18,8)) AS percentage,
 CASE WHEN p.certificate_id%19=0 THEN 'xlsx' ELSE 'pdf' END AS source_format, p.product_id%41=0 AS has_verification FROM fx_products p CROSS JOIN (VALUES ('C',1),('Mn',2),('Si',3)) AS v(element,k)
"""
VIEWS["fx_mill_docs"] = """
SELECT certificate_id, CASE certificate_id%3 WHEN 0 THEN 'hot' WHEN 1 THEN 'cold' END AS rolling, CASE WHEN certificate_id%2=0 THEN 'Pickled,oiled' END AS condition_text,
 CASE WHEN certificate_id%4=0 THEN 'Zn' END AS coating_metal, CASE WHEN certificate_id%4=0 THEN 'hot_dip' END AS coating_process, CASE WHEN certificate_id%8=0 THEN 'chromate' END AS coating_post_treatment,
 CASE certificate_id%5 WHEN 0 THEN 'SAE 1010' WHEN 1 THEN 'ASTM A1008' END AS standard, CASE WHEN certificate_id%15=0 THEN 'DC01' END AS grade, CASE WHEN certificate_id%6=0 THEN 'mill edge' END AS edge_condition,
 CASE certificate_id%3 WHEN 0 THEN '10^-2' WHEN 1 THEN '-3' ELSE '10^-1' END AS scale_c, CASE WHEN certificate_id%23<>0 THEN '-2' END AS scale_mn, '10(-3)' AS scale_si
FROM fx_certificates
"""
VIEWS["fx_mill_rows"] = """
SELECT certificate_id, row_number() OVER (PARTITION BY certificate_id ORDER BY product_id, row_no) AS row_pos, product_id,
 CASE WHEN product_id%89=0 THEN ' ' WHEN product_id%7=0 THEN concat(' ', product_identifier) ELSE concat(product_identifier, CASE WHEN row_no > 1 AND product_id%2=0 THEN concat('/', CAST(row_no AS VARCHAR(9))) ELSE '' END) END AS product_identifier,
 concat('L', CAST(product_id%50 AS VARCHAR(9))) AS label_no, CASE WHEN product_id%6=1 THEN '同上' WHEN product_id%31=0 THEN NULL ELSE heat_no END AS heat_no,
 CASE WHEN product_id%5=1 THEN '"' WHEN product_id%97=0 THEN 'abc' ELSE CAST(thickness_mm AS VARCHAR(30)) END AS thickness_mm, CASE WHEN product_id%4=2 THEN 'ditto' ELSE CAST(width_mm AS VARCHAR(30)) END AS width_mm,
 CASE WHEN product_id%8=3 THEN '"' WHEN product_id%3=0 THEN 'COIL' WHEN product_id%3=1 THEN '6.5' END AS length_raw, CASE WHEN product_id%9=4 THEN '"' WHEN product_id%101=0 THEN '-2' WHEN product_id%2=0 THEN CAST(product_id%4+1 AS VARCHAR(9)) END AS quantity,
 CAST(weight_kg AS VARCHAR(30)) AS weight_kg, CASE WHEN product_id%2=0 THEN CAST(weight_kg AS VARCHAR(30)) END AS net_weight_kg, CAST(NULL AS VARCHAR(30)) AS gross_weight_kg,
 CAST(yield_strength_mpa AS VARCHAR(30)) AS yield_strength_mpa, CASE WHEN product_id%3=0 THEN '410' ELSE '' END AS tensile_strength_mpa, CASE WHEN product_id%103=0 THEN 'x' WHEN product_id%4=0 THEN '28.5' END AS elongation_pct,
 CASE WHEN product_id%11=0 THEN 'Sn' END AS coating_metal, CASE WHEN product_id%4=1 THEN '60' END AS coating_superior_g_m2, CASE WHEN product_id%4=1 THEN '0' END AS coating_inferior_g_m2,
 CASE WHEN product_id%10=0 THEN 'hot' END AS rolling, CASE WHEN product_id%12=0 THEN 'EN 10130' END AS standard,
 product_id%17 <> 0 AS has_c, CASE WHEN product_id%3=2 THEN '"' WHEN product_id%19=0 THEN NULL ELSE CAST(heat_id%60 AS VARCHAR(9)) END AS c_raw,
 CASE WHEN product_id%7=5 THEN '〃' WHEN product_id%107=0 THEN 'n/a' ELSE concat(CAST(heat_id%150 AS VARCHAR(9)), ',5') END AS mn_raw, CAST(CASE WHEN heat_id%3=0 THEN heat_id%9 ELSE product_id%9 END AS VARCHAR(9)) AS si_raw,
 CASE WHEN product_id%37=0 THEN '-4' END AS own_scale_c, CASE WHEN product_id%2=0 THEN CAST(1 + product_id%3 AS INT) END AS page
FROM fx_product_rows
"""
# A scanned page: headers with scales in different places, second readings of identifiers and heats, one or two weights a row.
VIEWS["fx_scan_blocks"] = """
SELECT doc_id, 1 AS page, block_id, text, x0, x1, top, top + height AS bottom, confidence, CAST(1000 AS DOUBLE) AS page_width, CAST(1400 AS DOUBLE) AS page_height FROM (
 SELECT certificate_id AS doc_id, CAST(row_pos*10 + v.k AS BIGINT) AS block_id,
  CASE v.k WHEN 0 THEN CASE WHEN certificate_id%10=0 AND row_pos <= 2 THEN 'COIL-SAME1' ELSE concat('COIL-', CAST(product_id AS VARCHAR(20))) END WHEN 1 THEN width_raw WHEN 2 THEN c_raw WHEN 3 THEN concat('0.', CAST(product_id%9 AS VARCHAR(9)))
   WHEN 4 THEN concat('H', CAST(heat_id AS VARCHAR(20))) WHEN 5 THEN CASE WHEN product_id%3=0 THEN concat('CO1L-', CAST(product_id AS VARCHAR(20))) END WHEN 6 THEN CASE WHEN product_id%5=0 THEN 'H999' END WHEN 7 THEN CAST(100 + product_id%50 AS VARCHAR(9))
   ELSE CASE WHEN product_id%2=0 THEN CAST(200 + product_id%50 AS VARCHAR(9)) END END AS text,
  CAST(CASE v.k WHEN 0 THEN 80 WHEN 1 THEN 232 WHEN 2 THEN 390 WHEN 3 THEN 540 WHEN 4 THEN 670 WHEN 5 THEN 82 WHEN 6 THEN 690 ELSE 825 END AS DOUBLE) AS x0, CAST(CASE v.k WHEN 0 THEN 140 WHEN 1 THEN 288 WHEN 2 THEN 410 WHEN 3 THEN 560 WHEN 4 THEN 730 WHEN 5 THEN 142 WHEN 6 THEN 750 ELSE 875 END AS DOUBLE) AS x1,
  CAST(300 + 20*row_pos + CASE v.k WHEN 5 THEN 1 WHEN 7 THEN -3 WHEN 8 THEN 5 ELSE 0 END AS DOUBLE) AS top, CAST(CASE v.k WHEN 5 THEN 10 WHEN 7 THEN 6 WHEN 8 THEN 6 ELSE 12 END AS DOUBLE) AS height,
  CAST(CASE v.k WHEN 5 THEN CASE WHEN product_id%6=0 THEN 0.95 ELSE 0.5 END WHEN 6 THEN 0.3 ELSE 0.9 END AS DOUBLE) AS confidence
 FROM fx_raw_rows CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8)) AS v(k)
 UNION ALL SELECT certificate_id, CAST(v.k AS BIGINT), CASE v.k WHEN -1 THEN 'Coil No' WHEN -2 THEN 'Width mm' WHEN -3 THEN 'C' WHEN -4 THEN 'Mn %' WHEN -5 THEN 'Heat No' WHEN -6 THEN 'Weight' WHEN -7 THEN 'Bruto' WHEN -8 THEN CASE certificate_id%4 WHEN 0 THEN '10^-3' WHEN 1 THEN '%' WHEN 2 THEN '3' END
   ELSE CASE WHEN certificate_id%4=2 THEN 'x10' END END, CAST(CASE v.k WHEN -1 THEN 80 WHEN -2 THEN 230 WHEN -3 THEN 395 WHEN -4 THEN 540 WHEN -5 THEN 670 WHEN -6 THEN 820 WHEN -7 THEN 820 ELSE 390 END AS DOUBLE), CAST(CASE v.k WHEN -1 THEN 140 WHEN -2 THEN 290 WHEN -3 THEN 405 WHEN -4 THEN 560 WHEN -5 THEN 730 WHEN -6 THEN 880 WHEN -7 THEN 880 ELSE 410 END AS DOUBLE),
  CAST(CASE v.k WHEN -7 THEN 256 WHEN -8 THEN 262 WHEN -9 THEN 276 ELSE 240 END AS DOUBLE), CAST(12 AS DOUBLE), CAST(0.9 AS DOUBLE)
 FROM (SELECT DISTINCT certificate_id FROM fx_raw_rows) d CROSS JOIN (VALUES (-1),(-2),(-3),(-4),(-5),(-6),(-7),(-8),(-9)) AS v(k)) x
WHERE text IS NOT NULL
"""
# Certificates of two known layouts: columns at fixed places (upright and turned pages), and values below labels (bundles of two certificates).
VIEWS["fx_mill_lines"] = """
SELECT *, dense_rank() OVER (PARTITION BY doc_id, part ORDER BY heat_id) AS heat_rank, row_number() OVER (PARTITION BY doc_id, part, heat_id ORDER BY product_id) AS heat_row, count(*) OVER (PARTITION BY doc_id, part) AS part_rows FROM (
 SELECT certificate_id AS doc_id, product_id, heat_id, row_pos, width_raw, count(*) OVER (PARTITION BY certificate_id) AS n_rows, CASE WHEN certificate_id%3=0 AND row_pos%2=0 THEN 1 ELSE 0 END AS part FROM fx_raw_rows) x
"""
VIEWS["fx_known_docs"] = """
SELECT DISTINCT doc_id, CASE WHEN doc_id%2=0 THEN 'MOLINO_1_BX_POSCO' WHEN doc_id%7<>3 THEN 'ARCELORMITTAL_CALVERT' END AS profile FROM fx_mill_lines
"""
VIEWS["fx_known_pages"] = """
SELECT doc_id, v.page, CAST(CASE WHEN doc_id%2=0 THEN 842 ELSE 600 END AS DOUBLE) AS width, CAST(CASE WHEN doc_id%2=0 THEN 595 ELSE 800 END AS DOUBLE) AS height, CASE WHEN doc_id%4=2 THEN 90 ELSE 0 END AS rotation
FROM fx_known_docs CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS v(page) WHERE v.page = 1 OR (doc_id%2=1 AND (v.page <= 3 OR doc_id%3=0))
"""
VIEWS["fx_known_columns"] = """
SELECT doc_id, 1 AS page, block_id, text, CASE WHEN doc_id%4=0 THEN cy-4 ELSE cx-2 END AS x0, CASE WHEN doc_id%4=0 THEN cy+4 ELSE cx+2 END AS x1, CASE WHEN doc_id%4=0 THEN 593-cx ELSE cy-4 END AS top, CASE WHEN doc_id%4=0 THEN 597-cx ELSE cy+4 END AS bottom FROM (
 SELECT doc_id, CAST(1000 + row_pos*100 + v.k AS BIGINT) AS block_id, CAST(500 - 30*row_pos + v.across AS DOUBLE) AS cx, CAST(v.place AS DOUBLE) AS cy,
  CASE v.k WHEN 0 THEN concat('25BH2B', lpad(CAST(product_id AS VARCHAR(20)), 7, '0')) WHEN 1 THEN lpad(CAST(heat_id AS VARCHAR(20)), 7, '0') WHEN 2 THEN concat('1.', CAST(product_id%9 AS VARCHAR(9))) WHEN 3 THEN CASE WHEN width_raw IS NOT NULL THEN CAST(900 + product_id%300 AS VARCHAR(9)) END
   WHEN 4 THEN 'C' WHEN 5 THEN CAST(10000 + product_id%5000 AS VARCHAR(9)) WHEN 6 THEN CAST(10100 + product_id%5000 AS VARCHAR(9)) WHEN 7 THEN CAST(product_id%60 AS VARCHAR(9)) WHEN 8 THEN '1' WHEN 9 THEN '25' WHEN 10 THEN '5' WHEN 11 THEN '2' WHEN 12 THEN '40' WHEN 13 THEN '3'
   WHEN 14 THEN CAST(300 + product_id%50 AS VARCHAR(9)) WHEN 15 THEN CAST(400 + product_id%50 AS VARCHAR(9)) WHEN 16 THEN '28.5' WHEN 17 THEN '9.9' ELSE 'abc' END AS text
 FROM fx_mill_lines CROSS JOIN (VALUES (0,0,40),(1,-8,75),(2,0,108),(3,0,127),(4,0,147),(5,0,173),(6,-8,173),(7,3,237),(8,0,256),(9,0,275),(10,0,294),(11,0,314),(12,0,334),(13,0,355),(14,-8,445),(15,0,464),(16,0,484),(17,0,114),(18,0,109)) AS v(k, across, place) WHERE doc_id%2=0
 UNION ALL SELECT doc_id, CAST(v.k AS BIGINT), CAST(560 AS DOUBLE), CAST(v.place AS DOUBLE), CASE v.k WHEN 1 THEN '20260628' WHEN 2 THEN concat('E0', lpad(CAST(doc_id AS VARCHAR(20)), 10, '0')) WHEN 3 THEN 'BTA  BLZ112' WHEN 4 THEN 'grade PW.T' WHEN 5 THEN 'Total Pieces' ELSE CAST(doc_id%9 + 1 AS VARCHAR(9)) END
 FROM fx_known_docs CROSS JOIN (VALUES (1,20),(2,60),(3,100),(4,140),(5,600),(6,630)) AS v(k, place) WHERE doc_id%2=0) x WHERE text IS NOT NULL
"""
VIEWS["fx_known_labels"] = """
SELECT doc_id, CAST(page AS INT) AS page, CAST(page*100000 + k AS BIGINT) AS block_id, text, CAST(x0 AS DOUBLE) AS x0, CAST(x0 + 50 AS DOUBLE) AS x1, CAST(top AS DOUBLE) AS top, CAST(top + 6 AS DOUBLE) AS bottom FROM (
 SELECT doc_id, 1 AS page, 1 AS k, 'Identification according to international standard A1011' AS text, 50 AS x0, 50 AS top FROM fx_known_docs WHERE doc_id%2=1
 UNION ALL SELECT doc_id, p.page, v.k, CASE v.k WHEN 1 THEN 'Mill Certificate' WHEN 2 THEN 'Certificate Number' WHEN 3 THEN CAST(doc_id*10 + CASE WHEN p.page=3 AND doc_id%11=1 THEN 7 WHEN p.page >= 4 THEN 1 ELSE 0 END AS VARCHAR(20)) WHEN 4 THEN 'Date'
   WHEN 5 THEN CASE WHEN p.page >= 4 AND doc_id%17=1 THEN '07/01/2026' ELSE '06/28/2026' END ELSE 'ArcelorMittal Calvert LLC' END, v.x0, v.top
  FROM fx_known_pages p CROSS JOIN (VALUES (1,50,10),(2,200,30),(3,200,45),(4,400,30),(5,400,45),(6,50,60)) AS v(k, x0, top) WHERE doc_id%2=1 AND p.page > 1
 UNION ALL SELECT doc_id, p.page, v.k, CASE v.k WHEN 10 THEN CASE WHEN doc_id%19=1 THEN NULL WHEN p.page=2 THEN 'Coil S235 / 1.800 mm X 1,496 mm Hot Roll Pickled & Oiled' ELSE 'Aluminize Coil M1 / 2.000 mm X 900 mm' END WHEN 11 THEN CASE WHEN p.page=4 THEN 'Cold Roll Base' END
   WHEN 12 THEN 'Coil' WHEN 13 THEN 'Heat' WHEN 14 THEN 'Net' ELSE 'Gross' END, v.x0, v.top
  FROM fx_known_pages p CROSS JOIN (VALUES (10,50,70),(11,300,70),(12,50,100),(13,150,100),(14,250,100),(15,350,100)) AS v(k, x0, top) WHERE doc_id%2=1 AND p.page IN (2, 4)
 UNION ALL SELECT d.doc_id, p.page, 16, 'CHEMICAL COMPOSITION OF THE COIL', 50, 152 + 16*n FROM fx_known_pages p JOIN (SELECT doc_id, max(n_rows) AS n FROM fx_mill_lines GROUP BY doc_id) d ON d.doc_id = p.doc_id WHERE d.doc_id%2=1 AND p.page IN (2, 4)
 UNION ALL SELECT doc_id, 2 + 2*part, 100 + row_pos*10 + v.k, CASE v.k WHEN 0 THEN concat('K', CAST(product_id AS VARCHAR(20))) WHEN 1 THEN CASE WHEN doc_id%13<>1 OR row_pos > 1 THEN concat('H', CAST(heat_id AS VARCHAR(20))) END
   WHEN 2 THEN CASE product_id%3 WHEN 0 THEN '10,000.000' WHEN 1 THEN '9500' ELSE '1,2,000' END ELSE CASE WHEN product_id%2=1 THEN '10,100.000' END END, v.x0, 120 + 16*row_pos + CASE v.k WHEN 0 THEN 0 ELSE 3 END
  FROM fx_mill_lines CROSS JOIN (VALUES (0,50),(1,150),(2,250),(3,350)) AS v(k, x0) WHERE doc_id%2=1
 UNION ALL SELECT doc_id, 2 + 2*part, 50000 + CAST(heat_rank AS INT)*10 + v.k, CASE v.k WHEN 0 THEN concat('H', CAST(heat_id AS VARCHAR(20))) WHEN 1 THEN 'C' WHEN 2 THEN concat('0.', CAST(heat_id%60 AS VARCHAR(9))) WHEN 3 THEN 'SI' WHEN 4 THEN '0.01' WHEN 5 THEN 'Mn' WHEN 6 THEN '0'
   WHEN 7 THEN CASE WHEN doc_id%7=1 AND heat_rank=1 THEN 'C' END ELSE CASE WHEN doc_id%7=1 AND heat_rank=1 THEN '0.99' END END, v.x0, 152 + 16*n_rows + 40*CAST(heat_rank AS INT) + v.down
  FROM fx_mill_lines CROSS JOIN (VALUES (0,50,0),(1,150,8),(2,150,16),(3,220,8),(4,220,16),(5,290,8),(6,290,16),(7,360,8),(8,360,16)) AS v(k, x0, down) WHERE doc_id%2=1 AND heat_row=1 AND doc_id%13<>1
 UNION ALL SELECT doc_id, p.page, 20 + v.k, CASE v.k WHEN 0 THEN 'TENSILE TEST' WHEN 1 THEN 'Yield' WHEN 2 THEN '355 MPa' WHEN 3 THEN '% Total' WHEN 4 THEN '28.5' WHEN 5 THEN 'Top Side' WHEN 6 THEN '60' ELSE CASE WHEN doc_id%5=1 THEN '61' END END, v.x0, v.top
  FROM fx_known_pages p CROSS JOIN (VALUES (0,50,180),(1,50,200),(2,50,215),(3,150,200),(4,150,215),(5,250,200),(6,250,212),(7,250,220)) AS v(k, x0, top) WHERE doc_id%2=1 AND p.page IN (3, 5)) x WHERE text IS NOT NULL
"""
VIEWS["fx_known_blocks"] = """
SELECT * FROM fx_known_columns UNION ALL SELECT * FROM fx_known_labels
"""
# Documents of two templates, with every way in which a page, region, table, header, value or related row can fail.
VIEWS["fx_tp_docs"] = """
SELECT DISTINCT certificate_id AS doc_id, CASE WHEN certificate_id%3=1 THEN 2 ELSE 1 END AS template_id FROM fx_raw_rows
"""
VIEWS["fx_tp_pages"] = """
SELECT doc_id, 1 AS page, doc_id%29<>0 AS readable, true AS has_content FROM fx_tp_docs UNION ALL SELECT doc_id, 2, true, doc_id%10=0 FROM fx_tp_docs WHERE doc_id%2=0
"""
VIEWS["fx_tp_blocks"] = """
SELECT doc_id, 1 AS page, 1 AS block_id, CASE WHEN template_id=2 THEN concat('R', CAST(doc_id AS VARCHAR(20))) ELSE concat('C-', CAST(doc_id AS VARCHAR(20))) END AS text, CAST(10 AS DOUBLE) AS x0, CAST(60 AS DOUBLE) AS x1, CAST(5 AS DOUBLE) AS top, CAST(15 AS DOUBLE) AS bottom FROM fx_tp_docs WHERE template_id=2 OR doc_id%12<>0
UNION ALL SELECT doc_id, 1, 2, CASE WHEN template_id=2 THEN '1200' WHEN doc_id%2=0 THEN 'COIL' ELSE '6,5' END, CAST(210 AS DOUBLE), CAST(CASE WHEN template_id=2 AND doc_id%4=0 THEN 320 ELSE 260 END AS DOUBLE), CAST(5 AS DOUBLE), CAST(15 AS DOUBLE) FROM fx_tp_docs
UNION ALL SELECT doc_id, 2, 3, CASE WHEN doc_id%8=2 THEN '2 in' ELSE '1.5' END, CAST(10 AS DOUBLE), CAST(60 AS DOUBLE), CAST(5 AS DOUBLE), CAST(15 AS DOUBLE) FROM fx_tp_docs WHERE template_id=2 AND doc_id%2=0
"""
VIEWS["fx_tp_tables"] = """
SELECT doc_id, 1 AS page, v.k AS table_idx, CAST(CASE v.k WHEN 0 THEN 10 WHEN 1 THEN 460 WHEN 2 THEN 710 ELSE 600 END AS DOUBLE) AS x0, CAST(CASE v.k WHEN 0 THEN 390 WHEN 1 THEN 640 WHEN 2 THEN CASE WHEN doc_id%11=5 THEN 950 ELSE 890 END ELSE 690 END AS DOUBLE) AS x1,
 CAST(110 AS DOUBLE) AS top, CAST(800 AS DOUBLE) AS bottom, CASE WHEN v.k=2 AND doc_id%17=6 THEN 0 ELSE 100 END AS n_rows FROM fx_tp_docs CROSS JOIN (VALUES (0),(1),(2),(3)) AS v(k) WHERE template_id=1 AND (v.k<3 OR doc_id%7=3)
"""
VIEWS["fx_tp_cells"] = """
SELECT doc_id, 1 AS page, t AS table_idx, 0 AS row_idx, c AS col_idx, CASE WHEN t=0 AND c=4 THEN CASE WHEN doc_id%13=4 THEN 'WIDTH' ELSE 'Notes' END ELSE h END AS text
 FROM fx_tp_docs CROSS JOIN (VALUES (0,0,'Coil'),(0,1,'Heat'),(0,2,'Width '),(0,3,'YP'),(0,4,''),(1,0,'Heat'),(1,1,'C'),(2,0,'Coil'),(2,1,'YP'),(2,2,'EL')) AS v(t,c,h) WHERE template_id=1
UNION ALL SELECT certificate_id, 1, 0, CAST(row_pos*2 AS INT), c, CASE c WHEN 0 THEN concat('K', CAST(product_id AS VARCHAR(20))) WHEN 1 THEN concat('H', CAST(heat_id AS VARCHAR(20))) WHEN 2 THEN width_raw WHEN 3 THEN CASE WHEN product_id%10=0 THEN '300' END ELSE 'n' END FROM fx_raw_rows CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS v(c) WHERE certificate_id%3<>1
UNION ALL SELECT certificate_id, 1, 0, CAST(row_pos*2+1 AS INT), 0, ' ' FROM fx_raw_rows WHERE certificate_id%3<>1
UNION ALL SELECT certificate_id, 1, 1, CAST(1 + (heat_id%10)*2 + k AS INT), c, CASE c WHEN 0 THEN concat('H', CAST(heat_id AS VARCHAR(20))) ELSE CASE WHEN heat_id%6=5 THEN 'x' ELSE '13' END END FROM (SELECT DISTINCT certificate_id, heat_id FROM fx_raw_rows) h CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) AS v(k,c) WHERE certificate_id%3<>1 AND heat_id%9<>0 AND (k=0 OR heat_id%8=1)
UNION ALL SELECT doc_id, 1, 1, 50, c, CASE c WHEN 0 THEN 'H0' ELSE '13' END FROM fx_tp_docs CROSS JOIN (VALUES (0),(1)) AS v(c) WHERE template_id=1 AND doc_id%5=0
UNION ALL SELECT certificate_id, 1, 2, CAST(row_pos AS INT), c, CASE c WHEN 0 THEN concat('K', CAST(product_id AS VARCHAR(20))) WHEN 1 THEN '355' ELSE '28.5' END FROM fx_raw_rows CROSS JOIN (VALUES (0),(1),(2)) AS v(c) WHERE certificate_id%3<>1 AND product_id%21<>0
"""
VIEWS["fx_table_cells"] = """
SELECT c.cell_id - c.cell_id%8 AS doc_id, 1 AS page, 0 AS table_idx, CAST(floor((c.cell_id%8)/4.0) AS INT) AS row_idx, CAST(c.cell_id%4 AS INT) AS col_idx, c.header AS text FROM fx_header_cells c
UNION ALL SELECT c.cell_id - c.cell_id%8, 1, 0, CAST(2 + floor((c.cell_id%8)/2.0) AS INT), CAST(k AS INT), CASE WHEN k = 3 THEN '' WHEN c.cell_id%8 = 4 AND k = 0 THEN 'Total' ELSE concat('X', CAST(c.cell_id*10+k AS VARCHAR(20))) END FROM fx_header_cells c CROSS JOIN (VALUES (0),(1),(2),(3)) AS v(k) WHERE c.cell_id%2 = 0
"""


VIEWS["fx_quality_certificates"] = """
SELECT certificate_id, document_id, stored_file_id, certificate_no, CAST(manufacturer_id AS VARCHAR(20)) AS supplier, standard, approval_status, processing_status, archived, certificate_date, uploaded_at, manufacturer_id FROM fx_certificates
"""
VIEWS["fx_quality_heats"] = """
SELECT heat_id, certificate_id, CASE WHEN certificate_id%3=0 THEN concat('S', CAST(certificate_id AS VARCHAR(20))) ELSE heat_no END AS heat_no, standard, CAST(NULL AS VARCHAR(20)) AS grade FROM fx_heats WHERE heat_id%61 <> 0
"""
VIEWS["fx_quality_products"] = """
SELECT product_id, certificate_id, heat_id, heat_no, product_identifier, form, coiled, CASE WHEN product_id%67=0 THEN 'n/a' WHEN product_id%71=0 THEN '0' ELSE CAST(thickness_mm AS VARCHAR(30)) END AS thickness_mm, CAST(width_mm AS VARCHAR(30)) AS width_mm,
 CASE WHEN product_id%3=0 THEN NULL WHEN product_id%73=0 THEN '-2' ELSE '6.5' END AS length_m, CASE WHEN product_id%79=0 THEN '0' WHEN product_id%83=0 THEN NULL ELSE CAST(weight_kg AS VARCHAR(30)) END AS weight_kg FROM fx_products
"""
VIEWS["fx_quality_compositions"] = """
SELECT CAST(floor(heat_id/10) AS BIGINT) AS certificate_id, heat_id, CAST(NULL AS BIGINT) AS product_id, element, CASE WHEN heat_id%211=0 AND element='Mn' THEN '150' WHEN heat_id%223=0 AND element='Si' THEN '-1' WHEN heat_id%229=0 AND element='Ti' THEN 'tr' WHEN heat_id%227=0 AND element IN ('Cr','Ni','Co') THEN '40' ELSE CAST(percentage AS VARCHAR(30)) END AS percentage
FROM fx_compositions WHERE heat_id%59 <> 0
"""
VIEWS["fx_quality_observations"] = """
SELECT observation_id, CAST(floor(product_id/10) AS BIGINT) AS certificate_id, CASE WHEN observation_id%5=0 THEN NULL ELSE product_id END AS product_id, CASE WHEN observation_id%3=0 THEN product_id*10 ELSE NULL END AS heat_id, field_path, confidence, unit,
 CASE observation_id%7 WHEN 0 THEN 'captura_manual' WHEN 1 THEN 'OCR cell' ELSE 'text' END AS source_text, observation_id%8=0 AS inherited FROM fx_observations
"""
VIEWS["fx_results"] = """
SELECT p.product_id*10 + r.run_id%10 AS result_id, r.run_id, p.product_id, p.certificate_id, CASE WHEN p.product_id%6=0 THEN NULL WHEN p.product_id%5=0 THEN '72091601' WHEN p.product_id%5=1 THEN '72091701' ELSE '72083901' END AS fraction,
 CASE WHEN p.product_id%6=0 THEN NULL WHEN p.product_id%4=0 THEN '99' ELSE '01' END AS nico, CASE WHEN p.product_id%6=0 THEN 'needs_review' ELSE 'classified' END AS outcome FROM fx_products p JOIN fx_runs r ON r.certificate_id = p.certificate_id WHERE p.product_id%43 <> 0
"""
VIEWS["fx_candidates"] = """
SELECT r.result_id*10 + k AS candidate_id, r.result_id, CASE WHEN r.product_id%37=0 AND k=2 THEN 4 ELSE k END AS rank, CASE k WHEN 1 THEN coalesce(r.fraction, '72091801') WHEN 2 THEN '72091801' ELSE '72092501' END AS fraction, CASE k WHEN 1 THEN coalesce(r.nico, '01') WHEN 2 THEN '99' ELSE '00' END AS nico,
 r.product_id%47=0 AND k=3 AS manual, r.product_id%29=0 AND k=1 AS has_conflicts FROM fx_results r CROSS JOIN (VALUES (1),(2),(3)) AS v(k) WHERE k <= 1 + r.product_id%3
"""
VIEWS["fx_factors"] = """
SELECT candidate_id*10 + k AS factor_id, candidate_id, k AS sequence, concat('rule.', CAST(candidate_id%7 AS VARCHAR(5)), '.', CAST(k AS VARCHAR(5))) AS rule_code, CASE WHEN candidate_id%31=0 AND k=2 THEN 'conflict' WHEN k=3 THEN 'unknown' ELSE 'matched' END AS outcome, k <> 3 AS required_for_selection
FROM fx_candidates CROSS JOIN (VALUES (1),(2),(3)) AS v(k) WHERE k <= 1 + candidate_id%3
"""
VIEWS["fx_choices"] = """
SELECT c.candidate_id*4 + v.k AS selection_id, c.result_id, c.candidate_id, CASE WHEN v.k > 0 THEN c.candidate_id*4 + v.k - 1 END AS supersedes_selection_id, concat('person', CAST(c.candidate_id%5 AS VARCHAR(5))) AS person_name, c.result_id%19=0 AS selection_cleared
FROM fx_candidates c CROSS JOIN (VALUES (0),(1)) AS v(k) WHERE c.rank = 1 AND c.result_id%2 = 0 AND v.k <= c.candidate_id%2
"""
VIEWS["fx_approval_events"] = """
SELECT r.run_id*4 + k AS event_id, r.run_id, r.certificate_id, CASE (r.run_id + k*k)%4 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'draft' END AS to_status FROM fx_runs r CROSS JOIN (VALUES (0),(1),(2),(3)) AS v(k) WHERE k <= r.run_id%4
"""
VIEWS["fx_links"] = """
SELECT f.factor_id*10 + 1 AS link_id, f.factor_id, o.observation_id, 'observation' AS source_type FROM fx_factors f JOIN fx_candidates c ON c.candidate_id = f.candidate_id JOIN fx_results r ON r.result_id = c.result_id JOIN fx_observations o ON o.product_id = r.product_id AND o.is_current
"""


VIEWS["fx_tariff_rows"] = """
SELECT 1 AS source_id, p_partkey AS position, CASE WHEN p_partkey%60=1 THEN concat('72.', CAST(10 + p_partkey%80 AS VARCHAR(5))) WHEN p_partkey%12=2 THEN concat('72', CAST(10 + p_partkey%80 AS VARCHAR(5)), '.', CAST(10 + p_partkey%7 AS VARCHAR(5)))
 WHEN p_partkey%4=3 THEN concat('72', CAST(10 + p_partkey%80 AS VARCHAR(5)), '.', CAST(10 + p_partkey%7 AS VARCHAR(5)), '.0', CAST(p_partkey%9 AS VARCHAR(5))) WHEN p_partkey%97=0 THEN 'CÓDIGO' ELSE '' END AS code,
 CASE WHEN p_partkey%3=0 THEN concat('0', CAST(p_partkey%9 AS VARCHAR(5))) WHEN p_partkey%5=0 THEN '--' ELSE '' END AS marker, CASE WHEN p_partkey%53=0 THEN '' WHEN p_partkey%59=0 THEN 'CUOTA (ARANCEL)' ELSE p_name END AS description FROM part
"""
VIEWS["fx_rule_log"] = """
SELECT event_id AS log_id, user_id AS rule_set_id, CASE event_type WHEN 'click' THEN 'draft' WHEN 'view' THEN 'approved' ELSE 'retired' END AS status, 'rules' AS name, CAST(event_id%2 AS VARCHAR(5)) AS version, CAST(event_id%3 AS VARCHAR(5)) AS manifest FROM events
"""
VIEWS["fx_uploads"] = """
SELECT event_id AS document_id, ts AS uploaded_at, concat('h', CAST(user_id*7 + event_id%5 AS VARCHAR(20))) AS sha256 FROM events
"""


VIEWS["fx_sheet_cells"] = """
SELECT concat('S', CAST(s AS VARCHAR(5))) AS sheet, 1 AS row, CAST(k AS INT) AS col, CASE k WHEN 1 THEN 'WIDTH(MM)' WHEN 2 THEN 'THICK (MM)' WHEN 3 THEN 'PRODUCTION NAME' WHEN 4 THEN 'COIL WEIGHT(MT)' WHEN 5 THEN 'C' WHEN 6 THEN 'MN' WHEN 7 THEN CASE WHEN s%4=0 THEN 'C' ELSE 'NOTE' END ELSE 'HEAT NO' END AS value, false AS is_formula
FROM (SELECT DISTINCT certificate_id%20 AS s FROM fx_products) x CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) AS v(k)
UNION ALL SELECT concat('S', CAST(certificate_id%20 AS VARCHAR(5))), CAST(product_id+10 AS INT), CAST(k AS INT), CASE k WHEN 1 THEN CASE WHEN product_id%50=0 THEN '0' ELSE CAST(width_mm AS VARCHAR(30)) END WHEN 2 THEN CAST(thickness_mm AS VARCHAR(30)) WHEN 3 THEN CASE product_id%4 WHEN 0 THEN 'HOT ROLLED STEEL COIL' WHEN 1 THEN 'COLD-ROLLED SHEET' WHEN 2 THEN 'PLATE' ELSE 'bar' END
 WHEN 4 THEN CAST(product_id%30 AS VARCHAR(10)) WHEN 5 THEN CASE WHEN product_id%23=0 THEN '150' ELSE '0.05' END WHEN 6 THEN '=A1' WHEN 7 THEN '0.06' ELSE heat_no END, k = 6 FROM fx_products CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) AS v(k)
"""
VIEWS["fx_spec_cells"] = """
SELECT concat('P', CAST(g AS VARCHAR(5))) AS sheet, CAST(2 AS INT) AS row, CAST(k AS INT) AS col, CASE k WHEN 1 THEN 'SPEC' WHEN 2 THEN 'ALLOY OR NON-ALLOY' ELSE 'YIELD POINT (MPa)' END AS value, false AS is_formula FROM (SELECT DISTINCT p_partkey%10 AS g FROM part) x CROSS JOIN (VALUES (1),(2),(3)) AS v(k)
UNION ALL SELECT concat('P', CAST(p_partkey%10 AS VARCHAR(5))), CAST(p_partkey+10 AS INT), CAST(k AS INT), CASE k WHEN 1 THEN p_brand WHEN 2 THEN CASE WHEN p_partkey%20 < 10 THEN concat('ALLOY ', CAST(p_partkey%3 AS VARCHAR(5))) END ELSE CASE p_partkey%3 WHEN 0 THEN '>=355' WHEN 1 THEN '≤ 400' ELSE 'n/a' END END, false FROM part CROSS JOIN (VALUES (1),(2),(3)) AS v(k)
"""
VIEWS["fx_spec_merges"] = """
SELECT concat('P', CAST(p_partkey%10 AS VARCHAR(5))) AS sheet, CAST(p_partkey+10 AS INT) AS min_row, CAST(p_partkey+20 AS INT) AS max_row, 2 AS min_col, 2 AS max_col FROM part WHERE p_partkey%20 < 10
"""
VIEWS["fx_label_blocks"] = """
SELECT doc_id, 1 AS page, k AS block_id, CASE k WHEN 1 THEN CASE doc_id%3 WHEN 0 THEN concat('Certificate No: C-', CAST(doc_id AS VARCHAR(20))) WHEN 1 THEN concat('Certificado No C-', CAST(doc_id AS VARCHAR(20))) ELSE 'Certificate Number' END WHEN 2 THEN CASE WHEN doc_id%3=2 THEN concat('N-', CAST(doc_id AS VARCHAR(20))) ELSE 'free words' END
 WHEN 3 THEN CASE WHEN doc_id%4=0 THEN 'Supplier: Acme' ELSE 'Manufacturer' END WHEN 4 THEN 'Acme Steel' WHEN 5 THEN CASE WHEN doc_id%5=0 THEN 'Fabricante: Otro' ELSE 'Grand total 5' END ELSE CASE WHEN doc_id%2=0 THEN 'Customer: see notes' ELSE 'Norma ASTM' END END AS text,
 CAST(CASE k WHEN 2 THEN 205 ELSE 100 END AS DOUBLE) AS x0, CAST(CASE k WHEN 2 THEN 260 ELSE 200 END AS DOUBLE) AS x1, CAST(CASE k WHEN 2 THEN 100 WHEN 4 THEN 315 ELSE 100*k END AS DOUBLE) AS top, CAST(CASE k WHEN 2 THEN 112 WHEN 4 THEN 327 ELSE 100*k+12 END AS DOUBLE) AS bottom, CAST(600 AS DOUBLE) AS page_width, CAST(800 AS DOUBLE) AS page_height
FROM documents CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6)) AS v(k)
"""

VIEWS["fx_scripts"] = """
SELECT doc_id, concat(CASE doc_id%12 WHEN 0 THEN 'Ｃｏｉｌ　Ｎｏ．１２' WHEN 1 THEN 'ﬁne ﬂow Ⅷ ½' WHEN 2 THEN 'STRASSE Straße' WHEN 3 THEN 'Ελλάδα ΌΣΟΣ' WHEN 4 THEN 'Ёлка — Й' WHEN 5 THEN '㎏ ㎜² ℃' WHEN 6 THEN '𝐁𝐨𝐥𝐝 ①②' WHEN 7 THEN 'Naïve_Ünïcode ǅ'
 WHEN 8 THEN 'ｶﾞｽ 炉号' WHEN 9 THEN 'Límite-Elástico (MPa)' WHEN 10 THEN 'été ö' ELSE 'plain ASCII, no. 7' END, ' ', CAST(doc_id AS VARCHAR(20))) AS text FROM documents
"""
VIEWS["fx_exports"] = """
SELECT h.heat_id AS export_id, h.heat_id, h.certificate_id, h.certificate_id*10 AS run_id, h.heat_id%3 AS kind, CASE WHEN h.heat_id%4=0 THEN 100 + h.heat_id%50 END AS stored_file_id FROM fx_heats h WHERE h.heat_id%5=0
"""
VIEWS["fx_document_jobs"] = """
SELECT certificate_id*2 AS job_id, document_id, CAST(NULL AS BIGINT) AS export_id, CASE WHEN certificate_id%9=0 THEN 'running' ELSE 'succeeded' END AS status FROM fx_certificates
UNION ALL SELECT -export_id, CAST(NULL AS BIGINT), export_id, 'queued' FROM fx_exports
"""


def needed(sql: str, names=None) -> list[str]:
    """Views that a statement reaches, in definition order."""
    names = VIEWS if names is None else names
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in names:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(names[name])

    visit(sql)
    order: list[str] = []

    def place(name: str) -> None:
        for other in names:
            if other != name and other in seen and re.search(rf"\b{other}\b", names[name]):
                place(other)
        if name not in order:
            order.append(name)

    for name in names:
        if name in seen:
            place(name)
    return order


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    """One self-contained statement: the views it reaches become CTEs in front of it."""
    names = {**VIEWS, **(extra or {})}
    chain = needed(sql, names)
    if not chain:
        return sql
    body = sql.strip()
    text = "\n".join([body, *(names[name] for name in chain)])
    shared = {name: " MATERIALIZED" if len(re.findall(rf"\b{name}\b", text)) > 1 else "" for name in chain}
    ctes = ",\n".join(f"{name} AS{shared[name]} ({names[name].strip()})" for name in chain)
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{body[len('with recursive'):].lstrip()}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    """A fixture view (or a driver table) as a DataFrame; nothing runs until an action. ``written`` holds views that a query has written."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    built: dict[str, DataFrame] = dict(written or {})
    if name in built:
        return built[name]
    for step in needed(VIEWS[name]) + [name]:
        if step in built:
            continue
        text = VIEWS[step]
        inputs = {n: built[n] for n in built if re.search(rf"\b{n}\b", text)}
        inputs.update({n: table(spark, sf_dir, n) for n in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text)})
        for n in inputs:
            text = re.sub(rf"\b(FROM|JOIN)(\s+\(?\s*){n}\b", rf"\1\2{{{n}}}", text)
        built[step] = spark.sql(text, **inputs)
    return built[name]
