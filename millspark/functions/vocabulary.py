"""Words of certificate headers, labels and titles (fixed values), and small tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: column headers, in the order that decides between them ---
HEADER_WORDS = """
product_id product_id: coil, roll, plate, placa, sheet, hoja, coil no, coil number, coil id, pack no, package no, bundle no, bundle, roll no, item no, lot no, piece no, rollo, paquete, bulto, lote, pieza, rollo no, no rollo, no coil, 钢卷号, 卷号, 捆号, 件号, product no, product number, label no, material no, 产品序号, 物料号, labelno, 產品序號
heat_no heat_no: heat, cast, melt, charge, heat no, heat number, cast no, melt no, charge no, colada, numero de colada, colada no, no colada, no heat, 炉号, 熔炼号, 浇铸号
dimension quantity: quantity, qty, 件数, 數量
dimension coating_superior_g_m2: superior, top coating, upper coating
dimension coating_inferior_g_m2: inferior, bottom coating, lower coating
dimension thickness_mm: thickness, thick, gauge, espesor, calibre, 厚度, size, dimensions, 规格
dimension width_mm: width, ancho, anchura, 宽度
dimension length_m: length, largo, longitud, 长度
dimension weight_kg: weight, mass, net weight, gross weight, peso, peso neto, peso bruto, masa, 重量, 净重, 毛重
mechanical yield_strength_mpa: yield strength, yield point, proof stress, limite elastico, fluencia, 屈服强度, y s, ys, yp
mechanical tensile_strength_mpa: tensile strength, resistencia a la traccion, resistencia traccion, 抗拉强度, t s, ts
mechanical elongation_pct: elongation, alargamiento, elongacion, 伸长率, el
mechanical hardness_hrb: hardness, dureza, 硬度, rb, hrb
"""
# Whole-header words that come before every other rule.
WHOLE_HEADERS = {"widt": "width_mm", "宽度": "width_mm", "寬度": "width_mm", "lengt": "length_m", "長度": "length_m"}

# --- fixed values: element names ---
ELEMENT_WORDS = """
C: c, carbon, carbono, 碳
Si: si, silicon, silicio, 硅
Mn: mn, manganese, manganeso, 锰
P: p, phosphorus, fosforo, 磷
S: s, sulfur, azufre, 硫
Al_soluble: als, soluble al, solubleal, 酸溶铝
Al_total: alt, total al, totalal, 全铝, al, a1, aluminium, aluminum, aluminio, 铝
Ti: ti, titanium, titanio, 钛
Cu: cu, copper, cobre, 铜
Ni: ni, nickel, niquel, 镍
Cr: cr, chromium, cromo, 铬
Mo: mo, molybdenum, molibdeno, 钼
B: b, boron, boro, 硼
N: n, nitrogen, nitrogeno, 氮
V: v, vanadium, vanadio, 钒
Nb: nb, cb, niobium, columbium, niobio, 铌
Ca: ca, calcium, calcio, 钙
"""

# --- fixed values: fields of unseen layouts ---
FIELD_WORDS = """
product_id: coil no, coil number, coil id, pack no, roll no, bundle no
heat_no: heat no, heat number, cast no, melt no, charge no, colada, 炉号
thickness_mm: thick, thickness, gauge, espesor
width_mm: width, ancho
length_raw: length, largo, longitud
weight_kg: weight, mass, net weight, gross weight, peso, 重量
chemistry: chemical composition, chemical analysis, ladle analysis, composicion quimica, 化学成分
standard: standard, specification, spec, grade, norma
yield_strength_mpa: yield point, yield strength, proof stress, limite elastico
tensile_strength_mpa: tensile strength, resistencia a la traccion
"""
TITLES = ("mill test certificate", "mill certificate", "inspection certificate", "certificate of quality",
          "material test certificate", "test certificate", "certificado de molino", "质量证明书")

# --- fixed values: metadata labels ---
METADATA_WORDS = """
certificate_no: certificate no, cert no, certificate number, inspection certificate no, no de certificado, certificado no, numero de certificado, acta no, 证书编号, 证明书号, 质保书号
supplier: manufacturer, supplier, maker, producer, fabricante, proveedor, planta, molino, 制造厂, 生产厂, 制造者
standard: standard, specification, spec, grade, norma, especificacion, grado, calidad, 标准, 牌号, 执行标准, 規格名稱, 规格名称
issue_date: issue date, date of issue, fecha de emision, fecha del acta, 签发日期
shipping_date: shipping date, shipment date, fecha de embarque, 交运日期
delivery_date: delivery date, fecha de entrega, 出厂日期
product_name: product description, product name, commodity, descripcion del producto, producto declarado
customer: customer, consignee, buyer, purchaser, cliente, destinatario, comprador, 订货单位, 收货单位, 客户名称, 客戶名稱
"""

# --- fixed values: words beside labels and identifiers that are neither ---
NOT_LABELS = ("standard technique", "customer no", "customer number", "customer id")
TOTAL_STARTS = ("sub total", "grade total", "grand total")
NOT_IDENTIFIERS = ("standard", "specification", "grade", "norma", "especificacion")
ROLL_HEADERS = ("coil no", "coilno", "product no", "productno")
PACK_HEADERS = ("pack no",)
LABEL_HEADERS = ("label no", "labelno")
GROSS_WORDS = ("gross", "bruto", "毛重")
PLAIN_ELEMENTS = ("C", "Mn", "Si", "P", "Alt", "Als")

# --- fixed values: condition words of rolls ---
PICKLED = ("pickled", "decapado")
NOT_PICKLED = ("not_pickled", "unpickled", "sin decapar")

# --- fixed values: profiles of known layouts (required; weighted; negative signals) ---
PROFILES = (
    ("ARCELORMITTAL_CALVERT", ("arcelormittal calvert", "mill certificate"),
     (("chemical composition of the coil", 0.20), ("steel grade customer specification", 0.20), ("tensile test", 0.10)), ()),
    ("MOLINO_1_BX_POSCO", ("bx steel posco",),
     (("bta blz112", 0.20), ("cold rolled steel strip", 0.15), ("e02511200001", 0.15), ("astm a1008", 0.10)), ("bengang", "china steel", "secc")),
    ("MOLINO_2_BENGANG", ("bengang",),
     (("e02604270139", 0.20), ("sae1010mod", 0.20), ("cold rolled steel strip", 0.15), ("bta blz043", 0.15)), ("bx steel posco", "china steel", "secc")),
    ("MOLINO_3_CHINA_STEEL", ("china steel corporation",),
     (("sae 1035", 0.20), ("150612h0039", 0.20), ("hanwa", 0.15), ("mill edge", 0.10)), ("bengang", "posco", "secc")),
    ("MOLINO_4_POSCO_EG", ("posco", "secc"),
     (("eg coil", 0.20), ("240816 fz01ps", 0.20), ("cr free phosphate", 0.15), ("ladle", 0.10)), ("bengang", "china steel", "bta blz112")),
)
PROFILE_THRESHOLD = 0.85


def word_lists(text: str) -> list[tuple[str, str, int]]:
    """(name, word, position) for lines of the form 'name: word, word'."""
    rows = []
    for line in text.strip().splitlines():
        name, words = line.split(":", 1)
        rows += [(name, word.strip(), len(rows) + i) for i, word in enumerate(words.split(","))]
    return rows


def header_aliases(spark: SparkSession) -> DataFrame:
    """alias, its compact form, category, key and precedence of table headers (a literal table)."""
    rows = []
    for name, word, position in word_lists(HEADER_WORDS):
        category, key = name.split()
        rows.append((word, word.replace(" ", ""), category, key, position + 10))
    rows += [(word, word, "dimension", key, 0) for word, key in WHOLE_HEADERS.items()]
    return spark.createDataFrame(rows, "alias string, compact string, category string, key string, precedence int")


def element_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, e) for e, w, _ in word_lists(ELEMENT_WORDS)], "word string, element string")
