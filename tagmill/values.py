"""Fixed values of the label model: names, weights and word lists that results depend on."""

from __future__ import annotations

#: Fixed value: the maker's mark printed on the labels. Patterns take it from here.
BRAND = "IKEA"

#: Text fields in the order of the catalogue, with their names.
TEXT_FIELDS = (
    ("product_name", "Product name"),
    ("product_dimensions_metric", "Dimensions (metric)"),
    ("product_dimensions_imperial", "Dimensions (imperial)"),
    ("article_number", "Article number"),
    ("article_code", "Article code"),
    ("internal_item_number", "Internal item no."),
    ("quantity_multiplier", "Quantity multiplier"),
    ("gross_weight", "Gross weight"),
    ("net_weight", "Net weight"),
    ("package_number", "Package number"),
    ("package_type", "Package type"),
    ("copy_count_inline", "Copy (inline)"),
    (f"{BRAND.lower()}_logo", f"{BRAND} logo"),
    ("ean_barcode_value", "EAN-13 value (text)"),
    ("itf14_human_readable", "ITF-14 human readable"),
    ("ai_240", "AI(240)"),
    ("ai_13", "AI(13)"),
    ("ai_11", "AI(11)"),
    ("ai_10", "AI(10)"),
    ("human_readable_date", "Human-readable date"),
    ("date_stamp", "Date stamp"),
    ("date_alpha_code", "Alpha code"),
    ("date_numeric_prefix", "Numeric prefix"),
    ("custom_identifier", "Custom identifier"),
    ("plant_identifier", "Plant identifier"),
    ("supplier_name", "Supplier name"),
    ("supplier_address", "Supplier address"),
    ("address_block", "Address block"),
    ("origin_text", "Origin"),
    ("copyright_notice", "Copyright"),
    ("compliance_marks", "Compliance marks"),
    ("age_rating", "Age rating"),
    ("copy_count", "Copy count"),
)
#: Barcode fields, after the text fields.
BARCODE_FIELDS = (("ean_barcode", "EAN-13 (decoded)"), ("itf14_barcode", "ITF-14 (decoded)"), ("datamatrix_barcode", "DataMatrix (decoded)"))
BARCODES = tuple(f for f, _ in BARCODE_FIELDS)
#: Older fields that labels still carry but the catalogue does not list.
LEGACY_FIELDS = ("dimensions", "weight", "patent_info")

#: Fields that count double, and once, in a label's confidence. Others don't count.
CORE = ("product_name", "article_number", "itf14_barcode")
STANDARD = (
    "product_dimensions_metric", "article_code", "internal_item_number", "quantity_multiplier", "gross_weight", "net_weight", "package_number", "package_type",
    "ean_barcode_value", "datamatrix_barcode", "human_readable_date", "plant_identifier", "supplier_name", "supplier_address", "address_block", "origin_text",
    "copyright_notice", "compliance_marks", "date_stamp", "custom_identifier", "copy_count",
)

#: The section of each field of the catalogue.
SECTIONS = {
    "identity": (
        "product_name", "product_dimensions_metric", "product_dimensions_imperial", "article_number", "article_code", "internal_item_number", "quantity_multiplier",
        f"{BRAND.lower()}_logo", "gross_weight", "net_weight", "package_number", "package_type",
    ),
    "barcodes": ("ean_barcode", "ean_barcode_value", "itf14_barcode", "itf14_human_readable", "datamatrix_barcode", "ai_240", "ai_13", "ai_11", "ai_10"),
    "date": ("human_readable_date", "date_stamp", "date_alpha_code", "date_numeric_prefix", "custom_identifier"),
    "address": ("plant_identifier", "supplier_name", "supplier_address", "address_block", "origin_text"),
    "compliance": ("copyright_notice", "compliance_marks", "age_rating"),
    "copy": ("copy_count", "copy_count_inline"),
}
#: The report shows one field under another section than its colour's.
REPORT_SECTION = {"copyright_notice": "address"}
#: Red, green and blue of each section.
COLOURS = {"identity": (59, 130, 246), "barcodes": (234, 88, 12), "address": (168, 85, 247), "compliance": (236, 72, 153), "date": (20, 184, 166), "copy": (245, 158, 11)}

#: Words that are never part of a product name.
STOP_WORDS = (
    "MADE", "IN", "OF", "THE", "AND", "OR", "FOR", "WITH", "BY", "AT",
    "ASSEMBLED", "REPUBLIC", "CHINA", "PEOPLE", "INTER",
    BRAND, "SWEDEN", "SE", "AB", "BV", "DATE", "ATE",
    "DESIGN", "QUALITY",
)

#: The slot of a decoded symbol by its type.
SYMBOLS = {"itf14": ("I25", "ITF", "ITF-14", "CODE-ITF"), "ean13": ("EAN13", "EAN-13"), "datamatrix": ("DataMatrix",)}

#: Fields that a label's specification must have, and the words allowed in them.
TEMPLATE_FIELDS = ("template_id", "display_name", "family", "source_evidence", "review_state")
ELEMENT_FIELDS = ("element_id", "label", "semantic_role", "type", "required", "content_type", "placement", "evidence")
RULE_FIELDS = ("rule_id", "rule_type", "scope", "condition", "target", "actions", "severity", "normalized_text", "evidence")
SPEC_FIELDS = ("spec_id", "spec_type", "standard", "evidence")
RULE_TYPES = (
    "presence_rule", "conditional_layout_transform", "alignment_rule", "placement_rule", "resize_rule", "orientation_rule", "application_method_rule", "symbol_logic_rule",
)
SEVERITIES = ("must", "should", "may")
#: The variants that a specification of a type should list.
SPEC_VARIANTS = {"datamatrix_rectangular": "x_dim_variants", "datamatrix_square": "x_dim_variants", "ean13": "height_variants", "ean13_80pct": "height_variants", "itf": "size_variants"}
