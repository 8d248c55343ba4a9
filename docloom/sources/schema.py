"""The canonical document: one fixed, versioned schema, always given to readers."""

from __future__ import annotations

SCHEMA_VERSION = "1.0.0"

_PARTY = "struct<name:string,address:string,tax_id:string,gstin:string,phone:string,email:string>"

DOCUMENT = f"""schema_version string, doc_id string,
source struct<dataset:string,original_id:string,split:string,license:string>,
language string, currency string, document_type string,
pages array<struct<page_index:int,image_path:string,width:int,height:int,dpi:int>>,
parties struct<vendor:{_PARTY},buyer:{_PARTY},ship_to:{_PARTY}>,
invoice_meta struct<invoice_number:string,invoice_date:string,due_date:string,po_number:string,payment_terms:string>,
line_items array<struct<line_no:int,description:string,hsn_sac_code:string,quantity:double,unit:string,unit_price:double,discount:double,tax_rate:double,tax_amount:double,line_total:double>>,
tax_lines array<struct<type:string,rate:double,amount:double>>,
totals struct<subtotal:double,discount_total:double,tax_total:double,shipping:double,round_off:double,grand_total:double,amount_in_words:string>,
payment_info struct<bank_name:string,account_number:string,ifsc_or_swift:string,upi_id:string,mode:string,terms:string>,
grounding array<struct<field_path:string,page_index:int,bbox:array<double>,confidence:double>>,
annotator struct<annotated_by:string,verified:boolean,notes:string>"""

MANIFEST = "doc_id string, profile string, image_path string, ocr_gold_path string, width int, height int, dpi int, n_words int, source string, degradations_applied array<string>, is_photograph boolean"

LEDGER_ENTRY = "description string, category string, vendor string, unit_price double, quantity double, line_total double, hsn_sac_code string, doc_id string"

PARTY_FIELDS = ["name", "address", "tax_id", "gstin", "phone", "email"]
#: Dotted paths of every scalar that is compared or routed, by root.
SCALAR_PATHS = (
    [f"parties.{p}.{f}" for p in ("vendor", "buyer", "ship_to") for f in PARTY_FIELDS]
    + [f"invoice_meta.{f}" for f in ("invoice_number", "invoice_date", "due_date", "po_number", "payment_terms")]
    + [f"totals.{f}" for f in ("subtotal", "discount_total", "tax_total", "shipping", "round_off", "grand_total", "amount_in_words")]
    + [f"payment_info.{f}" for f in ("bank_name", "account_number", "ifsc_or_swift", "upi_id", "mode", "terms")]
)

# Leaves that are compared as numbers and as dates, and the fields that make a document right.
NUMERIC_LEAVES = ["unit_price", "quantity", "discount", "tax_rate", "tax_amount", "line_total", "subtotal", "discount_total", "tax_total", "shipping", "round_off", "grand_total", "amount", "rate"]
DATE_LEAVES = ["invoice_date", "due_date"]
CRITICAL_PATHS = ["invoice_meta.invoice_number", "invoice_meta.invoice_date", "totals.grand_total", "parties.vendor.name"]
TAX_TYPES = ["CGST", "SGST", "IGST", "CESS", "VAT", "GST", "OTHER"]
#: Keys that a document must have, null or not.
REQUIRED_KEYS = ["schema_version", "doc_id", "source", "document_type", "pages", "parties", "invoice_meta", "line_items", "totals"]
REQUIRED_NULLABLE = ["invoice_meta.invoice_number", "invoice_meta.invoice_date", "totals.grand_total"]
