"""Vocabularies and normalisers as Column expressions; each passes nulls through unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The aliases of each product relation.
RELATION_ALIASES = {
    "reads": ["read", "reads", "field_get", "field_read", "field_mask", "field_shift"],
    "writes": ["write", "writes", "field_write", "field_value"],
    "sets_field": ["field_set", "sets_field", "set_field", "sets_field_value", "reg_set_field", "read_modify_write", "read_modify_writes"],
    "maps_base": ["maps_base", "map_base", "address", "offset", "maps_offset"],
    "calls": ["calls", "call"],
    "contains": ["contains", "contains_box"],
    "documents": ["documents", "documents_register", "documented_by", "section_mentions", "explains"],
    "depends_on": ["depends_on", "requires"],
    "configures": ["configures", "programs"],
    "resets": ["resets", "reset"],
}
# Relations that only tell where something was seen.
PROVENANCE_RELATIONS = ["appears_in_code", "appears_in_doc", "appears_in_pdf", "defined_in", "has_field", "wraps"]
# Parts of a name that make it a field, and those that make it a register.
FIELD_NAME = "ENABLE|DISABLE|PENDING|MASK|SHIFT|RESET_REQUEST|INVALIDATE"
REGISTER_NAME = "CNTL|CONTROL|STATUS|RESET|BASE|SIZE|VMID|DOORBELL|HQD|MQD|WPTR|RPTR|QUEUE"
# Hardware blocks, in the order they are looked for.
IP_BLOCKS = ["GC", "GMC", "CP", "SDMA", "BIF", "RLC", "GDS", "IH", "NBIO"]


def slug(col: Column, sign: str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", sign), F.lit(sign))


def relation(col: Column) -> Column:
    """One of the product relations; null for provenance-only relations; anything else relates_to."""
    name = slug(col, "_")
    out = F.when(name.isin(PROVENANCE_RELATIONS), F.lit(None).cast("string"))
    for target, names in RELATION_ALIASES.items():
        out = out.when(name.isin(names), target)
    return F.when(col.isNotNull(), out.otherwise("relates_to"))


def graph_kind(col: Column) -> Column:
    name = F.lower(col)
    out = F.when(name.isin("function", "func"), "function").when(name == "register", "register").when(name.isin("macro", "context"), "macro")
    out = out.when(name == "field", "field").when(name.isin("doc_section", "section"), "doc_section").when(name.isin("pdf_section", "pdf_page"), "pdf_section")
    return out.when(name == "doc", "doc").when(name == "pdf", "pdf").when(name.isin("doc_box", "box"), "doc_box").otherwise("code")


def kind_from_symbol(symbol: Column) -> Column:
    """Graph kind of a bare symbol, by file anchors first and name parts after."""
    low = F.lower(symbol)
    return (
        F.when(low.rlike(r"\.(?:md|rst|txt|pdf)#box-"), "doc_box")
        .when(low.rlike(r"\.(?:md|rst|txt)#"), "doc_section")
        .when(low.contains(".pdf#"), "pdf_section")
        .when(low.rlike(r"\.(?:md|rst|txt)$"), "doc")
        .when(low.endswith(".pdf"), "pdf")
        .when(symbol.rlike(FIELD_NAME + "|FIELD"), "field")
        .when(symbol.startswith("CP_HQD_") | symbol.rlike("^(?:reg|mm|smn)[A-Z]|CNTL|CONTROL|STATUS|RESET|BASE|SIZE|VMID|DOORBELL|QUEUE|REGISTER"), "register")
        .otherwise("code")
    )


def canonical_register(symbol: Column) -> Column:
    """The name without its access prefix, where an upper-case letter follows."""
    return F.regexp_replace(symbol, "^(reg|mm|smn)(?=[A-Z])", "")


def ip_block(symbol: Column, path: Column) -> Column:
    """First hardware block named in symbol or path; empty if none."""
    text = F.upper(F.concat_ws(" ", symbol, path))
    out = F.when(F.lit(False), "")
    for b in IP_BLOCKS:
        out = out.when(text.contains(b), b)
    return out.otherwise("")


def ip_version(path: Column) -> Column:
    """`a.b` of a version such as v11_0 or _10.3 in a path; empty if none."""
    return F.when(path.rlike(r"(?:v|_)(\d{1,2})[_.-](\d)"), F.concat_ws(".", F.regexp_extract(path, r"(?:v|_)(\d{1,2})[_.-](\d)", 1), F.regexp_extract(path, r"(?:v|_)(\d{1,2})[_.-](\d)", 2))).otherwise("")


def language(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(r"\.(?:c|h)$"), "c").when(low.rlike(r"\.(?:cc|cpp|hpp|cxx|hh)$"), "cpp").when(low.endswith(".py"), "python").otherwise("unknown")


def source_type(path: Column) -> Column:
    """pdf, doc, register or code, by suffix and folder."""
    low = F.lower(path)
    register = low.endswith(".h") & (low.contains("/asic_reg/") | low.contains("/register") | low.rlike("(?:_offset|_sh_mask|_d)[.]h$"))
    return F.when(low.endswith(".pdf"), "pdf").when(low.rlike("[.](?:md|rst|txt)$"), "doc").when(register, "register").otherwise("code")


def job_status(col: Column) -> Column:
    """queued, indexing, succeeded, failed or superseded; every unknown status, null too, counts as succeeded."""
    s = F.lower(F.trim(col))
    return (
        F.when(s.isin("running", "started", "in_progress", "indexing"), "indexing").when(s.isin("error", "failed"), "failed").when(s.isin("queued", "superseded"), s).otherwise("succeeded")
    )


def repository(col: Column) -> Column:
    """Name without `.git`; null and blank become `unknown`."""
    name = F.regexp_replace(F.trim(col), "[.]git/?$", "")
    return F.when(F.length(name) > 0, name).otherwise("unknown")


def heading(text: Column) -> Column:
    """First markdown heading, with or without the stored line prefix; empty if none. Line ends may be LF, CRLF or CR."""
    return F.trim(F.regexp_extract(F.regexp_replace(text, r"\r\n?", "\n"), r"(?m)^(?:\d+: )?#{1,6}[ \t]+(.+)$", 1))


def section_id(path: Column, text: Column, page: Column, line: Column) -> Column:
    """path#heading-slug, else #page-N, else #lines-N, else #section."""
    s = slug(heading(text), "-")
    tail = F.when(s != "", s).when(page > 0, F.concat(F.lit("page-"), page.cast("string"))).when(line.isNotNull(), F.concat(F.lit("lines-"), line.cast("string"))).otherwise("section")
    return F.concat(path, F.lit("#"), tail)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def edge_confidence(col: Column) -> Column:
    """Null and zero count as one half; the rest is cut to [0.05, 1]."""
    return clamp(F.coalesce(F.when(col != 0, col), F.lit(0.5)), 0.05, 1.0)


def relation_priority(rel: Column) -> Column:
    return F.when(rel.isin("reads", "writes", "sets_field", "maps_base", "calls"), 0).when(rel.isin("contains", "documents", "configures", "resets", "depends_on"), 1).otherwise(2)
