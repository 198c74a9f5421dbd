"""Symbols of source and document text: predicates and scalar facts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import FIELD_NAME, REGISTER_NAME

IDENTIFIER = r"[A-Za-z_]\w*(?:->[A-Za-z_]\w*)*"
# Beginnings of the names of register wrappers.
WRAPPER = "^(?:RREG|WREG|SOC15_REG_|amdgv_wreg|amdgv_rreg|REG_FIELD_)|^(?:REG_SET_FIELD|REG_GET_FIELD)$"
# Words of register headers that are no symbols, and the parts that make an upper-case name one.
HEADER_STOP = ["adapt", "data", "define", "else", "endif", "if", "ifdef", "ifndef", "local", "reg", "ret", "tmp", "u32", "uint32_t", "value"]
HEADER_HINTS = "ADDR|BASE|CNTL|CONTROL|CP_HQD|CP_MQD|DOORBELL|GRBM|HQD|IH_|MMHUB|MQD|PTR|QUEUE|RESET|RLC|RPTR|SDMA|SIZE|SMN|SOFT_RESET|SQ_|SRBM|STATUS|VMID|WPTR"


def is_wrapper(symbol: Column) -> Column:
    return symbol.rlike(WRAPPER)


def all_upper(symbol: Column) -> Column:
    """Some cased letter and none in lower case."""
    return symbol.rlike("[A-Z]") & ~symbol.rlike("[a-z]")


def is_symbol(symbol: Column) -> Column:
    return ~is_wrapper(symbol) & ~symbol.isin("static", "void", "uint32_t", "return", "data") & (symbol.contains("_") | symbol.rlike("^(?:reg|mm)") | all_upper(symbol))


def is_header_symbol(symbol: Column) -> Column:
    plain = ~is_wrapper(symbol) & (F.length(symbol) > 2) & ~F.lower(symbol).isin(HEADER_STOP) & ~symbol.contains("->")
    named = symbol.rlike("^[A-Z][A-Z0-9_]*$") & ((symbol.contains("__") & symbol.rlike("_(?:MASK|SHIFT|DEFAULT)$")) | (symbol.contains("_") & symbol.rlike(HEADER_HINTS)))
    return plain & (symbol.rlike("^(?:reg|mm|smn)[A-Z]") | named)


def entity_type(symbol: Column) -> Column:
    return (
        F.when(symbol.contains("->"), "context").when(symbol.rlike(FIELD_NAME), "field").when(symbol.rlike("^(?:WREG|RREG|REG_)"), "macro").when(symbol.rlike(f"^(?:reg|mm|smn)|{REGISTER_NAME}"), "register").otherwise("function")
    )


def access_type(text: Column, symbol: Column) -> Column:
    """How the text uses the symbol: field_set, read_modify_write, write, read or mention."""
    call = r"\s*\([^)]*"
    return (
        F.when(text.contains("REG_SET_FIELD") & text.contains(symbol), F.when(entity_type(symbol) == "field", "field_set").otherwise("read_modify_write"))
        .when(F.regexp_like(text, F.concat(F.lit(r"\bWREG[0-9A-Z_]*" + call), symbol)), "write")
        .when(F.regexp_like(text, F.concat(F.lit(r"\bRREG[0-9A-Z_]*" + call), symbol)), "read")
        .otherwise("mention")
    )


def confidence(text: Column, symbol: Column) -> Column:
    return F.when(F.regexp_like(text, F.concat(F.lit(r"\b"), symbol, F.lit(r"\b"))), 0.95).otherwise(0.75)


def snippet(text: Column, symbol: Column) -> Column:
    """Two lines around the first line that holds the symbol, or the first five lines."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains(symbol)), True)
    start = F.greatest(at.cast("int") - 2, F.lit(1))
    return F.array_join(F.when(at > 0, F.slice(lines, start, at.cast("int") + 3 - start)).otherwise(F.slice(lines, 1, 5)), "\n")


def resolved_chain(text: Column, symbol: Column, access: Column) -> Column:
    args = F.transform(F.split(F.regexp_extract(text, r"REG_SET_FIELD\s*\(([^)]*)\)", 1), ","), F.trim)
    field = text.contains("REG_SET_FIELD") & (F.size(args) >= 4)
    return (
        F.when(field, F.concat(F.lit("REG_SET_FIELD -> register "), F.get(args, F.lit(1)), F.lit(" -> field "), F.get(args, F.lit(2)), F.lit(" -> "), symbol))
        .when(access.isin("read", "write"), F.concat(access, F.lit(" wrapper -> "), symbol))
        .otherwise(F.concat(F.lit("source mention -> "), symbol))
    )


def phrase_text(text: Column) -> Column:
    """Folded tokens with blanks around, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def phrase(query_token: str) -> str:
    import re

    return " " + " ".join(re.findall(r"[^\W_]+", query_token.lower())) + " "
