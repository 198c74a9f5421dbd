"""Small predicates and formats of symbols, endpoints and values: Column expressions; null in gives null or the stated default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of the kinds in a pair, kinds of product nodes, tones, words that are never an endpoint.
KIND_ORDER = {"register": 0, "field": 1, "code": 2, "doc": 3, "pdf": 3}
OPERATION_RELATIONS = ["field_set", "read", "write", "read_modify_write"]
LOCAL_PREFIXES = ["data_", "local_", "ret_", "tmp_", "value_"]
REGISTER_PARTS = ["CNTL", "CTRL", "STATUS", "BASE", "RESET"]
DOC_KINDS = ["doc", "doc_box", "doc_section", "pdf_section"]


def is_function_symbol(symbol: Column) -> Column:
    """An identifier that is not all upper case."""
    return symbol.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~((symbol == F.upper(symbol)) & symbol.rlike("[A-Z]"))


def callables(text: Column) -> Column:
    """The names that a text has before an opening bracket, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+)\s*\("), 1))


def has_callable(text: Column, symbol: Column) -> Column:
    return F.coalesce(F.array_contains(callables(text), symbol), F.lit(False)) & (symbol != "")


def tone(source_type: Column, entity_type: Column) -> Column:
    return F.when(source_type.isin("pdf", "doc"), source_type).when(entity_type.isin("register", "macro"), "register").when(entity_type == "field", "success").otherwise("code")


def query_id(explicit: Column, corpus: Column, query: Column) -> Column:
    """The explicit id, else corpus and slug of the query."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(query), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    name = F.when(F.trim(corpus) != "", F.trim(corpus)).otherwise("query")
    return F.when(explicit != "", explicit).otherwise(F.when(slug != "", F.concat_ws("_", name, slug)).otherwise(name))


def kind_order(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KIND_ORDER.items() for x in kv])[kind], F.lit(9))


def ordered_pair(a: Column, kind_a: Column, b: Column, kind_b: Column) -> Column:
    """struct(first, second): registers, fields, code, documents, others; by name among equals."""
    swap = (kind_order(kind_a) > kind_order(kind_b)) | ((kind_order(kind_a) == kind_order(kind_b)) & (a > b))
    return F.struct(F.when(swap, b).otherwise(a).alias("first"), F.when(swap, a).otherwise(b).alias("second"))


def register_identity(symbol: Column, ip: Column, version: Column, identity: str = "register:{symbol}", merge_blocks: bool = True, merge_versions: bool = True) -> Column:
    """Node id of a register by a template; parts that may not be merged away are appended, runs of colons collapse."""
    if not merge_blocks and "{ip}" not in identity:
        identity += ":{ip}"
    if not merge_versions and "{ip_version}" not in identity:
        identity += ":{ip_version}"
    out = F.lit(identity)
    for name, value in (("{symbol}", symbol), ("{ip_version}", version), ("{ip}", ip)):
        out = F.replace(out, F.lit(name), F.coalesce(value, F.lit("")))
    out = F.regexp_replace(F.trim(out), ":+", ":")
    return F.when(out.startswith("register:"), out).otherwise(F.concat(F.lit("register:"), out))


def operation_relation(access_type: Column) -> Column:
    return F.when(access_type.isin(OPERATION_RELATIONS), access_type).otherwise("relates_to")


def owner_register(chain: Column, snippet: Column) -> Column:
    """The register that a field belongs to: `register X` in the chain or snippet, else the second argument of REG_SET_FIELD, else empty."""
    text = F.concat_ws(" ", F.coalesce(chain, F.lit("")), F.coalesce(snippet, F.lit("")))
    named = F.regexp_extract(text, r"register\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(text, r"REG_SET_FIELD\s*\([^,]+,\s*([A-Za-z_][A-Za-z0-9_]*)\s*,", 1))


def endpoint_kind(endpoint: Column, words: list[str]) -> Column:
    """doc, function or register for what a product graph may hold, else null. words: lower-case names that never count."""
    v = F.trim(endpoint)
    low, up = F.lower(v), F.upper(v)
    prefix = F.regexp_extract(low, "^([^:]*):", 1)
    local = F.lit(False)
    for p in LOCAL_PREFIXES:
        local = local | low.startswith(p)
    none = (v == "") | low.isin(words) | local | up.startswith("ENABLE_") | up.startswith("DISABLE_")
    part = F.lit(False)
    for p in REGISTER_PARTS:
        part = part | up.contains(p)
    return (
        F.when(none, None)
        .when(v.contains(":"), F.when(prefix.isin(DOC_KINDS), "doc").when(prefix.isin("function", "register"), prefix))
        .when(v.contains("#") & low.rlike("[.](?:md|rst|txt|pdf)#"), "doc")
        .when(v.rlike("^(?:reg|mm|smn)") & (F.length(v) > 3), "register")
        .when(v.rlike("^[A-Z][A-Z0-9_]*$") & part, "register")
        .when(v.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & v.contains("_") & ~((v == up) & v.rlike("[A-Z]")), "function")
    )


def lenient_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def lenient_int(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("bigint"), F.lit(0).cast("bigint"))


def json_field(value: Column, name: str) -> Column:
    """A top-level field of a JSON object; null for broken JSON and other values."""
    return F.get_json_object(F.when(F.trim(value).startswith("{"), value), f"$.{name}")


def last_function(text: Column) -> Column:
    """Name of the last function header of a chunk, without its line prefixes; empty if none."""
    bare = F.regexp_replace(text, r"(?m)^\s*\d+:\s?", "")
    return F.coalesce(F.try_element_at(F.regexp_extract_all(bare, F.lit(r"(?m)^[A-Za-z_][\w \t*]*?[ \t*]([A-Za-z_]\w*)[ \t]*\([^;{}]*\)\s*\{"), 1), F.lit(-1)), F.lit(""))


def receiver_leaf(receiver: Column) -> Column:
    """Last part of `a->b.c`, without indexes."""
    return F.regexp_extract(F.regexp_replace(receiver, r"\[[^\]]*\]", ""), r"(\w+)\s*$", 1)


def is_global_receiver(receiver: Column) -> Column:
    return receiver.rlike(r"^(?:adev|adapt)\b")


def is_callback_table(name: Column) -> Column:
    return F.lower(name).rlike(r"(?:funcs|ops|callbacks|func)$|_ip_block(?:_version)?$")


def plain_type(c_type: Column) -> Column:
    """A C type without const, struct and pointers."""
    return F.trim(F.regexp_replace(F.regexp_replace(c_type, r"\b(?:const|volatile|struct|static)\b|[*&]", " "), r"\s+", " "))
