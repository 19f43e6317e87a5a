"""The gate a predicate passes before it is registered."""

from __future__ import annotations

import re

from .analysed import MARKERS, SIMILARITY, UNIQUE, Found, read
from .definition import RuleDefinitionError

# What a predicate may read, which of these are versioned or delivered, and what the engine binds.
ALLOWED = ("source_system", "data_batch", "hcp", "hco", "product", "territory", "territory_alignment", "sales_transaction", "feed_expectation")
MASTER = ("hcp", "hco", "product", "territory")
DELIVERED = ("territory_alignment", "sales_transaction", "data_batch")
ENGINE = ("batch_id", "as_of_date", "reference_watermark", "scope_period_start", "scope_period_end", "scope_source_system_id")
COLUMNS = ["subject_key", "offending_value", "observed_value", "expected_value"]
CHANGING = "insert update delete merge drop create alter truncate grant revoke call copy set use cache refresh".split()
VOLATILE = "now current_timestamp current_date current_time localtimestamp current_user user session_user current_database current_catalog current_schema current_timezone rand randn random uuid shuffle monotonically_increasing_id spark_partition_id input_file_name unix_timestamp version java_method reflect".split()
SIMILAR = "levenshtein soundex similarity metaphone difference jaro_winkler".split()


#: The rules that the analyser's own refusals belong to.
ERRORS = {"TABLE_OR_VIEW_NOT_FOUND": "5", "UNRESOLVED_ROUTINE": "3", "UNRESOLVABLE_TABLE_VALUED_FUNCTION": "4", "UNBOUND_SQL_PARAMETER": "8", "PARSE_SYNTAX_ERROR": "1"}
TABLE_FUNCTIONS = {"Generate", "Range", "UnresolvedTableValuedFunction"}


def _by_plan(found: Found, refuse) -> None:
    """The rules that hold of the analysed plan: what it reads, calls and orders by, and what binds each relation."""
    if tables := set(found.others) & TABLE_FUNCTIONS:
        refuse("4", f"no functions in FROM: {', '.join(sorted(tables))}")
    if found.calls & SIMILARITY:
        refuse("FR-016d", "exact comparison only")
    if found.calls:
        refuse("3", f"not known to be immutable: {', '.join(sorted(found.calls))}")
    if bad := [*found.others, *(v for _, _, v in found.relations if v not in ALLOWED)]:
        refuse("5", f"may not read {', '.join(sorted(set(bad)))}")
    if found.unordered:
        refuse("6", f"{found.unordered[0]}: an order that ends in one of {', '.join(UNIQUE)}")
    for block, alias, view in found.relations:
        bound = {(column, kind, name) for b, a, column, kind, name in found.bound if (b, a) == (block, alias)}
        seen = ("batch_id", "LessThanOrEqual", "reference_watermark") in bound
        if view in MASTER and not (seen and ("valid_from", "LessThanOrEqual", "as_of_date") in bound):
            refuse("7", f"{view} {alias} is bound by neither or one of valid_from and batch_id")
        if view in DELIVERED and not seen and ("batch_id", "EqualTo", "batch_id") not in bound:
            refuse("7", f"{view} {alias} is not bound by the watermark or the batch")


def stripped(sql: str) -> str:
    """Without comments, and with each literal as 'LIT'."""
    sql = re.sub(r"/\*.*?\*/|--[^\n]*", " ", sql, flags=re.S)
    return re.sub(r"'(?:[^']|'')*'", "'LIT'", sql)


def names(sql: str) -> set[str]:
    return set(re.findall(r"(?<!:):([A-Za-z]\w*)", stripped(sql)))


def validate(sql: str, parameters: dict, spark=None) -> None:
    """RuleDefinitionError, beginning with the label of the first broken rule. Without a session the text alone is read,
    which catches common mistakes; with one whose views are the readable tables, the analysed plan decides."""

    def refuse(label: str, why: str):
        raise RuleDefinitionError(f"rule {label}: {why}")

    text = stripped(sql).lower()
    words = set(re.findall(r"[a-z_]\w*", text))
    if not re.match(r"\s*(select|with)\b", text) or ";" in text or words & set(CHANGING):
        refuse("1", "one SELECT, nothing that changes data")
    if spark is None and not all(re.search(rf"\bas\s+{c}\b", text) for c in COLUMNS):
        refuse("2", f"the columns are {', '.join(COLUMNS)}")
    if bad := words & set(VOLATILE):
        refuse("3", f"not immutable: {', '.join(sorted(bad))}")
    if re.search(r"\b(from|join)\s+(?!lateral\b)[a-z_]\w*\s*\(", text):
        refuse("4", "no functions in FROM")
    own = set(re.findall(r"(?:\bwith|,)\s*([a-z_]\w*)\s+as\s*\(", text))
    reads = re.findall(r"\b(?:from|join)\s+([a-z_][\w.]*)(?:\s+(?:as\s+)?(?!on\b|where\b|join\b|group\b|order\b|left\b|inner\b|cross\b|using\b)([a-z_]\w*))?", text)
    for name, _ in reads:
        if "." in name or name not in ALLOWED and name not in own:
            refuse("5", f"may not read {name}")
    if spark is None and re.search(r"\blimit\b|\b(row_number|rank|dense_rank|first_value|last_value|nth_value|lead|lag|ntile)\s*\(", text) and not re.search(rf"order\s+by[^()]*\b({'|'.join(UNIQUE)})\s*(asc|desc)?\s*(\)|limit|$)", text):
        refuse("6", "an order that ends in a unique column")
    for name, alias in reads if spark is None else ():
        at = rf"\b{alias or name}\."
        seen = re.search(at + r"batch_id\s*<=\s*:reference_watermark\b", text)
        if name in MASTER and not (seen and re.search(at + r"valid_from\s*<=\s*:as_of_date\b", text)):
            refuse("7", f"{name} {alias} is bound by neither or one of valid_from and batch_id")
        if name in DELIVERED and not seen and not re.search(at + r"batch_id\s*=\s*:batch_id\b", text):
            refuse("7", f"{name} {alias} is not bound by the watermark or the batch")
    if unknown := names(sql) - set(ENGINE) - set(parameters):
        refuse("8", f"not declared: {', '.join(sorted(unknown))}")
    if re.search(r":[a-z]\w*\s*::", text):
        refuse("8b", "cast parameters by CAST")
    if words & set(SIMILAR) or "<->" in text or re.search(r"\s%\s+[a-z_]+\.", text):
        refuse("FR-016d", "exact comparison only")
    if spark is not None:
        try:
            df = spark.sql(sql, args={n: MARKERS.get(n, parameters.get(n)) for n in names(sql)})
            schema, found = df.schema, read(df)
        except Exception as e:
            first = str(e).split("\n")[0]
            refuse(next((label for error, label in ERRORS.items() if error in first), "plan"), first)
        _by_plan(found, refuse)
        if sorted(schema.names) != sorted(COLUMNS) or any(f.dataType.typeName() not in ("string", "void") for f in schema):
            refuse("2", f"the columns are {', '.join(COLUMNS)}, all text")
