"""Sensitive data: finding it, tagging it, masking it, filtering rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableward.functions.common import has_value, ratio, sanitized

# Built-in classes and the shape of their values. Only constructs with one meaning in all
# regular-expression dialects are used.
VALUE_PATTERNS = {
    "email_address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "phone_number": "[(]?[0-9]{3}[)]?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{4}",
    "card_number": "([0-9]{4}[ -]?){3}[0-9]{4}",
    "ip_address": "([0-9]{1,3}[.]){3}[0-9]{1,3}",
    "us_ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
SENSITIVE_NAME = "(?i)(^|_)(ssn|email|dob|phone|address)(_|$)"


def detection_pattern(name: str) -> str:
    """Value pattern, for digit classes with no digit next to it."""
    core = VALUE_PATTERNS[name]
    return core if name == "email_address" else f"(^|[^0-9]){core}([^0-9]|$)"


BUILT_IN_RULES = {name: detection_pattern(name) for name in VALUE_PATTERNS}

# What every hit of a class must contain. Texts without it skip the costly pattern; digit classes share one test.
_NEEDS = {"email_address": "_at", "phone_number": "_digits", "card_number": "_digits", "ip_address": "_digits"}
_NEEDS["us_ssn"] = "_digits"


# Order in which values are replaced: a card number first, with all digits that touch it, since other patterns match a part of one.
_REDACTED = {"card_number": "[0-9]*([0-9]{4}[ -]?){3}[0-9]{4}[0-9]*"}
_REDACTED |= {name: VALUE_PATTERNS[name] for name in ("email_address", "us_ssn", "ip_address", "phone_number")}


def _tests(text: Column) -> dict[str, Column]:
    return {"_at": text.contains("@"), "_digits": text.rlike("[0-9][0-9 .)-]{3}")}


def sensitive_name_scan(columns: DataFrame, tags: DataFrame) -> DataFrame:
    """Columns with a telling name and no class tag."""
    tagged = tags.filter(F.col("tag_key") == "class").select("object", "column_name")
    return (
        columns.filter(F.col("column_name").rlike(SENSITIVE_NAME))
        .select("object", "column_name")
        .join(tagged, ["object", "column_name"], "left_anti")
    )


def _pieces(apart: str, least: int) -> str:
    """SQL: the stretches of the text between characters that no value of a class holds, long enough for one. Each step reads a text once."""
    return f"filter(split(_text, '{apart}'), p -> length(p) >= {least})"


# Values that can exist. A card number is a group of 16 digits or four groups of four in a row, and its Luhn sum is right; an address has four
# numbers up to 255 and nothing that touches them; an SSN has no area 000, 666 or from 900 on, no group 00 and no serial 0000.
_CHECKED = {
    "card_number": f"""exists(transform({_pieces("[^0-9 -]+", 16)}, p -> filter(split(p, '[ -]+'), x -> x <> '')), g ->
        exists(g, x -> length(x) = 16 AND luhn_check(x)) OR (size(g) > 3 AND exists(sequence(1, greatest(size(g) - 3, 1)), i ->
            forall(slice(g, i, 4), x -> length(x) = 4) AND luhn_check(array_join(slice(g, i, 4), '')))))""",
    "ip_address": f"""exists(transform({_pieces("[^0-9.]+", 7)}, p -> trim('.' FROM p)), p ->
        p RLIKE '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$' AND forall(split(p, '[.]'), x -> try_cast(x AS INT) <= 255))""",
    "us_ssn": f"""exists(transform({_pieces("[^0-9-]+", 11)}, p -> trim('-' FROM p)), p ->
        p RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' AND NOT p RLIKE '^(000|666|9[0-9][0-9])|-00-|0000$')""",
}


def classify(df: DataFrame, text: str, rules: dict[str, str] | None = None, checked: bool = False) -> DataFrame:
    """Hits and hit rate per rule over whole texts, all rules in one pass and no shuffle of text.

    With ``checked`` built-in number classes count only texts that hold a value that can exist; otherwise the shape is enough.
    """
    rules = rules or BUILT_IN_RULES
    n = F.count(F.col("_text"))
    tests = _tests(F.col(text))
    needed = {_NEEDS[r] for r, p in rules.items() if p == BUILT_IN_RULES.get(r)}
    df = df.select(F.col(text).alias("_text"), *[tests[t].alias(t) for t in sorted(needed)])
    entries = []
    for name, pattern in rules.items():
        found = F.col("_text").rlike(pattern)
        if pattern == BUILT_IN_RULES.get(name):
            found = F.col(_NEEDS[name]) & (F.expr(_CHECKED[name]) if checked and name in _CHECKED else found)
        hits = F.count_if(found)
        entries.append(F.struct(F.lit(name).alias("rule"), hits.alias("hits"), ratio(hits, n, 6).alias("hit_rate")))
    return df.agg(F.array(*entries).alias("_r")).select(F.explode("_r").alias("r")).select("r.*")


def classify_columns(texts: dict[tuple[str, str], DataFrame], rules: dict[str, str] | None = None, checked: bool = False) -> DataFrame:
    """``classify`` over several (object, column) texts."""
    parts = [
        classify(df, column, rules, checked).select(F.lit(obj).alias("object"), F.lit(column).alias("column_name"), "*")
        for (obj, column), df in texts.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def custom_classify(
    df: DataFrame, text: str, rules: dict[str, str], created: str | None = None, since=None, full: bool = True
) -> DataFrame:
    """User rules: a full scan after a rule is added, else only rows created after ``since``."""
    if not full:
        df = df.filter(F.col(created) > F.lit(since).cast(df.schema[created].dataType))
    return classify(df, text, rules)


def auto_tag(classified: DataFrame, tags: DataFrame, min_rate: float = 0.01) -> DataFrame:
    """New class tags for columns whose hit rate reaches ``min_rate``."""
    wanted = classified.filter(F.col("hit_rate") >= min_rate).select(
        "object", "column_name", F.concat(F.lit("class."), F.col("rule")).alias("tag")
    )
    present = tags.select("object", "column_name", F.concat_ws(".", "tag_key", "tag_value").alias("tag"))
    return wanted.join(present, ["object", "column_name", "tag"], "left_anti")


def effective_tags(tags: DataFrame, objects: DataFrame) -> DataFrame:
    """Tags of tables with inheritance catalog -> schema -> table; the nearest level wins.

    Column tags do not inherit. The levels are joined one by one: the few catalog and schema tags are
    broadcast when their measured size allows, and only table tags meet the tables by id.
    """
    levels = [("table", "object"), ("schema", "schema_object"), ("catalog", "catalog_object")]
    found = None
    for rank, (level, ref) in enumerate(levels):
        at = tags.filter(F.col("level") == level).select(F.col("object").alias("_ref"), "tag_key", "tag_value")
        part = (
            objects.select("object", F.col(ref).alias("_ref"))
            .join(at, "_ref")
            .select("object", "tag_key", "tag_value", F.lit(level).alias("from_level"), F.lit(rank).alias("_rank"))
        )
        found = part if found is None else found.unionByName(part)
    nearest = F.min_by(F.struct("tag_value", "from_level"), "_rank")
    return found.groupBy("object", "tag_key").agg(nearest.alias("_t")).select("object", "tag_key", "_t.*")


def tags_of(tags: DataFrame, obj: str, columns: list[str]) -> dict[str, list[str]]:
    """Class tags of one table's columns; at most (columns x classes) short rows reach the driver."""
    rows = (
        tags.filter((F.col("object") == obj) & (F.col("tag_key") == "class") & F.col("column_name").isin(columns))
        .select("column_name", "tag_value")
        .distinct()
        .collect()
    )
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.column_name, []).append(r.tag_value)
    return out


def _redacted(text: Column, classes: list[str]) -> Column:
    """Values of the classes replaced; a text that holds none of what they need is passed through."""
    c = text
    for name, pattern in _REDACTED.items():
        if name in classes:
            c = F.regexp_replace(c, pattern, "***")
    tests = _tests(text)
    suspect = F.lit(False)
    for need in sorted({_NEEDS[name] for name in classes}):
        suspect = suspect | tests[need]
    return F.when(suspect, c).otherwise(text)


def column_mask(
    df: DataFrame,
    tags: dict[str, list[str]],
    policy: dict[str, str],
    reader_groups: set[str] = frozenset(),
    exempt: set[str] = frozenset(),
) -> DataFrame:
    """Mask tagged columns unless the reader is in an exempt group.

    ``policy`` maps a class to ``redact`` (replace values of the class inside text), ``mask`` (replace letters and digits),
    ``hash`` or ``null``. The strongest of several wins in the order null, hash, mask, redact.
    """
    if reader_groups & exempt:
        return df
    out = []
    for c in df.columns:
        classes = [t for t in tags.get(c, []) if t in policy]
        kinds = {policy[t] for t in classes}
        value = F.col(c)
        if "null" in kinds:
            value = F.lit(None).cast(df.schema[c].dataType)
        elif "hash" in kinds:
            value = F.sha2(value.cast("string"), 256)
        elif "mask" in kinds:
            value = F.mask(value)
        elif "redact" in kinds:
            value = _redacted(value, classes)
        out.append(value.alias(c))
    return df.select(*out)


def row_filter(
    df: DataFrame, column: str, entitlements: DataFrame, principals: list[str] | None = None
) -> DataFrame:
    """Rows whose ``column`` is an object the reader may SELECT."""
    allowed = entitlements.filter(F.col("privilege") == "SELECT")
    if principals is not None:
        allowed = allowed.filter(F.col("principal").isin(principals))
    return df.join(allowed.select(F.col("object").alias(column)).distinct(), column, "left_semi")


def unprotected_tables(columns: DataFrame, policies: DataFrame) -> DataFrame:
    """Tables with telling column names and no policy."""
    risky = columns.filter(F.col("column_name").rlike(SENSITIVE_NAME)).select("object").distinct()
    return risky.join(policies.select("object"), "object", "left_anti")


def classification_vs_ownership(columns: DataFrame, tags: DataFrame, tables: DataFrame) -> DataFrame:
    """Per schema: share of telling columns without a tag, and share of tables without an owner."""
    n = F.count(F.lit(1))
    tagged = tags.filter(F.col("tag_key") == "class").select("object", "column_name").distinct()
    untagged = (
        columns.filter(F.col("column_name").rlike(SENSITIVE_NAME))
        .join(tagged.withColumn("_tagged", F.lit(True)), ["object", "column_name"], "left")
        .groupBy("schema_name")
        .agg(ratio(F.count_if(F.col("_tagged").isNull()), n, 4).alias("untagged_rate"))
    )
    unowned = tables.groupBy(F.col("catalog_name").alias("schema_name")).agg(
        ratio(F.count_if(~has_value(F.coalesce("owner_email", F.lit("")))), n, 4).alias("unowned_rate")
    )
    return untagged.join(unowned, "schema_name", "full_outer")


def snippets(events: DataFrame, key: str, text: str) -> DataFrame:
    return events.select(key, sanitized(text).alias("snippet"))
