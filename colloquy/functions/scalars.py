"""Scalar functions, Column to Column: times, coercions, labels, bins, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Triggers of each topic, tried in this order.
KEYWORDS = {
    "Spam/Low-Signal": ["airdrop", "bitcoin", "crypto", "cryptocurrency", "defi", "nft", "scam", "shitpost", "solana", "token", "usdc"],
    "Builder/Technical": [
        "agentops", "agents", "agentskills", "aiagents", "automation", "build", "builders", "buildinpublic", "buildlogs", "clawtasks", "coding", "codinghelp", "dev", "engineering",
        "framework", "infrastructure", "localllm", "mcp", "programming", "research", "security", "shipping", "skills", "standards", "tech", "technology", "tool", "tools",
    ],
    "Philosophy/Meta": ["agentphilosophy", "agentsouls", "aithoughts", "consciousness", "existential", "meta", "musings", "philosophy", "ponderings", "souls", "thebecoming", "thoughts"],
    "Creative": ["creative", "creativeprojects", "music", "poetry", "shakespeare", "story", "theatre", "writing"],
    "Social/Casual": [
        "askmoltys", "blesstheirhearts", "casual", "general", "gaming", "humanwatching", "introductions", "jokes", "offmychest", "pixelwar", "random", "showandtell", "social", "sport",
        "todayilearned",
    ],
}
#: What the wider variant adds.
EXPANDED = {"Builder/Technical": ["ai", "llm"], "Philosophy/Meta": ["emergence"]}
#: Topic and forum names by coarse topic.
TOPIC_BY_CATEGORY = {"Builder/Technical": "tech", "Philosophy/Meta": "meta", "Social/Casual": "general", "Creative": "general", "Other": "general", "Spam/Low-Signal": "spam"}
TOPIC_BY_FORUM = {"MachineLearning": "tech", "Python": "tech", "datascience": "tech", "learnprogramming": "tech", "programming": "tech", "artificial": "meta"}
#: Order of topics in reports.
CATEGORY_ORDER = ["Builder/Technical", "Philosophy/Meta", "Social/Casual", "Creative", "Spam/Low-Signal", "Other"]


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from a to b, for timestamps with or without zone."""
    return F.timestamp_diff("MICROSECOND", a, b)


def hours_between(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(3.6e9)


def seconds_between(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(1e6)


def utc_timestamp(text: Column) -> Column:
    """Coercing parse of ISO text: what can't be read is null."""
    return F.try_to_timestamp(text)


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds.try_cast("bigint"))


def strict_utc_timestamp(text: Column) -> Column:
    """ISO text with an offset or Z; naive times are null."""
    return F.when(text.rlike("(?:Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def partition_day(dump_date: Column | None, created: Column) -> Column:
    """The partition key: the dump date where the table has one, else the day of creation."""
    return dump_date.cast("string") if dump_date is not None else F.date_format(created, "yyyy-MM-dd")


def int_or_zero(c: Column) -> Column:
    """A number or numeric text as a whole number, cut towards zero; 0 for all else."""
    n = c.cast("string").try_cast("double")
    whole = F.when(~F.isnan(n) & (F.abs(n) < 9.2e18), n.try_cast("bigint"))
    return F.coalesce(c.cast("string").try_cast("bigint"), whole, F.lit(0).cast("bigint"))


def int_or_null(text: Column) -> Column:
    """Whole numbers in text; '3.7' and words are null."""
    return F.when(F.btrim(text).rlike("^[+-]?[0-9]+$"), F.btrim(text).try_cast("bigint"))


def json_int(json: Column, key: str) -> Column:
    """A member as a whole number: booleans are 1 and 0, numbers are cut, text counts only if it is whole."""
    v = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant")
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(F.try_parse_json(json), f"$.{key}", "string")
    return F.when(kind == "BOOLEAN", (text == "true").cast("bigint")).when(kind == "STRING", int_or_null(text)).otherwise(F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint")))


def first_present(json: Column, keys: list[str]) -> Column:
    """The value of the first key that the object has, even if that value is null."""
    present = F.json_object_keys(json)
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.array_contains(present, k), F.get_json_object(json, f"$.{k}")).otherwise(out)
    return out


def name_or_text(json: Column, key: str, field: str = "name") -> Column:
    """A member that is an object with a name, or the name itself."""
    value = F.get_json_object(json, f"$.{key}")
    return F.when(value.startswith("{"), F.get_json_object(value, f"$.{field}")).otherwise(value)


def list_member(json: Column, keys: list[str]) -> Column:
    """The list of a payload: itself, or its first member that is a list."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        value = F.get_json_object(json, f"$.{k}")
        out = F.when(value.startswith("["), value).otherwise(out)
    return F.when(F.ltrim(json).startswith("["), json).otherwise(out)


def json_type(json: Column) -> Column:
    """Type name of a JSON text: null, bool, int, float, str, object or array."""
    v = F.btrim(json)
    return (
        F.when(v.isNull() | (v == "null"), "null").when(v.isin("true", "false"), "bool").when(v.rlike("^-?[0-9]+$"), "int")
        .when(v.rlike("^-?[0-9.]+(?:[eE][+-]?[0-9]+)?$"), "float").when(v.startswith("{"), "object").when(v.startswith("["), "array").otherwise("str")
    )


def variant_type(v: Column) -> Column:
    """Type name of a parsed JSON value: null, bool, int, float, str, object or array."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (kind == "VOID"), "null").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").when(kind == "STRING", "str")
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("float")
    )


def parent_type(parent: Column) -> Column:
    """Of forum references: t1_ a comment, t3_ a submission, else unknown."""
    return F.when(parent.startswith("t1_"), "comment").when(parent.startswith("t3_"), "submission").otherwise("unknown")


def parent_key(parent: Column, prefix: str) -> Column:
    return F.when(parent.startswith(prefix), F.substring(parent, len(prefix) + 1, 1 << 30))


def known_author(author: Column, deleted: Column) -> Column:
    a = F.btrim(author)
    return F.when(F.coalesce(deleted, F.lit(False)) | a.isin("", "[deleted]", "[removed]"), F.lit(None)).otherwise(a)


def is_deleted(body: Column, author: Column) -> Column:
    return F.coalesce(body.isin("[deleted]", "[removed]"), F.lit(False)) | author.isNull() | author.isin("[deleted]", "[removed]")


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: x != ""))


def keyword_category(name: Column, variant: str = "baseline", token_only: bool = False) -> Column:
    """The first topic with a trigger among the name's tokens or, unless token_only, anywhere in it."""
    lower, tokens = F.lower(F.btrim(name)), name_tokens(F.btrim(name))
    out = F.lit("Other")
    for topic, triggers in reversed(KEYWORDS.items()):
        triggers = triggers + (EXPANDED.get(topic, []) if variant == "expanded" else [])
        hit = F.arrays_overlap(tokens, F.array(*map(F.lit, triggers)))
        if not token_only:
            hit = hit | lower.rlike("|".join(triggers))
        out = F.when(hit, topic).otherwise(out)
    return F.when(name.isNull() | (F.btrim(name) == ""), "Other").otherwise(out)


def lookup(value: Column, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[value]


def follower_bin(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n <= 9, "1-9").when(n > 9, "10+")


def early_bin(n: Column) -> Column:
    """Right-closed bins of early comments."""
    return F.when(n <= -0.1, None).when(n <= 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n > 10, "11+")


def claim_label(claimed: Column, variant: str) -> Column:
    """``primary``: null counts as unclaimed; ``two_part``: null is unknown, all but 1 unclaimed; ``strict``: only 0 is unclaimed."""
    if variant == "primary":
        return F.when(claimed == 1, "Claimed").otherwise("Unclaimed")
    if variant == "two_part":
        return F.when(claimed.isNull(), "Unknown").when(claimed == 1, "Claimed").otherwise("Unclaimed")
    return F.when(claimed == 1, "Claimed").when(claimed == 0, "Unclaimed").otherwise("Unknown")


def positive_minutes(hours: Column) -> Column:
    m = hours * 60
    return F.when(~F.isnan(m) & (m > 0) & (m < float("inf")), m)


def reply_probability(alpha: Column, beta: Column) -> Column:
    """1 - exp(-alpha / beta): the chance that a reply ever comes."""
    return F.when((alpha > 0) & (beta > 0), 1 - F.exp(-alpha / beta))


def conditional_quantile(alpha: Column, beta: Column, p: float) -> Column:
    """Hours within which a share p of all replies that come have come."""
    mu = alpha / beta
    hazard = -F.log(1 - p * (1 - F.exp(-mu)))
    return F.when((alpha > 0) & (beta > 0) & (hazard < mu), -F.log(1 - hazard / mu) / beta)


def half_life_text(hours: Column) -> Column:
    """Minutes below an hour, else hours."""
    return F.when(hours < 1, F.format_string("%.6g min", hours * 60)).otherwise(F.format_string("%.6g h", hours))


def rounded(df, decimals: int = 12):
    """All floating columns rounded half to even."""
    return df.withColumns({c: F.bround(c, decimals) for c, t in df.dtypes if t in ("double", "float")})


def with_metadata(df, **values):
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def time_columns(df) -> list[str]:
    """Columns whose name says that they hold a time."""
    return [c for c in df.columns if c.endswith("_at") or c in ("timestamp", "hour")]


def with_parsed_times(df):
    """Each time column as text in ``<c>_raw`` and parsed in ``<c>_utc``."""
    return df.withColumns({k: v for c in time_columns(df) for k, v in ((f"{c}_raw", F.col(c).cast("string")), (f"{c}_utc", utc_timestamp(F.col(c).cast("string"))))})


def endpoint_id(endpoint: Column) -> Column:
    """The id of ``/posts/{id}/comments``."""
    return F.when(endpoint.startswith("/posts/") & endpoint.endswith("/comments"), F.get(F.split(endpoint, "/"), F.lit(2)))
