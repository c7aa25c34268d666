"""Scalar functions as Columns. ``REGISTRY`` names them, ``register`` puts the SQL forms into a session."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The characters that count as blanks in prompts and texts.
BLANK = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# File types by extension.
MIME = {
    "json": "application/json", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html",
    "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml", "css": "text/css",
    "js": "text/javascript", "ts": "text/typescript", "py": "text/x-python", "sh": "text/x-shellscript", "sql": "application/sql",
    "log": "text/plain", "txt": "text/plain",
}

#: Those of them beyond Latin, and a pattern of the others, which Java looks up in a table.
WIDE_BLANKS = "\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NARROW_BLANK = r"[\t-\r \xa0]"


def narrow_blanks(text: Column) -> Column:
    """The text with wide blanks as spaces. Few texts have any, and a look for one is much cheaper than a pattern of all."""
    return F.when(F.rlike(text, F.lit(r"[\x{1680}-\x{feff}]")), F.translate(text, WIDE_BLANKS, " " * len(WIDE_BLANKS))).otherwise(text)


def estimate_tokens(text: Column) -> Column:
    """UTF-16 units by 3 if at least 30 % of the first 512 characters are other than ASCII letters,
    digits and blanks, by 4 otherwise; rounded up."""
    head = F.substring(text, 1, 512)
    odd = F.length(F.regexp_replace(head, "[A-Za-z0-9 ]", ""))
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    dense = odd >= 0.3 * F.length(head)
    return F.when(F.length(text) == 0, 0).otherwise(F.ceil(units / F.when(dense, 3).otherwise(4))).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalize_prompt(text: Column) -> Column:
    """Lower case, blanks collapsed, trimmed, closing punctuation off."""
    one = F.trim(F.regexp_replace(F.lower(text), BLANK + "+", " "))
    return F.regexp_replace(one, r"[?.!,;:]+$", "")


def parse_approval(text: Column) -> Column:
    """Approval words go before rejecting ones, and both are found inside other words; a bare y or n counts."""
    t = F.lower(text)
    has = lambda a, b, c: F.contains(t, F.lit(a)) | F.contains(t, F.lit(b)) | (t == c)
    return F.when(has("approve", "yes", "y"), "approved").when(has("reject", "no", "n"), "rejected").otherwise("unclear")


def normalize_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def preview(text: Column, most: int = 160) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def flat_preview(text: Column, most: int = 120) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, most)


def truncate(text: Column, most: int = 32_000) -> Column:
    """Struct of the text, marked if it was cut, and whether it was; four characters count as a token."""
    cut = F.length(text) > most
    marked = F.concat(F.substring(text, 1, most), F.lit(f"\n\n[Content truncated at {most // 4:,} tokens]"))
    return F.struct(F.when(cut, marked).otherwise(text).alias("text"), cut.alias("cut"))


def truncate_with_length(text: Column, most: int = 2000) -> Column:
    note = F.concat(F.substring(text, 1, most), F.lit("... ("), F.length(text).cast("string"), F.lit(" characters)"))
    return F.when(F.length(text) > most, note).otherwise(text)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def mime_type(path: Column) -> Column:
    name = base_name(path)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("text/plain"))


def content_kind(header: Column) -> Column:
    """By content type; without one, and for others, a page is taken as HTML."""
    h = F.lower(header)
    plain = F.contains(h, F.lit("text/plain")) | F.contains(h, F.lit("text/markdown"))
    return F.when(F.contains(h, F.lit("application/pdf")), "pdf").when(plain, "text").otherwise("html")


def interpolate(template: Column, values: Column) -> Column:
    """``{{key}}`` replaced by the map's value; unknown keys stay."""
    put = lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"])
    return F.aggregate(F.map_entries(values), template, put)


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def labelled_ids(text: Column, label: str = "id") -> Column:
    return F.regexp_extract_all(text, F.lit(label + r":\s*([0-9A-Za-z-]+)"), 1)


def tagged_json(text: Column, tag: str, schema: str) -> Column:
    """The JSON of the first ``<tag>`` block as a struct; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit("")), schema)


def main_text(html: Column) -> Column:
    """Title as a heading, then the text without scripts, styles, navigation, headers, footers and asides."""
    title = F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    body = html
    for tag in ("head", "script", "style", "nav", "footer", "header", "aside", "noscript"):
        body = F.regexp_replace(body, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    body = F.regexp_replace(F.regexp_replace(body, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    body = normalize_blanks(body)
    return F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"), body)).otherwise(body)


REGISTRY = {
    "estimate_tokens": estimate_tokens, "content_hash": content_hash, "normalize_prompt": normalize_prompt,
    "parse_approval": parse_approval, "normalize_blanks": normalize_blanks, "preview": preview, "base_name": base_name,
    "mime_type": mime_type, "content_kind": content_kind, "round3": round3, "main_text": main_text,
}

_MIME_SQL = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in MIME.items()) + ")"
_BODY = "h"
for _tag in ("head", "script", "style", "nav", "footer", "header", "aside", "noscript"):
    _BODY = f"regexp_replace({_BODY}, r'(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', ' ')"
_BODY = rf"regexp_replace(regexp_replace({_BODY}, r'(?s)<!--.*?-->', ' '), r'(?s)<[^>]*>', ' ')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
    _BODY = f"replace({_BODY}, '{_entity}', '{_char}')"
_BODY = rf"trim(regexp_replace({_BODY}, r'\s+', ' '))"
_TITLE = "trim(regexp_extract(h, r'(?is)<title[^>]*>(.*?)</title>', 1))"
_HEAD = "regexp_replace(substring(t, 1, 512), '[A-Za-z0-9 ]', '')"

#: The same as SQL expressions, which the optimiser sees through.
SQL_FORMS = {
    "estimate_tokens": f"(t STRING) RETURNS BIGINT RETURN CASE WHEN length(t) = 0 THEN 0 ELSE CAST(ceil(octet_length(encode(t, 'UTF-16BE')) / 2"
    f" / CASE WHEN length({_HEAD}) >= 0.3 * length(substring(t, 1, 512)) THEN 3 ELSE 4 END) AS BIGINT) END",
    "content_hash": "(t STRING) RETURNS STRING RETURN sha2(t, 256)",
    "normalize_prompt": r"(t STRING) RETURNS STRING RETURN regexp_replace(trim(regexp_replace(lower(t), r'" + BLANK + r"+', ' ')), '[?.!,;:]+$', '')",
    "parse_approval": "(t STRING) RETURNS STRING RETURN CASE WHEN contains(lower(t), 'approve') OR contains(lower(t), 'yes') OR lower(t) = 'y' THEN 'approved'"
    " WHEN contains(lower(t), 'reject') OR contains(lower(t), 'no') OR lower(t) = 'n' THEN 'rejected' ELSE 'unclear' END",
    "normalize_blanks": r"(t STRING) RETURNS STRING RETURN trim(regexp_replace(t, r'" + BLANK + r"+', ' '))",
    "preview": "(t STRING) RETURNS STRING RETURN CASE WHEN length(t) <= 160 THEN t ELSE concat(substring(t, 1, 157), '...') END",
    "base_name": "(p STRING) RETURNS STRING RETURN element_at(split(p, '/'), -1)",
    "mime_type": f"(p STRING) RETURNS STRING RETURN coalesce(try_element_at({_MIME_SQL}, CASE WHEN contains(element_at(split(p, '/'), -1), '.')"
    " THEN lower(element_at(split(element_at(split(p, '/'), -1), '[.]'), -1)) END), 'text/plain')",
    "content_kind": "(x STRING) RETURNS STRING RETURN CASE WHEN contains(lower(x), 'application/pdf') THEN 'pdf'"
    " WHEN contains(lower(x), 'text/plain') OR contains(lower(x), 'text/markdown') THEN 'text' ELSE 'html' END",
    "round3": "(x DOUBLE) RETURNS DOUBLE RETURN floor(x * 1000 + 0.5) / 1000",
    "main_text": rf"(h STRING) RETURNS STRING RETURN CASE WHEN {_TITLE} <> '' THEN concat('# ', {_TITLE}, '\n\n', {_BODY}) ELSE {_BODY} END",
}


def names(*wanted: str) -> list[str]:
    """Names of the functions there are, or of those among ``wanted``."""
    return [k for k in sorted(REGISTRY) if not wanted or k in wanted]


def resolve(name: str):
    if name not in REGISTRY:
        raise KeyError(f"no function {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def register(spark: SparkSession) -> None:
    """SQL functions of the session: expressions, which the optimiser sees through."""
    for name, body in SQL_FORMS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
