"""Texts of the run log, signatures, keys, shares and pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _whole(raw: Column, kind: Column) -> tuple[Column, Column]:
    """(value, beyond) of a variant that holds a whole number; numbers beyond 64 bits are told by their 19 digits or more."""
    return F.when(kind == "BIGINT", F.try_variant_get(raw, "$", "bigint")), kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")


def strict_int(raw: Column, lo: int, hi: int, default: int) -> tuple[Column, Column]:
    """(value, error) of a JSON value (a variant): absent or null gives the default; texts, booleans and fractions are refused, never truncated."""
    kind = F.schema_of_variant(raw)
    value, beyond = _whole(raw, kind)
    absent = raw.isNull() | (kind == "VOID")
    error = F.when(absent, F.lit(None).cast("string")).when(value.isNull() & ~beyond, "not an integer").when(~F.coalesce(value.between(lo, hi), F.lit(False)), "out of range")
    return F.when(absent, F.lit(default)).when(error.isNull(), value), error


def loose_int(raw: Column, lo: int, hi: int, default: int) -> tuple[Column, Column]:
    """Like ``strict_int``, but whole numbers in texts are read, fractions lose their decimals and booleans count 0 and 1."""
    kind = F.schema_of_variant(raw)
    value, beyond = _whole(raw, kind)
    text = F.trim(F.try_variant_get(raw, "$", "string"))
    typed = F.when((kind == "STRING") & text.rlike("^[+-]?[0-9]+$"), F.coalesce(text.try_cast("long"), F.lit(hi + 1).cast("long")))
    number = F.when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(raw, "$", "double").cast("long")).when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("long"))
    value = F.coalesce(value, F.when(~beyond, number), typed)
    absent = raw.isNull() | (kind == "VOID")
    error = F.when(absent, F.lit(None).cast("string")).when(value.isNull() & ~beyond, "not an integer").when(~F.coalesce(value.between(lo, hi), F.lit(False)), "out of range")
    return F.when(absent, F.lit(default)).when(error.isNull(), value), error


def number(raw: Column) -> Column:
    """Blank and null stay null, the rest is cast."""
    return F.when(F.trim(raw) != "", raw).try_cast("double")


def cell(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def cell_list(values: Column) -> Column:
    return F.coalesce(F.array_join(values, " / "), F.lit(""))


def counts_text(counts: Column) -> Column:
    """A map as "k=v;k=v", sorted by key; "" when empty or null."""
    entries = F.array_sort(F.map_entries(counts))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"), F.lit(""))


def stage_ms(stages: Column, name: str) -> Column:
    """elapsed_ms of the first stage of this name, or null."""
    return F.try_element_at(F.filter(stages, lambda s: s["stage"] == name), F.lit(1))["elapsed_ms"]


def stages_text(stages: Column, field: str) -> Column:
    """"stage=value;..." in the order of the stages."""
    return F.coalesce(F.array_join(F.transform(stages, lambda s: F.concat(s["stage"], F.lit("="), F.coalesce(s[field].cast("string"), F.lit("")))), ";"), F.lit(""))


def source_text(entries: Column) -> Column:
    """Counters of the candidate sources (array of struct) as "src:r=,d=,s=,x=,f=,u=", sorted."""
    one = lambda e: F.format_string("%s:r=%d,d=%d,s=%d,x=%d,f=%d,u=%d", e["source"], e["raw"], e["duplicate"], e["size"], e["disconnected"], e["failed"], e["unique"])
    return F.array_join(F.array_sort(F.transform(entries, one)), ";")


def ids_signature(ids: Column) -> Column:
    """First 8 of the md5 over the sorted ids; coordinates don't enter."""
    return F.left(F.md5(F.array_join(F.array_sort(ids), "|")), F.lit(8))


def short_key(group_a: Column, group_b: Column) -> Column:
    """8 letters that stand for a partition."""
    digest = F.left(F.md5(F.concat_ws("|", F.array_join(group_a.cast("array<string>"), ","), F.array_join(group_b.cast("array<string>"), ","))), F.lit(8))
    return F.when((F.size(group_a) > 0) | (F.size(group_b) > 0), digest).otherwise("--------")


def seed_of(content_hash: Column) -> Column:
    """A number from a matrix's hash."""
    return F.conv(F.left(F.md5(content_hash), F.lit(8)), 16, 10).cast("long")


def matrix_content_hash(dur: Column, dist: Column) -> Column:
    """First 12 of the md5 over both matrices, cell by cell."""
    def one(m):
        rows = F.array_join(F.transform(m, lambda r: F.concat(F.array_join(F.transform(r, lambda v: F.coalesce(v.cast("string"), F.lit(""))), ","), F.lit(";"))), "")
        return F.coalesce(rows, F.lit("|none|"))

    return F.left(F.md5(F.concat(one(dur), one(dist))), F.lit(12))


def coordinates_key(profile: Column, coords: Column, what: str = "duration+distance") -> Column:
    """Cache key of ordered [lon, lat] pairs, 6 decimals."""
    pairs = F.array_join(F.transform(coords, lambda c: F.format_string("%.6f,%.6f", c[0], c[1])), ";")
    return F.md5(F.concat_ws("|", profile, F.lit(what), pairs))


def routes_key(profile: Column, routes: Column) -> Column:
    """Cache key of a map request: profile and every ordered coordinate."""
    one = lambda r: F.array_join(F.transform(r, lambda c: F.format_string("%.6f,%.6f;", c[0], c[1])), "")
    return F.md5(F.concat(F.coalesce(profile, F.lit("")), F.lit("#"), F.array_join(F.transform(routes, one), "#")))


def one_sided_key(a: Column, b: Column) -> Column:
    """The sorted side that holds the smallest index."""
    x, y = F.array_sort(a), F.array_sort(b)
    return F.when(F.size(y) == 0, x).when((F.size(x) > 0) & (F.element_at(x, 1) < F.element_at(y, 1)), x).otherwise(y)


def canonical_key(a: Column, b: Column) -> Column:
    """Both sorted sides, the lesser first: mirror images are equal."""
    x, y = F.array_sort(a), F.array_sort(b)
    return F.least(F.struct(x.alias("a"), y.alias("b")), F.struct(y.alias("a"), x.alias("b")))


def partition_difference(p: Column, q: Column) -> Column:
    """How many points change side between two keys, sides exchanged or not."""
    moved = lambda s, t: F.size(F.array_except(s, t))
    return F.least(moved(p["a"], q["a"]) + moved(p["b"], q["b"]), moved(p["a"], q["b"]) + moved(p["b"], q["a"]))


def source_family(source: Column) -> Column:
    return F.substring_index(source, ":", 1)


def split_ids(text: Column) -> Column:
    """Ids typed as free text: separated by line ends, commas, semicolons or tabs, never by spaces; trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, "[\n\r,;\t]+"), lambda x: F.trim(x)), lambda x: x != "")


def chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, each marked with "~" so that no sheet reads it as a formula."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("~"), F.substring(text, i * size + 1, F.lit(size))))


def joined_chunks(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.substring(p, F.lit(2), F.length(p))), "")


def nested(block: Column, field: str, default) -> Column:
    """A field of a struct that may be null, with a default."""
    return F.coalesce(block[field], F.lit(default))


def html_safe(text: Column) -> Column:
    """JSON that may stand inside a page's script: "<" and the two line separators are escaped."""
    out = F.replace(text, F.lit("<"), F.lit("\\u003c"))
    return F.replace(F.replace(out, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def file_name(signature: Column, at: Column, stem: str = "map") -> Column:
    safe = F.left(F.regexp_replace(F.coalesce(signature, F.lit("")), "[^A-Za-z0-9_-]", ""), F.lit(40))
    return F.concat_ws("_", F.lit(stem), F.when(safe != "", safe), F.date_format(at, "yyyy-MM-dd_HH-mm"))


def token() -> Column:
    """64 hexadecimal letters of two random UUIDs."""
    return F.replace(F.concat(F.uuid(), F.uuid()), F.lit("-"), F.lit(""))


def scrubbed(text: Column, most: int = 400) -> Column:
    """Lines that hint at secrets are hidden, and the rest is cut to ``most`` characters."""
    hidden = F.regexp_replace(text, r"(?im)^.*(?:authorization|api[_-]?key|token|secret|password).*$", "[hidden]")
    return F.left(hidden, F.lit(most))


def valid_app_url(url: Column, hosts: tuple[str, ...], forbidden: tuple[str, ...] = ("/dev", "/edit")) -> Column:
    """Null when a web-app address is fit to share, else what is wrong with it; the first fault counts."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(u, "^https://([^/?#]+)", 1))
    right = F.lit(False)
    for h in hosts:
        right = right | (host == h) | host.endswith("." + h)
    wrong = F.lit(False)
    for f in forbidden:
        wrong = wrong | (F.instr(u, f) > 0)
    return (
        F.when(u == "", "empty").when(~u.startswith("https://"), "not https").when(u.rlike("[?#]"), "has parameters")
        .when(wrong, "not a deployment").when(~right, "foreign host").when(~u.endswith("/exec"), "not an exec address")
    )


def deployment_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), "/s/([^/]+)/exec$", 1), F.lit(""))
