"""Names and text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)\.([^.]+)$", 1))


#: Extensions of each kind of file.
JPEG = ["jpg", "jpeg", "jpe", "heic", "heif"]
RAW = ["cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "raf", "orf", "rw2", "pef", "dng", "raw", "3fr", "iiq", "erf", "mrw"]
VIDEO = ["mov", "mp4", "m4v", "avi", "mts", "m2ts"]


def media_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(JPEG), "jpeg").when(ext.isin(RAW), "raw").when(ext.isin(VIDEO), "video").otherwise("other")


def sanitise_date(x: Column) -> Column:
    """Digits and hyphens of x; null if fewer than six remain."""
    kept = F.regexp_replace(x, "[^0-9-]", "")
    return F.when(F.length(kept) >= 6, kept)


def sanitise_block(x: Column) -> Column:
    """Without white space, `_` as `-`, and ASCII letters, digits and hyphens only."""
    return F.regexp_replace(F.translate(F.regexp_replace(x, r"\s", ""), "_", "-"), "[^A-Za-z0-9-]", "")


def build_prefix(*blocks: Column) -> Column:
    """The blocks that are neither null nor empty, joined by hyphens."""
    return F.array_join(F.filter(F.array(*blocks), lambda b: b.isNotNull() & (b != "")), "-")


def leading_number(x: Column) -> Column:
    """The first whole number anywhere in x; null without one or past 64 bits."""
    found = F.regexp_extract(x, "([0-9]+)", 1)
    number = F.expr("0").cast("decimal(38,0)")
    number = F.when(F.length(F.regexp_replace(found, "^0+", "")) <= 20, F.when(found != "", found).cast("decimal(38,0)"))
    return F.when(number < F.lit("18446744073709551616").cast("decimal(38,0)"), number.cast("decimal(20,0)"))


def duplicate_suffix(name: Column) -> Column:
    """struct<name, number> of `photo(1).jpg`: `photo.jpg` and `1`; null without such a suffix."""
    pattern = r"^(.*)\(([0-9]+)\)(\.[^.]*)?$"
    return F.when(name.rlike(pattern), F.struct(F.concat(F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 3)).alias("name"), F.regexp_extract(name, pattern, 2).alias("number")))


def sidecar_candidates(name: Column) -> Column:
    """Names that a photograph's JSON sidecar may have, likeliest first: exact, number moved behind, number dropped, each cut to 46 bytes."""
    split = duplicate_suffix(name)
    bodies = F.filter(F.array(name, F.concat(split["name"], F.lit("("), split["number"], F.lit(")")), split["name"]), lambda x: x.isNotNull())
    cut = F.transform(F.filter(bodies, lambda x: F.octet_length(x) > 46), lambda x: F.substring(x, 1, 46))
    return F.array_distinct(F.transform(F.concat(bodies, cut), lambda x: F.concat(x, F.lit(".json"))))


def shorten_caption(name: Column) -> Column:
    """At most 28 characters as they are, else 18 of the stem, an ellipsis and the extension with its dot."""
    ext = F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1)
    head = F.substring(F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", ""), 1, 18)
    return F.when(F.length(name) <= 28, name).otherwise(F.concat(head, F.lit("..."), ext))


def page_name(base: Column, page: Column, pages: Column) -> Column:
    return F.when(pages > 1, F.format_string("%s_p%03d.jpg", base, page)).otherwise(F.concat(base, F.lit(".jpg")))


def slug(x: Column) -> Column:
    """Everything but letters and digits, of any script, as a hyphen; case stays."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}]", "-")


def human_bytes(n: Column) -> Column:
    """Bytes, KB or MB with one digit; a tie goes to the even digit."""
    in_units = lambda unit, name: F.format_string(f"%.1f {name}", F.bround(n.cast("double") / unit, 1))
    return F.when(n == 0, "no bytes").when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, in_units(1 << 10, "KB")).otherwise(in_units(1 << 20, "MB"))


def fill_template(template: Column, **values: Column) -> Column:
    """{name} fields filled in, signs other than `-_. ` as hyphens; null if nothing or only dots are left."""
    out = template
    for k, v in values.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), F.coalesce(v, F.lit("")))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}. _-]", "-")
    return F.when(~out.rlike(r"^ *\.* *$"), out)


def keyed_id(*parts: Column) -> Column:
    """SHA-256 of the parts, null as empty, each ended by a zero character but the last."""
    return F.sha2(F.concat_ws("\x00", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def shot_scope(label: Column, fingerprint: Column) -> Column:
    """What tells a card from another: its label, else its content."""
    return F.coalesce(label, F.concat(F.lit("fingerprint:"), fingerprint))


def name_problem(name: Column) -> Column:
    """Why a preset may not have this name; null if it may."""
    bare = F.trim(name)
    return (
        F.when(bare.isNull() | (bare == ""), "empty")
        .when(F.length(bare) > 64, "longer than 64 characters")
        .when(bare.rlike(r"[/\\:\x00-\x1f]"), "a sign that is not allowed")
        .when(bare.startswith("."), "starts with a dot")
    )


def table_format(name: Column) -> Column:
    """What a colour table's file name says that it is."""
    low = F.lower(name)
    return F.when(low.endswith(".cube"), "cube").when(low.endswith(".3dl"), "3dl").when(low.endswith(".png"), "hald_png").otherwise("unknown")


def run_summary(done: Column, noun: str, failed: Column, skipped: Column, first_reason: Column, accepted: Sequence[str] = ()) -> Column:
    """A run's closing line, also when nothing was done."""
    reads = f" Accepted: {' '.join('.' + e for e in accepted)}." if accepted else ""
    none = F.when(skipped > 0, F.format_string(f'No work: %d skipped; first reason: "%s".{reads}', skipped, first_reason)).otherwise(
        f"No work: no file matched.{reads} Subfolders are read only on request."
    )
    line = F.concat(F.format_string(f"%d {noun}, %d failed", done, failed), F.when(skipped > 0, F.format_string(", %d skipped", skipped)).otherwise(""))
    return F.when((done == 0) & (failed == 0), none).otherwise(line)


def seed_of(sha256: Column) -> Column:
    """The first sixteen hexadecimal digits as a number (decimal(20,0)); null for other texts."""
    return F.when(sha256.rlike("^[0-9A-Fa-f]{16}"), F.conv(F.substring(sha256, 1, 16), 16, 10).cast("decimal(20,0)"))


def decode_base64(x: Column) -> Column:
    """Bytes; null for what is no base64."""
    return F.try_to_binary(x, F.lit("base64"))


def xml_escape(x: Column) -> Column:
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
