"""Text functions: aliases, accessions, alleles, casts, releases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accession patterns, decisions, media types by suffix, in the order they are tried.
ACCESSIONS = {
    "run": r"^[SED]RR[0-9]{6,}$",
    "experiment": r"^[SED]RX[0-9]{6,}$",
    "study": r"^[SED]RP[0-9]{6,}$",
    "biosample": r"^SAM(?:N|EA|D)[0-9]+$",
    "bioproject": r"^PRJ(?:NA|EB|DB)[0-9]+$",
}
DECISIONS = ("TP", "FP", "FN", "N", "UNK", "IGN")
MEDIA_TYPES = (
    (".vcf.gz", "application/gzip"),
    (".tbi", "application/octet-stream"),
    (".bed", "text/tab-separated-values"),
    (".fasta.gz", "application/gzip"),
    (".fasta", "text/plain"),
    (".fai", "text/plain"),
    (".gzi", "application/octet-stream"),
    (".parquet", "application/vnd.apache.parquet"),
    (".tsv", "text/tab-separated-values"),
    (".json", "application/json"),
    (".yaml", "text/yaml"),
    (".md", "text/markdown"),
    (".zip", "application/zip"),
    (".log", "text/plain"),
)
MEDIA_TYPES_1A = (
    (".vcf.gz", "application/gzip"),
    (".tbi", "application/octet-stream"),
    (".bed", "text/tab-separated-values"),
    (".fasta.gz", "application/gzip"),
    (".fai", "text/plain"),
    (".gzi", "application/octet-stream"),
    (".tsv", "text/tab-separated-values"),
    (".txt", "text/plain"),
    (".md", "text/markdown"),
    (".zip", "application/zip"),
)


def stripped(x: Column) -> Column:
    """x without white space of any kind at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def alias_key(x: Column) -> Column:
    """Lookup key of a vocabulary term: stripped, lower case, runs of white space, _ and - as one space."""
    return F.regexp_replace(F.lower(stripped(x)), r"(?U)[\s_-]+", " ")


def accession(x: Column, kind: str) -> Column:
    """x if it is an accession of the kind, else null."""
    return F.when(x.rlike(ACCESSIONS[kind]), x)


def split_distinct(*columns: Column) -> Column:
    """Distinct non-empty parts of ;-separated lists, in the order they come."""
    parts = F.concat(*[F.split(F.coalesce(c, F.lit("")), ";", -1) for c in columns])
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def with_scheme(uri: Column, scheme: str = "ftp") -> Column:
    return F.when(uri.contains("://"), uri).otherwise(F.concat(F.lit(f"{scheme}://"), uri))


def allele_lookup_key(assembly: Column, contig: Column, pos: Column, ref: Column, alts: Column) -> Column:
    """assembly|contig|pos|REF|ALT of a record with one plain alternative allele, else null."""
    plain = r"(?i)^[ACGTN]+$"
    alt = F.get(alts, F.lit(0))
    fits = (F.size(alts) == 1) & ref.rlike(plain) & alt.rlike(plain)
    return F.when(fits, F.concat_ws("|", assembly, contig, pos.cast("string"), F.upper(ref), F.upper(alt)))


def id_token(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9_.-]+", "_")


def value_text(values: Column) -> Column:
    """Values of a call joined by /, a dot for each null; UNKNOWN for none at all."""
    return F.when(values.isNull(), F.lit("UNKNOWN")).otherwise(F.array_join(values.cast("array<string>"), "/", "."))


def genotype_text(alleles: Column, phased: Column) -> Column:
    texts = alleles.cast("array<string>")
    return F.when(alleles.isNull(), F.lit("UNKNOWN")).when(phased, F.array_join(texts, "|", ".")).otherwise(F.array_join(texts, "/", "."))


def media_type(name: Column, types: tuple[tuple[str, str], ...] = MEDIA_TYPES) -> Column:
    """The type of the first suffix that a name has; MEDIA_TYPES_1A is the first phase's table."""
    out = F.lit("application/octet-stream")
    for suffix, kind in reversed(types):
        out = F.when(name.endswith(suffix), F.lit(kind)).otherwise(out)
    return out


def decision(raw: Column) -> Column:
    return F.when(raw.isin(*DECISIONS), raw).otherwise(F.lit("OTHER"))


def is_snv(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_indel(ref: Column, alt: Column) -> Column:
    return F.length(ref) != F.length(alt)


def optional(x: Column) -> Column:
    """Null for empty text."""
    return F.nullif(x, F.lit(""))


def integer(x: Column) -> Column:
    """Strict: text that is no integer fails the query."""
    return x.cast("long")


def optional_integer(x: Column) -> Column:
    """Null for empty text; other text that is no integer fails the query."""
    return optional(x).cast("long")


def optional_float(x: Column) -> Column:
    return optional(x).cast("double")


def non_negative(x: Column) -> Column:
    """A non-negative integer, else null."""
    n = F.when(F.trim(x).rlike(r"^[+-]?[0-9]+$"), F.trim(x).try_cast("long"))
    return F.when(n >= 0, n)


def boolean(x: Column) -> Column:
    """true or false in any case; anything else fails the query."""
    text = F.lower(F.trim(x))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(x, F.lit("null")))).cast("boolean"))


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_md5(x: Column) -> Column:
    return F.coalesce(x.rlike("^[0-9a-f]{32}$"), F.lit(False))


def utc_text(ts: Column) -> Column:
    """ISO text to the second with Z; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def semver(x: Column) -> Column:
    """(major, minor, patch), null if x isn't three dotted integers."""
    p = F.split(x, r"\.")
    return F.when(x.rlike(r"^\d+\.\d+\.\d+$"), F.struct(*[p[i].cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def release_kind(previous: Column, current: Column) -> Column:
    """MAJOR, MINOR or PATCH of a release that follows another, else the reason why it can't."""
    a, b = semver(previous), semver(current)
    major = F.when((b["minor"] == 0) & (b["patch"] == 0), F.lit("MAJOR")).otherwise(F.lit("MAJOR_MUST_RESET"))
    minor = F.when(b["patch"] == 0, F.lit("MINOR")).otherwise(F.lit("MINOR_MUST_RESET"))
    return F.when(a.isNull() | b.isNull(), F.lit("NOT_SEMVER")).when(b <= a, F.lit("NOT_ADVANCING")).when(a["major"] != b["major"], major).when(a["minor"] != b["minor"], minor).otherwise(F.lit("PATCH"))


def karyotype_rank(contig: Column) -> Column:
    """1 to 22, X 23, Y 24, M or MT 25; null for others."""
    name = F.upper(F.regexp_replace(contig, "^chr", ""))
    return F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(F.when(name.rlike("^[0-9]+$"), name.try_cast("int")))


def karyotype_key(contig: Column, variant: str = "sex") -> Column:
    """Sort keys for contigs: 'sex' (X, Y, M as 23 to 25), 'text' (numbers, then text), 'last' (others 1000)."""
    name = F.regexp_replace(contig, "^chr", "")
    number = F.when(name.rlike("^[0-9]+$"), name.try_cast("int"))
    if variant == "sex":
        return F.struct(F.coalesce(karyotype_rank(contig), F.lit(1000)).alias("rank"), name.alias("name"))
    if variant == "text":
        return F.struct(number.isNull().cast("int").alias("rank"), F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNull(), name).otherwise(F.lit("")).alias("name"))
    return F.struct(F.coalesce(number, F.lit(1000)).alias("rank"), contig.alias("name"))


def list_literal(x: Column) -> Column:
    """The items of a list in brackets as texts: numbers, texts quoted by ' or ", escapes; parted by commas, or texts by white space.

    No text and an empty one are an empty list; anything that is no list fails the query.
    """
    held = F.trim(x)
    listed = F.when(held.startswith("("), F.regexp_replace(held, r"^\((.*)\)$", "[$1]")).otherwise(held)
    listed = F.regexp_replace(listed, r",\s*\]$", "]")
    parsed = lambda t: F.from_json(t, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    items = F.coalesce(parsed(listed), parsed(F.regexp_replace(listed, r"""(?<=['"])\s+(?=['"])""", ", ")))
    empty = F.array().cast("array<string>")
    return F.when(x.isNull() | (held == ""), empty).when(items.isNull(), F.raise_error(F.concat(F.lit("no list: "), x)).cast("array<string>")).otherwise(items)


def json_value(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def json_object(text: Column) -> Column:
    """text if it is a JSON object; anything else fails the query. Null stays null."""
    good = text.isNull() | (F.substring(stripped(text), 1, 1) == "{") & F.json_object_keys(text).isNotNull()
    return F.when(F.coalesce(good, F.lit(False)), text).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.coalesce(text, F.lit("")))).cast("string"))


def json_has_exactly(text: Column, keys: list[str]) -> Column:
    """Whether a JSON object has just these keys, each with a non-empty value."""
    wanted = F.array(*[F.lit(k) for k in keys])
    found = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    full = F.lit(True)
    for k in keys:
        full &= F.coalesce(F.length(json_value(text, k)) > 0, F.lit(False))
    return (F.size(F.array_except(found, wanted)) == 0) & (F.size(F.array_except(wanted, found)) == 0) & full


def read_type(layout: Column, technology: Column) -> Column:
    long = technology.isin("nanopore", "smrt")
    known = technology != "UNKNOWN"
    return (
        F.when((layout == "PAIRED") & known & ~long, F.lit("SHORT_PAIRED_END"))
        .when((layout == "SINGLE") & long, F.lit("LONG_SINGLE_MOLECULE"))
        .when((layout == "SINGLE") & known, F.lit("SHORT_SINGLE_END"))
        .otherwise(F.lit("UNKNOWN"))
    )
