"""Scalar helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN_EDGES = ("fraud_partner", "socio_de", "pagou", "similar_a", "not_related")
ACCENTS = ("ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN")


def ts_ms(hlc: Column) -> Column:
    return F.shiftrightunsigned(hlc, 16)


def hlc_counter(hlc: Column) -> Column:
    return hlc.bitwiseAND(0xFFFF)


def edge_type_key(t: Column) -> Column:
    """Lower-cased; the known types by their name (with or without underscores), any other behind "custom:"."""
    low = F.lower(t)
    out = F.when(low.startswith("custom:"), low).otherwise(F.concat(F.lit("custom:"), low))
    for k in KNOWN_EDGES:
        out = F.when(low.isin(k, k.replace("_", "")), k).otherwise(out)
    return out


def edge_key(t: str) -> str:
    """edge_type_key of a constant."""
    low = t.lower()
    for k in KNOWN_EDGES:
        if low in (k, k.replace("_", "")):
            return k
    return low if low.startswith("custom:") else f"custom:{low}"


def edge_id(src: Column, dst: Column, key: Column) -> Column:
    """Injective: each part behind its length in bytes."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.concat(F.lit("e2:"), part(src), part(dst), part(key))


def logit(p: Column) -> Column:
    c = F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4))
    return F.ln(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_name(s: Column) -> Column:
    """Capital letters without accents; whatever is no letter parts words."""
    return F.trim(F.regexp_replace(F.translate(F.upper(s), *ACCENTS), "[^A-Z]+", " "))


PARTICLES = ("DE", "DA", "DO", "DOS", "DAS", "E")


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the words of two normal names, without particles; nothing on a side is 0."""
    words = lambda s: F.array_distinct(F.filter(F.split(s, " "), lambda t: (t != "") & ~t.isin(*PARTICLES)))
    return jaccard(words(a), words(b))


def cpf_fragment(masked: Column) -> Column:
    """The six digits that a masked number shows; null if it shows any other count, which is no block to trust."""
    d = F.regexp_replace(masked, "[^0-9]", "")
    return F.when(F.length(d) == 6, d)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(0.0)


def basis_points(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.least(F.floor(n * 10000 / F.when(d > 0, d)), F.lit(10000))).otherwise(0).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def domain_suffixes(host: Column) -> Column:
    """host, and what is left as its labels go one by one."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def canonical_domain(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), r"\.+$", "")


LABEL = "[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?"


def valid_domain(s: Column) -> Column:
    """The canonical domain, or null where a label is empty, too long, begins or ends with a hyphen or has other characters."""
    d = canonical_domain(s)
    return F.when(d.rlike(f"^{LABEL}(?:\\.{LABEL})*$") & (F.length(d) <= 253), d)


def canonical_email(s: Column) -> Column:
    """The domain is canonical; the part before it is the receiving host's affair and stays. Null if either is missing."""
    t = F.trim(s)
    local, domain = F.regexp_extract(t, "^(.*)@[^@]*$", 1), valid_domain(F.regexp_extract(t, "@([^@]*)$", 1))
    return F.when(local != "", F.concat(local, F.lit("@"), domain))


DIGITS = {"md5": 32, "sha1": 40, "sha256": 64, "sha3_256": 64, "sha512": 128}


def canonical_hash(s: Column, algorithm: str | None = None) -> Column:
    """Lower-case hexadecimal digits of the algorithm's length (of MD5, SHA-1 or SHA-256, if none is named), else null."""
    low = F.lower(F.trim(s))
    sizes = [DIGITS[algorithm]] if algorithm else [32, 40, 64]
    return F.when(low.rlike("^(" + "|".join(f"[0-9a-f]{{{n}}}" for n in sizes) + ")$"), low)


PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def canonical_url(s: Column) -> Column:
    """Scheme and host in lower case, a default port dropped; user, path, query and fragment stay as they are, as they may
    mean something else in another spelling. Null for other schemes and for what is no host."""
    t = F.trim(s)
    part = lambda i: F.regexp_extract(t, r"^([A-Za-z]+)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^/?#@:]*)(?::([0-9]+))?((?:[/?#].*)?)$", i)
    scheme = F.lower(part(1))
    host = F.when(part(3).startswith("["), F.lower(part(3))).otherwise(valid_domain(part(3)))
    default = F.lit(False)
    for k, p in PORTS.items():
        default = default | ((scheme == k) & (part(4) == p))
    port = F.when((part(4) == "") | default, "").when(part(4).cast("long") <= 65535, F.concat(F.lit(":"), part(4).cast("long").cast("string")))
    user = F.when(part(2) != "", F.concat(part(2), F.lit("@"))).otherwise("")
    return F.when(scheme.isin(*PORTS), F.concat(scheme, F.lit("://"), user, host, port, part(5)))


def ipv4(s: Column) -> Column:
    """An IPv4 address as a number, or null."""
    p = F.transform(F.split(F.trim(s), r"\."), lambda x: x.try_cast("long"))
    ok = F.trim(s).rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.array_max(p) <= 255)
    return F.when(ok, F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a * 256 + x))
