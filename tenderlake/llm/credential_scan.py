"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are always reported. Weaker candidates - short or temporary access identifiers, 40-character keys,
hex runs of 16 to 23 characters - are parts: a part is reported only when a part of another role (access identifier,
secret, endpoint) lies within ``scope`` code points of it in the same document. The interval join runs over the parts of
a document in order of place: the running maximum of ends before and the next start after a part, by role, say whether an
interval of that role is near enough, so no pairs are built. Endpoints are scanned on their own, so that parts within a
URL stay candidates, and the endpoint that holds them is near them.

Places come from the lengths of matches and of the text between them, summed along the document. Edge cases: null text
counts as empty; texts are scanned whole, any length; repeated rows are scanned row by row; no match gives no spans (the
digest of the empty string); an empty table gives an empty result; spans, and the count columns, replace input columns
of their names, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let

SCOPE = 256
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # equals the runs AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # equals the runs [0-9a-f]+ of 24 characters or more
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
WEAK = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])|(?<![0-9a-zA-Z])[0-9a-f]{16,23}(?![0-9a-zA-Z])|(?<![A-Z0-9])A(?:KIA[A-Z0-9]{8,15}|SIA[A-Z0-9]{8,})(?![A-Z0-9])"
#: Keys with a slash beside them, which are keys only within an endpoint; none of them is a match of WEAK.
URL_KEY = r"(?<=/)[A-Za-z0-9+]{40}(?![A-Za-z0-9+])|(?<![A-Za-z0-9+/])[A-Za-z0-9+]{40}(?=/)"
PARTS = f"{ENDPOINT}|{WEAK}|{URL_KEY}"  # a text without a match has no parts
#: Kinds in order of the report; role of each.
KINDS = {"assign": "secret", "access": "access", "hex": "secret", "weak_access": "access", "weak_key": "secret", "weak_hex": "secret", "endpoint": "endpoint"}
ROLES = ["access", "secret", "endpoint"]
_PART = "array<struct<pattern:int,nth:int,gap:int,len:int,kind:string>>"


def _matches(text: Column, pattern: str, number: int, kind) -> Column:
    """Each match with the length of the text before it (from the end of the match before)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_PART)

    def parts(m: Column, gaps: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct(F.lit(number).alias("pattern"), i.alias("nth"), F.length(F.get(gaps, i)).alias("gap"), F.length(x).alias("len"), kind(x).alias("kind")))

    with_gaps = lambda m: let(F.split(text, pattern, -1), lambda gaps: parts(m, gaps)).cast(_PART)
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(with_gaps(m)))


def _part_kind(x: Column) -> Column:
    return F.when(x.rlike("^[0-9a-f]{16,23}$"), "weak_hex").when(x.rlike("^A(?:KIA[A-Z0-9]{8,15}|SIA[A-Z0-9]{8,})$"), "weak_access").when(_mixed(x), "weak_key")


def _mixed(x: Column) -> Column:
    return x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in keep, or all) with spans: array of (start, end, kind, linked) in order of place; linked names
    the roles near a part."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "spans"])
    t = F.coalesce(F.col(text), F.lit(""))
    assign_kind = lambda x: F.when(F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6, "assign")
    found = F.concat(
        _matches(t, ASSIGN, 0, assign_kind),
        _matches(t, ACCESS, 1, lambda x: F.lit("access")),
        _matches(t, HEX, 2, lambda x: F.lit("hex")),
        _matches(t, WEAK, 3, _part_kind),
        _matches(t, ENDPOINT, 4, lambda x: F.lit("endpoint")),
        _matches(t, URL_KEY, 5, lambda x: F.when(_mixed(x), "url_key")),
    )
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid"), found.alias("found"))
    rows = rows.select("rid", "row", F.posexplode_outer("found").alias("pos", "part"))
    # The document itself goes along once, with its first part.
    rows = rows.select("rid", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("row")).alias("row"), "part.*").repartition("rid")
    of_pattern = Window.partitionBy("rid", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(of_pattern)).withColumn("start", F.col("end") - F.col("len"))
    within = F.max(F.when(F.col("kind") == "endpoint", F.col("end"))).over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)) >= F.col("end")
    rows = rows.withColumn("kind", F.when(F.col("kind") == "url_key", F.when(within, "weak_key")).otherwise(F.col("kind")))
    role = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    rows = rows.withColumn("role", role).withColumn("order", order)
    by_place = Window.partitionBy("rid").orderBy("start", "order", "end", "nth")
    before, after = by_place.rowsBetween(Window.unboundedPreceding, -1), by_place.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for r in ROLES:
        is_role = F.col("role") == r
        back = F.max(F.when(is_role, F.col("end"))).over(before)
        ahead = F.min(F.when(is_role, F.col("start"))).over(after)
        near[r] = F.coalesce(F.col("start") - back <= scope, F.lit(False)) | F.coalesce(ahead - F.col("end") <= scope, F.lit(False))
    rows = rows.withColumn("linked", F.array_compact(F.array(*[F.when(near[r] & (F.col("role") != r), F.lit(r)) for r in ROLES])))
    # Parts that lie in a base span of their role are reported with it already.
    is_base = F.col("kind").isin("assign", "access", "hex")
    covered = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("end"), F.lit(False))
    reported = is_base | ((F.size("linked") > 0) & ~covered & (F.col("kind") != "endpoint"))
    rows = rows.withColumn("reported", F.coalesce(reported, F.lit(False)))
    span = F.struct(F.col("start").alias("start"), F.col("order").alias("order"), F.col("end").alias("end"), F.col("kind").alias("kind"), F.col("linked").alias("linked"))
    out = rows.groupBy("rid").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("found"))
    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["linked"].alias("linked")))
    return out.select("row.*", spans.alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """scanned with n_assign, n_access, n_hex and base_sha256, and spans as a string."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = {f"n_{k}": of(k) for k in ("assign", "access", "hex")}
    return scanned.withColumns(counts | {"base_sha256": F.sha2(span_list(base), 256)}).withColumn("spans", span_list(F.col("spans")))


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """scanned without spans; each run of overlapping spans in text is replaced by a mark that names its first kind."""
    t = F.col(text)
    ends = free_name(scanned, "ends")
    # Where each span's text begins to be new: the largest end before it.
    prior = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("all")), lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.concat(acc["all"], F.array(acc["end"])).alias("all")))
    out = scanned.withColumn(ends, prior)

    def piece(s: Column, i: Column) -> Column:
        was = F.get(F.col(ends)["all"], i)
        return F.when(s["start"] >= was, F.concat(F.substring(t, was.cast("int") + 1, (s["start"] - was).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

    new = F.concat(F.array_join(F.transform("spans", piece), ""), F.substring(t, F.col(ends)["end"].cast("int") + 1, F.length(t)))
    return out.withColumn(text, F.when(F.size("spans") > 0, new).otherwise(t)).drop(ends, "spans").select(*[c for c in scanned.columns if c != "spans"])
