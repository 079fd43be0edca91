r"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings, leftmost non-overlapping per kind: `assign` (a password-like name, : or =, a value of 6 characters or
more), `access` (AKIA, capitals and digits, 20 or more characters) and `hex` (24 or more of 0-9a-f).

Weak candidates mean nothing alone: `identifier` (user or client names), `blob` (32 or more base64 characters) and
`endpoint` (connection URLs and host settings).  They are interval-joined, within a scope of some code points, with the
parts that complement them: an identifier needs a secret; a secret needs an identifier or an endpoint; an endpoint
needs a secret.  Base findings take part: assign and hex as secrets, access as an identifier.  Only weak candidates
with such a part are reported.  Parts are dealt by row and by scope-wide bucket, so a join meets the parts of
three buckets, not of a whole document; it is a semi join and makes no pairs.

Edge cases: a null text is empty and has no findings; rows that repeat doc_id and text get the same answer; a null
doc_id stays null; extra columns are ignored; an empty table gives no rows.  Texts are scanned whole, whatever their
length; of spans that start together the kind's order decides.  Offsets are code points, end exclusive.

The patterns run once over each text; what they find is kept as a narrow frame that all further steps read.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberlake.llm.common import keyed

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run cut short would fail whole, as its parts are shorter still: the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
IDENTIFIER = r"""(?i)(?<![a-z0-9])(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,}+)"""
BLOB = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}"
ENDPOINT = r"""(?i)(?<![a-z0-9])(?:(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}+)"""

#: kind: (order among kinds that start together, name, class of credential part, weak)
KINDS = [(0, "assign", "secret", False), (1, "access", "identifier", False), (2, "hex", "secret", False), (3, "identifier", "identifier", True), (4, "blob", "secret", True), (5, "endpoint", "endpoint", True)]
_SPAN = "array<struct<start:long,kind:int,end:long>>"


def spans_of(text: Column, pattern: str, kind: int, matches: Column, value: tuple[int, int] | None = None) -> Column:
    """Spans of all matches: what split() leaves between them gives their places.  value: (group, least length)."""
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(matches, F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value[0])), F.length) if value else lengths
    least = value[1] if value else 0
    parts = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), lengths.alias("length"), sizes.alias("size"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + part["length"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        out = F.when(part["size"] >= least, F.concat(state["out"], one)).otherwise(state["out"])
        return F.struct(F.coalesce(end, state["at"]).alias("at"), out.alias("out"))

    found = F.aggregate(parts, empty, step, lambda s: s["out"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(_SPAN))


def scan(rows: DataFrame) -> DataFrame:
    """rows without the text, but with a column of spans for each kind; kept on disk, since several branches read it."""
    patterns = [("assign", ASSIGN, (2, 6)), ("access", ACCESS, None), ("hex", HEX, None), ("identifier", IDENTIFIER, None), ("blob", BLOB, None), ("endpoint", ENDPOINT, None)]
    kept = [c for c in rows.columns if c != "text"]
    matched = rows.select(*kept, "text", *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{n}") for n, p, _ in patterns))
    return matched.select(*kept, *(spans_of(F.col("text"), p, k, F.col(f"m_{n}"), value).alias(n) for k, (n, p, value) in enumerate(patterns))).persist(StorageLevel.DISK_ONLY)


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(n) for _, n, _, _ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(found: DataFrame, scope: int) -> DataFrame:
    """(did, rid, weak): weak spans with a complementary part that starts within `scope` code points."""
    classes = F.array(*(F.lit(c) for _, _, c, _ in KINDS))
    every = F.concat("assign", "access", "hex", "identifier", "blob", "endpoint")
    weak_first = min(k for k, _, _, weak in KINDS if weak)
    able = found.where(F.size("identifier") + F.size("blob") + F.size("endpoint") > 0)
    able = able.where(F.size(every) > 1).select("did", "rid", F.explode(every).alias("s"))
    parts = able.select("did", "rid", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.element_at(classes, F.col("s.kind") + 1).alias("class"))
    parts = parts.withColumn("bucket", F.floor(F.col("start") / scope))
    weak = parts.where(F.col("kind") >= weak_first).withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    other = parts.select(F.col("did").alias("d"), F.col("rid").alias("r"), F.col("bucket").alias("b"), F.col("start").alias("at"), F.col("end").alias("to"), F.col("class").alias("c"))
    meets = (F.col("did") == F.col("d")) & (F.col("rid") == F.col("r")) & (F.col("bucket") == F.col("b")) & (F.abs(F.col("start") - F.col("at")) <= scope)
    apart = (F.col("end") <= F.col("at")) | (F.col("to") <= F.col("start"))
    complement = F.when(F.col("class") == "secret", F.col("c") != "secret").otherwise(F.col("c") == "secret")
    hits = weak.join(other, meets & apart & complement, "left_semi")
    return hits.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("weak"))


def secret_scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256 (of the base spans), spans (all, as kind:start:end)."""
    found = scan(keyed(docs))
    weak = linked(found, scope)
    base = F.array_sort(F.concat("assign", "access", "hex"))
    rows = found.select("doc_id", "did", "rid", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), base.alias("base"))
    rows = rows.join(weak, ["did", "rid"], "left").withColumn("weak", F.coalesce("weak", F.array().cast(_SPAN)))
    every = F.array_sort(F.concat("base", "weak"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.size("weak").cast("long").alias("n_linked"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def redact(docs: DataFrame, columns: tuple[str, ...] = (), scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """doc_id, text and the named further columns, each secret (overlapping ones together) replaced by the mark."""
    whole = keyed(docs, *(F.col(c) for c in columns))
    found = scan(whole.select("did", "rid", "text"))
    weak = linked(found, scope)
    spans = found.dropDuplicates(["did", "rid"]).join(weak, ["did", "rid"], "left")
    spans = spans.select("did", "rid", F.array_sort(F.concat("assign", "access", "hex", F.coalesce("weak", F.array().cast(_SPAN)))).alias("spans")).where(F.size("spans") > 0)
    rows = whole.join(spans, ["did", "rid"], "left")
    every = F.coalesce("spans", F.array().cast(_SPAN))

    def step(state, s):
        at = state["at"]
        gap = F.substring(F.col("text"), (at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0)).cast("int"))
        piece = F.when(s["start"] >= at, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(at, s["end"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(every, start, step, lambda x: F.concat(x["out"], F.substring(F.col("text"), (x["at"] + 1).cast("int"), F.length("text"))))
    return rows.select("doc_id", *columns, F.when(F.size(every) > 0, cut).otherwise(F.col("text")).alias("text"))
