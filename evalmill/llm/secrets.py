"""Secret scan: the parts of credentials, linked where complementary parts lie close together.

Strong parts (assigned values, access key ids, long hexadecimal strings) are reported by
themselves.  Weak parts are not: an account name, a short assigned value, a long mixed string or an
endpoint is reported only where the other parts of a credential lie in its scope.  The scope of a
part is itself with ``reach`` code points to either side.  Linking is an interval join of the parts
of a text in its merge form: sorted by start, the furthest end before a part and the nearest start
after it decide whether any part of another role meets its scope, so no pairs are made.

Everything is built-in expressions.  A match's place is the length of all gaps and matches before
it, summed by a window, since SQL functions give the matched texts without their places.

Null and empty texts have no spans.  Repeated rows are kept apart.  Ties in start are ordered by
kind, then end.  Columns other than the id and the text are never read by ``find_secrets``;
``redact`` hands all columns of its input through.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm.common import stored

#: Code points to either side of a part in which the other parts of a credential count.
REACH = 240
#: Least lengths: an assigned value by itself, and one that needs complementary parts.
STRONG_VALUE, WEAK_VALUE = 12, 6
MASK = "[REDACTED]"

# Patterns of the parts. A run of at least n characters of a class is the same match
# as a run of any length that is dropped when shorter, so the length is part of the pattern there.
PATTERNS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "account": r"(?i)(?<![a-z0-9])(?:access_?key(?:_?id)?|client_?id|account|user(?:_?name)?|login)"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}",
    "mixed": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"(?i)(?:https?|ftp|amqps?|postgres(?:ql)?|mysql|mongodb|redis)://[^\s\"'<>]+",
}
KINDS = ["assign", "access", "hex", "account", "mixed", "short", "endpoint"]
BASE = KINDS[:3]
ROLES = {
    "assign": "secret", "hex": "secret", "mixed": "secret", "short": "secret",
    "access": "identity", "account": "identity", "endpoint": "endpoint",
}


def _choose(column: Column, values: dict) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*pairs), column)


def _hits(text: Column) -> Column:
    """All matches in a text: kind, length of the gap before, length, and as value the length of an
    assigned value or the number of digits of a mixed string."""

    def of_kind(kind: str, pattern: str) -> Column:
        p = F.lit(pattern)
        value = F.regexp_extract_all(text, p, F.lit(2 if kind == "assign" else 0))
        zipped = F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"),
            F.regexp_extract_all(text, p, F.lit(0)).alias("found"),
            value.alias("value"),
        )
        found = F.transform(
            F.filter(zipped, lambda x: x["found"].isNotNull()),
            lambda x: F.struct(
                F.lit(kind).alias("kind"),
                F.length(x["gap"]).alias("gap"),
                F.length(x["found"]).alias("size"),
                (F.length(F.regexp_replace(x["found"], "[^0-9]", "")) if kind == "mixed" else F.length(x["value"])).alias("value"),
            ),
        )
        none = F.array().cast("array<struct<kind:string,gap:int,size:int,value:int>>")
        return F.when(text.rlike(pattern), found).otherwise(none)

    return F.concat(*[of_kind(kind, pattern) for kind, pattern in PATTERNS.items()])


def has_parts(text: Column) -> Column:
    """True where a text holds a part of any kind, strong or weak."""
    return functools.reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(p) for p in PATTERNS.values()])


def find_spans(rows: DataFrame, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """Spans of secrets in ``rows`` (row_id, doc_id, text), and the stored parts with all row ids."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = stored(
        rows.select("row_id", "doc_id", F.posexplode_outer(_hits(text)).alias("place", "hit")).select(
            "row_id", "doc_id", "place", "hit.*"
        ),
        "secret-parts",
    )
    in_order = Window.partitionBy("row_id", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        hits.where("kind is not null")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_order))
        .withColumn("start", F.col("end") - F.col("size"))
        .withColumn(
            "kind",
            F.when((F.col("kind") == "assign") & (F.col("value") < STRONG_VALUE), F.lit("short")).otherwise(
                F.col("kind")
            ),
        )
        .where((F.col("kind") != "short") | (F.col("value") >= WEAK_VALUE))
        .where((F.col("kind") != "mixed") | (F.col("value") > 0))
        .select("row_id", "start", "end", "kind", _choose(F.col("kind"), ROLES).alias("role"))
    )
    before = Window.partitionBy("row_id").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row_id").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    roles = sorted(set(ROLES.values()))
    met = {
        role: (
            F.coalesce(F.col(f"end_{role}") > F.col("start") - reach, F.lit(False))
            | F.coalesce(F.col(f"start_{role}") < F.col("end") + reach, F.lit(False))
        )
        for role in roles
    }
    complete = (
        F.when(F.col("role") == "secret", met["identity"] | met["endpoint"])
        .when(F.col("role") == "identity", met["secret"])
        .otherwise(met["secret"] & met["identity"])
    )
    linked = (
        parts.select("*", *[F.max(F.when(F.col("role") == r, F.col("end"))).over(before).alias(f"end_{r}") for r in roles])
        .select("*", *[F.min(F.when(F.col("role") == r, F.col("start"))).over(after).alias(f"start_{r}") for r in roles])
        .where(F.col("kind").isin(BASE) | complete)
        .select("row_id", "start", "end", "kind")
    )
    return linked, hits


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (start, order, end, kind)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_column).alias("doc_id"),
        F.col(text_column).alias("text"),
    )
    spans, hits = find_spans(rows, reach)
    order = _choose(F.col("kind"), {k: i for i, k in enumerate(KINDS)})
    found = F.when(F.col("kind").isNotNull(), F.struct("start", order.alias("kind_no"), "end", "kind"))
    # The parts name every document, also those without any span.
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("start", "bigint"), ("end", "bigint"), ("kind", "string"))]
    ids = hits.select("row_id", "doc_id", *nothing)
    both = ids.unionByName(spans.withColumn("doc_id", F.lit(None).cast(ids.schema["doc_id"].dataType)))
    return (
        both.groupBy("row_id")
        .agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(found)).alias("spans"))
        .select("doc_id", "spans")
    )


def redact(docs: DataFrame, text_column: str = "text", reach: int = REACH, mask: str = MASK) -> DataFrame:
    """The documents, with every span of a secret in the text replaced by ``mask``.

    Documents without any part are handed on as they are and are not shuffled.
    """
    flagged = has_parts(F.col(text_column))
    columns = docs.columns
    held = stored(
        docs.where(flagged).select(F.monotonically_increasing_id().alias("row_id"), F.struct(*columns).alias("row")),
        "secret-texts",
    )
    spans, _ = find_spans(
        held.select("row_id", F.lit(0).alias("doc_id"), F.col(f"row.{text_column}").alias("text")), reach
    )
    earlier = Window.partitionBy("row_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("row_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        spans.withColumn("opens", F.coalesce((F.col("start") > F.max("end").over(earlier)).cast("int"), F.lit(0)))
        .withColumn("run", F.sum("opens").over(so_far))
        .groupBy("row_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    )
    text = F.col(f"row.{text_column}")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("runs", lambda x: x["end"]))
    starts = F.concat(F.transform("runs", lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    pieces = F.zip_with(ends, starts, lambda e, s: F.substring(text, (e + 1).cast("int"), (s - e).cast("int")))
    cleaned = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(pieces, mask))
    rewritten = held.join(runs, "row_id", "left").select(
        *[(cleaned if c == text_column else F.col("row").getField(c)).alias(c) for c in columns]
    )
    return docs.where(~flagged).unionByName(rewritten)


def op9_secret_scan(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
