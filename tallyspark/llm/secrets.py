"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans (assignments, access identifiers, long hexadecimal runs) count by themselves. Weak candidates (other
identifiers, long mixed tokens, endpoints) count only where an interval join finds a complementary part close by in the
same document: an identifier or endpoint next to a secret, or a secret next to either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import BROADCAST_ROWS, Staged, let, small, table, table_bytes

# The strong kinds and their patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# The weak kinds.
IDENT = r"(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,}"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"(?:https?|ftps?|sftp|ssh|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"

#: Kinds in the order of their listing, with the role of each as part of a credential.
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
ROLES = {"assign": "S", "access": "A", "hex": "S", "ident": "A", "opaque": "S", "endpoint": "E"}

#: Code points between two parts that still belong together.
REACH = 256

#: Bytes of the table of linked spans up to which it may be broadcast.
BROADCAST_BYTES = 8 << 20

_BLOCK = 128


def _starts(lengths: Column) -> Column:
    """Sums of what stands before each element; by blocks, so that it stays near linear in the elements."""
    zero = F.array().cast("array<int>")

    def before(values: Column, first: Column) -> Column:
        grown = F.aggregate(
            values,
            F.struct(first.cast("int").alias("at"), zero.alias("all")),
            lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
        )
        return grown["all"]

    def whole(x: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))
        )
        return let(
            blocks,
            lambda bs: let(
                before(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda a, v: a + v)), F.lit(0)),
                lambda firsts: F.flatten(F.transform(bs, lambda b, i: before(b, F.get(firsts, i)))),
            ),
        )

    return F.when(F.size(lengths) == 0, zero).otherwise(let(lengths, whole))


def _spans(text: Column, pattern: str, fits: Column, keep=None) -> Column:
    """Spans (s, e in code points, e exclusive) of the leftmost matches. fits: a cheap test that no text with a match
    fails; keep: whether a match counts, from its text and its first group."""
    none = F.array().cast("array<struct<s:int,e:int>>")

    def found(parts: Column, match: Column) -> Column:
        steps = F.zip_with(
            F.transform(F.slice(parts, F.lit(1), F.size(match)), lambda p: F.length(p)),
            F.transform(match, lambda m: F.length(m)),
            lambda p, m: p + m,
        )
        at = let(
            _starts(steps),
            lambda b: F.transform(
                match,
                lambda m, i: F.struct(
                    (F.get(b, i) + F.length(F.get(parts, i))).alias("s"),
                    (F.get(b, i) + F.length(F.get(parts, i)) + F.length(m)).alias("e"),
                ),
            ),
        )
        if keep is None:
            return at
        group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if "([" in pattern else 0))
        return let(at, lambda a: let(group, lambda g: F.filter(a, lambda x, i: keep(F.get(g, i)))))

    return F.when(
        fits,
        let(
            F.split(text, pattern),
            lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: found(p, m)),
        ),
    ).otherwise(none)


def _mixed(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]")


def _scanned(text: Column) -> dict[str, Column]:
    """Spans by kind, strong and weak."""
    has = lambda p: text.rlike(p)
    return {
        "assign": _spans(text, ASSIGN, has(ASSIGN), lambda value: F.length(value) >= 8),
        "access": _spans(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": _spans(text, HEX, has(HEX)),
        "ident": _spans(text, IDENT, has(IDENT)),
        "opaque": _spans(text, OPAQUE, has(OPAQUE), _mixed),
        "endpoint": _spans(text, ENDPOINT, F.contains(text, F.lit("://")) & has(ENDPOINT)),
    }


def _spot(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"))


def _with_spans(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """docs with __k (content key), __strong and __weak (sorted arrays of start, kind, end)."""
    clean = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns({f"__{k}": c for k, c in _scanned(clean).items()})

    def gather(kinds) -> Column:
        return F.array_sort(F.concat(*[F.transform(f"__{k}", _spot(k)) for k in kinds]))

    strong = found.withColumns({"__k": F.xxhash64(*key, text), "__strong": gather(KINDS[:3]), "__weak": gather(KINDS[3:])})
    apart = F.filter(
        "__weak", lambda w: ~F.exists("__strong", lambda b: (b["s"] < w["e"]) & (w["s"] < b["e"]))
    )
    return strong.withColumn("__weak", F.when(F.size("__weak") == 0, F.col("__weak")).otherwise(apart)).drop(
        *[f"__{k}" for k in KINDS]
    )


def _linked(found: DataFrame, key: str, reach: int) -> DataFrame:
    """Weak candidates with a complementary part within reach: __d, __k2 and __linked (sorted spans)."""
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])
    some = found.filter(F.size("__weak") > 0).select(F.col(key).alias("d"), "__k", "__strong", "__weak")
    some = some.dropDuplicates(["d", "__k"])
    weak = some.select("d", "__k", F.explode("__weak").alias("w")).withColumn("role", F.get(roles, F.col("w.k")))
    parts = some.select("d", "__k", F.explode(F.concat("__strong", "__weak")).alias("p")).withColumn("role_", F.get(roles, F.col("p.k")))
    slot = lambda x: F.floor(x / reach).cast("int")
    weak = weak.withColumn("b", F.explode(F.sequence(slot(F.col("w.s") - reach), slot(F.col("w.e") + reach))))
    parts = parts.select(
        F.col("d").alias("d_"), F.col("__k").alias("k_"), "p", "role_", F.explode(F.sequence(slot(F.col("p.s")), slot(F.col("p.e")))).alias("b_")
    )
    close = (
        F.col("d").eqNullSafe(F.col("d_"))
        & (F.col("__k") == F.col("k_"))
        & (F.col("b") == F.col("b_"))
        & (F.col("p.s") < F.col("w.e") + reach)
        & (F.col("p.e") > F.col("w.s") - reach)
        & ((F.col("role") == "S") != (F.col("role_") == "S"))
    )
    hit = weak.join(parts, close, "left_semi")
    return hit.groupBy(F.col("d").alias("__d"), F.col("__k").alias("__k2")).agg(F.array_sort(F.collect_set("w")).alias("__linked"))


def _joined(found: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    linked = Staged(linked, "linked").df
    same = F.col(key).eqNullSafe(F.col("__d")) & (F.col("__k") == F.col("__k2"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    # Rows hold all spans of a text, so bytes count as well as rows.
    few = linked.count() if table_bytes(linked) <= BROADCAST_BYTES else BROADCAST_ROWS + 1
    return found.join(small(linked, few, 20_000), same, "left").withColumn(
        "__all", F.array_sort(F.concat("__strong", F.coalesce("__linked", none)))
    )


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined).

    Positions count code points. A null text is empty and has no spans. Rows that repeat a key and text get equal
    results; null keys are a key of their own. Every text is scanned once and whole.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = Staged(_with_spans(docs, ["key"], "text").select("key", "__k", "__strong", "__weak"), "spans").df
    out = _joined(found, _linked(found, "key", reach), "key")
    count = lambda i: F.size(F.filter("__strong", lambda x: x["k"] == i)).cast("long")
    return out.select(
        F.col("key").alias(key),
        *[count(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(_written(F.col("__strong")), 256).alias("base_sha256"),
        _written(F.col("__all")).alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """Sorted spans (s, e) as an array of those that do not overlap. A span begins a new one where it begins at or behind
    the largest end before it; running maxima come from blocks, so the work grows with the power 1.5 of their number."""

    def by_ends(v: Column) -> Column:
        ends, n, size = v["ends"], F.size(v["ends"]), v["size"]
        tops = F.transform(F.sequence(F.lit(0), ((n - 1) / size).cast("int")), lambda b: F.array_max(F.slice(ends, b * size + 1, size)))

        def by_tops(t: Column) -> Column:
            def upto(i: Column) -> Column:
                block = (i / size).cast("int")
                own = F.array_max(F.slice(ends, block * size + 1, i - block * size + 1))
                return F.when(block > 0, F.greatest(F.array_max(F.slice(t, F.lit(1), block)), own)).otherwise(own)

            return F.transform(ends, lambda e, i: upto(i))

        return let(tops, by_tops)

    size = F.greatest(F.sqrt(F.size(spans)).cast("int"), F.lit(1))
    running = let(F.struct(F.transform(spans, lambda x: x["e"]).alias("ends"), size.alias("size")), by_ends)

    def joined(m: Column) -> Column:
        opens = lambda i: (i == 0) | (F.get(spans, i)["s"] >= F.get(m, i - 1))
        some = lambda x: F.filter(x, lambda y: y.isNotNull())
        starts = some(F.transform(spans, lambda x, i: F.when(opens(i), x["s"])))
        stops = some(F.transform(m, lambda e, i: F.when((i == F.size(m) - 1) | opens(i + 1), e)))
        return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("s"), b.alias("e")))

    return let(running, joined)


#: Code points of the blocks that a text is laid out in before it is cut in many places.
_CUT = 4096


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """text with a mark in place of what its spans cover. A place in a text is found from its beginning, so the text is
    cut into blocks first, and the gaps between spans out of these."""
    blocks = F.transform(F.sequence(F.lit(0), (F.length(text) / _CUT).cast("int")), lambda b: F.substring(text, b * _CUT + 1, F.lit(_CUT)))

    def gap(v: Column, s: Column, e: Column) -> Column:
        first, last = (s / _CUT).cast("int"), (e / _CUT).cast("int")

        def part(b: Column) -> Column:
            low = F.when(b == first, s - b * _CUT).otherwise(F.lit(0))
            return F.substring(F.get(v["blocks"], b), low + 1, F.when(b == last, e - b * _CUT).otherwise(F.lit(_CUT)) - low)

        return F.when(s >= e, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, last), part), ""))

    def cut(v: Column) -> Column:
        m = v["spans"]
        gaps = F.transform(
            F.sequence(F.lit(0), F.size(m)),
            lambda i: gap(v, F.coalesce(F.get(m, i - 1)["e"], F.lit(0)), F.coalesce(F.get(m, i)["s"], F.length(text))),
        )
        return F.array_join(gaps, mark)

    return let(F.struct(blocks.alias("blocks"), _merged(spans).alias("spans")), cut)


def redact_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH, mark: str = "[SECRET]") -> DataFrame:
    """docs with mark in place of every reported span of text; overlapping spans become one mark. All rows and columns
    stay, whatever they are called; null texts stay null. The rows with weak candidates are found first; texts are not
    shuffled unless very many documents hold linked parts."""
    columns, shown = docs.columns, text
    docs = docs.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    key, text = "key", "text"
    found = _with_spans(docs.select(key, text), [key], text).select(key, "__k", "__strong", "__weak")
    found = Staged(found.filter(F.size("__weak") > 0), "weak").df
    out = _joined(_with_spans(docs, [key], text), _linked(found, key, reach), key)
    safe = F.when(F.size("__all") == 0, F.col(text)).otherwise(_marked(F.col(text), F.col("__all"), mark))
    return out.select(*[safe.alias(c) if c.lower() == shown.lower() else F.col("row")[c].alias(c) for c in columns])


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL for op10: matches and the pieces between them give the positions."""
    kinds = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "opaque": OPAQUE, "endpoint": ENDPOINT}
    scans = []
    for i, (kind, pattern) in enumerate(kinds.items()):
        p = _quoted(pattern)
        keep = {"assign": "length(g) >= 8", "opaque": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"}.get(kind, "true")
        group = 1 if kind == "assign" else 0
        scans.append(f"""
  SELECT r, {i} AS k, '{kind}' AS kind, '{ROLES[kind]}' AS role, e - length(m) AS s, e FROM (
    SELECT r, m, g, sum(length(pre) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(mm) AS m, unnest(gg) AS g, unnest(pp[:len(mm)]) AS pre, unnest(range(len(mm))) AS i FROM (
        SELECT r, regexp_extract_all(t, {p}, 0) AS mm, regexp_extract_all(t, {p}, {group}) AS gg, string_split_regex(t, {p}) AS pp FROM d)
    )) WHERE {keep}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({' UNION ALL '.join(scans)}),
strong AS (SELECT * FROM x WHERE k < 3),
weak AS (SELECT * FROM x WHERE k > 2 AND NOT EXISTS (SELECT 1 FROM strong b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM parts p WHERE p.r = w.r AND p.s < w.e + {REACH}
  AND p.e > w.s - {REACH} AND (p.role = 'S') <> (w.role = 'S'))),
b AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS base FROM strong GROUP BY r),
a AS (SELECT r, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS spans
  FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""
