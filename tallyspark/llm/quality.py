"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted; lines that more
documents hold than allowed count as removed, and a document that keeps too little is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import GAP, Staged, let, small, table, without, word_array


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules.

    max_documents: distinct documents of one host that may share a line, of any length. min_words, min_share: what has
    to be left of a document in words and as a share. distinct_texts: documents of one host with equal texts count as
    one, for use before copies are settled, when text that is copied often has to stay once.
    """

    max_documents: int = 20
    min_words: int = 10
    min_share: float = 0.3
    distinct_texts: bool = False


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column) -> Column:
    """Words covered by windows of five whose hash occurs twice or more, from the hashes of all windows."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        last = F.size(p) - 1
        twice = F.transform(
            p,
            lambda x, j: F.when(
                ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(p, j + 1)["h"] == x["h"])), x["i"]
            ),
        )
        return F.array_sort(F.filter(twice, lambda x: x.isNotNull()))

    def length(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.coalesce(F.least(F.lit(5), F.get(at, j + 1) - x), F.lit(5)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    many = let(pairs, lambda p: let(repeated(p), length))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(many)


def text_stats(text: Column) -> Column:
    """Struct of STATS for a text; all zero for a null."""
    text = F.coalesce(text, F.lit(""))

    def stats(w: Column) -> Column:
        n = F.size(w)
        hashed = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(
            hashed, lambda h: F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(h, i, F.lit(5))))
        )
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(without(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(without(text, "#*$%&|<>"))).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            F.when(n < 5, F.lit(0).cast("long")).otherwise(let(windows, _covered)).alias("n_repeat_words"),
        )

    return let(word_array(text), stats)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def _scanned(text: Column) -> Column:
    """All lines, normalised, as structs of hash and words."""

    def line(x: Column) -> Column:
        return let(
            F.filter(F.split(F.lower(x), GAP), lambda w: w != F.lit("")),
            lambda w: F.struct(F.xxhash64(F.array_join(w, " ")).alias("h"), F.size(w).alias("words")),
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def _lines(text: Column) -> Column:
    """Normalised lines with words, as structs of hash and words."""
    return F.filter(_scanned(text), lambda x: x["words"] > 0)


def line_quality(
    docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """docs with the columns of STATS, base_failed, removed_words and kept.

    kept is false for a document that fails the base rules, or that has fewer than min_words words or less than
    min_share of its words left without the lines that more than max_documents distinct documents of its host hold.
    Documents are told apart by key and text: rows that repeat both count once (as rows without a key do that repeat a
    text). A null text has no words and is not kept; null hosts form one host; documents of one host with equal texts
    get equal verdicts. Input columns that bear an output's name are replaced, all other columns stay whatever they are
    called. An empty table gives an empty result.
    """
    out = (*STATS, "base_failed", "removed_words", "kept")
    mine = [c for c in docs.columns if c.lower() not in out]
    row = F.struct(*[F.col(c) for c in mine]).alias("row") if mine else F.struct(F.lit(0)).alias("row")
    lines = docs.select(*_ids(key, text, host), _lines(F.col(text)).alias("lines")).filter(F.size("lines") > 0)
    keyed = docs.select(row, *_ids(key, text, host), text_stats(F.col(text)).alias("stats"))
    return _with_verdict(keyed, _removed(lines, rules), rules).select(*[F.col("row")[c].alias(c) for c in mine], *out)


def _ids(key: str, text: str, host: str) -> list[Column]:
    """The host, two hashes of host and text, and one of the document."""
    t, h = F.coalesce(F.col(text), F.lit("")), F.col(host)
    document = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), t)).otherwise(F.xxhash64(F.lit("no key"), t))
    return [h.alias("host"), F.xxhash64(h, t).alias("k1"), F.xxhash64(t, h, F.length(t)).alias("k2"), document.alias("d")]


def _removed(lines: DataFrame, rules: LineRules) -> DataFrame:
    """Words that each text (k1, k2) loses. lines: host, k1, k2, d and lines of every row.

    A text's lines are exploded once for all its copies, each then counting as many documents as hold the text.
    """
    texts = lines.dropDuplicates(["k1", "k2"]).select("host", "k1", "k2", "lines")
    if rules.distinct_texts:
        texts = texts.withColumn("documents", F.lit(1).cast("long"))
    else:
        copies = lines.groupBy(F.col("k1").alias("c1"), F.col("k2").alias("c2")).agg(F.countDistinct("d").alias("many"))
        copies = Staged(copies.filter("many > 1"), "copies").df
        same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
        texts = texts.join(small(copies, copies.count(), 200_000), same, "left").withColumn("documents", F.coalesce("many", F.lit(1)))
    each = (
        texts.select("host", "k1", "k2", "documents", F.explode("lines").alias("x"))
        .groupBy("host", "k1", "k2", F.col("x.h").alias("h"))
        .agg(F.sum("x.words").alias("words"), F.first("documents").alias("documents"))
    )
    each = Staged(each, "lines").df
    often = each.groupBy("host", "h").agg(F.sum("documents").alias("n")).filter(F.col("n") > rules.max_documents)
    often = Staged(often.select(F.col("host").alias("host_"), F.col("h").alias("h_")), "often").df
    hit = each.join(
        small(often, often.count()), F.col("host").eqNullSafe(F.col("host_")) & (F.col("h") == F.col("h_")), "left_semi"
    )
    gone = hit.groupBy(F.col("k1").alias("g1"), F.col("k2").alias("g2")).agg(F.sum("words").alias("removed"))
    return Staged(gone, "removed").df


def _same_text() -> Column:
    return (F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2"))


def _with_verdict(keyed: DataFrame, removed: DataFrame, rules: LineRules) -> DataFrame:
    """keyed, which has k1, k2 and stats, with the outputs."""
    s = F.col("stats")
    left = s["n_words"] - F.coalesce(F.col("removed"), F.lit(0))
    failed = base_failed(s)
    ok = (left >= rules.min_words) & (left >= rules.min_share * s["n_words"])
    return keyed.join(small(removed, removed.count()), _same_text(), "left").select(
        "*",
        *[s[c].alias(c) for c in STATS],
        failed.alias("base_failed"),
        F.coalesce(F.col("removed"), F.lit(0)).cast("long").alias("removed_words"),
        (~failed & ok).alias("kept"),
    )


def line_verdicts(
    docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """line_quality() without the texts: key and the outputs, with every text read and scanned once."""
    once = docs.select(
        F.col(key).alias("key"), *_ids(key, text, host), text_stats(F.col(text)).alias("stats"), _lines(F.col(text)).alias("lines")
    )
    once = Staged(once, "quality").df
    removed = _removed(once.filter(F.size("lines") > 0).select("host", "k1", "k2", "d", "lines"), rules)
    out = _with_verdict(once.select("key", "k1", "k2", "stats"), removed, rules)
    return out.select(F.col("key").alias(key), *STATS, "base_failed", "removed_words", "kept")


def pass_quality(
    docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id", text: str = "text", host: str = "source"
) -> DataFrame:
    """The rows of docs that line_quality() keeps, with docs' columns only, whatever they are called.

    Texts are scanned once; only the verdicts on distinct texts are joined with them. The texts that the base rules or
    the depletion reject are listed by their hashes, and texts are not shuffled unless very many of them are rejected.
    """
    each = docs.select(*_ids(key, text, host), base_failed(text_stats(F.col(text))).alias("failed"), _lines(F.col(text)).alias("lines"))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    lines = Staged(each.withColumn("n", total), "scanned").df
    sizes = lines.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max("failed").alias("failed"))
    removed = _removed(lines.filter(F.size("lines") > 0).select("host", "k1", "k2", "d", "lines"), rules)
    left = F.col("n") - F.coalesce("removed", F.lit(0))
    depleted = (left < rules.min_words) | (left < rules.min_share * F.col("n"))
    gone = sizes.join(small(removed, removed.count()), _same_text(), "left").filter(F.col("failed") | depleted)
    gone = Staged(gone.select(F.col("k1").alias("g1"), F.col("k2").alias("g2")), "rejected").df
    _, k1, k2, _ = _ids(key, text, host)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), k1, k2)
    return keyed.join(small(gone, gone.count(), 200_000), _same_text(), "left_anti").select("row.*")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents."""
    return line_verdicts(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), g AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), c AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g), (SELECT unnest(range(0, 5)) AS o)
  WHERE n > 1 GROUP BY r
), l AS (
  SELECT r, p, line, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d)
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE len(lw) > 0 GROUP BY r
), n AS (
  SELECT l.r, d.source, d.doc_id, d.t, array_to_string(lw, ' ') AS h, len(lw) AS words
  FROM l JOIN d USING (r) WHERE len(lw) > 0
), often AS (
  SELECT source, h FROM n GROUP BY source, h HAVING count(DISTINCT (doc_id, hash(t))) > 20
), gone AS (
  SELECT n.r, sum(words) AS removed FROM n JOIN often o ON n.h = o.h AND n.source IS NOT DISTINCT FROM o.source GROUP BY n.r
), s AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(removed, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, removed_words,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND n_words - removed_words >= 10 AND n_words - removed_words >= 0.3::DOUBLE * n_words AS kept
FROM s
"""
