"""Ranking, restricting, paging and the algebra of ordered gene lists (columns list_no, pos, gene_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.expr import full_match

# Built-in nuisance rules, as exact names, prefixes and full-match patterns.
RULES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "human": (
        ("MALAT1", "NEAT1", "XIST", "FTL", "FTH1"),
        ("MT-", "RPL", "RPS", "MRPL", "MRPS"),
        (r"HB[A-Z]\d?", r"HSP(?:90|A|B|D|E|H)\w*", r"DNAJ[A-C]\d+", r"FOS[BL]?", r"JUN[BD]?", r"EGR[1-4]", r"IER[1-5][A-Z]?", r"DUSP[1-9]\d?"),
    ),
    "mouse": (
        ("Malat1", "Neat1", "Xist", "Ftl1", "Fth1"),
        ("mt-", "Rpl", "Rps", "Mrpl", "Mrps"),
        (r"Hb[a-z].*", r"Hsp(?:90|a|b|d|e|h)\w*", r"Dnaj[a-c]\d+", r"Fos[bl]?", r"Jun[bd]?", r"Egr[1-4]", r"Ier[1-5][a-z]?", r"Dusp[1-9]\d?"),
    ),
    "ecoli": (
        ("tsf", "infA", "infB", "infC", "ssrA"),
        ("rpl", "rps", "rpm"),
        (r"rr[slf][A-H]", r"tuf[AB]?", r"fus[A-Z]?", r"gro[ELS]+", r"dna[KJ]\w*", r"clp[ABPX]\w*", r"csp[A-I]"),
    ),
    "bsub": (
        ("tsf", "infA", "infB", "infC", "ssrA"),
        ("rpl", "rps", "rpm"),
        (r"rrn[A-Z]", r"tuf[A-Z]?", r"fus[A-Z]?", r"groE[SL]\w*", r"dna[KJ]\w*", r"clp[CEPQXY]\w*", r"csp[A-Z]", r"sig[A-Z]", r"hbs\w*"),
    ),
}


def ranked(scores: DataFrame, descending: bool = True) -> DataFrame:
    """gene_id, score, rank from 1; missing scores count as 0, ties go by name."""
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = scores.select("gene_id", score.alias("score"))
    order = Window.orderBy(F.desc("score") if descending else F.asc("score"), "gene_id")
    return rows.withColumn("rank", F.row_number().over(order))


def restricted(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scores in the order of a list: pos, gene_id, score."""
    return wanted.select("pos", "gene_id").join(scores, "gene_id").select("pos", "gene_id", "score")


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.join(have, "gene_id", "left_anti")


def subset_strict(wanted: DataFrame, have: DataFrame, strict: bool = True) -> DataFrame:
    """The wanted genes that there are, in their order; raises on any other if strict."""
    if strict and (lost := [r["gene_id"] for r in missing(wanted, have).limit(5).collect()]):
        raise ValueError(f"genes not in the dataset: {lost}")
    return wanted.join(have.select("gene_id"), "gene_id", "left_semi").select("pos", "gene_id")


def usable(wanted: DataFrame, *tables: DataFrame) -> DataFrame:
    """The wanted genes (pos, gene_id) that every one of the tables has (a dataset's genes, a checkpoint's), in their order."""
    for t in tables:
        wanted = wanted.join(t.select("gene_id").distinct(), "gene_id", "left_semi")
    return wanted.select("pos", "gene_id")


def intersect(lists: DataFrame, order: str = "first") -> DataFrame:
    """pos, gene_id of the genes in all lists, in the order of the first list or of names."""
    n = lists.agg(F.countDistinct("list_no").alias("n"), F.min("list_no").alias("first"))
    rows = lists.crossJoin(F.broadcast(n)).groupBy("gene_id", "n").agg(
        F.countDistinct("list_no").alias("k"), F.min(F.when(F.col("list_no") == F.col("first"), F.col("pos"))).alias("at")
    )
    by = Window.orderBy("at" if order == "first" else "gene_id")
    return rows.filter("k = n").select((F.row_number().over(by) - 1).alias("pos"), "gene_id")


def union(lists: DataFrame) -> DataFrame:
    """pos, gene_id in the order of first sight."""
    rows = lists.groupBy("gene_id").agg(F.min(F.struct("list_no", "pos")).alias("at"))
    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).alias("pos"), "gene_id")


def universe(lists: DataFrame, mode: str) -> DataFrame:
    """Genes of the lists: exact (raises if the lists' sets differ), intersection or union."""
    if mode == "union":
        return union(lists)
    both = intersect(lists)
    if mode == "exact" and both.count() != union(lists).count():
        raise ValueError("the lists do not hold the same genes")
    return both


def rank_sum(lists: DataFrame) -> DataFrame:
    """pos, gene_id, rank_sum, mean_rank: ranks from 0 summed over lists; a list's length where it lacks a gene."""
    sizes = lists.groupBy("list_no").agg(F.count(F.lit(1)).alias("size"))
    grid = lists.select("gene_id").distinct().crossJoin(F.broadcast(sizes))
    rows = grid.join(lists, ["list_no", "gene_id"], "left").groupBy("gene_id").agg(
        F.sum(F.coalesce("pos", "size")).alias("rank_sum"), F.avg(F.coalesce("pos", "size")).alias("mean_rank")
    )
    by = Window.orderBy("rank_sum", "mean_rank", "gene_id")
    return rows.select((F.row_number().over(by) - 1).alias("pos"), "gene_id", "rank_sum", "mean_rank")


def sliced(names: DataFrame, start: int = 0, end: int | None = None, top: int | None = None, only: DataFrame | None = None, but: DataFrame | None = None) -> DataFrame:
    """A list's part from start to end (or top places) after intersecting with `only` and leaving out `but`."""
    if end is not None and end < start:
        raise ValueError("end lies before start")
    if only is not None:
        names = names.join(only.select("gene_id"), "gene_id", "left_semi")
    if but is not None:
        names = names.join(but.select("gene_id"), "gene_id", "left_anti")
    rows = names.select("gene_id", (F.row_number().over(Window.orderBy("pos")) - 1).alias("pos")).filter(F.col("pos") >= start)
    if top is not None:
        end = min(end, start + top) if end is not None else start + top
    return rows if end is None else rows.filter(F.col("pos") < end)


def nuisance(gene: Column, exact: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> Column:
    """Whether a gene is one of exact, begins with a prefix, or matches a pattern as a whole."""
    out = gene.isin(list(exact)) if exact else F.lit(False)
    for p in prefixes:
        out = out | gene.startswith(p)
    for p in patterns:
        out = out | full_match(gene, p)
    return out


def filtered(names: DataFrame, *rules: tuple) -> DataFrame:
    """Genes that no rule names; raises if none is left."""
    bad = F.lit(False)
    for r in rules:
        bad = bad | nuisance(F.col("gene_id"), *r)
    out = names.filter(~bad)
    if not out.limit(1).count():
        raise ValueError("the rules removed all genes")
    return out


def search(totals: DataFrame, text: str, limit: int) -> DataFrame:
    """Genes whose name contains a text in any case, largest totals first."""
    hit = totals.filter(F.contains(F.lower("gene_id"), F.lit(text.strip().lower())))
    return hit.orderBy(F.desc("total"), "gene_id").limit(limit)


def resolve(genes: DataFrame, asked: DataFrame) -> DataFrame:
    """query, gene_id, gene_idx: an exact name first, then an index in digits, then a name in any case."""
    ways = [F.col("gene_id"), F.col("gene_idx").cast("string"), F.lower("gene_id")]
    sides = [F.col("query"), F.col("query"), F.lower("query")]
    found = None
    for i, (name, side) in enumerate(zip(ways, sides, strict=True)):
        hit = asked.withColumn("k", side).join(genes.select("gene_id", "gene_idx", name.alias("k")), "k").select("query", F.lit(i).alias("way"), "gene_idx", "gene_id")
        found = hit if found is None else found.union(hit)
    best = found.groupBy("query").agg(F.min(F.struct("way", "gene_idx", "gene_id")).alias("x"))
    return best.select("query", "x.gene_id", "x.gene_idx")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of ordered rows with their place; a page beyond the last is the last."""
    total = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).alias("pages"))
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(total))
    at = F.least(F.greatest(F.lit(number), F.lit(1)), F.col("pages"))
    return placed.filter((F.col("place") > (at - 1) * size) & (F.col("place") <= at * size)).drop("pages")


def numbered(names: DataFrame, name: str, by: str, mark: str = "_") -> DataFrame:
    """Names made unique: the second of equal names gets mark and 1, and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(by)) - 1
    return names.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(name, F.lit(mark), n)))


def shards(names: DataFrame, world: int, size: int) -> DataFrame:
    """pos, gene_id, shard (place modulo world) and batch (place within the shard by size)."""
    at = F.row_number().over(Window.orderBy("pos")) - 1
    rows = names.select("gene_id", at.alias("pos"))
    return rows.select("pos", "gene_id", (F.col("pos") % world).alias("shard"), F.floor(F.floor(F.col("pos") / world) / size).alias("batch"))
