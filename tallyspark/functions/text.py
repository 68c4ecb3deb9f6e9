"""Column functions over names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.expr import let


def _filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def cleaned(text: Column) -> Column:
    """Trimmed, without one pair of single quotes around it; a null is empty."""
    return let(F.trim(_filled(text)), lambda t: F.when(t.rlike("^'.*'$") & (F.length(t) >= 2), F.substring(t, 2, F.length(t) - 2)).otherwise(t))


def preferred_name(index: Column, *columns: Column) -> Column:
    """The first column's name that is not empty after cleaning, else gene_ and the index."""
    return F.coalesce(*[F.nullif(cleaned(c), F.lit("")) for c in columns], F.concat(F.lit("gene_"), index.cast("string")))


def label_parts(label: Column, mark: str = "_") -> Column:
    """Struct of batch (up to the first mark) and perturbation (all behind it); null where either is empty or there is
    no mark."""
    at = F.instr(label, mark)
    batch, rest = F.substring(label, F.lit(1), at - 1), F.substring(label, at + 1, F.length(label))
    return F.when((at > 1) & (F.length(rest) > 0), F.struct(batch.alias("batch"), rest.alias("perturbation")))


def condition(label: Column, controls: list[str], apart: str = "[_+ ]+") -> Column:
    """A label's genes in order, joined by +; one gene goes with ctrl, none is ctrl. Words of controls count as none."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(_filled(label), apart), lambda x: (x != "") & ~F.lower(x).isin([c.lower() for c in controls]))))
    return let(words, lambda g: F.when(F.size(g) == 0, F.lit("ctrl")).when(F.size(g) == 1, F.concat(F.lit("ctrl+"), F.get(g, F.lit(0)))).otherwise(F.array_join(g, "+")))


def guide_targets(identity: Column, replacements: dict[str, str], controls: list[str], negative: str) -> Column:
    """Struct of num_targets, target_1, target_2, guide_target and target of a guide identity: what stands before two
    underscores, split at single ones, names replaced. A label of controls is "control"; of two targets of which one is
    a negative control (its name begins with `negative`) the other counts."""
    raw = F.split(_filled(identity), "__")[0]
    named = F.create_map(*[F.lit(x) for pair in replacements.items() for x in pair]) if replacements else None
    swap = lambda x: F.coalesce(F.element_at(named, x), x) if named is not None else x

    def out(parts: Column) -> Column:
        one, two = swap(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))), swap(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        many = F.when((F.size(parts) == 1) & (F.get(parts, F.lit(0)) == ""), F.lit(0)).otherwise(F.size(parts))
        label = F.when(many == 0, F.lit("")).when(many == 1, one).otherwise(F.concat(one, F.lit("_"), two))
        no_1, no_2 = F.startswith(one, F.lit(negative)), F.startswith(two, F.lit(negative))
        target = (
            F.when(label.isin(controls), F.lit("control")).when((one == "") & (two == ""), F.lit(""))
            .when(no_1 & ~no_2, two).when(no_2 & ~no_1, one).otherwise(label)
        )
        return F.struct(many.alias("num_targets"), one.alias("target_1"), two.alias("target_2"), label.alias("guide_target"), target.alias("target"))

    return let(F.split(raw, "_"), out)


def suffix_number(name: Column, mark: str = "-") -> Column:
    """The whole number behind the last mark of a name, null if there is none."""
    return F.nullif(F.regexp_extract(name, rf"\Q{mark}\E0*(\d+)$", 1), F.lit("")).try_cast("long")


def cell_parts(name: Column, pattern: str = r"^(young|old)_(LT_HSC|ST_HSC|MPP)_(\d+)$") -> Column:
    """Struct of age, kind and number of a cell's name; null where the name does not match as a whole."""
    get = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(name.rlike(pattern), F.struct(get(1).alias("age"), get(2).alias("kind"), get(3).cast("long").alias("number")))


def display_source(scope: Column, checkpoint: Column | None = None) -> Column:
    """How a prior's source is shown: its scope (global or label:x), after the checkpoint's name where that is given."""
    return scope if checkpoint is None else F.concat(checkpoint, F.lit("/"), scope)


def truth(text: Column) -> Column:
    """A truth value from true, 1, t or yes and their contraries in any case; null for all else."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1", "t", "yes"), F.lit(True)).when(t.isin("false", "0", "f", "no"), F.lit(False))


def json_genes(text: Column) -> Column:
    """Struct of gene_names and scores of a gene list in JSON; null where it does not parse."""
    return F.from_json(text, "gene_names array<string>, scores array<double>")
