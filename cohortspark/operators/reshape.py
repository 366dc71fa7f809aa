"""Gene by sample matrices, nested hierarchies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortspark.session import written

# Names of the gene columns in matrix files and of the columns they become.
GENE_COLUMN = "Hugo_Symbol"
GENE_ID_COLUMN = "Entrez_Gene_Id"
GENE = "gene_symbol"
SAMPLE = "sample_id"


def matrix_long(
    matrix: DataFrame, row_order: str | None = None, drop_missing_gene: bool = True, value_type: str = "string"
) -> DataFrame:
    """(sample_id, gene_symbol, value) of a gene by sample matrix.

    The first row of a repeated gene stays. Its order comes from ``row_order`` or, right after a
    file scan, from the order of the rows in the file. Rows without a gene go, except for
    methylation tables, where they count as one gene.
    """
    gene = GENE_COLUMN if GENE_COLUMN in matrix.columns else GENE
    samples = [c for c in matrix.columns if c not in (gene, GENE_ID_COLUMN, row_order)]
    order = F.col(row_order) if row_order else F.monotonically_increasing_id()
    rows = matrix.select(
        F.col(gene).alias(GENE), order.alias("_order"), *[F.col(f"`{s}`").cast(value_type).alias(s) for s in samples]
    )
    if drop_missing_gene:
        rows = rows.filter(F.col(GENE).isNotNull())
    cells = rows.unpivot([GENE, "_order"], samples, SAMPLE, "value")
    return cells.groupBy(SAMPLE, GENE).agg(F.min_by("value", "_order").alias("value"))


def matrix_wide(long: DataFrame, genes: Sequence[str]) -> DataFrame:
    """One row per sample with a column per named gene.

    Only named genes become columns, so neither the plan nor the rows grow with the genome.
    """
    if not genes:
        raise ValueError("name the genes to spread")
    wanted = long.filter(F.col(GENE).isin(list(genes)))
    return wanted.groupBy(SAMPLE).pivot(GENE, list(genes)).agg(F.first("value"))


def flatten_hierarchy(documents: DataFrame, column: str = "value") -> DataFrame:
    """(code, name, tissue) of all nodes of nested JSON trees that have all three.

    A node is ``{"code", "name", "tissue", "children": {...}}``. Each pass parses one level of all
    trees at once; the children are stored as JSON text for the next pass, so no level is parsed
    again for the levels below it.
    """
    schema = "code string, name string, tissue string, children map<string,string>"
    level = documents.select(F.col(column).alias("_json"))
    found = None
    while True:  # texts get shorter with every level, so this ends
        nodes = level.select(F.from_json("_json", schema).alias("node"))
        complete = nodes.select("node.code", "node.name", "node.tissue")
        for field in ("code", "name", "tissue"):
            complete = complete.filter(F.col(field) != "")
        found = complete if found is None else found.unionByName(complete)
        children = nodes.select(F.explode(F.map_values("node.children")).alias("_json"))
        level = written(children, "hierarchy-level")
        if level.isEmpty():
            return found


def flatten_edges(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reachable from the roots with their depth, from a (code, parent) table; a node once per way to it.

    Ancestors at a distance of 1, 2, 4, ... are joined to themselves, so the number of steps is the logarithm of the
    depth: nodes less than 2^k deep are known, those at most twice as deep follow from them and the ancestors at a distance
    of 2^k. A way of more steps than there are nodes goes round in a cycle, which is an error. Steps are stored.
    """
    above = written(nodes.select("code", F.col("parent").alias("above")).where("parent IS NOT NULL"), "walk-edges")
    known = roots.select("code").distinct().withColumn("depth", F.lit(0))
    most, reach = above.count(), 1
    while True:
        step = known.withColumnRenamed("code", "above").join(above, "above").select("code", (F.col("depth") + reach).alias("depth"))
        step = written(step, "walk-step")
        if step.isEmpty():
            return known
        if reach > most:
            raise ValueError("the hierarchy has a cycle")
        known = written(known.unionByName(step), "walk-known")
        further = above.select(F.col("code").alias("above"), F.col("above").alias("_far"))
        above = written(above.join(further, "above").select("code", F.col("_far").alias("above")), "walk-above")
        reach *= 2
