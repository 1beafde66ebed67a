"""Writers: Parquet tables, JSON lines, a Markdown report, and the CSR export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.sources.csr import export_csr  # noqa: F401


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as Parquet, edges laid out by source."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{folder}/edges")


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").parquet(path)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """One JSON object a line."""
    ledger.write.mode("overwrite").json(path)


def write_document(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, most: int = 10_000) -> str:
    """A table as Markdown, with every row; raises ValueError where there are more than ``most``."""
    head = rows.limit(most + 1).collect()
    if len(head) > most:
        raise ValueError(f"more than {most} rows; a report has {most} at most")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in head], ""])
