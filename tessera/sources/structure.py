"""Atom rows of mmCIF text: ``atoms`` for files of any length, ``parse`` for a text at hand."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint

ATOMS = "file string, position long, group string, model int, chain string, subchain string, entity string, seq_id int, atom string, residue string, x double, y double, z double, b_iso double"

# Item names of the atom_site loop and their places where a file has no header.
FIELDS = {
    "group": ("group_PDB", 0),
    "atom": ("label_atom_id", 3),
    "residue": ("label_comp_id", None),
    "subchain": ("label_asym_id", None),
    "chain": ("auth_asym_id", None),
    "entity": ("label_entity_id", None),
    "seq_id": ("label_seq_id", None),
    "x": ("Cartn_x", 10),
    "y": ("Cartn_y", 11),
    "z": ("Cartn_z", 12),
    "b_iso": ("B_iso_or_equiv", None),
    "model": ("pdbx_PDB_model_num", None),
}

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHOLE = r"^[+-]?[0-9]+$"
ATOM = "startswith(value, 'ATOM') or startswith(value, 'HETATM')"
BLANK = " \t\r\n\f\v"
#: Rows of a table of files or splits that are sent to every task; a larger one is shuffled.
MOST_SENT = 200_000


def parse(text: str) -> list[dict]:
    """Atom rows in file order; rows too short for the coordinates or without finite numbers there are left out.

    The header is that of the last loop before the first atom; the first line with # after it ends the rows.
    """
    columns: list[str] = []
    out, reading = [], False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("loop_"):
            if not reading:
                columns = []
        elif line.startswith("_atom_site."):
            if not reading:
                columns.append(line.split(".", 1)[1].split()[0])
        elif line.startswith(("ATOM", "HETATM")):
            reading = True
            place = {k: columns.index(n) if n in columns else d for k, (n, d) in FIELDS.items()}
            token = line.split()
            if max(place[k] for k in ("group", "atom", "x", "y", "z")) >= len(token):
                continue
            get = lambda k: token[place[k]].strip('"') if place[k] is not None and place[k] < len(token) and token[place[k]] not in ".?" else None  # noqa: B023, E731
            row = {k: get(k) for k in FIELDS}
            for k in ("x", "y", "z", "b_iso"):
                row[k] = float(row[k]) if row[k] and re.search(NUMBER, row[k]) else None
            for k in ("seq_id", "model"):
                row[k] = int(row[k]) if row[k] and re.search(WHOLE, row[k]) and -(2**31) <= int(row[k]) < 2**31 else None
            if any(row[k] is None or math.isinf(row[k]) for k in "xyz"):
                continue
            row["subchain"] = row["subchain"] or row["chain"]
            row["entity"] = row["entity"] or "?"
            out.append(row | {"position": len(out)})
        elif line.startswith("#") and reading:
            break
    return out


def _sent(d: DataFrame) -> DataFrame:
    d = checkpoint(d)
    return F.broadcast(d) if d.count() <= MOST_SENT else d


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, at, value): trimmed lines; ``at`` orders those of a file by their split and their place in it.

    A split is read by one task in order, and the same files are split alike in every pass, so ``at`` holds between passes.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.trim("value", F.lit(BLANK)).alias("value"), F.monotonically_increasing_id().alias("n"))
    return text.select("path", "file", F.struct("block", "n").alias("at"), "value")


def _headers(lines: DataFrame) -> DataFrame:
    """(path, end, places): one row a file with atoms. ``end`` is the line that ends them, ``places`` the names of its loop."""
    starts = _sent(lines.where(ATOM).groupBy("path").agg(F.min("at").alias("first")))
    marks = lines.where(F.col("value").startswith("loop_") | F.col("value").startswith("_atom_site.") | F.col("value").startswith("#")).join(starts, "path")
    before, is_ = F.col("at") < F.col("first"), F.col("value").startswith
    name = F.regexp_extract("value", r"^_atom_site\.(\S*)", 1)
    found = marks.groupBy("path").agg(
        F.min(F.when(is_("#") & ~before, F.col("at"))).alias("end"),
        F.max(F.when(is_("loop_") & before, F.col("at"))).alias("loop"),
        # the names of a header are few
        F.array_sort(F.collect_list(F.when(is_("_atom_site.") & before, F.struct("at", name.alias("name"))))).alias("items"),
    )
    own = F.filter("items", lambda i: F.col("loop").isNull() | (i["at"] > F.col("loop")))
    names = F.transform(own, lambda i: i["name"])
    place = lambda n, d: F.when(F.array_contains(names, n), F.array_position(names, n).cast("int") - 1).otherwise(F.lit(d)).alias(f"_{n}")
    return found.select("path", "end", F.lit(True).alias("known"), *[place(n, d) for n, d in FIELDS.values()])


def atoms(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """All atom rows below ``path``, as ``parse`` has them: schema ``ATOMS``.

    Files are read by splits, line by line, however long they are. Only marks (the header's names and the line that ends
    the atoms) are gathered by file. ``position`` counts within a split and adds the rows of the splits before; with
    ``numbered=False`` it is left out, no row moves, and filters on atoms and chains act where lines are read.
    Files without atoms give no rows; of files with one name in two folders the rows are told apart by nothing but order.
    """
    lines = _lines(spark, path)
    heads = _sent(_headers(lines))
    rows = lines.where(ATOM).join(heads, "path", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    token = F.split("value", r"\s+")
    place = {k: F.when(F.col("known"), F.col(f"_{n}")).otherwise(F.lit(d)) if d is not None else F.col(f"_{n}") for k, (n, d) in FIELDS.items()}

    def get(k):
        t = F.get(token, place[k].cast("int"))
        return F.when(~t.isin("", ".", "?", ".?"), F.trim(t, F.lit('"')))

    value = {k: get(k) for k in FIELDS}
    number = lambda c: F.when(c.rlike(NUMBER), c.try_cast("double"))
    whole = lambda c: F.when(c.rlike(WHOLE), c.try_cast("int"))
    full = lambda c: F.when(c != "", c)
    value |= {k: number(value[k]) for k in ("x", "y", "z", "b_iso")} | {k: whole(value[k]) for k in ("seq_id", "model")}
    value |= {"subchain": F.coalesce(full(value["subchain"]), value["chain"]), "entity": F.coalesce(full(value["entity"]), F.lit("?"))}
    enough = F.greatest(*[place[k] for k in ("group", "atom", "x", "y", "z")]) < F.size(token)
    names = [f.split()[0] for f in ATOMS.split(", ")]
    out = rows.where(enough).select("path", "at", "file", *[value[k].alias(k) for k in FIELDS])
    out = out.where(" and ".join(f"{k} is not null and abs({k}) < double('infinity')" for k in "xyz"))
    if not numbered:
        return out.select(*[n for n in names if n != "position"])
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = out.groupBy("path", F.col("at.block").alias("block")).agg(F.count(F.lit(1)).alias("n")).select("path", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    # a split is bounded, so no task numbers a whole file
    here = F.row_number().over(Window.partitionBy("path", "block").orderBy("at.n")) - 1
    placed = out.withColumn("block", F.col("at.block")).withColumn("here", here).join(_sent(splits), ["path", "block"])
    return placed.withColumn("position", F.col("before") + F.col("here")).select(*names)
