"""The control store: what people decide, in SQLite, with snapshots as DataFrames.

It holds labels and overrides made by hand, so its size is what people can
type; all that is computed lives in Parquet.
"""

from __future__ import annotations

import sqlite3
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "labels": "label_id INTEGER PRIMARY KEY, record_a TEXT NOT NULL, record_b TEXT NOT NULL, same INTEGER NOT NULL, reviewer TEXT, provenance TEXT, held_out INTEGER NOT NULL DEFAULT 0, active INTEGER NOT NULL DEFAULT 1, superseded_by INTEGER, decision_id TEXT",
    "overrides": "override_id INTEGER PRIMARY KEY, record_id TEXT NOT NULL, name TEXT NOT NULL, value TEXT, active INTEGER NOT NULL DEFAULT 1",
}
SCHEMAS = {
    "labels": "label_id long, record_a string, record_b string, same boolean, reviewer string, provenance string, held_out boolean, active boolean, superseded_by long, decision_id string",
    "overrides": "override_id long, record_id string, name string, value string, active boolean",
}


class ControlStore:
    def __init__(self, path: str):
        self.path = path
        with self._open() as c:
            for name, columns in TABLES.items():
                c.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
            c.execute("CREATE UNIQUE INDEX IF NOT EXISTS one_active ON labels (record_a, record_b) WHERE active")

    @contextmanager
    def _open(self):
        c = sqlite3.connect(self.path)
        try:
            with c:
                yield c
        finally:
            c.close()

    def label(self, a: str, b: str, same: bool, reviewer: str | None = None, provenance: str = "reviewer", decision_id: str | None = None) -> int:
        """A new label of the ordered pair; an earlier one is switched off, linked to it, and hands on its held-out mark."""
        a, b = sorted((str(a).strip(), str(b).strip()))
        if not a or a == b:
            raise ValueError("a label needs two different records")
        with self._open() as c:
            old = c.execute("SELECT label_id, held_out FROM labels WHERE record_a = ? AND record_b = ? AND active", (a, b)).fetchone()
            if old:
                c.execute("UPDATE labels SET active = 0 WHERE label_id = ?", (old[0],))
            new = c.execute("INSERT INTO labels (record_a, record_b, same, reviewer, provenance, held_out, decision_id) VALUES (?, ?, ?, ?, ?, ?, ?)", (a, b, int(same), reviewer, provenance, old[1] if old else 0, decision_id)).lastrowid
            if old:
                c.execute("UPDATE labels SET superseded_by = ? WHERE label_id = ?", (new, old[0]))
            return new

    def withdraw(self, label_id: int) -> None:
        """Switch a label off; one that belongs to a decision is only withdrawn with it."""
        with self._open() as c:
            row = c.execute("SELECT decision_id FROM labels WHERE label_id = ? AND active", (label_id,)).fetchone()
            if row is None:
                raise ValueError("no such label")
            if row[0] is not None:
                raise ValueError("the label belongs to a decision")
            c.execute("UPDATE labels SET active = 0 WHERE label_id = ?", (label_id,))

    def withdraw_decision(self, decision_id: str) -> int:
        with self._open() as c:
            return c.execute("UPDATE labels SET active = 0 WHERE decision_id = ? AND active", (decision_id,)).rowcount

    def override(self, record_id: str, name: str, value: str | None) -> int:
        with self._open() as c:
            c.execute("UPDATE overrides SET active = 0 WHERE record_id = ? AND name = ?", (record_id, name))
            return c.execute("INSERT INTO overrides (record_id, name, value) VALUES (?, ?, ?)", (record_id, name, value)).lastrowid

    def snapshot(self, spark: SparkSession, table: str) -> DataFrame:
        flags = {"same", "held_out", "active"}
        names = [p.split()[0] for p in SCHEMAS[table].split(", ")]
        with self._open() as c:
            got = c.execute(f"SELECT {', '.join(names)} FROM {table} ORDER BY 1").fetchall()
        return spark.createDataFrame([tuple(bool(v) if n in flags else v for n, v in zip(names, r, strict=True)) for r in got], SCHEMAS[table])
